"""Schemas of tables: roles, kinds and levels of columns; drafts made from a profile; what speaks against them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import MOST_LEVELS, category_levels, dependency_notes, profile_columns, profile_messages

INPUT, OUTPUT, IGNORE = "input", "output", "ignore"


@dataclass(frozen=True)
class Field:
    """A column: ``levels`` are those of a category, None for a number; ``unit`` is a label only."""

    name: str
    role: str = INPUT
    levels: tuple[str, ...] | None = None
    unit: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "name", self.name.strip())
        object.__setattr__(self, "unit", (self.unit or "").strip() or None)
        if not self.name:
            raise ValueError("a column needs a name")
        if self.role not in (INPUT, OUTPUT, IGNORE):
            raise ValueError(f"{self.name}: role {self.role} is none of {INPUT}, {OUTPUT}, {IGNORE}")
        if self.levels is not None:
            levels = tuple(v.strip() for v in self.levels)
            object.__setattr__(self, "levels", levels)
            if not levels or not all(levels):
                raise ValueError(f"{self.name}: a category needs levels, and none of them empty")
            if len(set(levels)) < len(levels):
                raise ValueError(f"{self.name}: a level is there twice")

    @property
    def display_name(self) -> str:
        return f"{self.name} [{self.unit}]" if self.unit else self.name

    @property
    def spec(self) -> str:
        return "C" if self.levels is None else f"K:{len(self.levels)}"


@dataclass(frozen=True)
class Schema:
    """Fields in the table's order; inputs and outputs keep that order among themselves."""

    fields: tuple[Field, ...]

    def __post_init__(self):
        names = [f.name for f in self.fields]
        for n in names:
            if names.count(n) > 1:
                raise ValueError(f"column {n} is there twice")
        if not self.inputs or not self.outputs:
            raise ValueError("a schema needs an input and an output")
        for f in self.outputs:
            if f.levels is not None:
                raise ValueError(f"{f.name}: an output is a number")

    @property
    def inputs(self) -> list[Field]:
        return [f for f in self.fields if f.role == INPUT]

    @property
    def outputs(self) -> list[Field]:
        return [f for f in self.fields if f.role == OUTPUT]

    def places(self, role: str) -> list[int]:
        """Places of a role's columns in the table."""
        return [i for i, f in enumerate(self.fields) if f.role == role]

    def check_dims(self, n_inputs: int, n_outputs: int) -> None:
        if (len(self.inputs), len(self.outputs)) != (n_inputs, n_outputs):
            raise ValueError(f"the schema has {len(self.inputs)} inputs and {len(self.outputs)} outputs, the data {n_inputs} and {n_outputs}")

    def signature(self) -> list[tuple[str, object]]:
        """What a model depends on, as (what, value) pairs in a fixed order: how many columns of each role, then names, kinds and levels; units don't count."""
        out: list[tuple[str, object]] = [(f"number of {role}s", len(self.places(role))) for role in (INPUT, OUTPUT)]
        for role, held in ((INPUT, self.inputs), (OUTPUT, self.outputs)):
            for i, f in enumerate(held, 1):
                out += [(f"{role} {i}, name", f.name), (f"{f.name}, kind", "number" if f.levels is None else "category"), (f"{f.name}, levels", f.levels)]
        return out

    def incompatible(self, data: Schema) -> str | None:
        """Why a model of this schema can't take data of the other one: the first pair of their signatures that differs; None if all are equal."""
        unlike = ((what, m, d) for (what, m), (_, d) in zip(self.signature(), data.signature()) if m != d)
        return next((f"{what}: {m} for the model, {d} in the data" for what, m, d in unlike), None)


def numbered(n_inputs: int, n_outputs: int, cards: dict[int, int] | None = None) -> Schema:
    """A schema without names: x0, x1.. and y0, y1..; the levels of a category are its codes."""
    cards = cards or {}
    levels = {i: tuple(map(str, range(n))) for i, n in cards.items()}
    return Schema((*(Field(f"x{i}", INPUT, levels.get(i)) for i in range(n_inputs)), *(Field(f"y{i}", OUTPUT) for i in range(n_outputs))))


def parse_cards(text: str, n_inputs: int) -> dict[int, int]:
    """``place:number of levels`` pairs parted by commas, as {place: number}."""
    out: dict[int, int] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        place, colon, n = part.partition(":")
        if not colon or not place.strip().isdigit() or not n.strip().isdigit():
            raise ValueError(f"{part}: not place:levels")
        at, card = int(place), int(n)
        if at >= n_inputs:
            raise ValueError(f"{part}: there are {n_inputs} inputs")
        if card == 0:
            raise ValueError(f"{part}: a category has a level at least")
        if at in out:
            raise ValueError(f"{part}: place {at} is there twice")
        out[at] = card
    return out


def code_warning(kind: str, schema: Schema) -> str | None:
    """Models that take codes as quantities see distances between levels that aren't there."""
    names = [f.name for f in schema.inputs if f.levels is not None and len(f.levels) > 2]
    return f"{kind} takes the codes of {', '.join(names)} as quantities" if names and kind in ("mlp", "kan", "spline", "dense") else None


# ---- drafts


@dataclass(frozen=True)
class DraftField:
    name: str
    role: str
    is_category: bool
    unit: str | None = None


#: What speaks against a column of a draft, and when it does.
RULES = {
    "column {place} needs a name": lambda c: c["blank"],
    "column {name} is there twice": lambda c: c["again"],
    "{name}: an output is a number": lambda c: c["output"] and c["category"],
    "{name}: not all values are numbers": lambda c: c["used"] and not (c["category"] or c["numeric"]),
    "{name}: more than {most} values": lambda c: c["used"] and c["category"] and c["values"] is None,
    "{name}: a category without values": lambda c: c["used"] and c["category"] and c["values"] == 0,
}


@dataclass(frozen=True)
class Draft:
    """A schema that may still be wrong. Every change gives a new draft; ``finish`` says what is wrong or gives the schema.

    ``levels``: the column's values in order, None beyond 256; ``numeric``: whether all of its values are numbers.
    """

    fields: tuple[DraftField, ...]
    levels: tuple[tuple[str, ...] | None, ...]
    numeric: tuple[bool, ...]

    def changed(self, i: int, **values) -> Draft:
        """With another name, role, unit or kind (``is_category``) of column i."""
        if not 0 <= i < len(self.fields):
            raise ValueError(f"there is no column {i}")
        if values.get("is_category") and self.levels[i] is None:
            raise ValueError(f"{self.fields[i].name}: more than {MOST_LEVELS} values")
        fields = list(self.fields)
        fields[i] = replace(fields[i], **values)
        return replace(self, fields=tuple(fields))

    def output_from(self, n_inputs: int) -> Draft:
        """The first ``n_inputs`` columns are inputs, all others outputs."""
        if not 0 < n_inputs < len(self.fields):
            raise ValueError(f"{n_inputs} inputs of {len(self.fields)} columns")
        return replace(self, fields=tuple(replace(f, role=INPUT if i < n_inputs else OUTPUT) for i, f in enumerate(self.fields)))

    def facts(self) -> list[dict]:
        """A row for each column, as the rules see it."""
        names = [f.name.strip() for f in self.fields]
        return [
            {"place": i + 1, "name": n, "blank": not n, "again": bool(n) and n in names[:i], "output": f.role == OUTPUT, "used": f.role != IGNORE, "category": f.is_category, "numeric": ok, "values": None if held is None else len(held)}
            for i, (f, n, ok, held) in enumerate(zip(self.fields, names, self.numeric, self.levels))
        ]

    def issues(self) -> list[str]:
        """Every rule that a column or the whole draft breaks."""
        roles = {f.role for f in self.fields}
        return [f"an {role} is needed" for role in (INPUT, OUTPUT) if role not in roles] + [why.format(**c, most=MOST_LEVELS) for why, broken in RULES.items() for c in self.facts() if broken(c)]

    def finish(self) -> Schema:
        """The schema of a draft without issues."""
        if found := self.issues():
            raise ValueError("; ".join(found))
        of = dict(zip((f.name for f in self.fields), self.levels))
        return Schema(tuple(Field(f.name, f.role, (of[f.name] or None) if f.is_category else None, f.unit) for f in self.fields))


def draft(df: DataFrame, columns: Sequence[str]) -> Draft:
    """The last column is the output, the others are inputs, and what isn't a number is a category."""
    rows = {r["column"]: r for r in profile_columns(df, list(columns)).collect()}  # a row for each column
    levels = []
    for c in columns:
        few = rows[c]["distinct_values"] is not None
        levels.append(tuple(r["level"] for r in category_levels(df, c).orderBy("code").collect()) if few else None)
    fields = tuple(DraftField(c, OUTPUT if i == len(columns) - 1 else INPUT, not rows[c]["is_numeric"]) for i, c in enumerate(columns))
    return Draft(fields, tuple(levels), tuple(bool(rows[c]["is_numeric"]) for c in columns))


def draft_fields(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, role, kind of the draft, as a relation."""
    last = columns[-1]
    return profile_columns(df, list(columns)).select(
        "column", F.when(F.col("column") == last, OUTPUT).otherwise(INPUT).alias("role"), F.when(F.col("is_numeric"), "number").otherwise("category").alias("kind")
    )


def messages(profile: DataFrame, n_ragged: DataFrame, duplicates: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """severity, column, message of a table: ragged rows block, missing and other cells warn, repeats, constants and ties between inputs are noted.

    ``n_ragged``: one row with n_ragged; ``duplicates``: one row with duplicate_rows; ``dependencies``: what ``profile.affine_dependencies`` gives.
    """
    none = F.lit(None).cast("string").alias("column")
    ragged = n_ragged.where("n_ragged > 0").select(F.lit("Blocking").alias("severity"), none, F.concat(F.col("n_ragged").cast("string"), F.lit(" rows of another width")).alias("message"))
    repeated = duplicates.where("duplicate_rows > 0").select(F.lit("Note").alias("severity"), none, F.concat(F.col("duplicate_rows").cast("string"), F.lit(" repeated rows")).alias("message"))
    out = ragged.unionByName(profile_messages(profile)).unionByName(repeated)
    return out if dependencies is None else out.unionByName(dependency_notes(dependencies))
