"""One way into any numeric table: a typed file as it is, any other table by its header; and tables to typed files."""

from __future__ import annotations

import os
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import INFINITE, parse_code, parse_number
from ..operators.schema import INPUT, OUTPUT, Field, Schema
from .text_table import MAGIC, Table, categorical_by_name, numbered_lines, output_start, read_table, trimmed, uncommented

#: The keywords of a typed file and what its quoted words escape.
KEYWORDS = (*MAGIC, "inputs", "outputs", "specs", "names", "units", "levels", "rows", "data")
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_WORD = re.compile(r'\s*(?:#.*|"((?:[^"\\]|\\.)*)"|([^\s"#]+))')


def quote(word: str) -> str:
    return '"' + "".join(ESCAPES.get(c, c) for c in word) + '"'


def words_of(line: str) -> list[str]:
    """The words of a header line; quoted ones may hold blanks, # and escapes; an unquoted # ends the line."""
    out, at = [], 0
    back = {v[1]: k for k, v in ESCAPES.items()}
    while at < len(line) and line[at:].strip():
        m = _WORD.match(line, at)
        if not m:
            raise ValueError(f"a quote is left open: {line}")
        if m[1] is None and m[2] is None:
            break
        if m[1] is not None:
            bad = [e for e in re.findall(r"\\(.)", m[1]) if e not in back]
            if bad:
                raise ValueError(f"unknown escape {bad[0]}: {line}")
            out.append(re.sub(r"\\(.)", lambda e: back[e[1]], m[1]))
        else:
            out.append(m[2])
        at = m.end()
    return out


# ---- typed files


def plain_number(value: Column) -> Column:
    """A 32-bit number as its shortest decimal text without an exponent: 2, 0.5, 10000000000."""
    text = value.cast("float").cast("string")
    # most numbers have no exponent and need no pattern
    plain = F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    short = F.regexp_replace(text, r"\.0(?=E|$)", "")
    sign, exponent = F.when(short.startswith("-"), "-").otherwise(""), F.regexp_extract(short, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_extract(short, r"^-?([0-9.]+)", 1), r"\.", "")
    large = F.concat(F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0")), F.when(F.length(digits) > exponent + 1, F.concat(F.lit("."), F.substring(digits, exponent + 2, F.lit(99)))).otherwise(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    return F.when(~text.contains("E"), plain).otherwise(F.concat(sign, F.when(exponent >= 0, large).otherwise(small)))


def header_lines(schema: Schema, n_rows: int) -> list[str]:
    """The head of a TRNUM2 file."""
    columns = [*schema.inputs, *schema.outputs]
    out = ["TRNUM2", f"inputs {len(schema.inputs)}", f"outputs {len(schema.outputs)}", "specs " + " ".join(f.spec for f in schema.inputs), "names " + " ".join(quote(f.name) for f in columns)]
    if any(f.unit for f in columns):
        out.append("units " + " ".join(quote(f.unit) if f.unit else "-" for f in columns))
    out += [f"levels {i} " + " ".join(map(quote, f.levels)) for i, f in enumerate(schema.inputs) if f.levels]
    return [*out, f"rows {n_rows}", "data"]


def bad_values(df: DataFrame, schema: Schema) -> Column:
    """Whether a row has a value that a typed file can't hold: not finite, or no code of its category."""
    bad = F.lit(False)
    for f in [*schema.inputs, *schema.outputs]:
        x = F.col(f"`{f.name}`").cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) >= INFINITE)
        if f.levels is not None:
            bad = bad | (F.abs(x - F.round(x)) >= 1e-4) | (F.round(x) < 0) | (F.round(x) >= len(f.levels))
    return bad


def write_typed(df: DataFrame, row_id: str, schema: Schema, path: str) -> int:
    """A folder of text parts in row order, TRNUM2 head first; returns the rows. ``df`` has a column for each input and output, categories as codes."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad_values(df, schema)).alias("bad")).first()
    if found["bad"]:
        raise ValueError(f"{found['bad']} rows hold a value that is not finite or no code of its category")
    columns = [*schema.inputs, *schema.outputs]
    values = [f"_v{i}" for i in range(len(columns))]
    body = df.select(F.lit(0).cast("long").alias("part"), F.col(row_id).cast("long").alias("row_id"), *[F.col(f"`{f.name}`").alias(v) for v, f in zip(values, columns)])
    head = df.sparkSession.createDataFrame([(-1, i, h) for i, h in enumerate(header_lines(schema, found["n"]))], "part long, row_id long, _head string")
    # rows are put in order as numbers, and become text once they lie there
    laid = head.unionByName(body, allowMissingColumns=True).repartitionByRange("part", "row_id").sortWithinPartitions("part", "row_id")
    laid.select(F.coalesce("_head", F.concat_ws(" ", *[plain_number(F.col(v)) for v in values])).alias("line")).write.text(path)
    return found["n"]


def read_typed(spark: SparkSession, path: str) -> tuple[DataFrame, Schema]:
    """(row_id and a column for each input and output, schema) of a TRNUM1 or TRNUM2 file or a folder of its parts.

    Lines that begin with a keyword are the head and go to the driver, as many as keywords and categories; all others are data: a stream of
    numbers in which a row may go over several lines and a line may hold several rows.
    """
    lines = numbered_lines(spark, path)
    cells = F.split(trimmed(uncommented(F.col("value"))), r"\s+", -1)
    first = F.split(trimmed(F.col("value")), r"[\s#]+", 2)
    kept = lines.where(trimmed(uncommented(F.col("value"))) != "").select("row_no", "value", F.get(first, F.lit(0)).alias("key"), cells.alias("cells"))
    is_head = F.col("key").isin(*KEYWORDS)
    head: dict[str, list[str]] = {}
    levels: dict[int, tuple[str, ...]] = {}
    rows = kept.where(is_head).orderBy("row_no").limit(len(KEYWORDS) + 100_000).collect()
    for r in rows:
        key, *rest = words_of(r["value"])
        if key == "levels":
            if int(rest[0]) in levels:
                raise ValueError(f"{path}: levels of {rest[0]} twice")
            levels[int(rest[0])] = tuple(rest[1:])
        elif key in head:
            raise ValueError(f"{path}: {key} twice")
        else:
            head[key] = rest
    if not rows or rows[0]["key"] not in MAGIC or rows[-1]["key"] != "data" or not {"inputs", "outputs", "specs", "rows"} <= set(head):
        raise ValueError(f"{path}: not a typed table")
    n_in, n_out = int(head["inputs"][0]), int(head["outputs"][0])
    if len(head["specs"]) != n_in or any(s != "C" and not re.fullmatch(r"K:[1-9][0-9]*", s) for s in head["specs"]):
        raise ValueError(f"{path}: specs do not match inputs")
    cards = {i: int(s[2:]) for i, s in enumerate(head["specs"]) if s != "C"}
    if any(i not in cards or len(v) != cards[i] for i, v in levels.items()):
        raise ValueError(f"{path}: levels do not match specs")
    names = head.get("names", [*(f"x{i}" for i in range(n_in)), *(f"y{i}" for i in range(n_out))])
    units = head.get("units", ["-"] * (n_in + n_out))
    if len(names) != n_in + n_out or len(units) != n_in + n_out:
        raise ValueError(f"{path}: names or units do not match inputs and outputs")
    schema = Schema(tuple(
        Field(n, INPUT if i < n_in else OUTPUT, levels.get(i, tuple(map(str, range(cards[i])))) if i in cards else None, None if u == "-" else u) for i, (n, u) in enumerate(zip(names, units))
    ))
    n, wide, after = int(head["rows"][0]), n_in + n_out, F.col("row_no") > rows[-1]["row_no"]
    data = kept.where(~is_head & after).select("row_no", "cells")

    def columns(values: DataFrame) -> DataFrame:
        return values.select("row_no", *[F.get("v", F.lit(i)).alias(f.name) for i, f in enumerate(schema.fields)])

    # one pass counts tokens and lines of another width, and judges the values as if each line were a row
    lined = kept.where(~is_head).select("row_no", "cells", F.transform("cells", parse_number).alias("v"))
    judged = lined.select("cells", after.alias("_after"), F.struct(*[F.get("v", F.lit(i)).alias(f.name) for i, f in enumerate(schema.fields)]).alias("_row"))
    judged = judged.select(F.size("cells").alias("_n"), "_after", "_row.*")
    found = judged.agg(
        F.coalesce(F.sum(F.when(F.col("_after"), F.col("_n"))), F.lit(0)).alias("tokens"), F.count_if(F.col("_after") & (F.col("_n") != wide)).alias("wrapped"),
        F.count_if(~F.col("_after")).alias("before"), F.count_if(F.col("_after") & bad_values(judged, schema)).alias("bad"),
    ).first()
    if found["tokens"] != n * wide or found["before"]:
        raise ValueError(f"{path}: {found['tokens']} values for {n} rows of {wide}")
    table = columns(_by_tokens(data, wide, rows[-1]["row_no"]) if found["wrapped"] else data.select("row_no", F.transform("cells", parse_number).alias("v")))
    bad = table.agg(F.count_if(bad_values(table, schema))).first()[0] if found["wrapped"] else found["bad"]
    if bad:
        raise ValueError(f"{path}: {bad} rows of wrong values")
    return table.select(F.col("row_no").alias("row_id"), *[f"`{f.name}`" for f in schema.fields]), schema


#: Lines that share a block when tokens are counted through a file.
LINES = 1 << 14


def _by_tokens(data: DataFrame, wide: int, head_row: int) -> DataFrame:
    """row_no, v: every ``wide`` tokens are a row, wherever lines and file splits end. Rows are numbered as if each had its line after the head.

    A token's place is its place in its line, plus the tokens of earlier lines of the block, plus those of earlier blocks (a row for each block).
    """
    lines = data.select("row_no", "cells", F.size("cells").alias("_n"), F.floor(F.col("row_no") / LINES).alias("_block"))
    blocks = lines.groupBy("_block").agg(F.sum("_n").alias("_in"))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_in").over(past(Window.partitionBy(F.lit(0)).orderBy("_block"))), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("_n").over(past(Window.partitionBy("_block").orderBy("row_no"))), F.lit(0))
    tokens = lines.withColumn("_within", within).join(blocks, "_block").select((F.col("_before") + F.col("_within")).alias("_start"), F.posexplode("cells").alias("_pos", "_cell"))
    placed = tokens.select((F.col("_start") + F.col("_pos")).alias("_at"), parse_number(F.col("_cell")).alias("_v"))
    row = F.floor(F.col("_at") / wide)
    cells = [F.max(F.when(F.col("_at") % wide == i, F.col("_v"))) for i in range(wide)]
    return placed.groupBy((row + head_row + 1).alias("row_no")).agg(F.array(*cells).alias("v"))


# ---- tables


def has_header(cells: list[str]) -> bool:
    """A first row is a header if any of its cells is no finite number."""
    def number(cell: str) -> bool:
        try:
            return re.fullmatch(r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?", cell.strip()) is not None and abs(float(cell)) < INFINITE
        except ValueError:
            return False

    return not all(map(number, cells))


def inferred_schema(table: Table) -> Schema:
    """Inputs before the first column named like an output; inputs named like a category are one if all their values are codes from nought."""
    if not table.header:
        raise ValueError(f"{table.source}: no header to tell inputs from outputs")
    at = output_start(table.header)
    if at is None:
        raise ValueError(f"{table.source}: no inputs before an output y, y0.. or out..")
    asked = [i for i in range(at) if categorical_by_name(table.header[i])]
    cards: dict[int, int] = {}
    if asked:
        x = {i: parse_number(F.get("cells", F.lit(i))) for i in asked}
        whole = {i: F.coalesce(F.min(F.coalesce((v >= -0.5) & (F.round(v) >= 0) & (F.abs(v - F.round(v)) < 1e-4), F.lit(False)).cast("int")), F.lit(0)) for i, v in x.items()}
        found = table.rows.agg(*[w.alias(f"w{i}") for i, w in whole.items()], *[F.max(F.round(v)).alias(f"m{i}") for i, v in x.items()]).first()
        cards = {i: int(found[f"m{i}"]) + 1 for i in asked if found[f"w{i}"] == 1}
    return spec_schema(table, at, len(table.header) - at, cards)


def spec_schema(table: Table, n_inputs: int, n_outputs: int, cards: dict[int, int] | None = None) -> Schema:
    """The first columns are inputs, the rest outputs, with the header's names; the levels of a category are its codes."""
    cards = cards or {}
    if n_inputs < 1 or n_outputs < 1:
        raise ValueError("inputs and outputs must be one at least")
    if table.n_columns != n_inputs + n_outputs:
        raise ValueError(f"{table.source}: {table.n_columns} columns for {n_inputs} inputs and {n_outputs} outputs")
    if any(i >= n_inputs or n < 1 for i, n in cards.items()):
        raise ValueError(f"categories {cards} of {n_inputs} inputs")
    names = table.header or [*(f"x{i}" for i in range(n_inputs)), *(f"y{i}" for i in range(n_outputs))]
    return Schema(tuple(Field(n, INPUT if i < n_inputs else OUTPUT, tuple(map(str, range(cards[i]))) if i in cards else None) for i, n in enumerate(names)))


def dataset(table: Table, schema: Schema, codes: tuple[str, ...] = ()) -> DataFrame:
    """row_id and a column for each input and output, categories as codes; raises with the row and column of the first cell without a value.

    Categories named in ``codes`` may also be written as codes; the others only by their levels.
    """
    if len(schema.fields) != table.n_columns:
        raise ValueError(f"{table.source}: {table.n_columns} columns, the schema has {len(schema.fields)}")
    used = [(i, f) for i, f in enumerate(schema.fields) if f.role in (INPUT, OUTPUT)]
    values = {f.name: parse_number(F.get("cells", F.lit(i))) if f.levels is None else parse_code(F.get("cells", F.lit(i)), list(f.levels), f.name in codes) for i, f in used}
    out = table.rows.select(F.col("row_no").alias("_row"), F.size("cells").alias("_width"), "cells", *[v.alias(n) for n, v in values.items()])
    bad = F.col("_width") != table.n_columns
    for n in values:
        bad = bad | F.col(f"`{n}`").isNull()
    first = out.where(bad).orderBy("_row").first()
    if first is not None:
        if first["_width"] != table.n_columns:
            raise ValueError(f"{table.source}, row {first['_row']}: {first['_width']} cells for {table.n_columns} columns")
        i, f = next((i, f) for i, f in used if first[f.name] is None)
        known = "" if f.levels is None else f" (levels {', '.join(f.levels)})"
        raise ValueError(f"{table.source}, row {first['_row']}, column {f.name}: no value for {first['cells'][i]!r}{known}")
    return out.select(F.col("_row").alias("row_id"), *[f"`{n}`" for n in values])


def is_typed(spark: SparkSession, path: str) -> bool:
    """By its name or by its first word."""
    if path.lower().rstrip("/").endswith(".tnum"):
        return True
    first = spark.read.text(path).select("value").where(trimmed(uncommented(F.col("value"))) != "").first()
    return first is not None and first["value"].strip().split()[0] in MAGIC


def read_numeric(spark: SparkSession, path: str, delimiter: str | None = None) -> tuple[DataFrame, Schema]:
    """(row_id, inputs and outputs; schema) of a typed file or of any table whose header tells inputs from outputs."""
    if is_typed(spark, path):
        return read_typed(spark, path)
    table = read_table(spark, path, has_header=False, delimiter=delimiter)
    head = table.rows.orderBy("row_no").first()
    if not has_header(head["cells"]):
        raise ValueError(f"{path}: no header to tell inputs from outputs")
    table = read_table(spark, path, True, delimiter)
    schema = inferred_schema(table)
    return dataset(table, schema, tuple(f.name for f in schema.inputs if f.levels is not None)), schema


def same_file(spark: SparkSession, one: str, other: str) -> bool:
    """Whether two paths name one file or folder: relative ones, ``..`` and links of a local file system are followed."""
    real = []
    for path in (one, other):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
        real.append(f"file:{os.path.realpath(whole.getPath())}" if whole.getScheme() == "file" else f"{whole.getScheme()}://{whole.getAuthority()}{posixpath.normpath(whole.getPath())}")
    return real[0] == real[1]


def table_to_typed(spark: SparkSession, path: str, out: str, n_inputs: int, n_outputs: int, cards: dict[int, int] | None = None, header: bool = True, delimiter: str | None = None) -> int:
    """Write a table as a typed file elsewhere; returns its rows."""
    if same_file(spark, path, out):
        raise ValueError(f"{path}: the table would be overwritten")
    table = read_table(spark, path, header, delimiter)
    schema = spec_schema(table, n_inputs, n_outputs, cards)
    return write_typed(dataset(table, schema, tuple(f.name for f in schema.inputs if f.levels is not None)), "row_id", schema, out)
