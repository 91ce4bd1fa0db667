"""Symbolic edges: the primitive, scale and shift that fit a curve best, and formulas as text and as Column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import PRIMITIVES, affine_edge, in_domain, primitive

#: Ranges of the inner scale and shift, settings of each, rounds after the first (three in all).
B_RANGE, C_RANGE, STEPS, ZOOMS = (-3.0, 3.0), (-4.0, 4.0), 13, 2
#: Squared deviations under which a curve is constant, and under which a setting says nothing.
CONSTANT, BLIND = 1e-10, 1e-9


def grid(spark: SparkSession, b: tuple[float, float] = B_RANGE, c: tuple[float, float] = C_RANGE) -> DataFrame:
    """name, turn, b, c of the first round: 13 by 13 settings of each primitive."""
    lines = []
    for low, high in (b, c):
        lines.append([low + (high - low) * i / (STEPS - 1) for i in range(STEPS)])
    settings = F.array(*[F.struct(F.lit(x).alias("b"), F.lit(y).alias("c")) for x in lines[0] for y in lines[1]])
    names = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(n).alias("name")) for i, n in enumerate(PRIMITIVES)])
    return spark.range(1).select(F.inline(names)).select("turn", "name", F.explode(settings).alias("s")).select("turn", "name", "s.*")


def _value(u: Column) -> Column:
    """The primitive of column ``name`` at u; null outside of its domain."""
    out = F.lit(None).cast("double")
    for n in PRIMITIVES:
        out = F.when((F.col("name") == n) & in_domain(n, u), primitive(n, u)).otherwise(out)
    return out


def fit_round(samples: DataFrame, settings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, turn, name, b, c, a, d, r2: closed-form a and d of every setting for each edge's samples (keys, x, y).

    A setting under which a sample leaves the primitive's domain, or all samples have one value, is left out. Settings are
    1521 rows for each edge at most and come from literals; sums are partial, so samples never meet.
    """
    on = [k for k in keys if k in settings.columns]
    pairs = samples.join(settings, on) if on else samples.join(F.broadcast(settings))
    pairs = pairs.withColumn("f", _value(F.col("b") * F.col("x") + F.col("c")))
    n = F.count(F.lit(1))
    sums = pairs.groupBy(*keys, "turn", "name", "b", "c").agg(
        n.alias("n"), F.count("f").alias("inside"), F.avg("f").alias("mf"), F.avg("y").alias("my"),
        (F.var_pop("f") * n).alias("vf"), (F.var_pop("y") * n).alias("vy"), (F.covar_pop("f", "y") * n).alias("cv"),
    )
    able = sums.where((F.col("inside") == F.col("n")) & (F.col("vf") >= BLIND))
    a = F.col("cv") / F.col("vf")
    r2 = F.when(F.col("vy") > 1e-12, F.col("cv") * F.col("cv") / (F.col("vf") * F.col("vy"))).otherwise(F.lit(0.0))
    return able.select(*keys, "turn", "name", "b", "c", a.alias("a"), (F.col("my") - a * F.col("mf")).alias("d"), r2.alias("r2"))


def best_of(fits: DataFrame, keys: list[str]) -> DataFrame:
    """The best fit of each edge: highest r2 (to nine digits), then first primitive, b and c."""
    order = F.struct(-F.round("r2", 9), "turn", "b", "c", "name", "a", "d", "r2")
    return fits.groupBy(*keys).agg(F.min(order).alias("m")).select(*keys, "m.name", "m.a", "m.b", "m.c", "m.d", "m.r2")


def constants(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean, is_constant of each edge's samples."""
    return samples.groupBy(*keys).agg(F.avg("y").alias("mean"), (F.var_pop("y") * F.count(F.lit(1)) < CONSTANT).alias("is_constant"))


def fit_edges(samples: DataFrame, keys: list[str], zooms: int = ZOOMS) -> DataFrame:
    """Best edge of each key: a first round over the whole grid, then rounds around each primitive's best setting.

    An edge whose samples are constant, or that no primitive explains at all, is ``const``: d is the mean, r2 is 1 or 0.
    """
    spark = samples.sparkSession
    fits = fit_round(samples, grid(spark), keys)
    wide_b, wide_c = (B_RANGE[1] - B_RANGE[0]) / (STEPS - 1), (C_RANGE[1] - C_RANGE[0]) / (STEPS - 1)
    for _ in range(zooms):
        tops = fits.groupBy(*keys, "turn", "name").agg(F.min(F.struct(-F.round("r2", 9), "b", "c")).alias("m")).select(*keys, "turn", "name", "m.b", "m.c")
        offsets = F.array(*[F.struct(F.lit(wide_b * (2 * i / (STEPS - 1) - 1)).alias("x"), F.lit(wide_c * (2 * j / (STEPS - 1) - 1)).alias("y")) for i in range(STEPS) for j in range(STEPS)])
        near = tops.select(*keys, "turn", "name", (F.col("b")).alias("b0"), F.col("c").alias("c0"), F.explode(offsets).alias("o")).select(*keys, "turn", "name", (F.col("b0") + F.col("o.x")).alias("b"), (F.col("c0") + F.col("o.y")).alias("c"))
        fits = fit_round(samples, near, keys)
        wide_b, wide_c = 2 * wide_b / (STEPS - 1), 2 * wide_c / (STEPS - 1)
    best = best_of(fits.where("r2 > 0"), keys)
    flat = F.col("is_constant") | F.col("name").isNull()
    nought = F.lit(0.0)
    return constants(samples, keys).join(best, keys, "left").select(
        *keys, F.when(flat, "const").otherwise(F.col("name")).alias("name"), *[F.when(flat, nought).otherwise(F.col(c)).alias(c) for c in ("a", "b", "c")],
        F.when(flat, F.col("mean")).otherwise(F.col("d")).alias("d"), F.when(F.col("is_constant"), F.lit(1.0)).when(flat, nought).otherwise(F.col("r2")).alias("r2"),
    )


def primitive_quality(fits: DataFrame, keys: list[str], least: float = 0.99) -> DataFrame:
    """name, worst, mean, weak: how well each primitive does over all edges at its best setting, and how many edges it leaves below ``least``."""
    best = fits.groupBy(*keys, "name").agg(F.max("r2").alias("r2"))
    return best.groupBy("name").agg(F.min("r2").alias("worst"), F.avg("r2").alias("mean"), F.count_if(F.col("r2") < least).alias("weak"))


def edge_quality(best: DataFrame, least: float = 0.99) -> DataFrame:
    """worst, mean, weak: R2 over the edges of ``fit_edges`` and how many are below ``least``; without edges 1, 1 and 0."""
    one = F.lit(1.0)
    return best.agg(F.coalesce(F.min("r2"), one).alias("worst"), F.coalesce(F.avg("r2"), one).alias("mean"), F.count_if(F.col("r2") < least).alias("weak"))


@dataclass(frozen=True)
class Edge:
    input: str
    name: str
    a: float
    b: float
    c: float
    d: float


def quoted(name: str) -> str:
    """Names that could be taken for a number or for a hidden node are put in backticks."""
    plain = name.isidentifier() and not (name[:1] == "h" and name[1:2].isdigit())
    return name if plain else f"`{name}`"


def formula_text(edges: list[Edge], bias: float) -> str:
    """Linear offsets go into one constant."""
    constant, parts = bias, []
    for e in edges:
        if e.name == "x":
            constant += e.a * e.c + e.d
            parts.append(f"{e.a * e.b:.6g}*{quoted(e.input)}")
        else:
            constant += e.d
            parts.append(f"{e.a:.6g}*{e.name}({e.b:.6g}*{quoted(e.input)} + {e.c:.6g})")
    return " + ".join([*parts, f"{constant:.6g}"])


def formula_column(edges: list[Edge], bias: float) -> Column:
    return sum((affine_edge(e.name, F.col(e.input), e.a, e.b, e.c, e.d) for e in edges), F.lit(bias))


def denormalized(edge: Edge, mean: float, std: float) -> Edge:
    """The same edge on raw input: f(b (x - mean) / std + c)."""
    return Edge(edge.input, edge.name, edge.a, edge.b / std, edge.c - edge.b * mean / std, edge.d)
