"""Normalizers, their application as literal expressions, and range checks against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-8


def fit(df: DataFrame, columns: list[str], groups: list[str] | None = None) -> DataFrame:
    """feature, mean, std (population, floored at 1e-8), low, high of each column (in each group)."""
    groups = groups or []
    wide = df.groupBy(*groups).agg(*[
        F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.greatest(F.stddev_pop(c), F.lit(FLOOR)).alias("std"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(f"s{i}")
        for i, c in enumerate(columns)
    ])
    return wide.select(*groups, F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))


def fit_without(df: DataFrame, columns: list[str], fold: str) -> DataFrame:
    """``fit`` of the rows that are in every other fold, for each fold: one pass over the rows, the rest on a row for each fold and column."""
    each = df.groupBy(fold).agg(*[
        F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(f"s{i}")
        for i, c in enumerate(columns)
    ]).select(F.col(fold).alias("_own"), F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))
    whole = each.groupBy("feature").agg(F.collect_list(F.struct("_own", "n", "m", "v", "low", "high")).alias("_all"))
    others = whole.select("feature", "_all", F.explode("_all").alias("_one")).select("feature", F.col("_one._own").alias(fold), F.filter("_all", lambda p: p["_own"] != F.col("_one._own")).alias("_p"))

    def total(value):
        return F.aggregate("_p", F.lit(0.0), lambda s, p: s + value(p))

    others = others.where(F.size("_p") > 0).withColumn("_n", total(lambda p: p["n"].cast("double")))
    others = others.withColumn("mean", total(lambda p: p["n"] * p["m"]) / F.col("_n"))
    square = total(lambda p: p["n"] * (p["v"] + (p["m"] - F.col("mean")) * (p["m"] - F.col("mean"))))
    return others.select(
        fold, "feature", "mean", F.greatest(F.sqrt(square / F.col("_n")), F.lit(FLOOR)).alias("std"),
        F.array_min(F.transform("_p", lambda p: p["low"])).alias("low"), F.array_max(F.transform("_p", lambda p: p["high"])).alias("high"),
    )


def literals(stats: DataFrame) -> dict[str, dict[str, float]]:
    """The statistics of one fit on the driver: a row for each column."""
    return {r["feature"]: r.asDict() for r in stats.collect()}


def transform(column: str, stats: dict[str, dict[str, float]]) -> Column:
    s = stats[column]
    return (F.col(column) - F.lit(s["mean"])) / F.lit(s["std"])


def inverse(value: Column, column: str, stats: dict[str, dict[str, float]]) -> Column:
    s = stats[column]
    return value * F.lit(s["std"]) + F.lit(s["mean"])


def warnings(columns: list[str], stats: dict[str, dict[str, float]]) -> Column:
    """array<struct<feature, value, low, high>> of the values outside of the fitted range."""
    each = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.lit(stats[c]["low"]).alias("low"), F.lit(stats[c]["high"]).alias("high")) for c in columns]
    return F.filter(F.array(*each), lambda w: (w["value"] < w["low"]) | (w["value"] > w["high"]))


def out_of_range(df: DataFrame, row_id: str, columns: list[str], stats: dict[str, dict[str, float]]) -> DataFrame:
    """row_id, feature, value, low, high: a row for each value outside."""
    return df.select(F.col(row_id).alias("row_id"), F.explode(warnings(columns, stats)).alias("w")).select("row_id", "w.*")


def range_report(df: DataFrame, columns: list[str], stats: dict[str, dict[str, float]]) -> DataFrame:
    """total, rows_out and outside_<column> counts, in one pass."""
    outside = {c: (F.col(c) < stats[c]["low"]) | (F.col(c) > stats[c]["high"]) for c in columns}
    some = None
    for o in outside.values():
        some = o if some is None else some | o
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(some).alias("rows_out"), *[F.count_if(o).alias(f"outside_{c}") for c, o in outside.items()])
