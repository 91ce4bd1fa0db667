"""Scores of predictions: per output, over all outputs, over runs; ranking of candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spread of flat targets; share of sigma under which a target is near nought.
FLAT, TINY = 1e-12, 1e-3


def per_output(df: DataFrame, scales: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """rmse, mae, r2, nmae, nrmse, rel_error of (output, pred, target) rows, by group and output.

    ``scales``: output, sigma (population, of the training targets; null if unknown), and the groups. R2 is 0 for
    flat targets; the scaled errors are null without a positive sigma, the relative one also if any target is near 0.
    """
    keys = [*(groups or []), "output"]
    rows = df.join(scales, keys, "left")
    error = F.col("pred") - F.col("target")
    near = F.abs("target") <= F.lit(TINY) * F.col("sigma")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        F.sum(error * error).alias("sse"), F.var_pop("target").alias("spread"), F.first("sigma").alias("sigma"),
        F.max(near.cast("int")).alias("near"), F.avg(F.when(F.col("target") != 0, F.abs(error) / F.abs("target"))).alias("rel"),
    )
    known = F.col("sigma") > 0
    return sums.select(
        *keys, "rmse", "mae",
        F.when(F.col("spread") * F.col("n") <= FLAT, F.lit(0.0)).otherwise(F.lit(1.0) - F.col("sse") / (F.col("spread") * F.col("n"))).alias("r2"),
        F.when(known, F.col("mae") / F.col("sigma")).alias("nmae"),
        F.when(known, F.col("rmse") / F.col("sigma")).alias("nrmse"),
        F.when(F.col("sigma").isNotNull() & (F.col("near") == 0), F.col("rel")).alias("rel_error"),
    )


def all_defined(c: str) -> Column:
    """Mean, or null unless every part is defined."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def overall(df: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row: rmse, mae, r2 over the flattened outputs with one mean, scaled errors as means over outputs if all are defined."""
    error = F.col("pred") - F.col("target")
    flat = df.agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.sum(error * error).alias("sse"), (F.var_pop("target") * F.count(F.lit(1))).alias("sst"))
    means = outputs.agg(all_defined("nmae").alias("nmae"), all_defined("nrmse").alias("nrmse"), all_defined("rel_error").alias("rel_error"))
    r2 = F.when(F.col("sst") <= FLAT, F.lit(0.0)).otherwise(F.lit(1.0) - F.col("sse") / F.col("sst"))
    return flat.join(F.broadcast(means)).select("rmse", "mae", r2.alias("r2"), "nmae", "nrmse", "rel_error")  # one row each


def target_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """output, sigma: population spread of each target of the training rows, without a floor; null if there are none or one isn't finite."""
    each = [F.stddev_pop(c) for c in columns]
    finite = [F.when(~F.isnan(s) & (F.abs(s) < float("inf")), s) for s in each]
    return df.agg(F.array(*[F.struct(F.lit(c).alias("output"), s.alias("sigma")) for c, s in zip(columns, finite)]).alias("s")).select(F.inline("s"))


def scales(spark: SparkSession, sigmas: dict[str, float | None]) -> DataFrame:
    """output, sigma as ``per_output`` takes them; None where a spread isn't known."""
    for name, s in sigmas.items():
        if s is not None and not (math.isfinite(s) and s >= 0):
            raise ValueError(f"{name}: spread {s}")
    return spark.createDataFrame([(n, None if s is None else float(s)) for n, s in sigmas.items()], "output string, sigma double")


def report(outputs: DataFrame, whole: DataFrame) -> DataFrame:
    """One row: outputs, rmse and mae (of a single output only: several have no common unit), r2, the scaled errors, worst output and its r2."""
    worst = outputs.agg(F.count(F.lit(1)).alias("outputs"), F.min(F.struct("r2", "output")).alias("w"))
    one = F.col("outputs") == 1
    return worst.join(F.broadcast(whole)).select(  # one row each
        "outputs", F.when(one, F.col("rmse")).alias("rmse"), F.when(one, F.col("mae")).alias("mae"), whole["r2"], "nmae", "nrmse", "rel_error",
        F.col("w.output").alias("worst_output"), F.col("w.r2").alias("worst_r2"),
    )


def over_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """r2_mean and the three spreads of runs (keys, seed, repeat, fold, r2): folds in repeats in seeds, population deviations.

    A spread over folds or repeats is the mean of what it is within each repeat or seed.
    """
    folds = runs.groupBy(*keys, "seed", "repeat").agg(F.avg("r2").alias("r2"), F.stddev_pop("r2").alias("sd_fold"), F.count(F.lit(1)).alias("folds"))
    repeats = folds.groupBy(*keys, "seed").agg(F.avg("r2").alias("r2"), F.avg("sd_fold").alias("sd_fold"), F.stddev_pop("r2").alias("sd_repeat"), F.count(F.lit(1)).alias("repeats"), F.min("folds").alias("few"), F.max("folds").alias("many"))
    return repeats.groupBy(*keys).agg(
        F.avg("r2").alias("r2_mean"), F.avg("sd_fold").alias("r2_std_folds"), F.avg("sd_repeat").alias("r2_std_repeats"), F.stddev_pop("r2").alias("r2_std_seeds"),
        F.count(F.lit(1)).alias("seeds"), F.max("repeats").alias("repeats"), F.max("many").alias("folds"),
        ((F.min("few") == F.max("many")) & (F.min("repeats") == F.max("repeats"))).alias("is_complete"),
    )


def run_problems(runs: DataFrame, keys: list[str], seeds: list[int], k: int = 1, repeats: int = 1) -> DataFrame:
    """keys, seed, repeat, problem: runs that don't make a whole plan of ``k`` folds and ``repeats`` repeats for each of ``seeds``.

    Every candidate needs every seed; every seed each repeat from 0; every repeat each fold from 0 once. A plan of one fold is a
    holdout, whose runs may have a null fold and repeat.
    """
    if not seeds or len(set(seeds)) < len(seeds):
        raise ValueError("seeds must be there, each once")
    if k < 1 or repeats < 1 or repeats > 1 and k < 2:
        raise ValueError(f"{repeats} repeats of {k} folds are no plan")
    own = runs.select(*keys, F.col("seed").cast("long").alias("seed"), F.coalesce(F.col("repeat"), F.lit(0)).cast("long").alias("repeat"), F.coalesce(F.col("fold"), F.lit(0)).cast("long").alias("fold"))
    listed = F.col("seed").isin(*seeds)
    unlisted = own.where(~listed).groupBy(*keys, "seed", "repeat").agg(F.lit("seed is not listed").alias("problem"))
    plan = own.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])).alias("seed")).select("*", F.explode(F.array(*[F.lit(r).cast("long") for r in range(repeats)])).alias("repeat"))
    held = own.where(listed).groupBy(*keys, "seed", "repeat").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("fold").alias("_folds"), F.min("fold").alias("_low"), F.max("fold").alias("_high")
    )
    both = plan.join(held, [*keys, "seed", "repeat"], "full")
    problem = (
        F.when(F.col("repeat") >= repeats, "repeat is not of the plan").when(F.col("_n").isNull(), "no runs")
        .when(F.col("_n") > F.col("_folds"), "a fold is there twice").when((F.col("_folds") != k) | (F.col("_low") != 0) | (F.col("_high") != k - 1), "folds are missing or not of the plan")
    )
    return unlisted.unionByName(both.select(*keys, "seed", "repeat", problem.alias("problem")).where("problem is not null"))


def aggregate_runs(runs: DataFrame, keys: list[str], seeds: list[int], k: int = 1, repeats: int = 1) -> DataFrame:
    """``over_runs`` of a whole plan; the first problem is an error."""
    first = run_problems(runs, keys, seeds, k, repeats).orderBy(*keys, "seed", "repeat").first()
    if first is not None:
        raise ValueError(f"{', '.join(str(first[c]) for c in keys)}, seed {first['seed']}, repeat {first['repeat']}: {first['problem']}")
    return over_runs(runs, keys)


def best_first(score: str, tie: str) -> list[Column]:
    """Order: finite scores first, descending, ties by ``tie``."""
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    return [finite.desc(), F.when(finite, F.col(score)).desc_nulls_last(), F.col(tie).asc()]
