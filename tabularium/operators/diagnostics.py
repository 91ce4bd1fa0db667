"""Diagnostics of a fitted surrogate: residual structure, tails, nearest rows, local sensitivity, edge importance."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import with_previous, with_rank


def sign_changes(df: DataFrame, feature: str, row_id: str, residual: str) -> DataFrame:
    """feature, sign_change_rate: share of neighbours along the feature whose residuals have opposite signs."""
    rows = with_previous(df.select(F.col(feature).alias("_x"), F.col(row_id).alias("_id"), F.col(residual).alias("_e")), "_x", "_id", "_e")
    n = F.count(F.lit(1))
    return rows.agg(
        F.lit(feature).alias("feature"),
        F.when(n > 1, F.count_if(F.col("_e") * F.col("previous") < 0) / (n - 1).cast("double")).otherwise(F.lit(0.0)).alias("sign_change_rate"),
    )


def tail_ratio(df: DataFrame, feature: str, row_id: str, residual: str) -> DataFrame:
    """feature, tail_ratio: mean |residual| of the outer tenths over that of the middle (from n/5 to n - n/5); 1 below ten rows."""
    rows = with_rank(df.select(F.col(feature).alias("_x"), F.col(row_id).alias("_id"), F.abs(residual).alias("_e")), "_x", "_id")
    n, at = F.col("rank_n"), F.col("rank") - 1
    tenth, fifth = F.floor(n / 10), F.floor(n / 5)
    outer, inner = (at < tenth) | (at >= n - tenth), (at >= fifth) & (at < n - fifth)
    sums = rows.agg(F.max("rank_n").alias("n"), F.avg(F.when(outer, F.col("_e"))).alias("o"), F.avg(F.when(inner, F.col("_e"))).alias("i"))
    return sums.select(F.lit(feature).alias("feature"), F.when((F.col("n") < 10) | (F.col("i") < 1e-12), F.lit(1.0)).otherwise(F.col("o") / F.col("i")).alias("tail_ratio"))


def interleaved_order(df: DataFrame, row_id: str, most: int) -> DataFrame:
    """row_id, offset, bucket of every row: bucket b of ``most`` holds the places from floor(b n / most) on; (offset, bucket) is the order.

    So the first rows of all buckets come first, then the second ones: any beginning of the order is spread over the whole table.
    """
    rows = with_rank(df.select(F.col(row_id).alias("row_id")), "row_id", "row_id")
    return rows.select("row_id", F.expr(f"(rank * least({most}, rank_n) + rank_n - 1) div rank_n - 1").alias("bucket"), "rank", "rank_n").select(
        "row_id", (F.col("rank") - 1 - F.expr(f"bucket * rank_n div least({most}, rank_n)")).alias("offset"), "bucket"
    )


def interleaved(df: DataFrame, row_id: str, most: int) -> DataFrame:
    """row_id, turn of ``most`` rows spread evenly over the order of ids: the first of each of ``most`` buckets."""
    return interleaved_order(df, row_id, most).where("offset = 0").select("row_id", F.col("bucket").cast("long").alias("turn"))


def nearest_rows(df: DataFrame, row_id: str, category: str, columns: list[str], most: int = 300) -> DataFrame:
    """base_id, other_id, distance: for ``most`` spread-out rows the nearest other row of the same category (distance over 1e-9).

    ``columns`` are z-scored. A row whose category has no other point is no base; the next one in the interleaved order is
    taken for it. ``most`` is the size of the diagnostic sample, so the bases are a bounded broadcast; all rows are
    searched twice: for each base's least distance, then for the least id at it. Distances that agree to nine digits are equal,
    since the last bits of z-scores depend on the order of sums. Partial aggregates hold a number for each base, nothing is sorted.
    """
    spread = [(F.max(c) - F.min(c)) > 2e-9 for c in columns]
    alive = df.groupBy(category).agg(functools.reduce(lambda a, b: a | b, spread).alias("_apart")).where("_apart").select(category)
    fit = df.join(alive, category, "left_semi").select(F.col(row_id).alias("row_id"), F.col(category).alias("_cat"), *[F.col(c).alias(f"b_{c}") for c in columns])
    chosen = interleaved_order(df, row_id, most).join(fit, "row_id").orderBy("offset", "bucket").limit(most)
    bases = chosen.select(F.col("row_id").alias("base_id"), "_cat", *[f"b_{c}" for c in columns])
    pairs = df.join(F.broadcast(bases), F.col(category) == F.col("_cat"))
    square = sum(((F.col(c) - F.col(f"b_{c}")) * (F.col(c) - F.col(f"b_{c}")) for c in columns), F.lit(0.0))
    near = pairs.select("base_id", F.col(row_id).alias("other_id"), F.sqrt(square).alias("_distance")).where("_distance > 1e-9")
    least = near.groupBy("base_id").agg(F.min("_distance").alias("distance"))  # a row for each base
    # the plain comparison spares most pairs the rounding
    tied = (F.col("_distance") <= F.col("distance") + 1e-9) & (F.round("_distance", 9) == F.round("distance", 9))
    found = near.join(F.broadcast(least), "base_id").where(tied | (F.col("_distance") == F.col("distance")))
    return found.groupBy("base_id", "distance").agg(F.min("other_id").alias("other_id")).select("base_id", "other_id", "distance")


def sensitivity(pairs: DataFrame, columns: list[str], predict: Callable[[list[Column]], Column | list[Column]], alpha: float = 1.0, sigmas: list[float] | None = None) -> DataFrame:
    """pairs, mean and max of |dy| / |dx| when a base moves the share ``alpha`` towards its neighbour.

    ``pairs`` has columns a_<c> of the base and b_<c> of the neighbour; categories never move. ``predict`` gives one output or
    several, in units of ``sigmas`` (one each where left out); a prediction that isn't finite is an error.
    """
    if not 0 < alpha <= 1 or not columns or any(not s > 0 or s == float("inf") for s in sigmas or []):
        raise ValueError("a step is a share in (0, 1] of numbers, and outputs have positive spreads")

    def outputs(at: list[Column]) -> list[Column]:
        made = predict(at)
        return made if isinstance(made, list) else [made]

    moved = [F.col(f"a_{c}") + F.lit(alpha) * (F.col(f"b_{c}") - F.col(f"a_{c}")) for c in columns]
    dx = F.sqrt(sum(((m - F.col(f"a_{c}")) * (m - F.col(f"a_{c}")) for m, c in zip(moved, columns)), F.lit(0.0)))
    before, after = outputs([F.col(f"a_{c}") for c in columns]), outputs(moved)
    steps = [(p - q) / F.lit(float(s)) for p, q, s in zip(after, before, sigmas or [1.0] * len(before), strict=True)]
    dy = F.sqrt(sum((s * s for s in steps), F.lit(0.0)))
    ratio = F.when(F.col("dy").isNull() | F.isnan("dy") | (F.col("dy") == float("inf")), F.raise_error(F.lit("a prediction is not finite")).cast("double")).otherwise(F.col("dy") / F.col("dx"))
    ratios = pairs.select(dx.alias("dx"), dy.alias("dy")).where("dx > 1e-9").select(ratio.alias("ratio"))
    return ratios.agg(F.count(F.lit(1)).alias("pairs"), F.avg("ratio").alias("mean_ratio"), F.max("ratio").alias("max_ratio"))


def sensitivity_report(
    pairs: DataFrame, columns: list[str], model: Callable[[list[Column]], Column | list[Column]], reference: Callable[[list[Column]], Column | list[Column]],
    alpha: float = 1.0, sigmas: list[float] | None = None,
) -> DataFrame:
    """pairs, mean and max ratio of a model and of the process it stands for, on the same pairs, and how far the means are apart."""
    mine, theirs = (sensitivity(pairs, columns, f, alpha, sigmas) for f in (model, reference))
    renamed = theirs.select(F.col("mean_ratio").alias("reference_mean"), F.col("max_ratio").alias("reference_max"))
    both = mine.join(F.broadcast(renamed))  # one row each
    return both.withColumn("divergence", F.abs(F.col("mean_ratio") - F.col("reference_mean")))


def gather(df: DataFrame, row_id: str, picked: DataFrame) -> DataFrame:
    """The rows of ``df`` at the picked (row_id, turn), with their turn; a row that is picked twice comes twice."""
    return df.join(picked.select(F.col("row_id").alias("_picked"), "turn"), F.col(row_id) == F.col("_picked")).drop("_picked")


def calibration_sample(df: DataFrame, row_id: str, most: int = 256) -> DataFrame:
    """row_id of ``most`` rows at even strides of the order of ids, all rows if there are no more."""
    rows = with_rank(df.select(F.col(row_id).alias("row_id")), "row_id", "row_id")
    at, stride = F.col("rank") - 1, F.col("rank_n") / F.lit(float(most))
    turn = F.ceil(at / stride)
    hit = F.lit(False)
    for near in (0, 1, -1):  # the turn whose stride begins here, whichever way the division was rounded
        hit = hit | (F.floor((turn + near) * stride) == at) & (turn + near).between(0, most - 1)
    return rows.where((F.col("rank_n") <= most) | hit).select("row_id")


def report(df: DataFrame, features: list[str], row_id: str, residual: str, outside: DataFrame) -> DataFrame:
    """kind, feature, value: changes of sign and tail ratio of the residuals along each feature, and how many rows are outside of its range.

    ``outside``: one row of outside_<feature> counts, as ``scaling.range_report`` gives them.
    """
    parts = [sign_changes(df, x, row_id, residual).select(F.lit("sign_changes").alias("kind"), "feature", F.col("sign_change_rate").alias("value")) for x in features]
    parts += [tail_ratio(df, x, row_id, residual).select(F.lit("tail_ratio").alias("kind"), "feature", F.col("tail_ratio").alias("value")) for x in features]
    counts = F.array(*[F.struct(F.lit("outside").alias("kind"), F.lit(x).alias("feature"), F.col(f"outside_{x}").cast("double").alias("value")) for x in features])
    return functools.reduce(DataFrame.unionByName, [*parts, outside.select(F.inline(counts))])


def nearest_rank(df: DataFrame, groups: list[str], value: str, share: float = 0.95) -> DataFrame:
    """groups, importance: the value at place round((n - 1) * share) of each group, without interpolation.

    A sketch (ranks right to 1e-4 of a group) gives two values a hundredth of the group's rows before and after the place. Rows below the first are
    only counted, rows between are counted by value, and the place is found among these. Groups of up to 1000 rows are counted by value as a whole.
    """
    rows = df.where(F.col(value).isNotNull())
    near = [max(0.0, share - 0.01), min(1.0, share + 0.01)]
    cuts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, near, 10_000).alias("_cuts"))
    cuts = cuts.select(*groups, F.round((F.col("_n") - 1) * F.lit(share)).alias("_place"), *[F.when(F.col("_n") > 1000, F.get("_cuts", F.lit(i))).alias(f"_cut{i}") for i in (0, 1)])
    held = rows.select(*groups, F.col(value).alias("importance")).join(cuts, groups).where(F.col("_cut1").isNull() | (F.col("importance") <= F.col("_cut1")))
    below = F.coalesce(F.col("importance") < F.col("_cut0"), F.lit(False))
    counts = held.groupBy(*groups, below.alias("_below"), F.when(~below, F.col("importance")).alias("importance")).agg(F.count(F.lit(1)).alias("_k"), F.first("_place").alias("_place"))
    upto = counts.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*groups).orderBy(F.desc("_below"), "importance")))
    return upto.where(F.col("_upto") > F.col("_place")).groupBy(*groups).agg(F.min("importance").alias("importance"))


def prune(edges: DataFrame, layer: list[str], share: float) -> DataFrame:
    """Add is_active: edges whose importance is ``share`` of their layer's largest at least."""
    top = F.max("importance").over(Window.partitionBy(*layer))
    return edges.withColumn("is_active", F.col("importance") >= F.lit(share) * top)
