"""Global ranks and neighbours without a single-task window.

A global order is cut into buckets by key; ranks are places within a bucket plus the rows of the buckets
before it, and neighbours across a bucket's edge meet in a table with a row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free_of(df: DataFrame, *names: str) -> None:
    """An error if the table has columns of names that are used here."""
    taken = [n for n in names if n in df.columns]
    if taken:
        raise ValueError(f"columns {', '.join(taken)} are there already")


def shuffle_key(seed: int, row_id: Column) -> Column:
    """A pseudo-random order that any engine with MD5 can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")).cast("binary"))


def ranked(df: DataFrame, seed: int, row_id: str, out: str = "place", within: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out``: place from 0 in the shuffled order (of each group of ``within``), and ``out_n``: rows of the group.

    Buckets are the first three digits of the hash, so there are 4096 of them whatever the input.
    """
    free_of(df, "_key", "_bucket", "_in", "_before", "_n", out, f"{out}_n")
    keyed = df.withColumn("_key", shuffle_key(seed, F.col(row_id))).withColumn("_bucket", F.substring("_key", 1, 3))
    sizes = keyed.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = sizes.select(
        *within, "_bucket",
        F.coalesce(F.sum("_n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias(f"{out}_n"),
    )
    place = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy("_key", row_id))
    return (
        keyed.withColumn("_in", place).join(before, [*within, "_bucket"])
        .withColumn(out, (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_key", "_bucket", "_in", "_before")
    )


def _with_below(df: DataFrame, cuts: list, value: str, out: str) -> DataFrame:
    """Add ``out``: how many of the sorted cuts are less than the value, by halves. A lambda over all cuts isn't compiled and costs microseconds a row."""
    held, known = df.withColumn(out, F.lit(0)), F.array(*map(F.lit, cuts))
    for k in reversed(range(len(cuts).bit_length())):
        held = held.withColumn(out, F.col(out) + F.when(F.get(known, F.col(out) + F.lit((1 << k) - 1)) < F.col(value), 1 << k).otherwise(0))
    return held


def bucketed(df: DataFrame, value: str, buckets: int = 256, tie: str | None = None) -> DataFrame:
    """Add ``_bucket``: which of about ``buckets`` ranges the value falls in, in their order (cut points by quantile sketch).

    A value that is a cut point has a bucket for itself. With a numeric ``tie`` such a bucket, whose rows may be most of
    the table, is cut again by ranges of the tie. So the order of (value, tie) is kept and no value is one task's.
    """
    numeric = tie is not None and dict(df.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(value, shares, 20000).alias("c"), (F.percentile_approx(tie, shares, 20000) if numeric else F.lit(None)).alias("t")).first()
    cuts, ties = (sorted(set(v)) if v else None for v in (found["c"], found["t"]))
    if cuts is None:
        return df.withColumn("_bucket", F.lit(0))
    held = _with_below(df, cuts, value, "_below")
    is_cut = F.coalesce(F.get(F.array(*map(F.lit, cuts)), F.col("_below")) == F.col(value), F.lit(False))
    if not ties:
        return held.withColumn("_bucket", (F.lit(2) * F.col("_below") + is_cut.cast("int")) * F.lit(2 * buckets)).drop("_below")
    within = F.when(is_cut, F.col("_within")).otherwise(0)
    return _with_below(held, ties, tie, "_within").withColumn("_bucket", (F.lit(2) * F.col("_below") + is_cut.cast("int")) * F.lit(2 * buckets) + within).drop("_below", "_within")


def with_previous(df: DataFrame, value: str, tie: str, carried: str) -> DataFrame:
    """Add ``previous``: ``carried`` of the row before in the order of (value, tie); null for the first row."""
    free_of(df, "_bucket", "_below", "_within", "_inner", "_at", "_edge", "previous")
    held = bucketed(df, value, tie=tie)
    order = Window.partitionBy("_bucket").orderBy(value, tie)
    lasts = held.groupBy("_bucket").agg(F.max_by(carried, F.struct(value, tie)).alias("_last"))
    edges = lasts.select(F.col("_bucket"), F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("_bucket")).alias("_edge"))
    return (
        held.withColumn("_inner", F.lag(carried).over(order)).withColumn("_at", F.row_number().over(order))
        .join(F.broadcast(edges), "_bucket")  # a row for each bucket
        .withColumn("previous", F.when(F.col("_at") == 1, F.col("_edge")).otherwise(F.col("_inner")))
        .drop("_bucket", "_inner", "_at", "_edge")
    )


def with_rank(df: DataFrame, value: str, tie: str, out: str = "rank", bucket: str | None = None) -> DataFrame:
    """Add ``out``: place from 1 in the order of (value, tie), and ``out_n``: all rows.

    ``bucket``: a column to add with the bucket, a stretch of the order by which the rows are partitioned already.
    """
    free_of(df, "_bucket", "_below", "_within", "_in", "_before", "_n", out, f"{out}_n")
    held = bucketed(df, value, tie=tie)
    sizes = held.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    one = Window.partitionBy(F.lit(0))
    before = sizes.select("_bucket", F.coalesce(F.sum("_n").over(one.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(one).alias(f"{out}_n"))
    placed = (
        held.withColumn("_in", F.row_number().over(Window.partitionBy("_bucket").orderBy(value, tie)))
        .join(F.broadcast(before), "_bucket")
        .withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).drop("_in", "_before")
    )
    return placed.withColumnRenamed("_bucket", bucket) if bucket else placed.drop("_bucket")
