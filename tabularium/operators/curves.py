"""Training curves as relations: recommended epochs, early stopping, best points, mean curves, spark lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: glyphs from low to high.
GLYPHS = "▁▂▃▄▅▆▇█"


@dataclass(frozen=True)
class Schedule:
    """Epochs at which a run is measured: every n-th, or those listed; none where both are left out."""

    every: int | None = None
    at: tuple[int, ...] | None = None

    def check(self, epochs: int) -> None:
        """An error for a schedule that measures nothing or what isn't run."""
        if self.every is not None and not 1 <= self.every <= epochs:
            raise ValueError(f"every {self.every} of {epochs} epochs measures nothing")
        if self.at is not None and (not self.at or len(set(self.at)) < len(self.at) or min(self.at) < 1 or max(self.at) > epochs):
            raise ValueError(f"points {self.at} of {epochs} epochs")

    def wants(self, epoch: Column) -> Column:
        if self.at is not None:
            return epoch.isin(*self.at)
        return epoch % self.every == 0 if self.every else F.lit(False)


def recommended_epoch(curves: DataFrame, groups: list[str], target: float = 0.95, least_gain: float = 0.02, plateau: float = 0.80) -> DataFrame:
    """groups, epoch: first to reach the target; else first on the plateau whose next gain is small; else the last."""
    rows = curves.withColumn("_next", F.lead("r2").over(Window.partitionBy(*groups).orderBy("epoch")))
    flat = (F.col("r2") >= plateau) & (F.col("_next") - F.col("r2") < least_gain)
    return rows.groupBy(*groups).agg(
        F.coalesce(F.min(F.when(F.col("r2") >= target, F.col("epoch"))), F.min(F.when(flat, F.col("epoch"))), F.max("epoch")).alias("epoch")
    )


def early_stop(curves: DataFrame, groups: list[str], patience: int, least_gain: float = 0.0) -> DataFrame:
    """groups, best_epoch, best_r2, stop_epoch: stops at the point that is the ``patience``-th in a row without an improvement.

    A point improves by more than ``least_gain`` over the last point that did, so small steps may add up to one. The best
    point is the first of the highest seen. A group is one run's curve, whose points meet in one row.
    """
    point = F.struct("epoch", F.col("r2").cast("double").alias("r2"))
    start = F.struct(
        F.lit(None).cast("double").alias("accepted"), F.lit(0).alias("since"), F.lit(None).cast("long").alias("stop"),
        F.lit(None).cast("long").alias("best_epoch"), F.lit(None).cast("double").alias("best_r2"),
    )

    def follow(s: Column, p: Column) -> Column:
        better = s["accepted"].isNull() | (p["r2"] > s["accepted"] + F.lit(float(least_gain)))
        since = F.when(better, F.lit(0)).otherwise(s["since"] + 1)
        top = s["best_r2"].isNull() | (p["r2"] > s["best_r2"])
        new = F.struct(
            F.when(better, p["r2"]).otherwise(s["accepted"]).alias("accepted"), since.alias("since"), F.when(since >= patience, p["epoch"].cast("long")).alias("stop"),
            F.when(top, p["epoch"].cast("long")).otherwise(s["best_epoch"]).alias("best_epoch"), F.when(top, p["r2"]).otherwise(s["best_r2"]).alias("best_r2"),
        )
        return F.when(s["stop"].isNotNull(), s).otherwise(new)

    held = curves.groupBy(*groups).agg(F.array_sort(F.collect_list(point)).alias("_points"))
    done = held.select(*groups, F.aggregate("_points", start, follow).alias("s"))
    kind = curves.schema["epoch"].dataType
    return done.select(*groups, F.col("s.best_epoch").cast(kind).alias("best_epoch"), "s.best_r2", F.col("s.stop").cast(kind).alias("stop_epoch"))


def mean_curve(curves: DataFrame, groups: list[str], split: str) -> DataFrame:
    """groups, epoch, r2, splits: means over the splits, of epochs that every split measured."""
    splits = curves.groupBy(*groups).agg(F.count_distinct(split).alias("_all"))
    each = curves.groupBy(*groups, "epoch").agg(F.avg("r2").alias("r2"), F.count_distinct(split).alias("splits"))
    return each.join(splits, groups).where("splits = _all").select(*groups, "epoch", "r2", "splits")


def spark_line(value: Column, low: Column, high: Column) -> Column:
    """The nearest of eight glyphs to the value's place between low and high."""
    share = (value - low) / F.greatest(high - low, F.lit(1e-12))
    return F.lit(GLYPHS).substr(F.least(F.lit(8), F.round(share * 7) + 1).cast("int"), F.lit(1))


def last_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, last_epoch, last_r2: the last point of each curve that has a value."""
    return df.where(F.col("r2").isNotNull()).groupBy(*keys).agg(F.max("epoch").alias("last_epoch"), F.max_by("r2", "epoch").alias("last_r2"))
