"""The same scoring on a stream: an extension, since the batch expressions hold for any DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scaling import warnings


def score_stream(stream: DataFrame, prediction: Column, inputs: list[str], stats: dict[str, dict[str, float]]) -> DataFrame:
    """The stream's columns, pred and n_warnings: stateless, so any output mode and trigger will do."""
    return stream.withColumns({"pred": prediction, "n_warnings": F.size(warnings(inputs, stats))})


def windowed_errors(scored: DataFrame, time: str, target: str, width: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """window_start, n, rmse of predictions by tumbling window; rows later than ``late`` are left out by the watermark."""
    error = F.col("pred") - F.col(target)
    return (
        scored.withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"))
        .select(F.col("w.start").alias("window_start"), "n", "rmse")
    )
