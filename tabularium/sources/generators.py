"""Named sample functions with known truth, as seeded DataFrames of any length."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name -> (ranges of the inputs, outputs of the input columns)
FUNCTIONS = {
    "sum": ([(-1.0, 1.0)] * 2, lambda x: [x[0] + x[1]]),
    "product": ([(-1.0, 1.0)] * 2, lambda x: [x[0] * x[1]]),
    "sine": ([(-math.pi, math.pi)], lambda x: [F.sin(x[0]), F.cos(x[0])]),
    "polynomial": ([(-2.0, 2.0)], lambda x: [F.lit(0.5) * x[0] * x[0] - x[0] + F.lit(1.0)]),
    "projectile": ([(1.0, 10.0), (0.1, 1.5)], lambda x: [x[0] * x[0] * F.sin(F.lit(2.0) * x[1]) / F.lit(9.81)]),
}


def truth(name: str, inputs: list[Column]) -> list[Column]:
    """The outputs, one or several."""
    return FUNCTIONS[name][1](inputs)


def generate(spark: SparkSession, name: str, rows: int, seed: int = 0) -> DataFrame:
    """row_id, x0.., y (y0, y1 of two outputs): inputs uniform over their ranges, the same for equal seeds."""
    ranges, _ = FUNCTIONS[name]
    df = spark.range(rows).withColumnRenamed("id", "row_id")
    for i, (low, high) in enumerate(ranges):
        # a hash of row and seed, so that values don't depend on how rows are dealt out
        unit = F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "row_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        df = df.withColumn(f"x{i}", F.lit(low) + F.lit(high - low) * unit)
    made = truth(name, [F.col(f"x{i}") for i in range(len(ranges))])
    return df.withColumns({"y" if len(made) == 1 else f"y{i}": y for i, y in enumerate(made)})
