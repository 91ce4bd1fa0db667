"""Search grids as relations: axes to candidates, what a search costs, objectives to scores."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Axes of the additive spline models that this library fits, by budget.
BUDGETS = {
    "quick": {"grid": [4], "strength": [1e-3, 1e-1], "epochs": [25]},
    "balanced": {"grid": [4, 8], "strength": [1e-4, 1e-2], "epochs": [40]},
    "thorough": {"grid": [4, 8, 12], "strength": [1e-5, 1e-3, 1e-1], "epochs": [40]},
}
#: Axes of the networks whose runs are recorded elsewhere and ranked here, by budget and kind; seeds; epochs of a search and of a final fit.
NETWORKS = {
    "quick": {
        "attention": {"d_model": [64], "layers": [2], "d_ff": [128], "encoder": ["linear", "mlp"]},
        "mlp": {"width": [128, 256], "layers": [3]},
        "kan": {"width": [16], "layers": [2], "grid": [8, 16]},
        "seeds": [0], "epochs": 25, "final_epochs": 60,
    },
    "balanced": {
        "attention": {"d_model": [64, 96], "layers": [2, 3], "d_ff": [128, 384], "encoder": ["linear", "mlp"]},
        "mlp": {"width": [128, 256], "layers": [3, 4]},
        "kan": {"width": [16, 32], "layers": [2], "grid": [8, 16]},
        "seeds": [0], "epochs": 40, "final_epochs": 80,
    },
    "thorough": {
        "attention": {"d_model": [64, 96, 128], "layers": [2, 3], "d_ff": [128, 256, 384], "encoder": ["linear", "mlp"]},
        "mlp": {"width": [128, 256, 512], "layers": [3, 4]},
        "kan": {"width": [16, 32], "layers": [2, 3], "grid": [8, 16, 32]},
        "seeds": [0, 1], "epochs": 40, "final_epochs": 80,
    },
}
LONG_MAX = (1 << 63) - 1


def network_configs(budget: str) -> list[dict]:
    """Every configuration of a budget: kind and a value of each of its axes, last axis fastest."""
    own = NETWORKS[budget]
    out = []
    for kind in ("attention", "mlp", "kan"):
        out += [{"kind": kind, **dict(zip(own[kind], values))} for values in itertools.product(*own[kind].values())]
    return out


def candidates(spark: SparkSession, axes: dict[str, Sequence[float]]) -> DataFrame:
    """candidate (from 0, last axis fastest) and a column for each axis: the product of the axes, as one exploded row."""
    if not axes or any(not len(v) for v in axes.values()):
        raise ValueError("every axis needs a value")
    out = spark.range(1).select(F.lit(0).cast("long").alias("candidate"))
    for name, values in axes.items():
        out = out.select("*", F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias("_at", name))
        out = out.withColumn("candidate", F.col("candidate") * F.lit(len(values)) + F.col("_at")).drop("_at")
    return out


def runs(grid: DataFrame, folds: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """candidate, seed, fold, train_rows, val_rows of every run; ``folds``: fold, n (a row for each fold)."""
    total = folds.agg(F.sum("n").alias("_total"))
    sized = folds.join(F.broadcast(total)).select("fold", (F.col("_total") - F.col("n")).alias("train_rows"), F.col("n").alias("val_rows"))
    return grid.select("candidate", F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed")).join(F.broadcast(sized))


@dataclass(frozen=True)
class Cost:
    configs: int
    seeds: int
    folds: int
    repeats: int
    max_epochs: int

    @property
    def runs(self) -> int:
        return min(LONG_MAX, self.configs * self.seeds * self.folds * self.repeats)

    @property
    def epochs(self) -> int:
        """Upper bound of all runs' epochs; large products stop at the largest long."""
        return min(LONG_MAX, self.runs * self.max_epochs)


def objective(name: str) -> Column:
    """Score of a candidate from r2_all, worst_r2, mean_r2 and nrmse; higher is better, null where it is not defined."""
    return {"worst_output_r2": F.col("worst_r2"), "aggregate_r2": F.col("r2_all"), "mean_output_r2": F.col("mean_r2"), "nrmse": -F.col("nrmse")}[name]


def objectives(per_output: DataFrame, overall: DataFrame) -> DataFrame:
    """objective, score: all objectives of one candidate, and the worst output's name as ``worst_output``."""
    outs = per_output.agg(F.min("r2").alias("worst_r2"), F.avg("r2").alias("mean_r2"), F.min_by("output", F.struct("r2", "output")).alias("worst_output"))
    one = outs.join(F.broadcast(overall.select(F.col("r2").alias("r2_all"), "nrmse")))  # one row each
    names = ["worst_output_r2", "aggregate_r2", "mean_output_r2", "nrmse"]
    return one.select("worst_output", F.inline(F.array(*[F.struct(F.lit(n).alias("objective"), objective(n).alias("score")) for n in names])))
