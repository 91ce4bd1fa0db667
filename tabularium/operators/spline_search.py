"""Additive spline models of all grids, strengths and folds from one aggregate over the rows.

A cubic basis has four entries in a row, and within a cell of the grid they are polynomials of the place in the cell. So the rows only
give moments: for each grid, fold and pair of cells the sums of ``t**a * u**b`` (and of ``t**a * y``), all grids in one job. From these few sums a
task for each grid builds the products of all features, takes each fold's products from the whole to leave it out, solves, and scores.
The driver sees nothing but the plan. Sums are as many as folds times cells by cells for each pair of columns, whatever the rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from .models import r2_from_products, ridge

LOW, HIGH = -3.0, 3.0
#: Of the four bases over a cell, by the place t in it: coefficients of 1, t, t**2, t**3.
CUBIC = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6.0


def moments(df: DataFrame, columns: Sequence[str], target: str, fold: str, grids: Sequence[int], model: str | None = None, widths: Mapping[str, int] | None = None) -> DataFrame:
    """model, grid, fold, p, q, cell_p, cell_q, m (array): sums over the rows of each pair of cells.

    For p = q (a column by itself): sums of t**a for a to 6, then of y t**a for a to 3, then of y**2. For p < q: sums of t**a u**b, a and b to 3.
    ``model``: a column that parts the rows into data of their own, whose first ``widths[model]`` columns count (all, if not given).
    Rows with a null among these, target and fold are left out; cells beyond the knots hold no basis and are counted as one.
    """
    known = df.select(F.col(model).cast("string").alias("model") if model else F.lit("").alias("model"), F.col(fold).cast("long").alias("fold"), F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    width = F.lit(len(columns)) if widths is None else F.coalesce(*[F.when(F.col("model") == k, F.lit(n)) for k, n in widths.items()])
    known = known.withColumn("width", width).where(F.col("fold").isNotNull() & F.col("y").isNotNull() & F.expr(" and ".join(f"(x{i} is not null or width <= {i})" for i in range(len(columns)))))
    each = known.select("*", F.explode(F.array(*[F.lit(int(g)) for g in grids])).alias("grid"))
    step = F.lit(HIGH - LOW) / F.col("grid")
    for i in range(len(columns)):
        at = (F.col(f"x{i}") - F.lit(LOW)) / step
        cell = F.least(F.greatest(F.floor(at), F.lit(-4)), F.col("grid") + F.lit(3)).cast("int")
        each = each.withColumn(f"c{i}", cell).withColumn(f"t{i}", F.when(F.col(f"c{i}").between(-3, F.col("grid") + 2), at - F.col(f"c{i}")).otherwise(F.lit(0.0)))
    nought, none = F.lit(0.0), F.lit(0)
    pairs = []
    for p, q in itertools.combinations_with_replacement(range(len(columns)), 2):
        own = p == q
        pairs.append(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.col(f"c{p}").alias("cell_p"), (none if own else F.col(f"c{q}")).alias("cell_q"), F.col(f"t{p}").alias("t"), (nought if own else F.col(f"t{q}")).alias("u")))
    long = each.select("model", "grid", "fold", "y", "width", F.inline(F.array(*pairs))).where("q < width")
    t, u, y = F.col("t"), F.col("u"), F.col("y")

    def power(c, n):
        return F.lit(1.0) if n == 0 else c if n == 1 else power(c, n - 1) * c

    # sixteen sums do for both kinds of pairs
    lone = [power(t, a) for a in range(7)] + [y * power(t, a) for a in range(4)] + [y * y] + [nought] * 4
    both = [power(t, a) * power(u, b) for a in range(4) for b in range(4)]
    sums = [F.sum(F.when(F.col("p") == F.col("q"), x).otherwise(z)) for x, z in zip(lone, both)]
    return long.groupBy("model", "grid", "fold", "p", "q", "cell_p", "cell_q").agg(F.array(*sums).alias("m"))


def products(rows: pd.DataFrame, grid: int, n_columns: int) -> np.ndarray:
    """Products of all features (each column's bases without the last, a constant) and the target, from one fold's moments."""
    width, size = grid + 3, n_columns * (grid + 2) + 2
    whole = np.zeros((n_columns * width + 2, n_columns * width + 2))
    powers = np.add.outer(np.arange(4), np.arange(4))
    for p, q, a, b, m in zip(rows["p"], rows["q"], rows["cell_p"], rows["cell_q"], rows["m"]):
        m = np.asarray(m, float)
        if p == q:
            block, side = CUBIC @ m[powers] @ CUBIC.T, CUBIC @ np.stack([m[:4], m[7:11]], 1)
            if p == 0:
                whole[-2, -2] += m[0]
                whole[-2, -1] += m[7]
                whole[-1, -1] += m[11]
        else:
            block = CUBIC @ m.reshape(4, 4) @ CUBIC.T
        left = [k for k in range(4) if 0 <= a + k < width]
        right = left if p == q else [k for k in range(4) if 0 <= b + k < width]
        x, z = [p * width + a + k for k in left], [q * width + (a if p == q else b) + k for k in right]
        whole[np.ix_(x, z)] += block[np.ix_(left, right)]
        if p == q:
            whole[np.ix_(x, [-2, -1])] += side[left]
    whole = np.triu(whole) + np.triu(whole, 1).T
    whole[-1, -2] = whole[-2, -1]
    keep = [i for i in range(len(whole)) if i >= n_columns * width or i % width != width - 1]
    return whole[np.ix_(keep, keep)].reshape(size, size)


def search(df: DataFrame, columns: Sequence[str], target: str, fold: str, grids: Sequence[int], strengths: Sequence[float], model: str | None = None, widths: Mapping[str, int] | None = None) -> DataFrame:
    """model, grid, strength, fold, r2, nrmse of every candidate on the fold that it didn't see; nrmse is in units of the training targets' spread.

    One job for all of them, and for all data that ``model`` tells apart. A grid whose rows leave a feature without support still has a
    solution, by the ridge; a fold that holds all rows has no scores.
    """
    if not grids or not strengths or not columns:
        raise ValueError("a search needs grids, strengths and columns")
    if any(g < 1 or g != int(g) for g in grids) or any(not s > 0 for s in strengths):
        raise ValueError("grids are whole numbers from 1, strengths are positive")
    strengths = [float(s) for s in strengths]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        name, grid, n = rows["model"].iloc[0], int(rows["grid"].iloc[0]), int(rows["p"].max()) + 1
        folds = {int(k): products(part, grid, n) for k, part in rows.groupby("fold")}
        whole, out = sum(folds.values()), []
        for k, held in sorted(folds.items()):
            rest = whole - held
            count, total, square = rest[-2, -2], rest[-2, -1], rest[-1, -1]
            for s in strengths:
                if len(folds) < 2:
                    out.append((name, grid, s, k, None, None))
                    continue
                w = ridge(rest, s)
                tail = np.append(w, -1.0)
                sigma = np.sqrt(max(0.0, square / count - (total / count) ** 2))
                rmse = np.sqrt(max(0.0, tail @ held @ tail / held[-2, -2]))
                out.append((name, grid, s, k, r2_from_products(held, w), rmse / sigma if sigma > 0 else None))
        return pd.DataFrame(out, columns=["model", "grid", "strength", "fold", "r2", "nrmse"])

    sums = moments(df, columns, target, fold, grids, model, widths)
    return sums.groupBy("model", "grid").applyInPandas(solve, "model string, grid int, strength double, fold long, r2 double, nrmse double")


def rows(found: DataFrame) -> DataFrame:
    """model, candidate, r2_mean and its spreads, nrmse_mean (null unless every run has one): a row for each candidate of a search."""
    label, keys = F.format_string("grid=%d ridge=%g", "grid", "strength"), ["model", "candidate"]
    runs = found.select("model", label.alias("candidate"), F.lit(0).alias("seed"), F.lit(0).alias("repeat"), "fold", "r2", "nrmse")
    return metrics.over_runs(runs, keys).join(runs.groupBy(*keys).agg(metrics.all_defined("nrmse").alias("nrmse_mean")), keys)


def sweep(found: DataFrame, output: str = "output") -> DataFrame:
    """model, candidate, worst_r2, mean_r2, nrmse, place: candidates of each model, of several outputs each, ranked by the worst output's mean R2.

    ``found``: the scores of a search with the model's name and ``output`` beside grid, strength and fold. A candidate without a
    finite score comes last; ties go by its settings.
    """
    label = F.format_string("grid=%d ridge=%g", "grid", "strength")
    each = found.groupBy("model", "grid", "strength", output).agg(metrics.all_defined("r2").alias("r2"), metrics.all_defined("nrmse").alias("nrmse"))
    scored = each.groupBy("model", "grid", "strength").agg(F.min("r2").alias("worst_r2"), metrics.all_defined("r2").alias("mean_r2"), metrics.all_defined("nrmse").alias("nrmse"))
    scored = scored.withColumn("tie", F.struct("grid", "strength"))
    place = F.row_number().over(Window.partitionBy("model").orderBy(*metrics.best_first("worst_r2", "tie")))
    return scored.select("model", label.alias("candidate"), "worst_r2", "mean_r2", "nrmse", place.alias("place"))
