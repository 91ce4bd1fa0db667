"""Surrogates as Spark jobs: fitted from sums, scored as Column expressions.

Networks are lists of plain weights. Scoring turns them into one select per layer, so that a score stays inside generated
code. Fitting is least squares on spline or polynomial features: one aggregate of products per group of
(candidate, fold) gives every candidate's solution on every fold in a single job, and folds are left out by
subtracting their sums instead of by reading rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bspline, gelu

# ---- networks as expressions


def dense_layer(inputs: Sequence[Column], weights: np.ndarray, bias: Sequence[float], activate: bool) -> list[Column]:
    """weights [inputs, outputs]."""
    out = []
    for j in range(weights.shape[1]):
        z = sum((x * F.lit(float(weights[i, j])) for i, x in enumerate(inputs)), F.lit(float(bias[j])))
        out.append(gelu(z) if activate else z)
    return out


def spline_layer(inputs: Sequence[Column], base: np.ndarray, spline: np.ndarray, bias: Sequence[float], grid: int) -> list[Column]:
    """Edges gelu(x) * base + basis(x) . spline; base [inputs, outputs], spline [inputs, outputs, grid + 3]. Edges of all-zero weights vanish."""
    acts, bases = [gelu(x) for x in inputs], [bspline(x, grid) for x in inputs]
    out = []
    for j in range(base.shape[1]):
        z = F.lit(float(bias[j]))
        for i in range(len(inputs)):
            if base[i, j]:
                z = z + acts[i] * F.lit(float(base[i, j]))
            for b, w in zip(bases[i], spline[i, j]):
                if w:
                    z = z + b * F.lit(float(w))
        out.append(z)
    return out


def edge(layer: dict, i: int, j: int, x: Column) -> Column:
    """The function of one edge of a spline layer, without the node's bias: base * gelu(x) + basis(x) . spline."""
    out = gelu(x) * F.lit(float(np.asarray(layer["base"])[i][j]))
    for b, w in zip(bspline(x, layer["grid"]), np.asarray(layer["spline"])[i][j]):
        out = out + b * F.lit(float(w))
    return out


def edge_values(df: DataFrame, inputs: list[str], layer: dict, keep: list[str]) -> DataFrame:
    """``keep``, input, output, x, value: every edge of a spline layer at the row's own inputs."""
    n_out = np.asarray(layer["base"]).shape[1]
    each = [F.struct(F.lit(i).alias("input"), F.lit(j).alias("output"), F.col(c).cast("double").alias("x"), edge(layer, i, j, F.col(c).cast("double")).alias("value")) for i, c in enumerate(inputs) for j in range(n_out)]
    return df.select(*keep, F.inline(F.array(*each)))


def edge_l1(df: DataFrame, inputs: list[str], layer: dict) -> DataFrame:
    """One row with l1: the sum over all edges of a spline layer of the mean size of what they add, both branches together."""
    each = [F.avg(F.abs(edge(layer, i, j, F.col(c).cast("double")))) for i, c in enumerate(inputs) for j in range(np.asarray(layer["base"]).shape[1])]
    return df.agg(F.coalesce(sum(each[1:], each[0]), F.lit(0.0)).alias("l1"))


def activations(df: DataFrame, inputs: list[str], layers: list[dict], keep: list[str]) -> list[DataFrame]:
    """What arrives at each layer, and the network's outputs last: ``keep`` and a0, a1, .. of each."""
    first = df.select(*keep, *[F.col(c).cast("double").alias(f"a{i}") for i, c in enumerate(inputs)])
    rest = [score(df, inputs, layers[: k + 1], keep, "a") for k in range(len(layers))]
    return [first, *(x.withColumnRenamed("a", "a0") for x in rest)]


def score(df: DataFrame, inputs: list[str], layers: list[dict], keep: list[str], name: str = "pred") -> DataFrame:
    """``keep`` and the outputs (``name`` or name0, name1, ...) of a network; a select for each layer.

    A layer is {"kind": "dense", "weights", "bias", "activate"} or {"kind": "spline", "base", "spline", "bias", "grid"}.
    """
    names = inputs
    for k, layer in enumerate(layers):
        columns = [F.col(c) for c in names]
        if layer["kind"] == "dense":
            outs = dense_layer(columns, np.asarray(layer["weights"]), layer["bias"], layer["activate"])
        else:
            outs = spline_layer(columns, np.asarray(layer["base"]), np.asarray(layer["spline"]), layer["bias"], layer["grid"])
        last = k == len(layers) - 1
        names = [(name if len(outs) == 1 else f"{name}{j}") if last else f"_h{k}_{j}" for j in range(len(outs))]
        df = df.select(*keep, *[o.alias(n) for o, n in zip(outs, names)])
    return df


def compact(layers: list[dict]) -> list[dict]:
    """Spline layers without hidden nodes that reach nothing or come from nothing; the latter's constant goes into the next bias.

    One node of a layer stays at least; predictions don't change.
    """
    layers = [{k: np.array(v, float) if k in ("base", "spline", "bias") else v for k, v in layer.items()} for layer in layers]
    changed = True
    while changed:
        changed = False
        for a, b in zip(layers, layers[1:]):
            arrives = (a["base"] != 0).any(0) | (a["spline"] != 0).any((0, 2))
            leaves = (b["base"] != 0).any(1) | (b["spline"] != 0).any((1, 2))
            drop = [j for j in range(len(arrives)) if not (arrives[j] and leaves[j])][: len(arrives) - 1]
            for j in reversed(drop):
                if leaves[j]:
                    x = float(a["bias"][j])
                    act = 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))
                    b["bias"] = b["bias"] + act * b["base"][j] + b["spline"][j] @ _basis(x, b["grid"])
                a["base"], a["spline"], a["bias"] = np.delete(a["base"], j, 1), np.delete(a["spline"], j, 1), np.delete(a["bias"], j)
                b["base"], b["spline"] = np.delete(b["base"], j, 0), np.delete(b["spline"], j, 0)
                changed = True
    return layers


def _basis(x: float, grid: int, low: float = -3.0, high: float = 3.0) -> np.ndarray:
    step = (high - low) / grid
    t = np.abs(x - (low + step * (np.arange(grid + 3) - 1))) / step
    return np.where(t < 1, 2 / 3 - t * t + t**3 / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0.0))


# ---- fitting from sums


def spline_features(columns: Sequence[str], grid: int) -> list[Column]:
    """An additive spline model's features: the basis of each column, without its last (they sum to one), and a constant."""
    return [b for c in columns for b in bspline(F.col(c), grid)[:-1]] + [F.lit(1.0)]


def fold_products(df: DataFrame, features: Sequence[Column], target: str, fold: str) -> dict[int, np.ndarray]:
    """fold -> products of (features, target), each p by p, from one aggregate."""
    parts = [f.alias(f"f{i}") for i, f in enumerate([*features, F.col(target).cast("double")])]
    p = len(parts)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = df.select(fold, *parts).groupBy(fold).agg(F.array(*[F.sum(F.col(f"f{i}") * F.col(f"f{j}")) for i, j in pairs]).alias("s")).collect()  # a row for each fold
    out = {}
    for r in rows:
        m = np.zeros((p, p))
        for (i, j), v in zip(pairs, r["s"]):
            m[i, j] = m[j, i] = v
        out[r[fold]] = m
    return out


def ridge(products: np.ndarray, strength: float) -> np.ndarray:
    """Weights of the last-column target on the other columns; the ridge is relative to the diagonal."""
    a, b = products[:-1, :-1], products[:-1, -1]
    return np.linalg.solve(a + strength * np.diag(np.maximum(np.diag(a), 1e-9)), b)


def r2_from_products(products: np.ndarray, weights: np.ndarray) -> float:
    """R2 on rows given by their products; the last feature is the constant."""
    n, total, square = products[-2, -2], products[-2, -1], products[-1, -1]
    sst = square - total * total / n
    w = np.append(weights, -1.0)
    return 0.0 if sst <= 1e-12 else float(1.0 - w @ products @ w / sst)


def search(df: DataFrame, columns: Sequence[str], target: str, fold: str, grids: Sequence[int], strengths: Sequence[float]) -> list[dict]:
    """Scores of every (grid, strength) on every fold left out: one job per grid, all strengths and folds from its sums."""
    out = []
    for grid in grids:
        features = spline_features(columns, grid)
        by_fold = fold_products(df, features, target, fold)
        whole = sum(by_fold.values())
        for k, strength in enumerate(strengths):
            for f, held in sorted(by_fold.items()):
                out.append({"grid": grid, "strength": strength, "fold": f, "r2": r2_from_products(held, ridge(whole - held, strength))})
    return out


def univariate_search(df: DataFrame, features: Sequence[str], target: str, fold: str, strengths: Sequence[float]) -> DataFrame:
    """candidate, feature, strength, fold, r2 of one-feature ridge models on each fold left out, without leaving the plan.

    Sums of each feature and fold are a small table; leaving a fold out is a subtraction in it.
    """
    y = F.col(target)
    long = df.select(fold, y.alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])))
    sums = long.groupBy("feature", fold).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    names = ["n", "sx", "sy", "sxx", "sxy", "syy"]
    total = sums.groupBy("feature").agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    both = sums.join(F.broadcast(total), "feature").select("feature", F.col(fold).alias("fold"), *names, *[(F.col(f"t_{c}") - F.col(c)).alias(f"r_{c}") for c in names])
    cells = both.select("*", F.posexplode(F.array(*[F.lit(float(s)) for s in strengths])).alias("candidate", "strength"))
    xx = F.col("r_sxx") - F.col("r_sx") * F.col("r_sx") / F.col("r_n")
    xy = F.col("r_sxy") - F.col("r_sx") * F.col("r_sy") / F.col("r_n")
    cells = cells.withColumn("w", xy / (xx * (F.lit(1.0) + F.col("strength")))).withColumn("b", (F.col("r_sy") - F.col("w") * F.col("r_sx")) / F.col("r_n"))
    sse = F.col("syy") - F.lit(2.0) * F.col("w") * F.col("sxy") - F.lit(2.0) * F.col("b") * F.col("sy") + F.col("w") * F.col("w") * F.col("sxx") + F.lit(2.0) * F.col("w") * F.col("b") * F.col("sx") + F.col("n") * F.col("b") * F.col("b")
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return cells.select("candidate", "feature", "strength", "fold", (F.lit(1.0) - sse / sst).alias("r2"))
