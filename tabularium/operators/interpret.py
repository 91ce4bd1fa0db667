"""Interpretation of additive spline models: prune weak edges, refit what is left from kept sums, and say what each step costs.

A model's edges are its columns' curves. All steps work on products that one pass over the rows has given (``spline_search.moments``). Leaving
features out is a Schur step on the inverse of the normal matrix: with B the inverse, R what stays and S what goes, the weights that a fit without S
has are ``w_R - B_RS (B_SS)^-1 w_S``, so neither rows nor the remaining system are looked at again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import r2_from_products
from .spline_search import moments, products

#: The version of profiles, its settings, and those without one.
VERSION = 1
PROFILE = {"l1": 1e-3, "prune": 0.05, "finetune_epochs": 20, "compact": True}
BARE = {"l1": 0.0, "prune": None, "finetune_epochs": 10, "compact": False}


@dataclass(frozen=True)
class InterpretProfile:
    """Settings of the steps. ``prune``: edges of less than this share of the strongest go, None: none does; ``finetune_epochs`` is recorded, as refits are exact."""

    version: int = VERSION
    l1: float = PROFILE["l1"]
    prune: float | None = PROFILE["prune"]
    finetune_epochs: int = PROFILE["finetune_epochs"]
    compact: bool = PROFILE["compact"]

    def __post_init__(self):
        wrong = [
            (self.version != VERSION, f"version {self.version} is not {VERSION}"),
            (not (math.isfinite(self.l1) and self.l1 >= 0), f"l1 {self.l1} is not a number from 0"),
            (self.prune is not None and not 0 <= self.prune < 1, f"prune {self.prune} is not from 0 to below 1"),
            (self.finetune_epochs < 1, "a refit needs an epoch"),
        ]
        for is_wrong, why in wrong:
            if is_wrong:
                raise ValueError(why)

    def describe(self) -> str:
        cut = f"prune {self.prune:g}, refit {self.finetune_epochs} epochs" if self.prune is not None else "no pruning"
        return f"v{self.version}: L1 {self.l1:g}, {cut}{', compact' if self.compact else ''}"


def resolve(use_profile: bool, **settings) -> InterpretProfile | None:
    """The profile with ``settings`` in place of its own; the bare one without ``use_profile``; None if nothing is asked for."""
    if not use_profile and not settings:
        return None
    made = replace(InterpretProfile(**(PROFILE if use_profile else BARE)), **settings)
    if "finetune_epochs" in settings and made.prune is None:
        raise ValueError("refit epochs are of no use without pruning")
    return made


# ---- steps on products


@dataclass
class Kept:
    """A fit that can leave features out: weights, the inverse of its normal matrix, and which features are in."""

    weights: np.ndarray
    inverse: np.ndarray
    active: np.ndarray

    @classmethod
    def of(cls, rest: np.ndarray, strength: float) -> Kept:
        a = rest[:-1, :-1]
        inverse = np.linalg.inv(a + strength * np.diag(np.maximum(np.diag(a), 1e-9)))
        return cls(inverse @ rest[:-1, -1], inverse, np.ones(len(a), bool))

    def without(self, gone: np.ndarray) -> Kept:
        """The fit without the features of mask ``gone``; weights of features that are out are nought."""
        s, r = self.active & gone, self.active & ~gone
        if not s.any():
            return self
        across = np.linalg.solve(self.inverse[np.ix_(s, s)], np.column_stack([self.weights[s], self.inverse[np.ix_(s, r)]]))
        weights, inverse = np.zeros_like(self.weights), np.zeros_like(self.inverse)
        weights[r] = self.weights[r] - self.inverse[np.ix_(r, s)] @ across[:, 0]
        inverse[np.ix_(r, r)] = self.inverse[np.ix_(r, r)] - self.inverse[np.ix_(r, s)] @ across[:, 1:]
        return Kept(weights, inverse, r)


def importance(rest: np.ndarray, weights: np.ndarray, edges: Sequence[slice]) -> list[float]:
    """Spread of what each edge adds over the rows of the products."""
    n, means = rest[-2, -2], rest[:-1, -2] / rest[-2, -2]
    out = []
    for e in edges:
        spread = rest[e, e] / n - np.outer(means[e], means[e])
        out.append(math.sqrt(max(0.0, float(weights[e] @ spread @ weights[e]))))
    return out


def run(df: DataFrame, columns: Sequence[str], target: str, fold: str, grid: int, profile: InterpretProfile, held_out: int = 0, model: str | None = None, widths: Mapping[str, int] | None = None) -> DataFrame:
    """model, kept (edges by place), active_edges, r2_before, r2_after_prune, r2_after_refit, r2_after_compact: R2 on the fold ``held_out``, fitted on the others.

    ``l1`` is the ridge's strength (1e-9 at least). Without pruning or compaction their R2 are null. One edge stays at least. All models are
    worked on in one job.
    """

    def steps(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["p"].max()) + 1
        folds = {int(k): products(part, grid, n) for k, part in rows.groupby("fold")}
        name, held = rows["model"].iloc[0], folds.pop(held_out, None)
        columns_ = ["model", "kept", "active_edges", "r2_before", "r2_after_prune", "r2_after_refit", "r2_after_compact"]
        if held is None or not folds:
            return pd.DataFrame([(name, list(range(n)), n, None, None, None, None)], columns=columns_)
        rest = sum(folds.values())
        fit = Kept.of(rest, max(profile.l1, 1e-9))
        edges = [slice(k * (grid + 2), (k + 1) * (grid + 2)) for k in range(n)]
        before, kept, after, refitted = r2_from_products(held, fit.weights), list(range(n)), None, None
        if profile.prune is not None:
            size = importance(rest, fit.weights, edges)
            top = max(size)
            kept = [k for k in range(n) if size[k] >= profile.prune * top]
            gone = np.zeros(len(fit.weights), bool)
            for k in set(range(n)) - set(kept):
                gone[edges[k]] = True
            after = r2_from_products(held, np.where(gone, 0.0, fit.weights))
            fit = fit.without(gone)
            refitted = r2_from_products(held, fit.weights)
        compacted = None
        if profile.compact:  # the smaller model itself: only features that are left, on their own products
            left = np.flatnonzero(np.append(fit.active, True))
            compacted = r2_from_products(held[np.ix_(left, left)], fit.weights[fit.active])
        return pd.DataFrame([(name, kept, len(kept), before, after, refitted, compacted)], columns=columns_)

    sums = moments(df, columns, target, fold, [grid], model, widths)
    schema = "model string, kept array<int>, active_edges long, r2_before double, r2_after_prune double, r2_after_refit double, r2_after_compact double"
    return sums.groupBy("model").applyInPandas(steps, schema).withColumn("kept", F.sort_array("kept"))
