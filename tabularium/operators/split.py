"""Split plans over row ids: holdout, k-fold, repeated k-fold, with one test set that no search can reach."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import ranked

#: Fixed value: the odd step between the seeds of repeats.
SEED_STEP = 0x9E3779B97F4A7C15


def check_fractions(*parts: float) -> None:
    if not all(math.isfinite(p) and 0 < p < 1 for p in parts) or sum(parts) >= 1:
        raise ValueError("fractions must be positive and sum to less than one")


def check_holdout(n_rows: int, train: float = 0.70, val: float = 0.15) -> tuple[int, int, int]:
    """Rows of train, validation and test; an error if any is empty."""
    check_fractions(train, val)
    first, second = math.floor(n_rows * train + 0.5), math.floor(n_rows * val + 0.5)
    parts = first, second, n_rows - first - second
    if min(parts) < 1:
        raise ValueError(f"{n_rows} rows give parts of {parts}: each needs a row")
    return parts


def check_kfold(n_rows: int, k: int = 5, test: float = 0.15, repeats: int = 1) -> tuple[int, int]:
    """Rows of test and pool; an error if the test is empty or the pool has fewer rows than folds."""
    if k < 2 or repeats < 1 or k * repeats >= 1 << 63:
        raise ValueError(f"{repeats} repeats of {k} folds are no plan")
    check_fractions(test)
    held = math.floor(n_rows * test + 0.5)
    if held < 1 or n_rows - held < k:
        raise ValueError(f"{n_rows} rows give {held} of test and {n_rows - held} for {k} folds")
    return held, n_rows - held


def label(k: int = 1, repeats: int = 1, is_test: bool = False) -> str:
    """Where a score comes from."""
    return "test" if is_test else "validation" if k == 1 else f"cv-{k}" if repeats == 1 else f"cv-{k}x{repeats}"


def holdout(df: DataFrame, row_id: str, seed: int = 1, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """row_id, part: round(n * train) rows train, round(n * val) validate, the rest test."""
    check_fractions(train, val)
    rows = ranked(df.select(F.col(row_id).alias("row_id")), seed, "row_id")
    first = F.round(F.col("place_n") * F.lit(train))
    second = first + F.round(F.col("place_n") * F.lit(val))
    return rows.select("row_id", F.when(F.col("place") < first, "train").when(F.col("place") < second, "val").otherwise("test").alias("part"))


def kfold(df: DataFrame, row_id: str, k: int = 5, test: float = 0.15, test_seed: int = 1, folds_seed: int = 2) -> DataFrame:
    """row_id, part (test or pool), fold (null for test): the first m mod k folds have one row more."""
    if k < 2:
        raise ValueError("k must be 2 at least")
    check_fractions(test)
    first = ranked(df.select(F.col(row_id).alias("row_id")), test_seed, "row_id", "drawn")
    is_test = F.col("drawn") < F.round(F.col("drawn_n") * F.lit(test))
    # both parts are ranked, so that the first ranking is made once
    parted = ranked(first.select("row_id", F.when(is_test, "test").otherwise("pool").alias("part")), folds_seed, "row_id", within=("part",))
    return parted.select("row_id", "part", F.when(F.col("part") == "pool", fold_of(k)).alias("fold"))


def refit_pool(plan: DataFrame) -> DataFrame:
    """row_id of train and validation rows together, as a final fit uses them."""
    return plan.where("part in ('train', 'val')").select("row_id").distinct()


def fold_of(k: int):
    """Fold of ``place`` among ``place_n`` rows."""
    small, more = F.floor(F.col("place_n") / k), F.col("place_n") % k
    edge = more * (small + 1)
    return F.when(F.col("place") < edge, F.floor(F.col("place") / (small + 1))).otherwise(more + F.floor((F.col("place") - edge) / F.greatest(small, F.lit(1)))).cast("int")


def repeat_seed(folds_seed: int, repeat: int) -> int:
    return (folds_seed + repeat * SEED_STEP) % (1 << 64)


def repeated_kfold(df: DataFrame, row_id: str, k: int = 5, repeats: int = 3, test: float = 0.15, test_seed: int = 1, folds_seed: int = 2) -> DataFrame:
    """row_id, repeat, fold of the pool for every repeat; the test set is that of the plain plan, repeat 0 is the plain plan."""
    if repeats < 2:
        raise ValueError("repeats must be 2 at least")
    pool = kfold(df, row_id, k, test, test_seed, folds_seed).where("part = 'pool'").select("row_id")
    out = None
    for r in range(repeats):
        one = ranked(pool, repeat_seed(folds_seed, r), "row_id").select("row_id", F.lit(r).alias("repeat"), fold_of(k).alias("fold"))
        out = one if out is None else out.unionByName(one)
    return out


@dataclass
class SearchPool:
    """What a search may see: rows and their folds, without the test rows."""

    rows: DataFrame


class HoldoutTest:
    """The test rows; ``open`` gives them once."""

    def __init__(self, rows: DataFrame):
        self._rows = rows

    def open(self) -> DataFrame:
        if self._rows is None:
            raise RuntimeError("the test set was opened before")
        rows, self._rows = self._rows, None
        return rows


def prepare(df: DataFrame, row_id: str, plan: DataFrame) -> tuple[SearchPool, HoldoutTest]:
    """Join rows with their plan and part them."""
    both = df.join(plan.withColumnRenamed("row_id", row_id), row_id)
    return SearchPool(both.where("part <> 'test'")), HoldoutTest(both.where("part = 'test'").drop(*(c for c in ("part", "fold") if c not in df.columns)))
