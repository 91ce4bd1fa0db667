"""Scoring of whole tables: bind columns by name, add or replace outputs, warn of extrapolation, export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import score
from .scaling import inverse, transform, warnings


def bind(df: DataFrame, names: list[str]) -> dict[str, str]:
    """Model column -> table column, by trimmed name; a name that is there twice or not at all is an error."""
    found: dict[str, list[str]] = {}
    for c in df.columns:
        if c.strip():
            found.setdefault(c.strip(), []).append(c)
    for n in names:
        if len(found.get(n, [])) != 1:
            raise ValueError(f"column {n}: there {len(found.get(n, []))} times")
    return {n: found[n][0] for n in names}


def export(df: DataFrame, inputs: list[str], outputs: dict[str, Callable[[dict[str, Column]], Column]], stats: dict[str, dict[str, float]]) -> DataFrame:
    """The table with each output in place of its namesake or at the right, and the number of inputs out of range as ``n_warnings``."""
    bound = bind(df, inputs)
    columns = {n: F.col(f"`{c}`") for n, c in bound.items()}
    made = {name: f(columns) for name, f in outputs.items()}
    out = df.withColumns({**made, "n_warnings": F.size(warnings(inputs, stats))}) if made else df
    return out


def summary(scored: DataFrame) -> DataFrame:
    """total, extrapolated rows of an export."""
    return scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_warnings") > 0).alias("extrapolated"))


def predict(df: DataFrame, inputs: list[str], layers: list[dict], stats: dict[str, dict[str, float]], outputs: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and the outputs in their own units: inputs are normalised by ``stats``, scored by a select for each layer, and taken back.

    ``stats``: mean and std of each input and output, as ``scaling.literals`` gives them; categories have none and go in as they are.
    """
    scaled = [(transform(c, stats) if c in stats else F.col(c).cast("double")).alias(f"_z{i}") for i, c in enumerate(inputs)]
    names = ["_p"] if len(outputs) == 1 else [f"_p{j}" for j in range(len(outputs))]
    scored = score(df.select(*keep, *scaled), [f"_z{i}" for i in range(len(inputs))], layers, keep, "_p")
    return scored.select(*keep, *[inverse(F.col(n), o, stats).alias(o) for n, o in zip(names, outputs)])
