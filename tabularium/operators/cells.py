"""Cells to values with every error kept: one pass gives the good rows and a relation of what is wrong with the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import NUMBER, is_missing, parse_code, parse_number, trimmed
from .schema import Field

#: Reasons, in the order in which a cell is judged.
WIDTH, EMPTY, LEVEL, TEXT, INFINITE_ = "wrong number of cells", "empty", "unknown level", "not a number", "not finite"
_NO_FINITE = r"(?i)^[+-]?(inf|infinity|nan)$"


def cell_reason(cell: Column, field: Field, codes_allowed: bool = False) -> Column:
    """Why a cell has no value for the field; null if it has one."""
    value = cell_value(cell, field, codes_allowed)
    if field.levels is not None:
        wrong = F.lit(LEVEL)
    else:
        wrong = F.when(trimmed(cell).rlike(_NO_FINITE) | trimmed(cell).rlike(NUMBER), INFINITE_).otherwise(TEXT)
    return F.when(is_missing(cell), EMPTY).when(value.isNull(), wrong)


def cell_value(cell: Column, field: Field, codes_allowed: bool = False) -> Column:
    return parse_number(cell) if field.levels is None else parse_code(cell, list(field.levels), codes_allowed).cast("double")


def parsed(rows: DataFrame, fields: Sequence[Field], codes_allowed: bool = False, keep: Sequence[str] = ("row_no",)) -> DataFrame:
    """``keep``, a column for each field, and errors: array of (column, place, cell, reason), empty for a row that can be used.

    ``rows`` has ``cells``, an array of text. A row of another width has one error, without a column; null cells are empty ones. Nothing is
    left out: take ``good`` and ``errors`` of the result.
    """
    cell = lambda i: F.get("cells", F.lit(i))
    each = [F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("place"), cell(i).alias("cell"), cell_reason(cell(i), f, codes_allowed).alias("reason")) for i, f in enumerate(fields)]
    width = F.coalesce(F.size("cells"), F.lit(0))
    other = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("int").alias("place"), width.cast("string").alias("cell"), F.lit(WIDTH).alias("reason")))
    errors = F.when(width != len(fields), other).otherwise(F.filter(F.array(*each), lambda e: e["reason"].isNotNull()))
    return rows.select(*keep, *[cell_value(cell(i), f, codes_allowed).alias(f.name) for i, f in enumerate(fields)], errors.alias("errors"))


def good(rows: DataFrame) -> DataFrame:
    """Rows of ``parsed`` without errors."""
    return rows.where(F.size("errors") == 0).drop("errors")


def errors(rows: DataFrame, keep: Sequence[str] = ("row_no",)) -> DataFrame:
    """``keep``, column, place, cell, reason: a row for each error of ``parsed``."""
    return rows.select(*keep, F.inline("errors"))
