"""Profiles of raw tables: missing and non-numeric cells, levels, constants, duplicate rows, affine dependencies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import is_missing, is_number, trimmed

#: Levels that a category has at most; thresholds of affine dependencies.
MOST_LEVELS = 256
EXACT, NEAR, LEAST_ROWS, LEAST_FREEDOM = 0.999999, 0.999, 10, 5


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unpivot to (column, cell), cells as text."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) as (column, cell)")


def profile_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, total, missing, non_numeric, distinct_values (null above 256), is_numeric, is_constant."""
    values = cells(df, columns).select("column", trimmed(F.coalesce("cell", F.lit(""))).alias("cell"))
    per_value = values.groupBy("column", "cell").agg(F.count(F.lit(1)).alias("n"))
    missing, number = is_missing(F.col("cell")), is_number(F.col("cell"))
    out = per_value.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("missing"),
        F.sum(F.when(~missing & ~number, F.col("n")).otherwise(0)).alias("non_numeric"),
        F.sum(F.when(missing, 0).otherwise(1)).alias("kinds"),
    )
    return out.select(
        "column", "total", "missing", "non_numeric",
        F.when(F.col("kinds") <= MOST_LEVELS, F.col("kinds")).alias("distinct_values"),
        ((F.col("non_numeric") == 0) & (F.col("missing") < F.col("total"))).alias("is_numeric"),
        ((F.col("missing") == 0) & (F.col("kinds") == 1)).alias("is_constant"),
    )


def profile_messages(profile: DataFrame) -> DataFrame:
    """severity, column, message: what a reader of the profile should know."""
    notes = F.array(
        F.when(F.col("missing") > 0, F.struct(F.lit("Warning").alias("severity"), F.concat(F.col("missing").cast("string"), F.lit(" missing cells")).alias("message"))),
        F.when((F.col("non_numeric") > 0), F.struct(F.lit("Warning").alias("severity"), F.concat(F.col("non_numeric").cast("string"), F.lit(" non-numeric cells")).alias("message"))),
        F.when(F.col("is_constant"), F.struct(F.lit("Note").alias("severity"), F.lit("constant column").alias("message"))),
    )
    return profile.select("column", F.explode(F.filter(notes, lambda n: n.isNotNull())).alias("m")).select("m.severity", "column", "m.message")


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """total_rows, distinct_rows, duplicate_rows."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows"))


def category_levels(df: DataFrame, column: str) -> DataFrame:
    """level, code: levels in numeric order if all are numbers, else in byte order; an error beyond ``MOST_LEVELS``.

    The levels are cut to one more than those before they meet in one row, so that none grows with the table.
    """
    text = F.col(column).cast("string")
    levels = df.where(~is_missing(text)).select(trimmed(text).alias("level")).distinct().limit(MOST_LEVELS + 1)
    held = levels.agg(F.collect_set("level").alias("v"), F.min(is_number(F.col("level")).cast("int")).alias("numeric"))
    by_number = F.array_sort(F.transform("v", lambda x: F.struct(x.try_cast("double").alias("n"), x.alias("level"))))
    ordered = F.when(F.col("numeric") == 1, F.transform(by_number, lambda s: s["level"])).otherwise(F.array_sort("v"))
    few = F.when(F.size("v") <= MOST_LEVELS, ordered).otherwise(F.raise_error(F.lit(f"{column}: more than {MOST_LEVELS} levels")).cast("array<string>"))
    return held.select(F.posexplode(few).alias("code", "level")).select("level", "code")


def label_encode(df: DataFrame, column: str, levels: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and code of each row; an unknown level has a null code. More levels than a category may have are an error, so the broadcast is bounded."""
    counted = levels.limit(MOST_LEVELS + 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    known = counted.where(F.when(F.col("_n") <= MOST_LEVELS, True).otherwise(F.raise_error(F.lit(f"{column}: more than {MOST_LEVELS} levels")).cast("boolean"))).drop("_n")
    return df.join(F.broadcast(known), trimmed(F.col(column).cast("string")) == F.col("level"), "left").select(*keep, F.col("code").cast("int").alias("code"))


# ---- affine dependencies


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, centred products) of rows that have every column, in two passes of p and p*p sums."""
    own = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    p = len(columns)
    first = own.agg(F.count(F.lit(1)), *[F.avg(f"c{i}") for i in range(p)]).first()
    n, means = first[0], np.array([x or 0.0 for x in first[1:]])
    centred = [F.col(f"c{i}") - F.lit(float(means[i])) for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = own.agg(*[F.coalesce(F.sum(centred[i] * centred[j]), F.lit(0.0)) for i, j in pairs]).first()
    out = np.zeros((p, p))
    for (i, j), v in zip(pairs, sums):
        out[i, j] = out[j, i] = v
    return n, means, out


def fit_affine(n: int, means: np.ndarray, products: np.ndarray, target: int, terms: list[int]) -> tuple[np.ndarray, float, float] | None:
    """(coefficients, intercept, R2) of the target on the terms, from standardised normal equations; None if singular."""
    if products[target, target] <= 0:
        return None
    scale = np.sqrt(np.maximum(np.diag(products), 1e-300))
    a = products[np.ix_(terms, terms)] / np.outer(scale[terms], scale[terms])
    b = products[terms, target] / (scale[terms] * scale[target])
    a = a + 1e-12 * max(1e-300, np.diag(a).max(initial=0)) * np.eye(len(terms))
    try:
        z = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None
    coefficients = z * scale[target] / scale[terms]
    r2 = 1.0 - max(0.0, 1.0 - 2 * z @ b + z @ (products[np.ix_(terms, terms)] / np.outer(scale[terms], scale[terms])) @ z)
    return coefficients, float(means[target] - coefficients @ means[terms]), float(r2)


def explained(products: np.ndarray, pool: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(R2 of each column of the pool on the pool's others, coefficients in units of spreads) from one inverse of the correlations.

    With B the inverse, column i is explained up to ``1 / B_ii`` of its spread, by ``-B_ij / B_ii``. A ridge of 1e-12 stands for the
    places of exact ties.
    """
    scale = np.sqrt(np.maximum(np.diag(products)[pool], 1e-300))
    inverse = np.linalg.inv(products[np.ix_(pool, pool)] / np.outer(scale, scale) + 1e-12 * np.eye(len(pool)))
    weights = -inverse / np.diag(inverse)[:, None]
    np.fill_diagonal(weights, 0.0)
    return 1.0 - 1.0 / np.diag(inverse), weights * scale[:, None] / scale[None, :]


def affine_dependencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """target, terms, intercept, r2, is_exact: inputs that the others give. Columns are tried in order; one that is found explains no later one.

    p by p sums come to the driver, whatever the rows; they say which columns are tied. R2 of those is taken from the residuals in one more
    pass over the rows, because products of near-exact fits cancel.
    """
    n, means, products = gram(df, columns)
    spread = np.diag(products)
    pool = [i for i in range(len(columns)) if spread[i] > 1e-24 * max(means[i] ** 2, 1e-300) * max(n, 1)]
    found, stale = [], True
    for target in list(pool) if n >= LEAST_ROWS else []:
        if len(pool) < 2 or n < len(pool) + LEAST_FREEDOM:
            continue
        if stale:
            r2, weights = explained(products, pool)
            stale = False
        at = pool.index(target)
        if r2[at] >= NEAR - 1e-9:
            own = {pool[j]: float(weights[at, j]) for j in range(len(pool)) if abs(weights[at, j]) > 1e-9}
            found.append((target, own, float(means[target] - sum(k * means[j] for j, k in own.items()))))
            pool.remove(target)
            stale = True
    schema = "target string, terms array<struct<column:string,coefficient:double>>, intercept double, r2 double, is_exact boolean"
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    own = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    errors = [F.col(f"c{t}") - F.lit(d) - sum((F.col(f"c{j}") * F.lit(k) for j, k in terms.items()), F.lit(0.0)) for t, terms, d in found]
    left = own.agg(*[F.sum(e * e) for e in errors]).first()
    rows = []
    for (target, terms, intercept), sse in zip(found, left):
        r2 = float(1.0 - sse / spread[target])
        if r2 >= NEAR:
            rows.append((columns[target], [(columns[j], k) for j, k in sorted(terms.items())], intercept, r2, r2 >= EXACT))
    return df.sparkSession.createDataFrame(rows, schema)


def coefficient_text(value: Column) -> Column:
    """At most six decimals without closing noughts."""
    text = F.regexp_replace(F.format_string("%.6f", F.round(value, 6)), r"\.?0+$", "")
    return F.when(text.isin("-0", ""), "0").otherwise(text)


def dependency_notes(dependencies: DataFrame) -> DataFrame:
    """severity, column, message: a note for each tie of inputs, since formulas and sensitivities by tied inputs are ambiguous."""
    size = lambda t: coefficient_text(F.abs(t["coefficient"]))
    shown = F.filter("terms", lambda t: size(t) != "0")
    terms = F.array_join(F.transform(shown, lambda t: F.concat(F.when(t["coefficient"] < 0, " - ").otherwise(" + "), size(t), F.lit("·"), t["column"])), "")
    how = F.when(F.col("is_exact"), "exactly").otherwise("nearly")
    message = F.concat(F.lit("tied "), how, F.lit(" to other inputs: "), F.col("target"), F.lit(" ≈ "), coefficient_text(F.col("intercept")), terms, F.lit(" (R2 = "), F.format_string("%.6f", "r2"), F.lit(")"))
    return dependencies.select(F.lit("Note").alias("severity"), F.col("target").alias("column"), message.alias("message"))


def affine_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, slope, intercept, r2 of every pair of columns, in one aggregate."""
    pairs = [(a, b) for a in columns for b in columns if a < b]
    parts = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2")) for a, b in pairs]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
