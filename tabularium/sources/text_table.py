"""Raw text tables: lines to cells, headers, typed text files. Cells stay text until a schema asks for numbers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import trimmed

def uncommented(line: Column) -> Column:
    """The line up to its first #, also within quotes: there is no quoting here."""
    return F.regexp_extract(line, r"^[^#]*", 0)


def split_cells(line: Column, delimiter: str) -> Column:
    """Cells of a line, trimmed, empty ones kept; ``delimiter`` is ',', a tab or '' for runs of blanks."""
    own = uncommented(line)
    parts = F.split(trimmed(own), r"(?U)\s+", -1) if delimiter == "" else F.split(own, delimiter, -1)
    return F.transform(parts, trimmed)


def surviving(lines: DataFrame) -> DataFrame:
    """(row_no, value) lines that are not blank once comments are gone."""
    return lines.where(trimmed(uncommented(F.col("value"))) != "")


def detect_delimiter(line: str) -> str:
    """Comma, else tab, else blanks: decided on the first line that survives."""
    return next((d for d in (",", "\t") if d in line), "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_no from 1, value) of the lines of a text file, or of a folder's files in order of their names.

    Spark's text source has no line numbers, but ids that rise by one within a partition: a line's number is its id, less the least of its file
    split, plus the lines of the splits before. The splits' least ids and sizes are a row for each split, so lines aren't shuffled. They are
    counted while the plan is made and held by the driver, so that what reads the lines later needn't count them again.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.when(F.col("value").endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value")).alias("value"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("_id"),
    )
    sizes = lines.groupBy("file", "at").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = sizes.select("file", "at", (before - F.col("_least") + 1).alias("_start"))
    start = spark.createDataFrame(start.collect(), "file string, at long, _start long")
    return lines.join(F.broadcast(start), ["file", "at"]).select((F.col("_id") + F.col("_start")).cast("long").alias("row_no"), "value")


@dataclass
class Table:
    """A raw table: cells by physical row number, its header if it has one, and where it came from."""

    rows: DataFrame
    header: list[str] | None
    source: str
    header_row: int | None = None
    delimiter: str = ","
    sheet: str | None = None
    n_columns: int = field(default=0)


def read_table(spark: SparkSession, path: str, has_header: bool = True, delimiter: str | None = None) -> Table:
    lines = surviving(numbered_lines(spark, path))
    top = lines.orderBy("row_no").limit(2).collect()
    if not top:
        raise ValueError(f"{path}: no rows")
    first = top[0]
    delimiter = detect_delimiter(first["value"].split("#")[0]) if delimiter is None else delimiter
    cells = lines.select("row_no", split_cells(F.col("value"), delimiter).alias("cells"))
    head = spark.createDataFrame([(first["value"],)], "value string").select(split_cells(F.col("value"), delimiter)).first()[0]
    if has_header:
        cells = cells.where(F.col("row_no") > first["row_no"])
        if len(top) == 1:
            raise ValueError(f"{path}: a header and no rows")
    return Table(cells, head if has_header else None, path, first["row_no"] if has_header else None, delimiter, None, len(head))


def preview(table: Table, n: int = 20) -> DataFrame:
    """The first rows."""
    return table.rows.orderBy("row_no").limit(n)


def ragged_examples(table: Table, n: int = 5) -> list[int]:
    """The first rows of another width, by their place in the file."""
    return [r["row_no"] for r in ragged_rows(table).orderBy("row_no").limit(n).collect()]


def ragged_rows(table: Table) -> DataFrame:
    """row_no, cells of rows whose number of cells is not that of the first."""
    return table.rows.where(F.size("cells") != table.n_columns)


# ---- inference from names and values


#: Words in the names of categorical inputs.
CATEGORY_WORDS = ("material", "category", "class")


def output_start(header: list[str]) -> int | None:
    """Place of the first output: y, y<digits> or out*, after the first column; all later columns are outputs too."""
    for i, name in enumerate(header):
        low = name.strip().lower()
        if i and (low == "y" or low[:1] == "y" and low[1:].isdigit() or low.startswith("out")):
            return i
    return None


def categorical_by_name(name: str) -> bool:
    low = name.strip().lower()
    return low == "id" or low.endswith("_id") or any(w in low for w in CATEGORY_WORDS)


def category_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, is_category, cardinality: columns of whole numbers from nought (within 1e-4), whose cardinality is the largest plus one."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        whole = F.coalesce(F.min(((x >= 0) & (F.abs(x - F.round(x)) <= 1e-4)).cast("int")), F.lit(0)) == 1
        parts.append(F.struct(F.lit(c).alias("column"), whole.alias("is_category"), F.when(whole, F.round(F.max(x)).cast("long") + 1).alias("cardinality")))
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


# ---- typed text files

#: The first word of a typed file.
MAGIC = ("TRNUM1", "TRNUM2")


def data_lines(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """row_id, line: values of a row in order, parted by one blank."""
    return df.select(F.col(row_id).alias("row_id"), F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("line"))


def bad_codes(df: DataFrame, row_id: str, cards: dict[str, int]) -> DataFrame:
    """row_id, column, value of codes that are not whole within 1e-4 or not in [0, n)."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"), F.lit(n).alias("n")) for c, n in cards.items()])
    wrong = F.filter(each, lambda s: s["value"].isNull() | (F.abs(s["value"] - F.round(s["value"])) > 1e-4) | (F.round(s["value"]) < 0) | (F.round(s["value"]) >= s["n"]))
    return df.select(F.col(row_id).alias("row_id"), F.explode(wrong).alias("s")).select("row_id", "s.column", "s.value")
