"""Line dedup with DataFrame functions only: explode, hash, count documents per hash, drop, reassemble.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case. Keys of
at least ``min_chars`` code points found in at least ``min_docs`` documents lose their lines in every
document but the one of smallest id.

Lines are read and hashed once and staged as two hashes with their place; documents then meet their dropped places
and take the others in order, in time that grows with their lines.

Edge cases: null and empty texts are one empty line; repeated rows of one id count as one document; rows
without an id hold no key, so they neither drop nor cause drops; a text may have any number of lines and of dropped ones;
of a key's documents the smallest id keeps all its lines, also where it has several; an empty table gives an empty result;
extra columns are ignored. A key's rows meet as partial counts, and the join that finds the lines again
is one that Spark splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """doc_id, text_hash, line_no of each line to drop."""
    lines = (
        docs.where("doc_id is not null and length(text) >= %d" % min_chars)
        .select("doc_id", _text_hash().alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .select("doc_id", "text_hash", "line_no", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "line_no", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))
    )
    lines = staged(lines, "lines")
    if min_docs == 2:
        keys = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last")
    else:
        keys = (
            lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
            .groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
        )
    # staged, so that Spark can split the rows of a hot key in the join
    keys = staged(keys.select("h1", "h2", "keeper"), "line-keys")
    return (
        lines.join(keys, ["h1", "h2"])
        .where("doc_id > keeper")
        .select("doc_id", "text_hash", "line_no")
    )


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, text (what is left)."""
    drops = (
        repeated_lines(docs, min_chars, min_docs)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("line_no").alias("gone"))
    )
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _text_hash().alias("text_hash"))
    joined = whole.join(drops, ["doc_id", "text_hash"], "left").select("doc_id", "text", "gone", F.split("text", "\n").alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
    )
