"""Texts as characters: vocabularies, codes and windows of a context and what follows it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """ch, n, id: every character that occurs, how often, and its place in byte order; a row for each character of the scripts in use."""
    counts = df.select(F.explode(characters(F.col(text))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("ch", "n", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ch")) - 1).alias("id"))


def encode(df: DataFrame, row_id: str, text: str, known: DataFrame) -> DataFrame:
    """row_id, codes: each text as ids of its characters in order; a character that isn't known is null."""
    each = df.select(F.col(row_id).alias("row_id"), F.posexplode_outer(characters(F.col(text))).alias("at", "ch"))
    # a row for each character: Unicode has 1,114,112
    coded = each.join(F.broadcast(known.groupBy("ch").agg(F.min("id").alias("id"))), "ch", "left")
    held = coded.groupBy("row_id").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "id")))).alias("_c"))
    return held.select("row_id", F.transform("_c", lambda s: s["id"]).alias("codes"))


def decode(df: DataFrame, codes: str, known: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, text of lists of ids; ids that aren't known are left out."""
    alphabet = known.groupBy("id").agg(F.min("ch").alias("ch")).agg(F.array_sort(F.collect_list(F.struct("id", "ch"))).alias("_a")).select(F.transform("_a", lambda s: s["ch"]).alias("_a"))
    return df.join(F.broadcast(alphabet)).select(*keep, F.array_join(F.transform(codes, lambda i: F.get("_a", i)), "").alias("text"))


def windows(df: DataFrame, text: str, context: int = 1) -> DataFrame:
    """context, following: every run of ``context`` characters with the character after it, within a text."""
    if context < 1:
        raise ValueError("a context has a character at least")
    own = df.select(characters(F.col(text)).alias("c")).where(F.size("c") > context)
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - context), lambda i: F.struct(F.array_join(F.slice("c", i, F.lit(context)), "").alias("context"), F.get("c", i + (context - 1)).alias("following")))
    return own.select(F.inline(pairs))


#: Characters that a task counts at once, and unlike windows that it holds before they go on.
PIECE, HELD = 1 << 20, 1 << 18


def counted(texts: list[str], context: int) -> Counter:
    """How often each run of ``context + 1`` characters occurs within the texts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    n = len(points) - context
    if n < 1:
        return Counter()
    seen = np.zeros(0x110000, np.int64)
    seen[points] = 1
    size = int(seen.sum())
    ids = (np.cumsum(seen) - 1)[points]
    code, codes = ids[:n], size
    for k in range(1, context + 1):
        if codes * size >= 1 << 62:
            own, code = np.unique(code, return_inverse=True)
            codes = len(own)
        code, codes = code * size + ids[k : k + n], codes * size
    starts, inside = np.arange(n), np.ones(n, bool)
    ends = np.cumsum([len(t) for t in texts])[:-1]
    for k in range(1, context + 1):  # windows that would go on into the next text
        across = ends - k
        inside[across[(across >= 0) & (across < n)]] = False
    code, starts = code[inside], starts[inside]
    if codes <= 4 * PIECE:
        times, at = np.bincount(code, minlength=codes), np.zeros(codes, np.int64)
        at[code] = starts
        hit = np.flatnonzero(times)
        times, at = times[hit], at[hit]
    else:
        _, first, times = np.unique(code, return_index=True, return_counts=True)
        at = starts[first]
    rows = points[at[:, None] + np.arange(context + 1)]
    return Counter({row.tobytes().decode("utf-32-le"): int(k) for row, k in zip(rows, times)})


def transitions(df: DataFrame, text: str, context: int = 1) -> DataFrame:
    """context, following, n: how often each run of ``context`` characters is followed by a character within a text.

    As counting ``windows``, without a row for each: tasks count pieces of a million characters, Spark adds the counts.
    """
    if context < 1:
        raise ValueError("a context has a character at least")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                own = value.as_py().decode("utf-8", "replace")
                # a long text goes in pieces that share ``context`` characters
                for i in range(0, max(1, len(own) - context), PIECE):
                    held.append(own[i : i + PIECE + context])
                    size += len(held[-1])
                    if size >= PIECE:
                        yield held
                        held, size = [], 0
        yield held

    def table(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"context": [w[:-1] for w in found], "following": [w[-1] for w in found], "n": list(found.values())}, pa.schema([("context", pa.string()), ("following", pa.string()), ("n", pa.int64())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for texts in pieces(batches):
            found.update(counted(texts, context))
            if len(found) > HELD:
                yield table(found)
                found = Counter()
        yield table(found)

    parts = df.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "context string, following string, n long")
    return parts.groupBy("context", "following").agg(F.sum("n").alias("n"))
