"""Periodic runs of words: tiles per octave of periods, solved with Z-functions at their boundary and stitched.

A run is a maximal stretch of words with smallest period q, at least ``max(6, 4 * q)`` words long. Where words q apart are equal, a run of
period q shows as a stretch of ``max(6, 4 * q) - q`` equal pairs or more, so boundaries 2 * 2**k apart (octave k: periods from 2**k to
below 2**(k + 1)) meet each such stretch with some words of it to their right. A document is exploded into the tiles around boundaries
whose next words recur one period of the octave further (every run has such boundaries; text without repeats has almost none). A tile is solved on its
own by two Z-functions from its boundary, to the right and to the left, which give the equal stretch through the boundary for every period
of the octave as far as the tile goes; a period whose words repeat a divisor of it isn't a smallest one, which the first Z-function says too. The
tiles overlap by a boundary's distance, so fragments of one stretch touch: they are shuffled by (document, period) and stitched to whole
stretches. Tiles that lie side by side go in one row, so that overlapping words are sent once. Of periods with the same stretch of words the smallest one is the run's.

Edge cases: null and empty texts have no words; a null id is an id; equal rows have equal results; unlike texts of one id are told apart by
their hash; a very long text has many small tiles, dealt to many tasks; an empty table gives an empty one; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

LEAST, POWER = 6, 4
#: Words of a row of tiles, about.
ROW = 1 << 12
#: Words that must recur at a boundary: at most as many that boundaries 2 * 2**k apart still meet every stretch.
GRAM = 8


def words(text: str | None) -> list[bytes]:
    """Stretches of other bytes than blanks (20, 09 to 0D)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(found: list) -> np.ndarray:
    """A number for each word, equal for equal words."""
    ids: dict = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, len(found))


def _gram(octave: int) -> int:
    return (4, 3)[octave] if octave < 2 else min((1 << octave) + 1, GRAM)


def candidates(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(octave, boundary) of all tiles that may hold a stretch of a run: the boundary's gram recurs one period later."""
    n, grams = len(ids), {}
    for octave in range(64):
        base, gram = 1 << octave, _gram(octave)
        if POWER * base > n or n < LEAST:
            return
        if gram not in grams:
            hashed = np.zeros(n - gram + 1, np.uint64)
            for j in range(gram):
                hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + ids[j : n - gram + 1 + j].astype(np.uint64)
            grams[gram] = hashed
        held, step = grams[gram], 2 * base
        at = np.arange(0, max(0, len(held) - base), step)
        if not len(at):
            continue
        later = np.resize(held, len(at) * step + base) if len(held) < len(at) * step + base else held
        near = np.lib.stride_tricks.as_strided(later[base:], (len(at), base), (step * later.itemsize, later.itemsize), writeable=False)
        hit = (near == held[at][:, None]).any(axis=1)
        hit[-1] = (held[at[-1] + base : at[-1] + step] == held[at[-1]]).any()  # only the last row may reach beyond the end
        for boundary in at[hit].tolist():
            yield octave, boundary


def tile_bounds(n: int, octave: int, boundary: int) -> tuple[int, int]:
    """Words of a tile: pairs from one step before the boundary to one step and a gram after it, and their partners."""
    step = 2 << octave
    return max(0, boundary - step), min(n, boundary + step + _gram(octave) + step)


def z_function(x: list) -> list[int]:
    """Length of the longest common prefix of x and each of its suffixes."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def tile_rows(ids: np.ndarray) -> Iterator[tuple[int, list[int], int, int]]:
    """(octave, boundaries, first word, last word + 1): tiles side by side together, a row of about ``ROW`` words or of one tile."""
    held: tuple[int, list[int], int, int] | None = None
    for octave, boundary in candidates(ids):
        a, b = tile_bounds(len(ids), octave, boundary)
        if held and held[0] == octave and boundary - held[1][-1] <= 2 << octave and b - held[2] <= max(ROW, 8 << octave):
            held[1].append(boundary)
            held = (octave, held[1], held[2], b)
        else:
            if held:
                yield held
            held = (octave, [boundary], a, b)
    if held:
        yield held


def primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def solve(tile: list[int], first: int, octave: int, boundary: int) -> list[tuple[int, int, int]]:
    """(period, begin, end) of the equal pairs through the boundary, as far as the tile sees; stretches that end within it and are too short are left out.

    So are periods whose words from the boundary on repeat a divisor of the period: the whole stretch does then.
    """
    base, at = 1 << octave, boundary - first
    periods = [q for q in range(base, 2 * base) if at + q < len(tile) and tile[at] == tile[at + q]]
    if not periods:
        return []
    most = 2 * base + _gram(octave)
    ahead = z_function(tile[at : at + most + 2 * base])
    periods = [q for q in periods if not any(ahead[q // r] >= q - q // r for r in primes(q))]
    if not periods:
        return []
    head = tile[:at][::-1]
    behind = z_function([*head, -1, *tile[: at + 2 * base - 1][::-1]])
    out = []
    for q in periods:
        right = min(ahead[q], most)
        turned = len(head) + 1 + (min(len(tile), at + 2 * base - 1) - (at + q))  # where the words before boundary + q begin, read backwards
        left = min(behind[turned], len(head)) if head and turned < len(behind) else 0
        cut = left == len(head) and first > 0 or right == most
        if cut or left + right >= max(LEAST, POWER * q) - q:
            out.append((q, boundary - left, boundary + right))
    return out


def solve_row(words_: list[int], first: int, octave: int, boundaries: list[int]) -> list[tuple[int, int, int]]:
    """The fragments of all tiles of a row, each solved on its own; those of one period that touch are joined."""
    found: dict[int, list[list[int]]] = {}
    step = 2 << octave
    for boundary in boundaries:
        a, b = max(first, boundary - step), min(first + len(words_), boundary + 2 * step + _gram(octave))
        for q, begin, end in solve(words_[a - first : b - first], a, octave, boundary):
            own = found.setdefault(q, [])
            while own and begin <= own[-1][1]:  # boundaries rise, so only the last ones can touch
                last = own.pop()
                begin, end = min(begin, last[0]), max(end, last[1])
            own.append([begin, end])
    return [(q, begin, end) for q, own in found.items() for begin, end in own]


# ---- Spark jobs

_TILE = "id {kind}, key binary, octave int, first int, boundaries binary, words binary, text string"


def _key(docs: DataFrame) -> DataFrame:
    """id, text and a hash of both: equal rows have equal keys."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(F.col("doc_id").alias("id"), F.unhex(F.md5(named.cast("binary"))).alias("key"), F.col("text").cast("string").alias("text"))


def _tiles(doc: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    same = [pa.array([doc.column(i)[0].as_py()] * len(rows), doc.column(i).type) for i in (0, 1)]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([*same, *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], ["id", "key", "octave", "first", "boundaries", "words", "text"])


def tiles(docs: DataFrame) -> DataFrame:
    """Rows of documents that may hold runs: one with the text (octave null) and one for each row of tiles (words and boundaries as packed numbers)."""
    schema = _TILE.format(kind=docs.schema["id"].dataType.simpleString())

    def run(batches):
        for batch in batches:
            for at in range(len(batch)):
                doc, text = batch.slice(at, 1), batch.column(2)[at].as_py()
                ids = numbered(words(text))
                rows: list[tuple] = []
                size = n = 0
                for octave, boundaries, a, b in tile_rows(ids):
                    rows.append((octave, a, np.array(boundaries, np.int32).tobytes(), ids[a:b].astype(np.int32).tobytes(), None))
                    n, size = n + 1, size + b - a
                    if size > 1 << 20:
                        yield _tiles(doc, rows)
                        rows, size = [], 0
                if n:
                    yield _tiles(doc, [*rows, (None, None, None, None, text)])

    return docs.mapInArrow(run, schema)


def fragments(tiles_of: DataFrame) -> DataFrame:
    """key, period, begin, end of each tile's equal stretches."""

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for key, octave, first, boundaries, held in zip(*(c.to_pylist() for c in batch.columns)):
                found = solve_row(np.frombuffer(held, np.int32).tolist(), first, octave, np.frombuffer(boundaries, np.int32).tolist())
                rows += found
                keys += [key] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([r[i] for r in rows], pa.int32()) for i in range(3))], ["key", "period", "begin", "end"])

    return tiles_of.select("key", "octave", "first", "boundaries", "words").mapInArrow(run, "key binary, period int, begin int, end int")


def stitch(found: DataFrame) -> DataFrame:
    """key, start, length, period of each run: touching fragments joined, short ones left out, the smallest period of each stretch of words."""
    order = Window.partitionBy("key", "period").orderBy("begin", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", F.when(F.col("begin") <= reached, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    whole = islands.groupBy("key", "period", "island").agg(F.min("begin").alias("start"), (F.max("end") + F.col("period") - F.min("begin")).alias("length"))
    return whole.where((F.col("length") >= LEAST) & (F.col("length") >= POWER * F.col("period"))).groupBy("key", "start", "length").agg(F.min("period").alias("period"))


_RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _result(kind: str) -> str:
    return f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs {_RUN}, collapsed string"


def collapse(found: list[bytes], runs: list[dict]) -> list[bytes]:
    """Words that no run repeats: of each run's words the first period stays, unless another run repeats it."""
    keep = np.ones(len(found), bool)
    for r in runs:
        keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
    return [w for w, k in zip(found, keep.tolist()) if k]


def strongest(runs: list[dict]) -> dict | None:
    """The run with the greatest exact length / period; of equal ones the first, then the shortest period."""
    return min(runs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)


def _rows(ids: pa.Array, rows: list[tuple[str | None, list[dict]]], kind: str) -> pa.RecordBatch:
    best = [strongest(runs) for _, runs in rows]
    of = lambda f: pa.array([None if r is None else f(r) for r in best], pa.int64())
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kept = [b" ".join(collapse(words(text), runs)).decode("utf-8", "surrogatepass") for text, runs in rows]
    return pa.RecordBatch.from_arrays([
        ids, pa.array([len(runs) for _, runs in rows], pa.int64()), of(lambda r: r["start"]), of(lambda r: r["length"]), of(lambda r: r["period"]),
        of(lambda r: 1000 * r["length"] // r["period"]), pa.array([runs for _, runs in rows], run), pa.array(kept, pa.string()),
    ], [c.split(" ")[0] for c in _result(kind).split(", ")])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_runs; start, length, period and exponent_milli of the strongest run; all runs in order; the text without repeats.

    Documents without a candidate tile come straight from their task. Of the others the texts and tiles are staged in the shared
    folder, tiles are dealt to tasks of their own, and the runs found meet the texts again by key.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = _key(docs)

    def plain(batches):
        for batch in batches:
            held = [t.as_py() for t in batch.column(2)]
            clean = [i for i, t in enumerate(held) if next(candidates(numbered(words(t))), None) is None]
            yield _rows(batch.column(0).take(pa.array(clean, pa.int64())), [(held[i], []) for i in clean], kind)

    def joined(batches):
        for batch in batches:
            yield _rows(batch.column(0), list(zip(batch.column(1).to_pylist(), ([] if r is None else r for r in batch.column(2).to_pylist()))), kind)

    cut = staged(tiles(docs), "tiles", compression="zstd")
    dealt = cut.where(F.col("octave").isNotNull()).repartition("key", "octave", "first")
    each = F.struct(*(F.col(c).cast("long").alias(c) for c in ("start", "length", "period")))
    found = stitch(fragments(dealt)).groupBy("key").agg(F.sort_array(F.collect_list(each)).alias("runs"))
    texts = cut.where(F.col("octave").isNull()).select("id", "key", "text")
    with_runs = texts.join(found, "key", "left").select("id", "text", "runs").mapInArrow(joined, _result(kind))
    return docs.mapInArrow(plain, _result(kind)).unionByName(with_runs)


# ---- the query's documents


def replayed(text: Column, doc_id: Column) -> Column:
    """The query's texts: of every id with h % 10 = 0 the words from a on repeat the p words from there (h: CRC-32 of the decimal id)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / F.lit(10)).cast("long")
    def again(found: Column) -> Column:
        n = F.greatest(F.size(found), F.lit(1)).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        place = F.sequence(F.lit(0).cast("long"), n - 1)
        at = F.transform(place, lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.element_at(found, (i + 1).cast("int"))), " ")

    # the words are the only element of an array, so that they are found once and not for each place
    found = F.array(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    changed = (h % 10 == 0) & F.coalesce(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    return F.when(changed, F.element_at(F.transform(found, again), 1)).otherwise(text)


def runs_text(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
