"""Repeated passages across documents, by sorting suffixes with prefix hashes.

A byte goes if a ``span``-byte string that covers it also starts in a document of smaller id. Every such
string holds an anchor: the ``gram``-byte string of least hash in it, at the same place in all its copies.
So only suffixes at anchors are sorted, and of those only the ones whose anchor is in two documents:

1. anchors of each document, dealt out by hash in packed runs; those of two documents at least stay;
2. their surroundings meet by anchor. Within a task the suffixes are put in order by a mergesort whose
   comparisons find the common extension by binary search over prefix polynomial hashes. Neighbours'
   extensions then give, for each length, the runs of suffixes that share it; with the hash of the bytes
   before the anchor they give each ``span``-byte string's documents. Bytes are compared before any removal;
3. documents drop the bytes that were found.

Equal texts are one text of their least id throughout: in the others all bytes go if there are ``span``.
Texts are dealt out by id in one exchange that the three steps share. Of equal surroundings that documents of one task
have, only those of the least id go on: the others' strings are all in that document. So an anchor of a passage that
very many documents share is a row for each task and not for each document. An anchor's surroundings are sorted
by anchor outside of memory and worked on in runs of whole anchors; equal suffixes cost one comparison. Anchors meet in
buckets whose number grows with the bytes of the input.

Edge cases: null is the empty text; texts under ``span`` bytes keep all bytes; rows without an id keep all
bytes and remove none; repeated rows give repeated results; unlike texts of one id are documents of their own, neither before the
other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged
from .textkit import U64, blocks, mix, prefix_hash, slice_hash

SPAN, GRAM = 50, 24
FLUSH = 1 << 20
#: Bytes of text for each bucket of anchors, and buckets at most; surroundings that a task remembers, if so many documents of a block had them.
BUCKET_BYTES, BUCKETS = 13 << 20, 1 << 18
REMEMBERED, OFTEN = 4096, 4


# ---- anchors


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every run of ``width`` values."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are least in some window of ``span`` bytes; windows stay within texts.

    ``ends``: where each text ends in ``data``. Of equal least hashes all count.
    """
    if len(data) < span:
        return np.empty(0, np.int64), np.empty(0, U64)
    width = span - gram + 1
    at = np.arange(len(data) - gram + 1)
    hashed = mix(slice_hash(prefix_hash(data), at, at + gram))
    least = _slide(hashed, width, np.minimum)
    crossing = np.zeros(len(data) + 1, np.int64)  # windows that begin within span - 1 of a text's end
    begins = np.concatenate([[0], ends[:-1]])
    np.add.at(crossing, np.maximum(begins, ends - span + 1), 1)
    np.add.at(crossing, ends, -1)
    least = np.where(np.cumsum(crossing)[: len(least)] > 0, U64(0), least)
    edge = np.zeros(width - 1, U64)
    spots = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum)[: len(hashed)] == hashed)
    return spots, hashed[spots]


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))


# ---- suffix order


def common(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b share, ``most`` at most: binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = slice_hash(prefix, a, a + middle) == slice_hash(prefix, b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_order(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of suffixes (start, length) by group and then by bytes, a shorter one before its extensions.

    Bottom-up mergesort of all groups at once: an element's place in a merged run is its place in its own
    run and, by binary search, the number of elements before it in the other.
    """
    order = np.argsort(group, kind="stable")
    sorted_group = group[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])) if len(order) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(order)))
    base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    spot = np.arange(len(order)) - base
    width = 1
    while len(sizes) and width < sizes.max():
        run = spot // width
        is_left = run % 2 == 0
        other = base + np.where(is_left, run + 1, run - 1) * width
        stop = np.minimum(other + width, base + size)
        live = np.flatnonzero((size > width) & (other < stop))
        low, high, mine = other[live], stop[live].copy(), order[live]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            x, y = mine[open_], order[middle]
            most = np.minimum(length[x], length[y])
            same = common(prefix, start[x], start[y], most)
            end = same == most
            p, q = data[np.minimum(start[x] + same, len(data) - 1)], data[np.minimum(start[y] + same, len(data) - 1)]
            before = np.where(end, length[y] < length[x], q < p)
            tie = end & (length[x] == length[y])
            before |= tie & ~is_left[live[open_]]
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        place = np.arange(len(order))
        left_start = base[live] + (run[live] - ~is_left[live]) * width
        place[live] = left_start + spot[live] % width + (low - other[live])
        merged = np.empty_like(order)
        merged[place] = order
        order = merged
        width *= 2
    return order


def _earlier(key: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the most and the fewest bytes before it at which a repeated string begins; -1 without any.

    ``around``: [anchors, 2 * span - gram] bytes, the anchor at column ``span - gram``; ``left`` and ``right``
    say how many bytes before and from the anchor on belong to the text.
    """
    n, wide = around.shape
    before = span - gram
    data = np.ascontiguousarray(around).reshape(-1)
    prefix = prefix_hash(data)
    start = np.arange(n) * wide + before
    whole = mix(slice_hash(prefix, start, start + right) + mix(right.astype(U64)) + mix(key.view(U64)))
    _, chosen, member = np.unique(whole, return_index=True, return_inverse=True)
    order = suffix_order(data, prefix, start[chosen], right[chosen], key[chosen])
    ranked = chosen[order]
    shared = np.zeros(len(ranked), np.int64)
    if len(ranked) > 1:
        a, b = ranked[:-1], ranked[1:]
        shared[1:] = np.where(key[a] == key[b], common(prefix, start[a], start[b], np.minimum(right[a], right[b])), 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank = rank[member]
    most, fewest = np.full(n, -1), np.full(n, -1)
    for o in range(before + 1):
        need = span - o
        live = np.flatnonzero((left >= o) & (right >= need))
        if not len(live):
            continue
        interval = np.cumsum(shared < need)[rank[live]]
        name = mix(interval.astype(U64) * U64(0x9E3779B97F4A7C15) + slice_hash(prefix, start[live] - o, start[live]))
        by = np.lexsort((doc[live], name))
        live, name = live[by], name[by]
        heads = np.concatenate([[True], name[1:] != name[:-1]])
        head = live[np.flatnonzero(heads)[np.cumsum(heads) - 1]]
        found = np.flatnonzero(doc[head] < doc[live])
        x, y = live[found], head[found]
        same = (around[x, before - o : before - o + span] == around[y, before - o : before - o + span]).all(1)
        if not same.all():  # two strings met under one hash: compare the bytes with every other one of that name
            x = np.concatenate([x[same], _by_bytes(live, doc, around, before - o, span, np.isin(name, name[found[~same]]))])
        else:
            x = x[same]
        most[x] = o
        fewest[x] = np.where(fewest[x] < 0, o, fewest[x])
    return most, fewest


def _by_bytes(live, doc, around, at, span, asked):
    """Members of ``live[asked]`` whose very bytes are in a smaller document."""
    least: dict[bytes, int] = {}
    held = [(i, around[i, at : at + span].tobytes()) for i in live[asked].tolist()]
    for i, text in held:
        least[text] = min(least.get(text, int(doc[i])), int(doc[i]))
    return np.array([i for i, text in held if least[text] < doc[i]], np.int64)


# ---- Spark jobs


def _packed_anchors(texts: DataFrame, buckets: int, span: int, gram: int) -> DataFrame:
    """bucket, keys (32 bits of the hash each), ids: the distinct anchors of each text, in runs by bucket."""

    def flush(held):
        hashed, ids = (np.concatenate(x) for x in zip(*held))
        bucket = ((hashed >> U64(32)) % U64(buckets)).astype(np.int64)
        by = np.lexsort((ids, bucket))
        hashed, ids, bucket = hashed[by], ids[by], bucket[by]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(bucket)]
        short = (hashed & U64(0xFFFFFFFF)).astype(np.uint32)
        runs = list(zip(cuts, cuts[1:]))
        return pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in runs], pa.int32()), pa.array([short[a:b].tobytes() for a, b in runs], pa.binary()), pa.array([ids[a:b].tobytes() for a, b in runs], pa.binary())], ["bucket", "keys", "ids"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for block in blocks(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()), 1):
                data, ends = _joined([t for _, t in block])
                spots, hashed = anchors(data, ends, span, gram)
                ids = np.array([i for i, _ in block], np.int64)[np.searchsorted(ends, spots, "right")]
                by = np.lexsort((hashed, ids))
                hashed, ids = hashed[by], ids[by]
                new = np.concatenate([[True], (hashed[1:] != hashed[:-1]) | (ids[1:] != ids[:-1])])[: len(ids)]
                held.append((hashed[new], ids[new]))
                size += int(new.sum())
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    # all three steps read the same columns, so that they share the exchange of the texts
    return texts.select("node", "doc_id", "text").mapInArrow(run, "bucket int, keys binary, ids binary")


def _shared_anchors(packed: DataFrame) -> DataFrame:
    """node, key: anchors that two texts at least have (by bucket and 32 bits of hash)."""

    def settle(bucket, held):
        keys = np.concatenate([np.frombuffer(k, np.uint32) for k, _ in held])
        ids = np.concatenate([np.frombuffer(i, np.int64) for _, i in held])
        by = np.argsort(keys, kind="stable")
        keys, ids = keys[by], ids[by]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
        keep = np.repeat(several, np.diff(np.append(first, len(keys))))
        return pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array((np.int64(bucket) << 32) | keys[keep].astype(np.int64), pa.int64())], ["node", "key"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for bucket, keys, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    yield settle(now, held)
                    held = []
                now = bucket
                held.append((keys, ids))
        if held:
            yield settle(now, held)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "node long, key long")


def _whole_runs(name: np.ndarray, most: int):
    """(start, end) of pieces of sorted names, of about ``most`` rows and never within a run of equal names."""
    at = 0
    while at < len(name):
        end = at + most
        end = len(name) if end >= len(name) else int(np.searchsorted(name, name[end - 1], "right"))
        yield at, end
        at = end


def _surroundings(texts: DataFrame, buckets: int, span: int, gram: int) -> DataFrame:
    """key, node, doc_id, left, right, places, around of the anchors in column ``keys`` of ``texts`` (node, doc_id, text, keys).

    A document's anchors with the same surroundings, as periodic text has them, are one row with all their places. Where a
    document of smaller id in the same task has the same surroundings, the row is settled already: left and -1 - right are the
    most and the fewest bytes before the anchor at which a repeated string begins, around is empty and key spreads such rows.
    """
    before = span - gram
    wide = 2 * span - gram

    def run(batches):
        known: dict[int, tuple[int, bytes]] = {}  # surroundings that were frequent in a block: least id, bytes

        def least(name: int, doc: int, text: bytes) -> int:
            """The least id that has these surroundings as far as is known; remembers ``doc`` if it is that."""
            held = known.get(name)
            if held is not None and held[1] != text:
                return doc
            if held is None or doc < held[0]:
                if held is None and len(known) >= REMEMBERED:
                    known.pop(next(iter(known)))
                known[name] = (doc, text)
                return doc
            return held[0]

        for batch in batches:
            for block in blocks(zip(*(c.to_pylist() for c in batch.columns)), 2):
                data, ends = _joined([b[2] for b in block])
                spots, hashed = anchors(data, ends, span, gram)
                which = np.searchsorted(ends, spots, "right")
                key = (((hashed >> U64(32)) % U64(buckets)) << U64(32)) | (hashed & U64(0xFFFFFFFF))
                asked = np.concatenate([mix(np.array(k, np.int64).view(U64)) + U64(i) for i, (*_, k) in enumerate(block)])
                keep = np.isin(mix(key) + which.astype(U64), asked)
                spots, which, key = spots[keep], which[keep], key[keep].view(np.int64)
                begin = np.concatenate([[0], ends])[which]
                left, right = np.minimum(spots - begin, before), np.minimum(ends[which] - spots, span)
                ids = np.array([b[1] for b in block], np.int64)[which]
                nodes = np.array([b[0] for b in block], np.int64)
                padded = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(span, np.uint8)])
                prefix = prefix_hash(data)
                name = mix(slice_hash(prefix, spots - left, spots + right) + mix((left * 2 * span + right).astype(U64)))
                by = np.lexsort((which, ids, name))
                spots, which, begin, left, right, ids, key, name = (x[by] for x in (spots, which, begin, left, right, ids, key, name))
                for a, b in _whole_runs(name, 1 << 15):
                    part = slice(a, b)
                    around = padded[spots[part, None] + np.arange(wide)]
                    column = np.arange(wide)
                    around[(column < before - left[part, None]) | (column >= before + right[part, None])] = 0
                    other = np.ones(len(around), bool)  # also where a hash is shared by unlike bytes
                    other[1:] = (name[part][1:] != name[part][:-1]) | (around[1:] != around[:-1]).any(1) | (left[part][1:] != left[part][:-1]) | (right[part][1:] != right[part][:-1])
                    new = other.copy()
                    new[1:] |= which[part][1:] != which[part][:-1]
                    first = np.flatnonzero(new)
                    places = np.split((spots - begin)[part], first[1:])
                    group = np.cumsum(other)[first] - 1
                    heads = np.flatnonzero(other[first])
                    lowest = ids[part][first][heads]
                    for g in np.flatnonzero(np.bincount(group) >= OFTEN).tolist():
                        at = first[heads[g]]
                        lowest[g] = least(int(name[part][at]), int(lowest[g]), around[at].tobytes())
                    settled = ids[part][first] > lowest[group]
                    fewest = np.maximum(0, span - right[part][first])
                    useful = ~settled | (fewest <= left[part][first])
                    by = np.argsort(np.where(settled, len(data), spots[part][first]))  # neighbours overlap, which compresses well
                    by = by[useful[by]]
                    settled, fewest, first, places = settled[by], fewest[by], first[by], [places[i] for i in by]
                    doc, node = ids[part][first], nodes[which[part][first]]
                    offsets = np.concatenate([[0], np.cumsum(np.where(settled, 0, wide))]).astype(np.int32)
                    flat = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(around[first[~settled]].tobytes())])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.where(settled, mix(doc.view(U64)).view(np.int64), key[part][first])), pa.array(node), pa.array(doc), pa.array(left[part][first], pa.int16()),
                        pa.array(np.where(settled, -1 - fewest, right[part][first]), pa.int16()), pa.array([x.astype(np.int64).tobytes() for x in places], pa.binary()), flat,
                    ], ["key", "node", "doc_id", "left", "right", "places", "around"])

    return texts.select("node", "doc_id", "text", "keys").mapInArrow(run, "key long, node long, doc_id long, left short, right short, places binary, around binary")


def _repeats(rows: DataFrame, span: int, gram: int, most: int = 1 << 15) -> DataFrame:
    """node, start, end of stretches to drop. Rows come sorted by key; a run of whole keys is worked on at a time."""
    wide = 2 * span - gram

    def settle(held):
        key, node, doc, left, right, places, around = (np.concatenate([h[i] for h in held]) for i in range(7))
        most, fewest = _earlier(key, doc, left, right, around, span, gram)
        got = np.flatnonzero(most >= 0)
        each = [np.frombuffer(places[i], np.int64) for i in got]
        n = np.fromiter(map(len, each), np.int64, len(each))
        pos = np.concatenate([np.empty(0, np.int64), *each])
        return stretches(np.repeat(node[got], n), pos, np.repeat(most[got], n), np.repeat(fewest[got], n))

    def stretches(node, pos, most, fewest):
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(pos - most), pa.array(pos + span - fewest)], ["node", "start", "end"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            is_settled = batch.column(4).to_numpy(zero_copy_only=False) < 0
            if is_settled.any():
                done = batch.filter(pa.array(is_settled))
                batch = batch.filter(pa.array(~is_settled))
                each = [np.frombuffer(x, np.int64) for x in done.column(5).to_pylist()]
                n = np.fromiter(map(len, each), np.int64, len(each))
                node, most_, fewest_ = (np.repeat(done.column(i).to_numpy(zero_copy_only=False).astype(np.int64), n) for i in (1, 3, 4))
                yield stretches(node, np.concatenate(each), most_, -1 - fewest_)
            if not len(batch):
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
            places = np.empty(len(batch), object)
            places[:] = batch.column(5).to_pylist()
            around = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, wide)
            held.append((*cols, places, around))
            size += len(around)
            if size < most or cols[0][-1] == held[0][0][0]:  # all of one key
                continue
            flat = [np.concatenate([h[i] for h in held]) for i in range(7)]
            last = int(np.searchsorted(flat[0], flat[0][-1]))  # the last key may go on
            held = [tuple(flat)]
            if last:
                yield settle([tuple(x[:last] for x in flat)])
                held = [tuple(x[last:] for x in flat)]
            size = len(held[0][0])
        if held:
            yield settle(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "node long, start long, end long")


def _cut(texts: DataFrame) -> DataFrame:
    """node, n_removed, n_spans, kept_sha256 of texts with their stretches (pairs; null without any)."""

    def run(batches):
        for batch in batches:
            rows = []
            for node, text, pairs in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for p in sorted((p["start"], p["end"]) for p in pairs or []):
                    if spans and p[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], p[1])
                    else:
                        spans.append(list(p))
                at, parts = 0, []
                for a, b in spans:
                    parts.append(raw[at:a])
                    at = b
                kept = b"".join([*parts, raw[at:]])
                rows.append((node, len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["node", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("node", "doc_id", "text", "pairs").mapInArrow(run, "node long, n_removed long, n_spans long, kept_sha256 string")


#: Marks a further text of an id that has several; ids of documents are below.
_FURTHER = 1 << 62


def _named(texts: DataFrame) -> DataFrame:
    """``texts`` (h1, h2, first_id) with node: first_id, but of unlike texts with one first_id only one has it and the others have a hash."""
    order = F.struct("h1", "h2")
    several = texts.groupBy("first_id").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first_id", "head")
    further = F.xxhash64("h1", "h2", "first_id").bitwiseAND(F.lit(_FURTHER - 1)).bitwiseOR(F.lit(_FURTHER))
    node = F.when(order > F.col("head"), further).otherwise(F.col("first_id"))
    return texts.join(several, "first_id", "left").select("h1", "h2", "first_id", node.alias("node"))


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, first_id (least id with the same text), a row for each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"),
        F.when((size < span) | F.col("doc_id").isNull(), F.sha2(text, 256)).alias("own_sha256"),
    )
    first = staged(_named(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"))), "texts")
    rows = staged(rows.join(first, ["h1", "h2"]).select("doc_id", "node", "n_bytes", "own_sha256", "first_id"), "rows")
    whole_bytes = rows.where(F.col("doc_id") == F.col("first_id")).agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(BUCKETS, whole_bytes // BUCKET_BYTES + 1))
    chosen = rows.where(F.col("doc_id") == F.col("first_id")).where(F.col("n_bytes") >= span).select("node").distinct()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    further = first.where(F.col("node") != F.col("first_id"))
    if further.isEmpty():  # every text has an id of its own
        source = source.withColumn("node", F.col("doc_id"))
    else:
        hashed = source.withColumns({"h1": F.xxhash64(F.lit(1), "text"), "h2": F.xxhash64(F.lit(2), "text")})
        source = hashed.join(further.select("h1", "h2", F.col("first_id").alias("doc_id"), "node"), ["doc_id", "h1", "h2"], "left").withColumn("node", F.coalesce("node", "doc_id"))
    texts = source.select("node", "doc_id", "text").join(chosen.hint("shuffle_hash"), "node")
    keys = _shared_anchors(_packed_anchors(texts, buckets, span, gram)).groupBy("node").agg(F.collect_list("key").alias("keys"))
    around = _surroundings(texts.join(keys.hint("shuffle_hash"), "node"), buckets, span, gram)
    pairs = _repeats(around, span, gram).groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("pairs"))
    cut = _cut(texts.join(pairs.hint("shuffle_hash"), "node", "left"))
    done = rows.join(cut.dropDuplicates(["node"]), "node", "left")
    copy = F.col("doc_id") > F.col("first_id")
    whole = (F.col("n_bytes") >= span) & copy
    return done.select(
        "doc_id", "n_bytes",
        F.when(F.col("own_sha256").isNotNull(), 0).when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(F.col("own_sha256").isNotNull(), 0).when(whole, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.coalesce("own_sha256", F.when(whole, F.sha2(F.lit(""), 256)), "kept_sha256").alias("kept_sha256"),
        "first_id",
    )
