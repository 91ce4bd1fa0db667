"""Conversation prefix trie: every distinct sequence of first turns is a node; subtree totals by time-forward processing.

``ordered`` numbers the turns of each conversation, ``prefix_trie`` makes the nodes. A turn is known by 128 bits of its SHA-256, a prefix by the
exclusive or of hashes of (turn, place) along it (128 bits), so texts are sorted once and never shuffled again. A node's members, their number
and the smallest are one aggregate by prefix.

Totals go up by time-forward processing. A node's weight is the number of its members' turns at or below it; weights fall along every
path, and a node of weight w is of level l where w has l bytes. Nodes of one level below one topmost node of at most that level are a shard
of at most 256 nodes for each depth. Level by level, from the lightest, a task gets whole shards, sorts their nodes by reverse level order (Spark's external sort) and
passes totals to parents through a priority queue that spills to disk; a shard's root passes its total to its parent's shard of a higher level, and the last
totals go to the root. Nodes of a single conversation are paths whose totals are known (one leaf, nothing saved), so they only send their top's.

Edge cases: null roles and texts are empty; a null turn comes first; equal turns of a conversation are ordered by role, then text, and all
count; rows without conv_id belong to no conversation; an empty table has no nodes, not even a root; further columns are ignored. No task
sees all turns of a long conversation or all members of a prefix: turns are numbered in ranges of one global order, prefixes are joined in blocks of 1024
turns, and ids of members that end at one node are packed by ranges before one task hashes them as a stream, as SHA-256 demands.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

BLOCK = 1024
#: Messages in a task's memory before a sorted run of them is spilled.
QUEUED = 1 << 18
PACKED = 4096


# ---- turns in order


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest, bytes (of the text) of every turn; staged in the shared folder."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    keys = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    named = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    digest = F.substring(F.unhex(F.sha2(named.cast("binary"), 256)), 1, 16)
    narrow = turns.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"), F.spark_partition_id().alias("part"))

    def number(batches):
        last, n = None, 0
        for batch in batches:
            places = []
            for c in batch.column(0).to_pylist():
                last, n = c, n + 1 if c == last else 0
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "local"])

    held = staged(narrow.mapInArrow(number, "conv_id long, digest binary, bytes long, part int, local long"), "turns")
    # conversations that go on in a later range: two at most for each range
    sizes = held.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    cut = sizes.join(sizes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1"), "conv_id")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = cut.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.col("local") + F.coalesce("before", F.lit(0))
    return staged(held.join(F.broadcast(carried), ["conv_id", "part"], "left").select("conv_id", place.alias("place"), "digest", "bytes"), "places")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations: of c the first h turns of c - c % 5, then its own after its first h; h is the CRC-32 of c's decimal form modulo 9.

    Returns turns (conv_id, place, digest, bytes, n_turns) and conversations (conv_id, n_turns); no text moves.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = sizes.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    plan = own.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("kept"))
    plan = staged(plan.withColumn("n_turns", F.col("lent") + F.col("kept")), "rebuilt")
    late = turns.join(plan.drop("base", "kept"), "conv_id").where(F.col("place") >= F.col("h"))
    first = turns.where((F.col("place") < 8) & (F.col("conv_id") % 5 == 0)).withColumnRenamed("conv_id", "base").join(plan, "base").where(F.col("place") < F.col("h"))
    columns = ["conv_id", "place", "digest", "bytes", "n_turns"]
    moved = late.withColumn("place", F.col("place") - F.col("h") + F.col("lent")).select(columns)
    return moved.unionByName(first.select(columns)), plan.select("conv_id", "n_turns")


# ---- time-forward processing within a task


class SpillingQueue:
    """A priority queue of (key..., sums...) as tuples of integers; beyond ``most`` entries sorted runs go to scratch files.

    A run is an unnamed file of the task, as Spark's own sort spills are: no other task reads it and it is gone with the task.
    """

    def __init__(self, width: int, most: int = QUEUED):
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # (entry, number of its run)
        self.runs: list = []
        self.form, self.most = struct.Struct(f"<{width}q"), most

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) >= self.most:
            run = tempfile.TemporaryFile()
            for e in sorted(self.heap):
                run.write(self.form.pack(*e))
            run.seek(0)
            self.heap = []
            self.runs.append(run)
            self._read(len(self.runs) - 1)

    def _read(self, at: int) -> None:
        held = self.runs[at].read(self.form.size)
        if held:
            heapq.heappush(self.heads, (self.form.unpack(held), at))
        else:
            self.runs[at].close()

    def least(self) -> tuple | None:
        of = [q for q in (self.heap and self.heap[0], self.heads and self.heads[0][0]) if q]
        return min(of, default=None)

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            entry, at = heapq.heappop(self.heads)
            self._read(at)
            return entry
        return heapq.heappop(self.heap)


_NODE = ["k1", "k2", "p1", "p2", "depth", "r1", "r2", "saved", "leaves_in", "saved_in", "children_in"]
_TOTAL = "k1 long, k2 long, p1 long, p2 long, top boolean, n_leaves long, saved_tokens long, n_children long"


def time_forward(rows, most: int = QUEUED):
    """Nodes in reverse level order (depth falling, then key) to (k1, k2, p1, p2, top, leaves, saved, children); totals of shard roots aren't passed on here."""
    queue = SpillingQueue(6, most)
    for k1, k2, p1, p2, depth, r1, r2, saved, leaves, more, children in rows:
        me, saved = (-depth, k1, k2), saved + more
        while (head := queue.least()) and head[:3] == me:
            queue.pop()
            leaves, saved, children = leaves + head[3], saved + head[4], children + head[5]
        leaves = leaves or 1
        top = (k1, k2) == (r1, r2)
        if not top:
            queue.push((1 - depth, p1, p2, leaves, saved, 1))
        yield k1, k2, p1, p2, top, leaves, saved, children


def _pass_up(batches):
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 3
    names, held = [c.split(" ")[0] for c in _TOTAL.split(", ")], []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], kind) for i, kind in enumerate(kinds)], names)

    for row in time_forward(rows()):
        held.append(row)
        if len(held) >= 10_000:
            yield out()
            held = []
    yield out()


# ---- Spark jobs


def prefix_xor(df: DataFrame, by: str, place: str, cols: list[str], longest: int) -> DataFrame:
    """``cols`` become the exclusive or of all rows of the group up to this one; groups are cut into blocks of places, joined by blocks of blocks."""
    block = Window.partitionBy(by, "_block").orderBy(place)
    cut = df.withColumn("_block", F.floor(F.col(place) / BLOCK))
    inner = cut.withColumns({c: F.bit_xor(c).over(block) for c in cols})
    if longest <= BLOCK:
        return inner.drop("_block")
    sums = cut.groupBy(by, "_block").agg(*(F.bit_xor(c).alias(c) for c in cols))
    up = prefix_xor(sums.withColumnRenamed("_block", "_at"), by, "_at", cols, -(-longest // BLOCK))
    up = up.select(by, (F.col("_at") + 1).alias("_block"), *(F.col(c).alias(f"_{c}") for c in cols))
    return inner.join(up, [by, "_block"], "left").withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))) for c in cols}).drop("_block", *(f"_{c}" for c in cols))


def _ends(ended: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 from (k1, k2, conv_id): ids are packed by ranges, then hashed as one stream for each node."""

    def pack(batches):
        done, key, ids = [], None, []

        def out():
            columns = (pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))
            return pa.RecordBatch.from_arrays([*columns], ["k1", "k2", "first", "ids"])

        for batch in batches:
            for k1, k2, c in zip(*(x.to_pylist() for x in batch.columns)):
                if ids and ((k1, k2) != key or len(ids) >= PACKED):
                    done.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = (k1, k2)
                ids.append(c)
            yield out()
            done = []
        if ids:
            done = [(*key, ids[0], ",".join(map(str, ids)))]
            yield out()

    def digest(batches):
        key = state = None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(x.to_pylist() for x in batch.columns)):
                if (k1, k2) != key:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((*key, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])

    packed = ended.repartitionByRange("conv_id").sortWithinPartitions("k1", "k2", "conv_id").select("k1", "k2", "conv_id").mapInArrow(pack, "k1 long, k2 long, first long, ids string")
    return packed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "ids").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _level(weight: Column) -> Column:
    """How many bytes the weight has."""
    return F.ceil(F.length(F.bin(weight)) / 8).cast("int")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, place, digest, bytes, n_turns) of ``convs`` (conv_id, n_turns), each with its totals.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; for the root too.
    """
    whole = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.coalesce(F.max("n_turns"), F.lit(0)).alias("longest")).first()
    depth = F.col("place") + 1
    hashed = turns.select("conv_id", depth.alias("depth"), "bytes", "n_turns", F.xxhash64("digest", depth).alias("x1"), F.xxhash64(depth, "digest").alias("x2"))
    keyed = prefix_xor(hashed.withColumns({"k1": F.col("x1"), "k2": F.col("x2")}), "conv_id", "depth", ["k1", "k2"], whole["longest"])
    paths = staged(keyed.select("conv_id", "depth", "n_turns", "bytes", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2")), "paths")
    key = ["k1", "k2"]
    nodes = staged(paths.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_turns").alias("n_turns"), _level(F.sum(F.col("n_turns") - F.col("depth") + 1)).alias("level"),
        *(F.max(c).alias(c) for c in ("depth", "bytes", "p1", "p2"))), "nodes")
    shared = nodes.where("n_convs > 1")
    levels = shared.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]

    # of each conversation: where it leaves what it shares, and the roots of its shards
    marks = paths.join(shared.select(*key, "level"), key).groupBy("conv_id").agg(
        F.max(F.struct("depth", *key)).alias("last"),
        *(F.min(F.when(F.col("level") <= n, F.struct("depth", *key))).alias(f"root{n}") for n in range(1, levels + 1)))
    marks = staged(convs.join(marks, "conv_id", "left").withColumns({"left_at": F.coalesce("last.depth", F.lit(0)), "k1": F.coalesce("last.k1", F.lit(0)), "k2": F.coalesce("last.k2", F.lit(0))}).drop("last"), "marks")
    root = F.coalesce(*(F.when(F.col("level") == n, F.col(f"root{n}")) for n in range(1, levels + 1))) if levels else F.lit(None).cast("struct<depth:bigint,k1:bigint,k2:bigint>")
    inside = shared.join(marks.drop(*key, "n_turns", "left_at"), "conv_id").select(
        *key, "p1", "p2", "depth", "level", root["k1"].alias("r1"), root["k2"].alias("r2"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    inside = staged(inside, "shards")

    # tops of paths of single conversations send one leaf each
    sums = ["leaves_in", "saved_in", "children_in"]
    sent = [marks.where("n_turns > left_at").groupBy(*key).agg(F.count(F.lit(1)).alias("leaves_in"), F.lit(0).cast("long").alias("saved_in"), F.count(F.lit(1)).alias("children_in"))]
    done = []
    for level in range(1, levels + 1):
        received = _all(sent).groupBy(*key).agg(*(F.sum(c).alias(c) for c in sums))
        own = inside.where(F.col("level") == level).join(received, key, "left").fillna(0, sums)
        order = [F.desc("depth"), "k1", "k2"]
        passed = own.select(*_NODE).repartition("r1", "r2").sortWithinPartitions(*order).mapInArrow(_pass_up, _TOTAL)
        done.append(staged(passed, f"level{level}"))
        sent.append(done[-1].where("top").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("leaves_in"), F.sum("saved_tokens").alias("saved_in"), F.count(F.lit(1)).alias("children_in")))

    return _rows(nodes, shared, marks, _all(done) if done else None, _all(sent).where("k1 = 0 and k2 = 0"), whole)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _rows(nodes: DataFrame, shared: DataFrame, marks: DataFrame, totals: DataFrame | None, to_root: DataFrame, whole) -> DataFrame:
    """The nodes with totals, parents and ends put together."""
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    single = nodes.where("n_convs = 1").withColumns({
        "n_children": (F.col("depth") < F.col("n_turns")).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long"),
        "ends_sha256": F.when(F.col("depth") == F.col("n_turns"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing)})
    ends = staged(_ends(marks.where("n_turns = left_at").select("k1", "k2", "conv_id")), "ends")
    parts = single
    if totals is not None:
        own = totals.select("k1", "k2", "n_children", "n_leaves", "saved_tokens")
        parts = single.unionByName(shared.join(own, ["k1", "k2"]).join(ends, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)))
    # a parent that isn't shared is of the same conversation; a parent of depth 0 is the root
    parents = shared.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    deep = parts.where("depth > 1").join(parents, ["p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent", "conv_id"))
    flat = parts.where("depth = 1").withColumn("parent_conv_id", F.lit(whole["first"]).cast("long"))
    turnless = ends.where("k1 = 0 and k2 = 0").select("ends_sha256")
    top = to_root.unionByName(turnless, allowMissingColumns=True).agg(
        F.coalesce(F.sum("leaves_in"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_in"), F.lit(0)).alias("saved_tokens"),
        F.coalesce(F.sum("children_in"), F.lit(0)).alias("n_children"), F.coalesce(F.max("ends_sha256"), nothing).alias("ends_sha256"))
    top = top.where(F.lit(whole["n"] > 0)).withColumns({
        "conv_id": F.lit(whole["first"]).cast("long"), "depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long"), "n_convs": F.lit(whole["n"]).cast("long")})
    return top.select(columns).unionByName(deep.select(columns)).unionByName(flat.select(columns))
