"""Near-duplicate classes with DartMinHash signatures.

Every element of a weighted set throws hashed darts into the regions (weight level, rank level) that its
weight reaches; only darts below the weight and below a rank limit count, about ``k (ln k + 2)`` of them
whatever the set's size. Each coordinate keeps its earliest dart. A set whose coordinates aren't all hit
throws again with twice the limit, which changes no coordinate that was hit. Equal coordinates of two sets
have the probability of their weighted Jaccard similarity. Bands of coordinates are joined on.

Candidates are verified exactly on the sets of five-word shingles. No pairs are made within a bucket: each
member is compared with the bucket's most central member. For members of buckets that then still hold several
classes, an exact prefix filter with positions finds the pairs of unlike classes that may yet be similar.
Links become classes by label spreading over staged tables.
Equal texts are one representative throughout, so copies cost one row each.

Edge cases: null text is the empty text; equal texts, also empty ones, share a class; texts without words
have no other link; texts of fewer than five words are one shingle; rows without an id are left out;
repeated ids with unlike texts: each text is classed for itself, so two classes may bear the same least id, and ``leads`` tells
their rows; very long texts are whole sets of shingles; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spent, staged
from .textkit import U64, blocks, mix, shingles

BANDS, ROWS, SHINGLE, SIMILARITY = 20, 5, 5, 0.8


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulated Poisson probabilities, up to one."""
    p, total, out, n = math.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-12 and n < 400:
        total += p
        out.append(total)
        n += 1
        p *= mean / n
    return np.array(out)


def _region(elements: np.ndarray, level: int, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Darts of each element in one region: (index of the element, weight position, rank, hash).

    Weight levels are [0,1), [1,2), [2,4) and so on, rank levels alike; a region has a Poisson number of darts
    with its area as mean. Regions of large area are cut along the rank so that the mean stays at 16 at most.
    """
    w0, w1 = (0, 1) if level == 0 else (1 << level - 1, 1 << level)
    r0, r1 = (0, 1) if rank == 0 else (1 << rank - 1, 1 << rank)
    pieces = max(1, (w1 - w0) * (r1 - r0) // 16)
    found = []
    cumulated = _poisson_table((w1 - w0) * (r1 - r0) / pieces)
    for piece in range(pieces):
        seed = mix(elements + U64(((level << 40) | (rank << 32) | piece) * 2 + 1))
        n = np.searchsorted(cumulated, (seed >> U64(11)).astype(np.float64) * 2.0**-53, "right")
        which = np.repeat(np.arange(len(elements)), n)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(seed[which] + mix(turn.astype(U64) + U64(0xD1B54A32D192ED03)))
        lo, hi = r0 + (r1 - r0) * piece / pieces, r0 + (r1 - r0) * (piece + 1) / pieces
        # two halves of one hash: where the dart lands on either axis
        weight, at = (dart >> U64(32)).astype(np.float64) * 2.0**-32, (dart & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
        found.append((which, w0 + (w1 - w0) * weight, lo + (hi - lo) * at, dart))
    return tuple(np.concatenate(x) for x in zip(*found))


def signatures(elements: np.ndarray, offsets: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """[sets, k] signatures of weighted sets (elements of set i are ``elements[offsets[i]:offsets[i+1]]``).

    Sets of no weight get 0 in every coordinate. ``weights`` are positive; one each where left out.
    """
    n = len(offsets) - 1
    out = np.zeros((n, k), U64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    weights = np.ones(len(elements)) if weights is None else weights.astype(float)
    total = np.bincount(owner, weights, n)
    todo = np.flatnonzero(total > 0)
    limit = np.zeros(n)
    limit[todo] = k * (math.log(k) + 2) / total[todo]
    open_ = np.zeros(n, bool)
    open_[todo] = True
    while open_.any():
        darts = []
        mine = np.flatnonzero(open_[owner])
        level = 0
        while len(mine):
            near, rank = mine, 0
            while len(near):
                which, weight, at, dart = _region(elements[near], level, rank)
                who = near[which]
                hit = (weight < weights[who]) & (at < limit[owner[who]])
                darts.append((owner[who[hit]], at[hit], dart[hit]))
                near = near[limit[owner[near]] > (1 << rank)]
                rank += 1
            mine = mine[weights[mine] > (1 << level)]
            level += 1
        doc, at, dart = (np.concatenate(x) for x in zip(*darts))
        local = np.cumsum(open_) - 1
        slot = local[doc] * k + (mix(dart ^ U64(0x8EBC6AF09C88C6E3)) % U64(k)).astype(np.int64)
        order = np.argsort(slot << 32 | at.astype(np.float32).view(np.uint32))
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        grid = np.zeros((int(open_.sum()), k), U64)
        grid.reshape(-1)[slot[first]] = dart[first] | U64(1)
        full = (grid != 0).all(1)
        rows = np.flatnonzero(open_)
        out[rows[full]] = grid[full]
        open_[rows[full]] = False
        limit *= 2
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """[sets, bands] keys, one for each run of coordinates."""
    parts = signature.reshape(len(signature), bands, -1)
    key = np.arange(bands, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15)
    for j in range(parts.shape[2]):
        key = mix(key + parts[:, :, j])
    return key


# ---- Spark jobs


def sketch(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, h1, h2 (the text's hashes), n (shingles), keys (a key for each band; empty without words)."""

    def run(batches):
        for batch in batches:
            ids, h1, h2 = (c.to_pylist() for c in batch.columns[:3])
            for block in blocks(zip(ids, h1, h2, batch.column(3).to_pylist()), 3, 1 << 19):
                elements, at = shingles([b[3] for b in block], size)
                keys = band_keys(signatures(elements, at, k=bands * rows), bands).view(np.int64)
                n = np.diff(at)
                held = [k.tolist() if c else [] for k, c in zip(keys, n.tolist())]
                cols = [pa.array([b[0] for b in block], pa.int64()), pa.array([b[1] for b in block], pa.int64()), pa.array([b[2] for b in block], pa.int64()), pa.array(n, pa.int64()), pa.array(held, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h1", "h2", "n", "keys"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"), text.alias("text"))
    return source.mapInArrow(run, "doc_id long, h1 long, h2 long, n long, keys array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int = SHINGLE) -> DataFrame:
    """id, shingles (sorted 64-bit hashes, packed) of the texts that are asked for by (id, doc_id, h1, h2)."""

    def run(batches):
        for batch in batches:
            for block in blocks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), 1):
                elements, at = shingles([b[1] for b in block], size)
                packed = [elements[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in block], pa.int64()), pa.array(packed, pa.binary())], ["id", "shingles"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wanted = ids.select("id", "doc_id", F.col("h1").alias("w1"), F.col("h2").alias("w2"))
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(wanted, "doc_id")
    source = source.where((F.xxhash64(F.lit(1), "text") == F.col("w1")) & (F.xxhash64(F.lit(2), "text") == F.col("w2")))
    return source.select("id", "text").mapInArrow(run, "id long, shingles binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches the threshold.

    A hot id is on the ``a`` side: its set joins narrow rows first, then rows are dealt out by ``b``.
    """

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9 and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def across(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of unlike labels that may reach the similarity: a prefix filter with positions, which loses none.

    ``sets``: id, shingles, label. With shingles in one order, rarest first, two sets of that similarity share one
    among the first ``n - ceil(similarity * n) + 1`` of either, and what follows it must be enough for the overlap.
    """

    def run(batches):
        for batch in batches:
            for i, shingles_, label in zip(batch.column(0), batch.column(1), batch.column(2)):
                values = np.frombuffer(shingles_.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i.as_py())), pa.array(np.full(len(values), label.as_py())), pa.array(values)], ["id", "label", "shingle"])

    each = sets.select("id", "shingles", "label").mapInArrow(run, "id long, label long, shingle long")
    common = staged(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "held")
    # shingles of one set alone come first in it and need no place: their number is the difference in size
    known = each.join(common, "shingle").groupBy("id", "label").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("common"))
    sizes = sets.select("id", (F.octet_length("shingles") / 8).cast("int").alias("n"))
    prefix = (F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)) + 1 - F.col("alone")).cast("int")
    known = known.join(sizes, "id").withColumn("alone", F.col("n") - F.size("common")).where(prefix > 0)
    first = known.select("id", "label", "n", "alone", F.posexplode(F.slice("common", F.lit(1), prefix)).alias("place", "c"))
    first = staged(first.select("id", "label", "n", (F.col("place") + F.col("alone")).alias("place"), F.col("c.shingle").alias("shingle")), "prefixes")
    x = first.select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("id", "label", "n", "place")))
    y = first.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("id", "label", "n", "place")))
    need = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-9)
    fits = (F.col("label_a") < F.col("label_b")) & (F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= need)
    return x.join(y, "shingle").where(fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def classes(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Spread the least label over links (a, b) until nothing changes. labels: id, label.

    Each round takes the least label of the neighbours and then the label of that label's id.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = staged(labels, "labels")
    while True:
        near = (
            edges.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy("a").agg(F.min("label").alias("least"))
        )
        one = labels.join(near, labels["id"] == near["a"], "left").select(labels["id"], labels["label"].alias("was"), F.least("label", F.coalesce("least", "label")).alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("upper"))
        two = staged(one.join(up, "label", "left").select("id", "was", F.least("label", F.coalesce("upper", "label")).alias("label")), "labels")
        changed = not two.where("label < was").isEmpty()
        spent(labels)
        labels = two
        if not changed:
            spent(edges)
            return labels.select("id", "label")


#: Stands for a further text of an id that has several; document ids are below.
_FURTHER = 1 << 62


def _nodes(sketches: DataFrame) -> DataFrame:
    """h1, h2, doc_id, id of every distinct text: its least doc_id, and the number that stands for the text.

    That is the doc_id, but where unlike texts have one least id only one of them has it and the others get a hash.
    """
    texts = staged(sketches.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")), "texts")
    several = texts.groupBy("doc_id").agg(F.min("h1").alias("top"), F.max("h1").alias("low")).where("top < low").select("doc_id", "top")
    further = F.xxhash64("h1", "h2", "doc_id").bitwiseAND(F.lit(_FURTHER - 1)).bitwiseOR(F.lit(_FURTHER))
    nodes = texts.join(several, "doc_id", "left").select("h1", "h2", "doc_id", F.when(F.col("h1") > F.col("top"), further).otherwise(F.col("doc_id")).alias("id"))
    out = staged(nodes, "nodes")
    spent(texts)
    return out


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), copy_of (the least doc_id with its text), n_shingles, h1, h2 (the
    text's hashes), leads (it is the class's first row, or a row equal to that one), n_links (verified links of its text to unlike
    texts), linked_to (the least doc_id at the other end of one; null without any), a row for each row with an id.

    A class's links join all its texts: each is a pair of unlike texts whose similarity was found to reach the threshold.
    """
    sketches = staged(sketch(docs, size, bands, rows), "sketch")
    nodes = _nodes(sketches)
    # staged, so that Spark can split the hot side of the joins that follow
    members = staged(sketches.select("doc_id", "h1", "h2", "n").join(nodes.select("h1", "h2", F.col("doc_id").alias("first_id"), "id"), ["h1", "h2"]), "members")
    entries = (
        sketches.join(nodes, ["doc_id", "h1", "h2"])
        .dropDuplicates(["id"]).select("id", "n", F.explode("keys").alias("key"))
    )
    entries = staged(entries, "entries")
    spent(sketches)
    counts = staged(entries.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "counts")
    met = staged(entries.join(counts, "key"), "buckets")
    spent(entries, counts)
    # a bucket is led by its member that meets most others in all its buckets: of edited copies, the original
    rank = staged(met.groupBy("id").agg(F.sum("held").alias("met")), "rank")
    leads = staged(met.join(rank, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("back"))).alias("top")).select("key", (-F.col("top.back")).alias("lead")), "leads")
    shared = staged(met.join(leads, "key").drop("held"), "buckets")
    spent(met, rank, leads)
    sets = staged(shingle_sets(docs, shared.select("id").distinct().join(nodes, "id"), size), "sets")
    sizes = shared.select(F.col("id").alias("lead"), F.col("n").alias("lead_n")).distinct()
    alike = (F.least("n", "lead_n") >= F.greatest("n", "lead_n") * F.lit(similarity) - F.lit(1e-9))
    star = shared.where("id <> lead").select("lead", "id", "n").distinct().join(sizes, "lead").where(alike)
    first = staged(verified(star.select(F.col("lead").alias("a"), F.col("id").alias("b")), sets, similarity), "links")
    labels = classes(first, nodes.select("id", F.col("id").alias("label")))
    # what is left: members of one bucket in unlike classes
    placed = shared.select("key", "id").join(labels, "id")
    mixed = staged(placed.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p < q").select("key"), "mixed")
    open_ = staged(placed.join(mixed, "key").select("id", "label").distinct(), "open")
    spent(shared, mixed)
    second = staged(verified(across(sets.join(open_, "id"), similarity), sets, similarity), "links")
    spent(sets, open_)
    if not second.isEmpty():
        labels = classes(second, labels)
    heads = staged(labels.join(nodes.select("id", F.col("doc_id").alias("least")), "id"), "heads")
    leaders = heads.groupBy("label").agg(F.min(F.struct("least", "id")).alias("lead"))
    links = first.union(second.select("a", "b"))
    met = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct()
    far = nodes.select(F.col("id").alias("other"), F.col("doc_id").alias("linked"))
    met = met.join(far.hint("merge"), "other").groupBy("id").agg(F.count(F.lit(1)).alias("n_links"), F.min("linked").alias("linked_to"))
    named = heads.select("id", "label").join(leaders.hint("merge"), "label").join(met, "id", "left")
    named = staged(named.select("id", F.col("lead.least").alias("class_id"), F.col("lead.id").alias("lead"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "linked_to"), "named")
    spent(heads, first, second)
    # kept a merge join: Spark splits the rows of a hot text in it
    return members.join(named.hint("merge"), "id").select(
        "doc_id", "class_id", F.col("first_id").alias("copy_of"), F.col("n").alias("n_shingles"), "h1", "h2",
        ((F.col("id") == F.col("lead")) & (F.col("doc_id") == F.col("class_id"))).alias("leads"), "n_links", "linked_to",
    )


def keep_leads(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` with all their columns, but of each class only its leading row, once; rows without an id stay.

    Of rows with the same id and text one stays, the one whose columns have the least hash: whichever task finds it, it is the same.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.lit(1), text).alias("_h1"), F.xxhash64(F.lit(2), text).alias("_h2")]
    keep = near_duplicates(docs, **settings).where("leads").select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    names = ["_id", "_h1", "_h2"]
    order = F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    rows = docs.where("doc_id is not null").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), order.alias("_order"), *key)
    rows = rows.join(keep, names, "left_semi").groupBy(*names).agg(F.min_by("_row", "_order").alias("_row"))
    return rows.select("_row.*").unionByName(docs.where("doc_id is null"))
