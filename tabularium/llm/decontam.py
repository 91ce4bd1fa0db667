"""Benchmark passages in documents: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distance.

The alphabet is words (lower case, no punctuation). An item of n words matches a stretch of a document
within ``limit(n)`` word edits: a quarter of n, and few enough that any such stretch has ``SEED`` words of the
item in a row. Those runs say where windows of n words can match at all, as ranges of starts; nothing else is lost by them.
Window and item then take the same random walks (CGK: at each step the current word is put out and a
random bit of step and word decides whether to move on), which maps edits to differing coordinates; a
repetition compares ``BITS`` coordinates sampled from the first 2n, within which a walk of n words ends on average. The
repetitions that an item's length needs for the target recall come from collisions of items of such lengths with edited copies. Where
``MOST`` of them don't reach it, all windows of such items go on. Windows that collide and overlap are one region, and the
exact edit distance of the item to the best stretch of the region decides.

The benchmark is the stated query set: it goes through in blocks of bounded rows and bytes, every block against all
documents, without a shuffle of documents.

Edge cases: null and wordless texts match nothing, as items or as documents; items of under 6 words match
without edits only; equal items all match; of several stretches with the fewest edits the first counts; texts and items of any length
are searched whole, and words that repeat on and on make long regions, not more of them; an empty benchmark matches nothing, an
empty table gives an empty result; extra columns are ignored by ``matches`` and kept by ``clean``; repeated documents are repeated in the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U64, blocks, mix, words

SEED, SHARE, BITS, RECALL = 3, 0.25, 2, 0.99
#: Repetitions at most before windows go on unsampled; edited copies per class of lengths to measure recall with.
MOST, COPIES = 64, 96
BLOCK_ITEMS, BLOCK_BYTES = 4000, 4 << 20
#: Characters of documents that are searched at a time.
BLOCK_CHARS = 1 << 19
_ANY = U64(1)


def limit(n: int) -> int:
    """Word edits that an item of n words may have."""
    return max(0, min(int(SHARE * n), n // SEED - 1))


def walk(rows: np.ndarray, lengths: np.ndarray, repetition: int, steps: int | None = None) -> np.ndarray:
    """First ``steps`` coordinates (2n where left out) of the CGK embedding of word rows [pairs, longest] (0 beyond a row's length): [steps, pairs] words."""
    n, longest = rows.shape
    steps = 2 * longest if steps is None else steps
    padded = np.concatenate([rows, np.zeros((n, 1), U64)], 1).reshape(-1)
    start = np.arange(n) * (longest + 1)
    at, end = start.copy(), start + lengths
    out = np.zeros((steps, n), U64)
    for j in range(steps):
        word = padded[at]
        out[j] = word
        at = np.minimum(at + (mix(word + U64(repetition * 1_000_003 + j)) >> U64(63)).astype(np.int64), end)
    return out


def sampled(rows: np.ndarray, lengths: np.ndarray, repetition: int, bits: int = BITS) -> np.ndarray:
    """One key of ``bits`` coordinates below 2n of each row's embedding, the same ones for all rows of one length."""
    drawn = [(mix(lengths.astype(U64) * U64(7919) + U64(repetition * 64 + b + 1)) % (2 * lengths).astype(U64)).astype(np.int64) for b in range(bits)]
    embedded = walk(rows, lengths, repetition, int(max((d.max(initial=0) for d in drawn), default=0)) + 1)
    key = np.zeros(len(rows), U64)
    for b, at in enumerate(drawn):
        key = mix(key + embedded[at, np.arange(len(rows))] + U64(b))
    return key


def length_class(n: int) -> int:
    """Lengths within some nine percent of each other share their repetitions."""
    return round(8 * math.log2(max(1, n)))


def repetitions(items: list[np.ndarray], recall: float = RECALL, most: int = MOST) -> dict[int, tuple[int, float]]:
    """Length class -> (repetitions, measured recall) for items that may have edits; 0 repetitions: ``most`` don't reach it.

    Recall is that of ``COPIES`` copies of the class's items under ``limit(n)`` random edits, drawn with a fixed seed.
    """
    rng = np.random.default_rng(7)
    pools: dict[int, list[np.ndarray]] = {}
    for w in items:
        if limit(len(w)):
            pools.setdefault(length_class(len(w)), []).append(w)
    out = {}
    for name, pool in sorted(pools.items()):
        left, right = [], []
        for i in rng.integers(0, len(pool), COPIES):
            edited = pool[i].tolist()
            for _ in range(limit(len(edited))):
                at, kind = int(rng.integers(0, len(edited))), int(rng.integers(0, 3))
                new = int(rng.integers(2, 1 << 62))
                edited[at : at + (kind != 2)] = [new] if kind != 1 else []
            left.append(pool[i])
            right.append(np.array(edited[: len(pool[i])], U64))
        a, n = _rows(left)
        b, _ = _rows(right, a.shape[1])
        missed, enough = np.ones(COPIES, bool), 0
        for r in range(most):
            open_ = np.flatnonzero(missed)
            missed[open_] = sampled(a[open_], n[open_], r) != sampled(b[open_], n[open_], r)
            if missed.mean() <= 1 - recall:
                enough = min(most, r + 4)
                break
        out[name] = enough, 1.0 - float(missed.mean())
    return out


def _rows(held: list[np.ndarray], longest: int = 0) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in held], np.int64)
    out = np.zeros((len(held), max(longest, int(lengths.max(initial=1)))), U64)
    for i, w in enumerate(held):
        out[i, : len(w)] = w
    return out, lengths


def aligned(items: np.ndarray, lengths: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least edit distance of each item row, its first ``length`` words, to any stretch of its row of ``around``; where the first such stretch ends)."""
    n, wide = around.shape
    step = np.arange(wide + 1)
    row = np.zeros((n, wide + 1), np.int64)
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        changed = np.empty_like(row)
        changed[:, 0] = i + 1
        changed[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (around != items[:, i : i + 1]))
        row = np.minimum.accumulate(changed - step, axis=1) + step
        ended = np.flatnonzero(lengths == i + 1)
        if len(ended):
            end[ended] = row[ended].argmin(1)
            best[ended] = row[ended, end[ended]]
    return best, end


def edits(items: np.ndarray, lengths: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Least edit distance of each item row (its first ``length`` words) to any stretch of its row of ``around``."""
    return aligned(items, lengths, around)[0]


def merged(group: np.ndarray, low: np.ndarray, high: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first index, low, high) of the unions of ranges of one group that overlap or lie at most ``gap`` apart; rows sorted by group and low."""
    if not len(group):
        return (np.empty(0, np.int64),) * 3
    new = np.concatenate([[True], group[1:] != group[:-1]])
    far = int(high.max() - low.min()) + int(gap.max()) + 2
    base = (np.cumsum(new) - 1) * far
    reach = np.maximum.accumulate(high - low.min() + base)
    head = np.flatnonzero(new | np.concatenate([[True], low[1:] - low.min() + base[1:] > reach[:-1] + gap[1:]]))
    return head, low[head], np.maximum.reduceat(high, head)


class Matcher:
    """The items of one block, as tables that a task uses."""

    def __init__(self, ids: list, texts: list[str | None]):
        hashed, at = words(texts)
        held = [(i, hashed[a:b]) for i, a, b in zip(ids, at[:-1], at[1:]) if b > a]
        self.ids, items = [i for i, _ in held], [w for _, w in held]
        self.items, self.lengths = items, np.array([len(w) for w in items], np.int64)
        self.limits = np.array([limit(len(w)) for w in items], np.int64)
        self.measured = repetitions(items)
        # items without edits need one: equal windows collide
        self.repeat = np.array([self.measured[length_class(len(w))][0] if limit(len(w)) else 1 for w in items], np.int64)
        self.keys = [np.zeros(len(items), U64) for _ in range(int(self.repeat.max(initial=0)))]
        by = np.argsort(self.lengths, kind="stable")
        for a in range(0, len(by), 256):
            k = by[a : a + 256]
            rows, lengths = _rows([items[i] for i in k])
            for r in range(int(self.repeat[k].max())):
                self.keys[r][k] = sampled(rows, lengths, r)
        self.seeds = {}
        for q in sorted({min(SEED, len(w)) for w in items}):
            parts = [(_grams(w, q), np.full(len(w) - q + 1, k), np.arange(len(w) - q + 1)) for k, w in enumerate(items) if min(SEED, len(w)) == q]
            gram, item, place = (np.concatenate(x) for x in zip(*parts))
            by = np.lexsort((place, item, gram))
            gram, item, place = gram[by], item[by], place[by]
            head = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (item[1:] != item[:-1])]))
            known = np.zeros(1 << 20, bool)
            known[(gram & U64((1 << 20) - 1)).astype(np.int64)] = True
            self.seeds[q] = gram[head], item[head], place[head], np.maximum.reduceat(place, head), known

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, first word of a window that ends with the best stretch) of every matching pair."""
        if not self.ids:
            return []
        hashed, at = words(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        d, k, low, high = self._ranges(hashed, doc)
        sizes = high - low + 1
        hits = []
        for a in range(0, int(sizes.sum()), 4096):  # windows, some at a time
            ends = np.cumsum(sizes)
            turn = np.arange(a, min(a + 4096, ends[-1]))
            row = np.searchsorted(ends, turn, "right")
            start = low[row] + turn - (ends - sizes)[row]
            near = self._collide(hashed, at, d[row], k[row], start)
            hits.append(np.stack([d[row][near], k[row][near], start[near]]))
        if not hits:
            return []
        d, k, start = np.concatenate(hits, 1)
        head, low, high = merged(d * len(self.ids) + k, start, start, self.lengths[k])
        d, k = d[head], k[head]
        n, begin = self._verify(hashed, at, d, k, low, high)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for x, y, m, s in zip(d.tolist(), k.tolist(), n.tolist(), begin.tolist()):
            if m <= self.limits[y] and (m, s) < best.get((x, y), (1 << 60, 0)):
                best[x, y] = (m, s)
        return [(x, y, m, max(0, s - int(at[x]))) for (x, y), (m, s) in best.items()]

    def _ranges(self, hashed, doc):
        """(text, item, first and last start) of the windows that runs of shared words allow: disjoint ranges, sorted."""
        found = []
        for q, (gram, item, first, last, known) in self.seeds.items():
            if len(hashed) < q:
                continue
            g = _grams(hashed, q)
            spot = np.flatnonzero(known[(g & U64((1 << 20) - 1)).astype(np.int64)] & (doc[: len(g)] == doc[q - 1 :]))
            low = np.searchsorted(gram, g[spot], "left")
            n = np.searchsorted(gram, g[spot], "right") - low
            spot, low, n = spot[n > 0], low[n > 0], n[n > 0]
            ends = np.cumsum(n)
            for a in range(0, int(n.sum()), 1 << 18):
                turn = np.arange(a, min(a + (1 << 18), ends[-1]))
                row = np.searchsorted(ends, turn, "right")
                entry = low[row] + turn - (ends - n)[row]
                found.append(self._unions(doc[spot[row]], item[entry], spot[row] - last[entry], spot[row] - first[entry]))
        if not found:
            return (np.empty(0, np.int64),) * 4
        return self._unions(*(np.concatenate(x) for x in zip(*found)))

    def _unions(self, d, k, low, high):
        by = np.lexsort((low, k, d))
        d, k, low, high = d[by], k[by], low[by], high[by]
        head, low, high = merged(d * len(self.ids) + k, low, high, np.ones(len(d), np.int64))
        return d[head], k[head], low, high

    def _window(self, hashed, at, d, start, wide):
        spot = start[:, None] + np.arange(wide)
        inside = (spot >= at[d][:, None]) & (spot < at[d + 1][:, None])
        return np.where(inside, hashed[np.clip(spot, 0, len(hashed) - 1)], _ANY)

    def _collide(self, hashed, at, d, k, start):
        lengths = self.lengths[k]
        rows = self._window(hashed, at, d, start, int(lengths.max()))
        rows[np.arange(rows.shape[1]) >= lengths[:, None]] = 0
        hit = self.repeat[k] == 0
        for r in range(len(self.keys)):
            left = np.flatnonzero(~hit & (self.repeat[k] > r))
            if not len(left):
                break
            hit[left] = sampled(rows[left], lengths[left], r) == self.keys[r][k[left]]
        return hit

    def _verify(self, hashed, at, d, k, low, high):
        """(edits, first word) by region of starts: regions of like width together, some million cells at a time."""
        n, begin = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
        slack = 2 * self.limits[k]
        left = np.maximum(low - slack, at[d])
        wide = np.minimum(high + self.lengths[k] + slack, at[d + 1]) - left
        by = np.argsort(wide, kind="stable")
        a = 0
        while a < len(by):
            b = a + 1
            while b < len(by) and (b + 1 - a) * int(wide[by[b]]) <= 1 << 20 and wide[by[b]] <= 1.25 * wide[by[a]] + 8:
                b += 1
            part = by[a:b]
            most = int(wide[part].max())
            around = self._window(hashed, at, d[part], left[part], most)
            around[np.arange(most) >= wide[part][:, None]] = _ANY
            rows, lengths = _rows([self.items[i] for i in k[part]])
            n[part], end = aligned(rows, lengths, around)
            begin[part] = left[part] + end - lengths
            a = b
        return n, begin


def _grams(w: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros(len(w) - q + 1, U64)
    for j in range(q):
        out = mix(out + w[j : len(w) - q + 1 + j])
    return out


# ---- Spark jobs


def _blocks(items: DataFrame) -> list[Matcher]:
    """The benchmark's blocks, each bounded in rows and bytes in expectation (by a hash of the row)."""
    own = items.where("text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    n, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES))
    for part in range(parts):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield Matcher([r["item_id"] for r in rows], [r["text"] for r in rows])


def _found_in(docs: DataFrame, matcher: Matcher) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for block in blocks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), 1, BLOCK_CHARS):
                rows = [(block[x][0], matcher.ids[y], n, int(matcher.lengths[y]), s) for x, y, n, s in matcher.find([t for _, t in block])]
                kinds = [batch.schema[0].type, pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "item_id", "edits", "item_words", "start_word"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, item_id long, edits int, item_words int, start_word long")


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, item_words, start_word: a row for each document and item that it holds."""
    out = None
    for matcher in _blocks(items):
        found = _found_in(docs, matcher)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; a map, without a shuffle."""
    at = docs.columns.index("text")
    for matcher in _blocks(items):

        def run(batches, matcher=matcher):
            for batch in batches:
                rows = list(enumerate(batch.column(at).to_pylist()))
                bad = {block[x][0] for block in blocks(rows, 1, BLOCK_CHARS) for x, _, _, _ in matcher.find([t for _, t in block])}
                yield batch.filter(pa.array([i not in bad for i, _ in rows], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
