"""Token counts that follow edits: a segment tree of pre-token pieces per document, re-encoded only where edits touch it.

Byte-level BPE encodes the pieces of a pre-token pattern one by one, so a document's count is the sum over its
pieces. ``build`` makes a tree for each document, to be kept as a table: blocks of piece lengths and counts under a binary tree
of sums. ``edited`` takes kept trees with edits, opens only the blocks that these come to, and returns the new trees, from which the
next edits start. An edit re-splits the text from the piece that contains the character two before it (no piece that ends earlier looks that far ahead) until a new piece ends where an old one ended behind the edit; from there on all
pieces are the old ones. The blocks touched get new sums, and so do their ancestors.

Edge cases: null is the empty text, of no pieces; null edits are none; edits that lie outside of the text are cut to it;
of overlapping edits the one that begins first holds (of those the longer, then the lesser text) and the others are
skipped; places are 32-bit numbers; repeated rows give repeated results; very long texts, also of one piece, are whole documents; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
AHEAD, FAN, SLICE = 2, 64, 128
_CACHE = 1 << 17
_loaded: dict[str, "Counter"] = {}


class Counter(dict):
    """Piece -> tokens; forgets all when it holds ``_CACHE`` pieces."""

    def __init__(self, path: str, pattern: str = PATTERN):
        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n

    @classmethod
    def of(cls, path: str) -> "Counter":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def pieces(self, text: str) -> tuple[list[int], list[int]]:
        """(length, tokens) of each piece."""
        found = self.pattern.findall(text)
        return list(map(len, found)), list(map(self.__getitem__, found))


class TokenTree:
    """Pieces in blocks of about ``FAN``; ``chars`` and ``tokens`` are heaps of sums, their root at 1.

    A tree that was kept (``restored``) has its sums at once and opens a block only when an edit comes to it; ``opened`` counts those.
    """

    def __init__(self, lengths: list[int], counts: list[int]):
        parts = [(lengths[i : i + FAN], counts[i : i + FAN]) for i in range(0, len(lengths), FAN)] or [([], [])]
        self.open = dict(enumerate(parts))
        self.held, self.ends = b"", [0] * len(parts)
        self.opened, self.pieces = 0, len(lengths)
        self.leaves = 1 << (len(parts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for k, heap in enumerate((self.chars, self.tokens)):
            heap[self.leaves : self.leaves + len(parts)] = [sum(p[k]) for p in parts]
            for i in range(self.leaves - 1, 0, -1):
                heap[i] = heap[2 * i] + heap[2 * i + 1]

    @classmethod
    def restored(cls, sums: bytes, blocks: bytes) -> "TokenTree":
        tree = cls.__new__(cls)
        tree.pieces, n, *rest = _unpack(sums)
        tree.leaves = 1 << (n - 1).bit_length()
        tree.chars, tree.tokens, tree.ends = rest[: 2 * tree.leaves], rest[2 * tree.leaves : 4 * tree.leaves], rest[4 * tree.leaves :]
        tree.held, tree.open, tree.opened = blocks, {}, 0
        return tree

    def kept(self) -> tuple[bytes, bytes]:
        """The sums (with where each block ends), and the packed blocks; a tree whose blocks have outgrown it is built anew."""
        n = len(self.ends)
        if any(len(lengths) > 8 * FAN for lengths, _ in self.open.values()):
            parts = [self.block(b) for b in range(n)]
            return TokenTree([x for p in parts for x in p[0]], [x for p in parts for x in p[1]]).kept()
        blocks = [_pack(self.open[b][0] + self.open[b][1]) if b in self.open else self._packed(b) for b in range(n)]
        ends, at = [], 0
        for x in blocks:
            at += len(x)
            ends.append(at)
        return _pack([self.pieces, n, *self.chars, *self.tokens, *ends]), b"".join(blocks)

    def _packed(self, b: int) -> bytes:
        return self.held[self.ends[b - 1] if b else 0 : self.ends[b]]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def block(self, b: int) -> tuple[list[int], list[int]]:
        """(lengths, tokens) of the block's pieces."""
        if b not in self.open:
            held = _unpack(self._packed(b))
            self.open[b] = held[: len(held) // 2], held[len(held) // 2 :]
            self.opened += 1
        return self.open[b]

    def locate(self, at: int) -> tuple[int, int, int]:
        """(block, piece in the block, first character of the piece) of the piece that contains character ``at``."""
        node, begin = 1, 0
        while node < self.leaves:
            node *= 2
            if at >= begin + self.chars[node]:
                begin += self.chars[node]
                node += 1
        block = min(node - self.leaves, len(self.ends) - 1)
        lengths = self.block(block)[0]
        if node - self.leaves < len(self.ends):
            for i, n in enumerate(lengths):
                if at < begin + n:
                    return block, i, begin
                begin += n
        return block, len(lengths), begin

    def _update(self, b: int) -> None:
        for k, heap in enumerate((self.chars, self.tokens)):
            node = self.leaves + b
            heap[node] = sum(self.open[b][k])
            while node > 1:
                node //= 2
                heap[node] = heap[2 * node] + heap[2 * node + 1]

    def edit(self, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[str, int]:
        """Replace ``text[start:end]``; (the new text, pieces encoded anew)."""
        changed = text[:start] + new + text[end:]
        shift, behind = len(new) - (end - start), start + len(new)
        first, piece, begin = self.locate(max(0, start - AHEAD)) if text else (0, 0, 0)
        b, i, old = first, piece, begin
        fresh: tuple[list[int], list[int]] = ([], [])
        synced = False
        for found in counter.pattern.finditer(changed, begin):
            at = found.end()
            fresh[0].append(at - found.start())
            fresh[1].append(counter[found.group()])
            if at < behind:
                continue
            while old < at - shift and b < len(self.ends):
                lengths = self.block(b)[0]
                if i < len(lengths):
                    old += lengths[i]
                    i += 1
                else:
                    b, i = b + 1, 0
            if old == at - shift and old >= end:
                synced = True
                break
        if not synced:  # the text ends in new pieces: what is left of old ones goes
            b, i = len(self.ends) - 1, len(self.block(len(self.ends) - 1)[0])
        elif b == len(self.ends):
            b, i = b - 1, len(self.block(b - 1)[0])
        head, tail = self.block(first), self.block(b)
        self.pieces += len(fresh[0]) - (i - piece if b == first else len(head[0]) - piece + i + sum(len(self.block(k)[0]) for k in range(first + 1, b)))
        rest = tuple(x[i:] for x in tail)
        self.open[first] = tuple(h[:piece] + f + (r if b == first else []) for h, f, r in zip(head, fresh, rest))
        if b != first:
            self.open[b] = rest
        for between in range(first + 1, b):
            self.open[between] = [], []
        for touched in range(first, b + 1):
            self._update(touched)
        return changed, len(fresh[0])


def settled(edits, size: int) -> list[tuple[int, int, str]]:
    """Edits cut to the text, in order, without those that overlap an earlier one."""
    out: list[tuple[int, int, str]] = []
    cut = ((min(max(0, e["start"]), size), min(max(0, e["end"]), size), e["text"] or "") for e in edits or [] if e and e["start"] is not None and e["end"] is not None)
    for a, b, new in sorted(cut, key=lambda e: (e[0], -e[1], e[2])):
        if b >= a and (not out or a >= out[-1][1] and a > out[-1][0]):
            out.append((a, b, new))
    return out


# ---- Spark jobs


def _pack(numbers: list[int]) -> bytes:
    """Numbers of one byte each where all fit, else of four or eight; the first byte says which."""
    most = max(numbers, default=0)
    return b"\1" + bytes(numbers) if most < 256 else b"\4" + np.array(numbers, np.uint32).tobytes() if most < 1 << 32 else b"\10" + np.array(numbers, np.uint64).tobytes()


def _unpack(held: bytes) -> list[int]:
    return list(held[1:]) if held[:1] == b"\1" else np.frombuffer(held, np.uint32 if held[:1] == b"\4" else np.uint64, offset=1).tolist()


_EDITS = "array<struct<start:int,end:int,text:string>>"
_TREE = "text string, sums binary, blocks binary"
_COUNTS = "n_tokens long, n_pieces long, n_edits long, n_tokens_after long, n_reencoded long, n_blocks long, n_blocks_read long"


def _names(*schemas: str) -> list[str]:
    return [c.strip().split(" ")[0] for schema in schemas for c in schema.split(",")]


def _slices(batches):
    """Small pieces of Spark's batches: lists of pieces take many times the text's memory."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def build(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text, sums, blocks: each document's tree (and edits, if ``docs`` has them). Keep it as a table; edits start from it."""
    more = ["edits"] if "edits" in docs.columns else []

    def run(batches):
        counter = Counter.of(path)
        for batch in _slices(batches):
            held = [TokenTree(*counter.pieces(t.as_py() or "")).kept() for t in batch.column(1)]
            trees = [pa.array([h[k] for h in held], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *trees, *batch.columns[2:]], ["doc_id", *_names(_TREE), *more])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(F.col(c).cast(_EDITS).alias(c) for c in more))
    return rows.mapInArrow(run, f"doc_id {kind}, {_TREE}" + "".join(f", {c} {_EDITS}" for c in more))


def edited(trees: DataFrame, path: str = VOCABULARY, carry: tuple[str, ...] = ()) -> DataFrame:
    """The trees of ``build`` (or of an earlier round) under their column ``edits``: doc_id, the new text, sums and blocks, the counts, and columns to ``carry`` along.

    n_tokens and n_pieces are those before the edits; n_reencoded pieces were encoded anew, n_blocks_read of n_blocks blocks opened.
    """

    def run(batches):
        counter = Counter.of(path)
        for batch in _slices(batches):
            rows = []
            for text, sums, blocks, edits in zip(*(c.to_pylist() for c in batch.columns[1:5])):
                text = text or ""
                tree, todo, fresh = TokenTree.restored(sums, blocks), settled(edits, len(text)), 0
                before, n, pieces = tree.total, len(tree.ends), tree.pieces
                for a, b, new in reversed(todo):  # from the right, so that places to the left stay
                    text, k = tree.edit(text, a, b, new, counter)
                    fresh += k
                rows.append((text, *(tree.kept() if todo else (sums, blocks)), before, pieces, len(todo), tree.total, fresh, n, tree.opened))
            kinds = [pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * 7]
            new = (pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), *new, *batch.columns[5:]], ["doc_id", *_names(_TREE, _COUNTS), *carry])

    types = dict(trees.dtypes)
    rows = trees.select("doc_id", "text", "sums", "blocks", F.col("edits").cast(_EDITS).alias("edits"), *carry)
    return rows.mapInArrow(run, f"doc_id {types['doc_id']}, {_TREE}, {_COUNTS}" + "".join(f", {c} {types[c]}" for c in carry))


def recount(trees: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and the counts of ``edited``."""
    return edited(trees, path).select("doc_id", *_names(_COUNTS))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with column edits from a table of (doc_id, start, end, text): code points of the text, end excluded.

    A column of that name that is there already gets underscores at its end.
    """
    held = edits.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("text").alias("text"))).alias("edits"))
    free = "edits"
    while free in docs.columns:
        free += "_"
    return docs.withColumnRenamed("edits", free).join(held, "doc_id", "left")


def redactions(text: Column) -> Column:
    """Edits of a clean-up pass: the first address and the first number masked, the first line break doubled, 40 last characters cut."""
    # an address begins where its run of characters does and no run is read twice, so that long runs take linear time
    address = F.when(text.contains("@"), F.regexp_substr(text, F.lit(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++@[A-Za-z0-9-]++\.[A-Za-z.]++")))
    number = F.regexp_substr(text, F.lit("[0-9]+"))
    # what is found is an element of an array, so that it is looked for once, however often its place is needed
    wanted = F.array(*(F.struct(found.alias("found"), F.lit(new).alias("new")) for found, new in ((address, "<EMAIL>"), (number, "<NUM>"), (F.lit("\n"), "\n\n"))))
    placed = F.transform(wanted, lambda e: F.struct((F.call_function("locate", e["found"], text) - 1).alias("start"), F.char_length(e["found"]).alias("n"), e["new"].alias("text")))
    edits = F.transform(F.filter(placed, lambda e: e["start"] >= 0), lambda e: F.struct(e["start"].alias("start"), (e["start"] + e["n"]).alias("end"), e["text"].alias("text")))
    size = F.char_length(text)
    cut = F.array(F.when(size > 80, F.struct((size - 40).alias("start"), size.alias("end"), F.lit("").alias("text"))))
    return F.concat(edits, F.filter(cut, lambda e: e.isNotNull()))
