"""BPE encoding with a minimal acyclic transducer of the corpus's frequent words, and decoding.

``lexicon`` counts the words (pre-token pieces) of all documents, and compiles the most frequent ones with their token ids into a minimal
acyclic transducer: outputs are pushed as far to the front as words agree on them, and equal suffixes are one state. Its arcs are an
open-addressed table in one file, which also holds the vocabulary. The file lies in the shared folder; Spark brings it to each executor, whose
workers map it into memory. ``encode`` walks it for every word that a worker hasn't just met; words that it doesn't know are merged exactly
by the vocabulary's merges. ``decode`` puts the bytes of ids together.

Ids are those of the ``tokenizers`` library without added special tokens; the vocabulary's own special strings in a text are their ids.

Edge cases: null and empty texts have no ids; very long words are merged by a heap; repeated rows have equal results; a corpus without words has
an empty lexicon; an empty table gives an empty one; columns besides doc_id and text are ignored. Words longer than ``LONGEST`` bytes aren't
put into the lexicon, and at most ``WORDS`` are, those most often met (ties: the lesser word), so that its size is bounded; ids don't depend on it.
"""

from __future__ import annotations

import heapq
import json
import mmap
from bisect import bisect_left
from collections import Counter
from collections.abc import Collection, Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .shared import new_folder

WORDS, LONGEST = 1 << 16, 64
#: Units or words that a worker keeps at hand, and as many older ones.
AT_HAND = 1 << 16
#: Bytes of texts whose words are counted together.
COUNTED = 1 << 23
#: Units or ids whose places are computed together, so that very long texts take little more than their ids.
GATHERED = 1 << 17
#: White space as Unicode has it, and the pre-token pattern of byte-level BPE.
BLANK = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
_PIECE = regex.compile(PATTERN)
#: A blank before a word always begins a piece. Where another blank follows, a plain split at blanks won't do.
_DOUBLED, _UNIT = regex.compile(rf" (?:[{BLANK}]|$)"), regex.compile(rf" (?=[^{BLANK}])")
#: A character that is neither letter, number nor blank in any version of Unicode.
_OTHER = "\ue000"
_MARKS = frozenset(".,;:!?")


class Pieces:
    """Pre-token pieces of a text. ``odd``: ranges of code points that ``regex`` takes for letters or numbers, but the encoding doesn't know as such."""

    def __init__(self, odd: Iterable[tuple[int, int]] = ()):
        odd = list(odd)
        held = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in odd)
        self.odd = regex.compile(f"[{held}]") if held else None
        self.least = chr(min(a for a, _ in odd)) if held else "\U0010ffff"

    def after_blank(self, unit: str) -> list[str]:
        """Pieces of a blank and ``unit``: one if that is all letters, two if a mark follows these."""
        if unit.isalpha():
            if unit.isascii() or max(unit) < self.least:
                return [" " + unit]
        elif unit[-1:] in _MARKS and (word := unit[:-1]).isalpha() and (word.isascii() or max(word) < self.least):
            return [" " + word, unit[-1]]
        return self(" " + unit)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or max(text, default="") < self.least or self.odd is None or not self.odd.search(text):
            return _PIECE.findall(text)
        return [text[m.start() : m.end()] for m in _PIECE.finditer(self.odd.sub(_OTHER, text))]


@cache
def odd_letters() -> list[tuple[int, int]]:
    """Letters and numbers of ``regex`` that the older Unicode of ``tokenizers`` doesn't hold for such: asked from the library, all in two calls."""
    ask = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    every, found = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])), []
    for kind, like in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        held = regex.findall(kind, every)
        text = "\n".join(like + c + like for c in held)
        whole = {text[a:b] for _, (a, b) in ask(text)}
        found += [ord(c) for c in held if like + c + like not in whole]
    ranges: list[list[int]] = []
    for c in sorted(found):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return [(a, b) for a, b in ranges]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def units(texts: list[str]) -> tuple[list[str], pa.ListArray]:
    """Each text cut before each blank that a word follows: (what stands before the first cut, the other units without the cutting blanks).

    Pieces never cross such a cut.
    """
    first, plain, doubled, where = [], [], [], []
    for text in texts:
        if _DOUBLED.search(text):
            begins, *rest = _UNIT.split(text)
            where.append(~len(doubled))
            doubled.append(rest)
        else:
            begins, _, rest = text.partition(" ")
            where.append(len(plain))
            plain.append(rest or None)
        first.append(begins)
    held = pc.split_pattern(pa.array(plain, pa.string()), " ")
    if doubled:
        at = np.array(where)
        held = pa.concat_arrays([held, pa.array(doubled, held.type)]).take(pa.array(np.where(at < 0, len(plain) + ~at, at)))
    return first, held


def _strings(held: pa.Array) -> list[str]:
    """``to_pylist`` without an Arrow scalar for each string."""
    return held.to_numpy(zero_copy_only=False).tolist()


# ---- the vocabulary


class Vocabulary:
    """Byte-level BPE of a tokenizer file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        letters, model = byte_letters(), held["model"]
        if model["type"] != "BPE" or (held["pre_tokenizer"] or {}).get("type") != "ByteLevel" or held["pre_tokenizer"].get("add_prefix_space") or held["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in held["added_tokens"]):
            raise ValueError(f"{path}: special tokens that take blanks or words with them")
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ids = model["vocab"]
        self.tokens: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.merges = np.array([[ids[a], ids[b], ids[a + b]] for a, b in pairs], np.int64).reshape(-1, 3)
        self.singles = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]


class Merger:
    """Exact merges: the pair of least rank first, of equal ones the leftmost."""

    SHORT, WIDTHS = 24, (8, 12, 20, 40)

    def __init__(self, singles: list[int], merges: np.ndarray):
        self.singles = singles
        keys = merges[:, 0] << 32 | merges[:, 1]
        self.ranks = dict(zip(keys.tolist(), range(len(merges))))
        self.made = merges[:, 2].tolist()
        # the same as arrays, for many words at once; a last key that no pair has
        order = np.argsort(keys, kind="stable")
        self._keys, self._rank = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, len(merges)).astype(np.int32)
        self._made, self._singles = np.append(merges[:, 2], -1).astype(np.int64), np.array(singles, np.int64)
        self._of_bytes = self._ranks_of(*np.broadcast_arrays(self._singles[:, None], self._singles))

    def many(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as 32-bit numbers; words of about one length are merged side by side, one pair of each at a time."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) <= self.WIDTHS[-1]:
                by_width.setdefault(self.WIDTHS[bisect_left(self.WIDTHS, len(w))], []).append(i)
            else:
                out[i] = np.array(self(w), np.int32).tobytes()
        for width, which in by_width.items():
            for at in range(0, len(which), 1 << 14):
                part = which[at : at + (1 << 14)]
                for i, found in zip(part, self._side_by_side([words[i] for i in part], width)):
                    out[i] = found
        return out

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._rank[at], len(self.made)).astype(np.int32)

    def _side_by_side(self, words: list[bytes], width: int) -> list[bytes]:
        n, none, wide = len(words), len(self.made), width + 1
        size = np.fromiter(map(len, words), np.int64, n)[:, None]
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        column, first = np.arange(wide), np.arange(n)[:, None] * wide
        # ids stay where they are and know their neighbours' places; the last place of each row, without an id, is the neighbour of its ends
        ids = np.full((n, wide), -1, np.int64)
        ids[:, :width] = np.where(column[:-1] < size, self._singles[data], -1)
        ranks = np.full((n, width), none, np.int32)
        ranks[:, :-1] = np.where(column[1:-1] < size, self._of_bytes[data[:, :-1], data[:, 1:]], none)
        after, before = (first + np.where(column + 1 < size, column + 1, width)).ravel(), (first + np.where(column > 0, column - 1, width)).ravel()
        held, base = ids.ravel(), first.ravel()
        while True:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(at)), at]
            on = least < none
            if not on.all():
                base, ranks, at, least = base[on], ranks[on], at[on], least[on]
            if not len(at):
                break
            row, here = np.arange(len(at)), base + at
            gone, left = after[here], before[here]
            right = after[gone]
            held[here], held[gone] = self._made[least], -1
            after[here], before[right] = right, here
            ranks[row, gone - base] = none
            ranks[row, at] = self._ranks_of(held[here], held[right])
            row = np.flatnonzero(held[left] >= 0)
            ranks[row, (left - base)[row]] = self._ranks_of(held[left[row]], held[here[row]])
        kept = ids >= 0
        flat, ends = ids[kept].astype(np.int32).tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def __call__(self, word: bytes) -> list[int]:
        ids = [self.singles[b] for b in word]
        if len(ids) > self.SHORT:
            return self._by_heap(ids)
        ranks, none = self.ranks, len(self.made)
        at = [ranks.get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while at:
            least = min(at)
            if least == none:
                break
            i = at.index(least)
            ids[i : i + 2] = [self.made[least]]
            del at[i]
            if i < len(at):
                at[i] = ranks.get(ids[i] << 32 | ids[i + 1], none)
            if i:
                at[i - 1] = ranks.get(ids[i - 1] << 32 | ids[i], none)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := ranks.get(a << 32 | b)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ranks.get(ids[i] << 32 | ids[j]) != rank:
                continue  # one of them has been merged since
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(queue, (r, a))
        return [i for i in ids if i >= 0]


# ---- the transducer


def transducer(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> tuple[list[tuple], int]:
    """States of the minimal transducer of sorted (word, ids), and the number of its first one.

    A state is (output at the end of a word or None, ((byte, output, state), ...)).
    """
    register: dict[tuple, int] = {}

    def freeze(state: list) -> int:
        return register.setdefault((state[0], tuple(map(tuple, state[1]))), len(register))

    path: list[list] = [[None, []]]  # open states along the last word: [output at the end, arcs]
    last = b""
    for word, out in entries:
        same = 0
        while same < len(word) and same < len(last) and word[same] == last[same]:
            same += 1
        for i in range(len(last), same, -1):
            path[i - 1][1][-1][2] = freeze(path.pop())
        for i in range(same):  # outputs that both words share stay in front, what only the earlier words have goes behind
            arc, child = path[i][1][-1], path[i + 1]
            k = 0
            while k < len(arc[1]) and k < len(out) and arc[1][k] == out[k]:
                k += 1
            rest, arc[1], out = arc[1][k:], arc[1][:k], out[k:]
            if rest:
                child[0] = None if child[0] is None else rest + child[0]
                for a in child[1]:
                    a[1] = rest + a[1]
        for b in word[same:]:
            path[-1][1].append([b, (), None])
            path.append([None, []])
        if same < len(word):
            path[same][1][-1][1], path[-1][0] = out, ()
        else:
            path[-1][0] = out
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1][1][-1][2] = freeze(path.pop())
    first = freeze(path.pop())
    return list(register), first


_EMPTY, _SPREAD = 0xFFFFFFFF, 0x9E3779B1


def compiled(entries: Iterable[tuple[bytes, tuple[int, ...]]], vocabulary: Vocabulary) -> bytes:
    """The file: sizes, then arrays of 32-bit numbers (arc keys, targets, outputs, ends of states, output pool, merges, tokens, odd letters), then the tokens' bytes."""
    states, first = transducer(entries)
    pool, places = [0], {(): 0}  # the empty output is a length of nought at the front

    def place(out: tuple[int, ...]) -> int:
        if out not in places:
            places[out] = len(pool)
            pool.extend((len(out), *out))
        return places[out]

    arcs = [(s << 8 | b, target, place(out)) for s, (_, held) in enumerate(states) for b, out, target in held]
    size = 1 << (2 * len(arcs) + 1).bit_length()
    table = np.full((3, size), _EMPTY, np.uint32)
    for key, target, out in arcs:
        slot = key * _SPREAD % (1 << 32) & (size - 1)
        while table[0, slot] != _EMPTY:
            slot = slot + 1 & (size - 1)
        table[:, slot] = key, target, out
    ends = [_EMPTY if end is None else place(end) for end, _ in states]
    ids = sorted(vocabulary.tokens)
    held = [vocabulary.tokens[i] for i in ids]
    special = [vocabulary.special[s] for s in sorted(vocabulary.special)]
    odd = [end for pair in odd_letters() for end in pair]
    parts = [table[0], table[1], table[2], ends, pool, vocabulary.singles, vocabulary.merges.ravel(), ids, [len(t) for t in held], special, odd]
    parts = [np.asarray(p, np.uint32) for p in parts]
    sizes = np.array([first, *map(len, parts)], np.uint32)
    return sizes.tobytes() + b"".join(p.tobytes() for p in parts) + b"".join(held)


class Recent:
    """Ids of what was met lately. When ``most`` entries are held they become the older generation; what is asked for again moves on."""

    def __init__(self, most: int):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.most = most

    def known(self, keys: Collection[str]) -> tuple[dict[str, bytes], list[str]]:
        """(ids of the keys that are held, the other keys)."""
        now, before = self.now.get, self.before.get
        found = {k: ids for k in keys if (ids := now(k) or before(k)) is not None}
        return found, [k for k in keys if k not in found]

    def hold(self, made: dict[str, bytes]) -> None:
        if len(self.now) >= self.most:
            self.now, self.before = {}, self.now
        self.now.update(made)


class Lexicon:
    """A compiled file, mapped into memory: ``walk`` looks up many words at once, ``encode`` takes texts, ``decode`` ids."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            held = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        numbers = np.frombuffer(held, np.uint32, len(held) // 4)
        self.first, sizes, at = int(numbers[0]), numbers[1:12].tolist(), 12
        parts = []
        for n in sizes:
            parts.append(numbers[at : at + n])
            at += n
        self.keys, self.targets, self.outs, self.ends, self.pool, singles, merges, ids, lengths, special, odd = parts
        self.pieces = Pieces(zip(odd[0::2].tolist(), odd[1::2].tolist()))
        self.merge = Merger(singles.tolist(), merges.astype(np.int64).reshape(-1, 3))
        self.tokens, place = {}, 4 * at
        for i, n in zip(ids.tolist(), lengths.tolist()):
            self.tokens[i] = held[place : place + n]
            place += n
        # the same as arrays, for many ids at once
        self.token_size, self.token_at = np.zeros((2, int(ids.max(initial=0)) + 1), np.int64)
        self.token_size[ids], self.token_at[ids] = lengths, np.cumsum(lengths, dtype=np.int64) - lengths
        self.token_bytes = np.frombuffer(held, np.uint8, offset=4 * at)
        self.special = {self.tokens[i].decode(): i for i in special.tolist()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words, self.units = Recent(AT_HAND), Recent(AT_HAND)

    def walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether each word is in the lexicon, offsets of its ids, the ids): all words go along their paths together, byte by byte."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        start, mask = np.cumsum(lengths) - lengths, np.uint32(len(self.keys) - 1)
        state, known = np.full(n, self.first, np.uint32), np.ones(n, bool)
        live, step, who, what = np.flatnonzero(lengths > 0), 0, [], []
        while len(live):
            key = state[live] << np.uint32(8) | data[start[live] + step].astype(np.uint32)
            slot = key * np.uint32(_SPREAD) & mask
            found = self.keys[slot]
            while len(more := np.flatnonzero((found != key) & (found != _EMPTY))):
                slot[more] = slot[more] + np.uint32(1) & mask
                found[more] = self.keys[slot[more]]
            on = found == key
            known[live[~on]] = False
            live, slot = live[on], slot[on]
            state[live], out = self.targets[slot], self.outs[slot]
            who.append(live[out > 0])
            what.append(out[out > 0])
            step += 1
            live = live[lengths[live] > step]
        end = np.where(known, self.ends[state], np.uint32(_EMPTY))
        known &= end != _EMPTY
        last = known & (end > 0)
        who, what = np.concatenate([*who, np.flatnonzero(last)]), np.concatenate([*what, end[last]]).astype(np.int64)
        kept = known[who]
        order = np.argsort(who[kept], kind="stable")  # outputs along a path were met in its order
        who, what = who[kept][order], what[kept][order]
        size = self.pool[what].astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(who, size, n).astype(np.int64))])
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return known, offsets, self.pool[np.repeat(what + 1, size) + at].astype(np.int32)

    def _made(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of words: by the transducer, or merged."""
        words = [p.encode() for p in pieces]
        known, offsets, ids = self.walk(words)
        held, ends = ids.tobytes(), (offsets * 4).tolist()
        made = {p: held[a:b] for p, a, b in zip(pieces, ends, ends[1:])}
        strange = np.flatnonzero(~known).tolist()
        made.update(zip([pieces[i] for i in strange], self.merge.many([words[i] for i in strange])))
        return made

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        plan: list[list[int]] = []  # of each text its special ids, as they are, and its parts' numbers, inverted
        parts: list[str] = []
        for text in texts:
            plan.append([])
            for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
                if i % 2:
                    plan[-1].append(self.special[part])
                elif part:
                    plan[-1].append(~len(parts))
                    parts.append(part)
        first, rest = units(parts)
        first = [self.pieces(x) for x in first]
        lead = {p for found in first for p in found}
        every = rest.flatten().dictionary_encode()
        asked = _strings(every.dictionary)
        unit_ids, unknown = self.units.known(asked)
        cut = {u: found for u in unknown if len(found := self.pieces.after_blank(u)) != 1}
        # a unit's first piece is a blank and a unit of that one piece: held as such, not as a word once more
        heads = {found[0][1:] for found in cut.values()}.difference(unit_ids)
        head_ids, new = self.units.known(heads.difference(unknown))
        whole = [u for u in (*unknown, *new) if u not in cut]
        lead.update(p for found in cut.values() for p in found[1:])
        word_ids, missing = self.words.known(lead)
        for at in range(0, len(missing), AT_HAND // 4):
            word_ids |= self._made(missing[at : at + AT_HAND // 4])
        for at in range(0, len(whole), AT_HAND // 4):
            some = whole[at : at + AT_HAND // 4]
            unit_ids.update(zip(some, self._made([" " + u for u in some]).values()))
        unit_ids.update(head_ids)
        for u, found in cut.items():
            unit_ids[u] = b"".join([unit_ids[found[0][1:]], *map(word_ids.__getitem__, found[1:])])
        self.words.hold(word_ids)
        self.units.hold(unit_ids)
        held = list(map(unit_ids.__getitem__, asked))
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        begin, pool = np.cumsum(size) - size, np.frombuffer(b"".join(held), np.int32)
        which = every.indices.to_numpy()
        reach = np.concatenate([[0], np.cumsum(size[which])])
        gathered = [np.zeros(0, np.int32)]
        for at in range(0, len(which), GATHERED):
            some = which[at : at + GATHERED]
            behind = np.cumsum(size[some]) - size[some]
            gathered.append(pool[np.repeat(begin[some] - behind, size[some]) + np.arange(size[some].sum())])
        ids = np.concatenate(gathered)
        lengths = pc.fill_null(pc.list_value_length(rest), 0).to_numpy(zero_copy_only=False)
        ends = reach[np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])].tolist()
        out = []
        for of_text in plan:
            found: list[np.ndarray] = [np.zeros(0, np.int32)]
            for i in of_text:
                if i < 0:
                    found.append(np.frombuffer(b"".join([word_ids[p] for p in first[~i]]), np.int32))
                    found.append(ids[ends[~i] : ends[~i + 1]])
                else:
                    found.append(np.array([i], np.int32))
            out.append(np.concatenate(found))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ``ids`` between one of ``ends`` and the next: bytes of all tokens are gathered at once."""
        held, reach = [], [np.zeros(1, np.int64)]
        for at in range(0, len(ids), GATHERED):
            part = ids[at : at + GATHERED]
            size = self.token_size[part]
            reach.append(reach[-1][-1] + np.cumsum(size))
            behind = np.cumsum(size) - size
            held.append(self.token_bytes[np.repeat(self.token_at[part] - behind, size) + np.arange(size.sum())].tobytes())
        data, ends = b"".join(held), np.concatenate(reach)[ends].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


_loaded: dict[str, Lexicon] = {}


def _lexicon(name: str) -> Lexicon:
    """The file that Spark has brought to this executor."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Lexicon(SparkFiles.get(name))
    return _loaded[name]


# ---- Spark jobs


def word_counts(docs: DataFrame, special: Iterable[str] = ()) -> DataFrame:
    """word, n of all pieces of all texts; special strings are no words."""
    cut, odd = regex.compile("|".join(map(regex.escape, special))) if special else None, odd_letters()

    def run(batches):
        find = Pieces(odd)
        for batch in batches:
            for some in _parts(batch, COUNTED):
                texts = some.column(0).to_pylist()
                first, rest = units([part for text in texts for part in (cut.split(text) if cut else [text])])
                counted = rest.flatten().value_counts()
                held, n = counted.field(0), counted.field(1)
                whole = pc.ascii_is_alpha(held)  # units that are one word
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise("", held.filter(whole), " "), n.filter(whole)], ["word", "n"])
                pieces = Counter(p for text in first for p in find(text))
                other = pc.invert(whole)
                for unit, k in zip(_strings(held.filter(other)), n.filter(other).to_pylist()):
                    for p in find.after_blank(unit):
                        pieces[p] = pieces.get(p, 0) + k
                yield pa.RecordBatch.from_arrays([pa.array(pieces.keys(), pa.string()), pa.array(pieces.values(), pa.int64())], ["word", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text") != "")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, vocabulary: str | None = None, words: int = WORDS) -> str:
    """Compile the ``words`` most frequent words of all texts that occur twice at least; returns the name by which executors find the file."""
    spark = docs.sparkSession
    known = Vocabulary(vocabulary or default_vocabulary())
    short = word_counts(docs, known.special).where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST))
    frequent = short.orderBy(F.desc("n"), "word").limit(words).select("word").toArrow().column(0).to_pylist()
    merge = Merger(known.singles, known.merges)
    blob = compiled(((w, tuple(merge(w))) for w in sorted(w.encode() for w in frequent)), known)
    name = new_folder(spark, "lexicon").rsplit("/", 1)
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(name) + ".bin")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(blob))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name[1] + ".bin"


def _parts(batch: pa.RecordBatch, most: int = 1 << 20):
    """A batch in parts of about ``most`` bytes and a row at least, so that lists of units stay small."""
    rows = max(1, len(batch) * most // max(most, batch.nbytes))
    return (batch.slice(at, rows) for at in range(0, len(batch), rows))


def encode(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, ids of every text, by the lexicon of that name."""

    def run(batches):
        held = _lexicon(name)
        for batch in batches:
            for part in _parts(batch):
                found = held.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, name: str) -> DataFrame:
    """What ``decode(encode(docs, name), name)`` gives, in one pass: doc_id, ids, and the text made of these ids."""

    def run(batches):
        held = _lexicon(name)
        for batch in batches:
            for part in _parts(batch):
                found = held.encode([t or "" for t in part.column(1).to_pylist()])
                ends, every = np.cumsum([0, *map(len, found)]), np.concatenate(found)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(every, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(held.decode_many(every, ends), pa.string())], ["doc_id", "ids", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def decode(encoded: DataFrame, name: str) -> DataFrame:
    """doc_id, ids, text: the text that the ids stand for; null ids are none."""

    def run(batches):
        held = _lexicon(name)
        for batch in batches:
            for part in _parts(batch):
                texts = pa.array([held.decode(ids.as_py() or []) for ids in part.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
