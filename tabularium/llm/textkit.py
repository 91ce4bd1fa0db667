"""Words and shingles of many texts at once, as NumPy arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: ASCII that is no letter or digit parts words; bytes of longer code points belong to words.
_PART = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_powers: dict[str, np.ndarray] = {}

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of each at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, _BASE, U64), np.full(size, U64(pow(int(_BASE), -1, 1 << 64)), U64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte times power; a slice's hash is their difference, shifted by the inverse power."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def blocks(rows: Iterable[tuple], text_at: int, most: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows in lists of about ``most`` characters, so that working arrays stay small; a row is never cut."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at] or "") + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, in order; offsets of each text's words, one more than texts).

    Words are runs of ASCII letters and digits and of other code points, in lower case.
    """
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    data = np.frombuffer(b" " + b" ".join(parts).translate(_PART) + b" ", np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    hashed = mix(slice_hash(prefix_hash(data), start, end) + (end - start).astype(U64))
    begins = np.concatenate([[0], np.cumsum(sizes)]) + 1
    return hashed, np.searchsorted(start, begins)


def shingles(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text, sorted within the text; offsets).

    A text of fewer words than ``size`` but one at least has one shingle of all its words.
    """
    hashed, at = words(texts)
    n_docs = len(at) - 1
    counts = np.diff(at)
    doc = np.repeat(np.arange(n_docs), counts)
    rolled = np.zeros(len(hashed), U64)
    place = np.arange(len(hashed)) - at[doc]
    width = np.minimum(counts, size)[doc]
    for j in range(size):
        has = np.flatnonzero((j < width) & (place + j < counts[doc]))
        rolled[has] = rolled[has] * U64(0x100000001B3) + mix(hashed[has + j] + U64(j + 1))
    whole = place + width <= counts[doc]
    return distinct(mix(rolled[whole]), doc[whole], n_docs)


def distinct(values: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Values made distinct and sorted within each document; offsets."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[first], np.searchsorted(doc[first], np.arange(n_docs + 1))
