"""GIF as a media column: decode LZW code streams, apply palettes, disposal and transparency, keep timed frames.

``decode_gif`` reads any GIF87a/89a of 8-bit or smaller samples (global and local palettes, interlace,
clear and end codes, deferred clears, all four disposal methods, transparent colours). ``encode_gif``
stores a byte payload losslessly as grey frames of width 24. Both are small helpers of the Spark jobs
``gif_frames`` and ``store_texts`` / ``read_texts``, which work on slices of about a megabyte within each input split,
so that the codes of many streams are packed and unpacked as arrays: no shuffle, memory bounded by the largest value.

Edge cases: null and empty texts are one frame of padding; equal texts give equal bytes and values; a null
or broken media value gives one row with frame_no null and an error (``gif_frames``); very long texts are as many
frames as they need; repeated rows are repeated in the result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import blocks

BLOCK, WIDTH, FRAME_BLOCKS, DELAY_CS = 576, 24, 32, 4
GREY = bytes(v for i in range(256) for v in (i, i, i))


# ---- code streams


@lru_cache(16)
def _widths(min_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of the j-th code after a clear, and its bit offset from there; the reader has 2**m + 2 + j - 1 entries then."""
    j = np.arange(8200)
    entries = (1 << min_bits) + 2 + np.maximum(0, j - 1)
    width = np.full(len(j), min_bits + 1)
    for bits in range(min_bits + 1, 12):
        width[entries >= 1 << bits] = bits + 1
    return width, np.concatenate([[0], np.cumsum(width)])


def _codes(data: bytes, min_bits: int) -> np.ndarray:
    """The codes of longest-match LZW, with clear and end codes; a clear code follows when the table is full.

    The table is a list with a place for each entry and next sample, where samples go by their rank among those that occur;
    it grows by pages.
    """
    clear = 1 << min_bits
    used = np.flatnonzero(np.bincount(np.frombuffer(data, np.uint8), minlength=256))
    n, most = len(used), min(4094 - clear - 2, len(data))
    ranks = bytearray(256)
    for rank, sample in enumerate(used.tolist()):
        ranks[sample] = rank
    out = array("q", [-2])
    add = out.append
    page, limit = n * min(256, n + most), n * (n + most)
    table, free = [0] * max(page, n * n), n * n
    full = len(table)
    held = -1
    for b in data.translate(ranks):
        if held < 0:
            held = b * n
            continue
        at = held + b
        longer = table[at]
        if longer:
            held = longer
            continue
        add(held)
        if free == full and full < limit:
            table.extend([0] * min(page, limit - full))
            full = len(table)
        if free < full:
            table[at] = free
            free += n
        else:
            add(-2)
            table, free = [0] * full, n * n
        held = b * n
    if held >= 0:
        add(held)
    add(-1)
    entry = np.frombuffer(out, np.int64)
    entry = np.where(entry < 0, entry, entry // max(1, n))
    return np.where(entry < 0, clear + 2 + entry, np.where(entry < n, np.append(used, 0)[np.clip(entry, 0, n)], entry - n + clear + 2))


def lzw_encode_all(streams: list[bytes], min_bits: int = 8) -> list[bytes]:
    """Code streams of longest-match LZW; all codes of the streams are packed at once."""
    if not streams:
        return []
    made = [_codes(s, min_bits) for s in streams]
    sizes = np.array([len(c) for c in made])
    begin = np.cumsum(sizes) - sizes
    code = np.concatenate(made)
    here = np.arange(len(code))
    last_clear = np.maximum.accumulate(np.where(code == 1 << min_bits, here, -1))
    since = here - np.concatenate([[-1], last_clear[:-1]]) - 1
    since[begin] = 0
    width = _widths(min_bits)[0][since]
    bit = np.cumsum(width) - width
    n_bytes = -(-np.add.reduceat(width, begin) // 8)
    first = np.cumsum(n_bytes) - n_bytes
    bit += np.repeat(8 * first - bit[begin], sizes)
    value, byte = code << (bit & 7), bit >> 3
    total = int(n_bytes.sum()) + 2
    packed = sum(np.bincount(byte + k, value >> 8 * k & 255, total) for k in range(3)).astype(np.uint8).tobytes()
    return [packed[a : a + n] for a, n in zip(first.tolist(), n_bytes.tolist())]


def lzw_encode(data: bytes, min_bits: int = 8) -> bytes:
    return lzw_encode_all([data], min_bits)[0]


def _read_codes(streams: list[bytes], min_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, run within it, code) of every code but clears and ends, in order: a run of each stream a round."""
    clear = 1 << min_bits
    width, offset = _widths(min_bits)
    total = np.array([8 * len(s) for s in streams], np.int64)
    base = np.cumsum(total + 24) - total - 24
    raw = np.frombuffer(b"".join(s + b"\0\0\0" for s in streams), np.uint8).astype(np.int64)
    at, place, run = np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64)
    live, held = np.arange(len(streams)), []
    while len(live):
        place[live] = np.minimum(place[live], 4200)  # the width is 12 from there on
        j = place[live]
        n = np.searchsorted(offset, total[live] - at[live] + offset[j], "right") - 1 - j
        live, j, n = live[n > 0], j[n > 0], np.minimum(n[n > 0], 3900)
        if not len(live):
            break
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(np.arange(len(live)), n)
        bit = (base + at)[live][row] + offset[j[row] + step] - offset[j][row]
        byte = bit >> 3
        code = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (bit & 7) & ((1 << width[j[row] + step]) - 1)
        stop = np.flatnonzero((code == clear) | (code == clear + 1))
        ended, where = np.unique(row[stop], return_index=True)
        cut = n.copy()
        cut[ended] = step[stop[where]]
        whole = step < cut[row]
        held.append((live[row[whole]], run[live][row[whole]], code[whole]))
        over = np.zeros(len(live), bool)
        over[ended] = code[stop[where]] == clear + 1
        fresh = (cut < n) & ~over
        used = np.where(fresh, cut + 1, cut)
        at[live] += offset[j + used] - offset[j]
        place[live] = np.where(fresh, 0, j + used)
        run[live] += fresh
        live = live[~over]
    if not held:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    stream, run_no, code = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(stream, kind="stable")
    return stream[order], run_no[order], code[order]


def lzw_decode_all(streams: list[bytes], min_bits: int) -> list[bytes | None]:
    """All samples of each code stream, which ends at its end code or where its bits end; None where a code isn't in the table yet.

    Entry i of a run is its code i's samples and the first sample of its code i + 1. So each code that isn't a sample
    has an earlier code as parent; lengths and first samples come by doubling steps to the parents, then all
    codes write their last sample, their parents' last sample before it, and so on.
    """
    clear = 1 << min_bits
    stream, run, code = _read_codes(streams, min_bits)
    if not len(code):
        return [b""] * len(streams)
    here = np.arange(len(code))
    new = np.ones(len(code), bool)
    new[1:] = (stream[1:] != stream[:-1]) | (run[1:] != run[:-1])
    begin = np.maximum.accumulate(np.where(new, here, 0))
    parent = np.where(code < clear, -1, begin + code - clear - 2)
    early = parent >= here
    wrong = set(np.unique(stream[early]).tolist())
    parent[early] = -1
    root, length = np.where(parent < 0, here, parent), (parent >= 0).astype(np.int64)
    while True:
        up = root[root]
        if (up == root).all():
            break
        length += length[root]
        root = up
    length += 1
    first = code[root].astype(np.uint8)
    last = np.where(parent < 0, code, first[np.minimum(parent + 1, len(code) - 1)]).astype(np.uint8)
    end = np.cumsum(length)
    out = np.empty(int(end[-1]), np.uint8)
    now, spot = here, end - 1
    while len(now):
        out[spot] = last[now]
        now = parent[now]
        more = now >= 0
        now, spot = now[more], spot[more] - 1
    samples = out.tobytes()
    ends = np.concatenate([[0], end])[np.searchsorted(stream, np.arange(len(streams) + 1))].tolist()
    return [None if i in wrong else samples[a:b] for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]


def lzw_decode(stream: bytes, min_bits: int) -> bytes:
    samples = lzw_decode_all([stream], min_bits)[0]
    if samples is None:
        raise ValueError("a code is not in the table yet")
    return samples


# ---- files


def encode_gifs(payloads: list[bytes]) -> list[bytes]:
    """Payloads of whole 576-byte blocks as grey frames, 32 blocks each at most, 40 ms apart."""
    parts = [[p[at : at + BLOCK * FRAME_BLOCKS] for at in range(0, len(p), BLOCK * FRAME_BLOCKS)] for p in payloads]
    streams = iter(lzw_encode_all([x for frames in parts for x in frames]))
    made = []
    for frames in parts:
        out = [struct.pack("<6sHHBBB", b"GIF89a", WIDTH, len(frames[0]) // WIDTH, 0xF7, 0, 0), GREY]
        for part in frames:
            out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 2 << 2, DELAY_CS, 0, 0))
            out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0, 8))
            codes = next(streams)
            out += [bytes([len(c := codes[i : i + 255])]) + c for i in range(0, len(codes), 255)]
            out.append(b"\0")
        made.append(b"".join([*out, b"\x3b"]))
    return made


def encode_gif(payload: bytes) -> bytes:
    return encode_gifs([payload])[0]


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := data[at]) != 0:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _rows(height: int) -> np.ndarray:
    """Order of an interlaced picture's rows."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _palette(data: bytes, at: int, n: int) -> np.ndarray:
    """RGBA of each colour, as one 32-bit number; samples beyond the palette are black."""
    table = np.zeros((256, 4), np.uint8)
    table[:n, :3], table[:, 3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), 255
    return table.view(np.uint32)[:, 0]


@dataclass
class Picture:
    """One image of a file, still coded."""

    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    palette: np.ndarray
    min_bits: int
    codes: bytes
    delay: int
    disposal: int
    clear_colour: int


def pictures(data: bytes) -> tuple[int, int, list[Picture]]:
    """Width and height of the canvas and the file's images."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared, found = 13, None, []
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = _palette(data, at, n), at + 3 * n
    delay, disposal, clear_colour = 0, 0, -1
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            body, end = _sub_blocks(data, at + 2)
            if data[at + 1] == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_colour = packed >> 2 & 7, index if packed & 1 else -1
            at = end
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at, palette = at + 10, shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette, at = _palette(data, at, n), at + 3 * n
        if palette is None:
            raise ValueError("no palette")
        min_bits = data[at]
        if not 1 <= min_bits <= 8:
            raise ValueError(f"samples of {min_bits} bits")
        codes, at = _sub_blocks(data, at + 1)
        found.append(Picture(left, top, w, h, bool(flags & 0x40), palette, min_bits, codes, delay, disposal, clear_colour))
        delay, disposal, clear_colour = 0, 0, -1
    return wide, high, found


def decoded(found: list[Picture], most: int = 1 << 17) -> Iterator[bytes | None]:
    """The samples of each image in order, decoded in groups of about ``most`` code bytes."""
    at = 0
    while at < len(found):
        end, size = at, 0
        while end < len(found) and found[end].min_bits == found[at].min_bits and size < most:
            size += len(found[end].codes)
            end += 1
        yield from lzw_decode_all([f.codes for f in found[at:end]], found[at].min_bits)
        at = end


def composed(wide: int, high: int, found: list[Picture], samples: Iterator[bytes | None]) -> Iterator[dict]:
    """Draw each image on the canvas and dispose of it."""
    canvas, clock = np.zeros((high, wide), np.uint32), 0
    for number, f in enumerate(found):
        got = next(samples)
        if got is None:
            raise ValueError("a code is not in the table yet")
        got = np.frombuffer(got, np.uint8)[: f.width * f.height]
        if len(got) < f.width * f.height:
            raise ValueError("the code stream ends early")
        got = got.reshape(f.height, f.width)
        if f.interlaced:
            straight = np.empty_like(got)
            straight[_rows(f.height)] = got
            got = straight
        before = canvas.copy() if f.disposal == 3 else None
        w, h = max(0, min(f.width, wide - f.left)), max(0, min(f.height, high - f.top))
        got = got[:h, :w]
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        drawn = f.palette[got]
        area[...] = np.where(got == f.clear_colour, area, drawn) if f.clear_colour >= 0 else drawn
        yield {
            "frame_no": number, "start_ms": clock, "delay_ms": 10 * f.delay, "left": f.left, "top": f.top, "width": w, "height": h,
            "disposal": f.disposal, "canvas": canvas.view(np.uint8).reshape(high, wide, 4),
        }
        clock += 10 * f.delay
        if f.disposal == 2:
            area[...] = 0
        elif f.disposal == 3:
            canvas = before


def decode_gif(data: bytes) -> Iterator[dict]:
    """Frames in order: frame_no, start_ms, delay_ms, left, top, width, height, disposal, canvas (height, width, RGBA)."""
    wide, high, found = pictures(data)
    return composed(wide, high, found, decoded(found))


# ---- Spark jobs


def colour_histogram(canvas: np.ndarray, bins: int = 16) -> list[list[int]]:
    """Counts of red, green and blue in equal bins, over pixels that are not transparent."""
    seen = canvas[canvas[..., 3] > 0]
    return [np.bincount(seen[:, c] >> (8 - bins.bit_length() + 1), minlength=bins).tolist() for c in range(3)]


FRAME_SCHEMA = "frame_no int, start_ms long, delay_ms int, width int, height int, disposal int, red array<long>, green array<long>, blue array<long>, rgba binary, error string"


def gif_frames(df: DataFrame, key: str, media: str, bins: int = 16) -> DataFrame:
    """A row for each composed frame of each GIF: key, times, size, colour histograms, RGBA samples of the canvas."""
    fields = [f.split(" ")[0] for f in FRAME_SCHEMA.split(", ")]

    def frames(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows = []
                try:
                    for f in decode_gif(data.as_py() or b""):
                        red, green, blue = colour_histogram(f["canvas"], bins)
                        rows.append((f["frame_no"], f["start_ms"], f["delay_ms"], f["canvas"].shape[1], f["canvas"].shape[0], f["disposal"], red, green, blue, f["canvas"].tobytes(), None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((*[None] * 10, str(e)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), batch.schema[0].type), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [key, *fields])

    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.string()]
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(media)).mapInArrow(frames, f"`{key}` {kind}, {FRAME_SCHEMA}")


def pad(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text padded with 255 to a positive multiple of the block)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def _values(column: pa.Array) -> Iterator:
    """A column's values one at a time, so that a batch isn't held twice."""
    return (v.as_py() for v in column)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a GIF."""

    def store(batches):
        for batch in batches:
            for block in blocks(zip(batch.column(0).to_pylist(), _values(batch.column(1))), 1, 1 << 18):
                held = {t: pad(t) for _, t in block}  # equal texts are coded once
                media = dict(zip(held, encode_gifs([p for _, p in held.values()])))
                cols = [pa.array([i for i, _ in block], batch.schema[0].type), pa.array([held[t][0] for _, t in block], pa.int64()), pa.array([media[t] for _, t in block], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(store, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


READ_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"


def read_texts(stored: DataFrame) -> DataFrame:
    """Decode the media column of ``store_texts``: digests of the payload that comes back and of the stored form.

    feature: counts of grey in 16 equal bins over all frames, joined by commas.
    """

    def values(media: bytes, samples: Iterator[bytes | None], parsed: tuple[int, int, list[Picture]]) -> tuple:
        parts, frames, end = [], 0, 0
        for f in composed(*parsed, samples):
            parts.append(f["canvas"][f["top"] : f["top"] + f["height"], f["left"] : f["left"] + f["width"], 0].tobytes())
            frames, end = frames + 1, f["start_ms"] + f["delay_ms"]
        payload = b"".join(parts)
        bins = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, bins.tolist())), frames, end

    def read(batches):
        for batch in batches:
            for block in blocks(zip(*(_values(batch.column(i)) for i in range(3))), 2, 1 << 18):
                parsed = {m: pictures(m) for _, _, m in block}
                samples = decoded([f for _, _, found in parsed.values() for f in found])
                done = {m: values(m, samples, p) for m, p in parsed.items()}
                out = [(n, *done[m]) for _, n, m in block]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
                cols = [pa.array([i for i, _, _ in block], batch.schema[0].type), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f.split(" ")[0] for f in READ_SCHEMA.split(", "))])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, {READ_SCHEMA}")
