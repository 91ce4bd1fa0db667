"""WARC archives with a Zstandard dictionary: trained from the archive's own records, embedded in a leading
skippable frame, every record compressed by itself so that one can be read alone.

Spark decides which records refer to an earlier capture, writes the archives through its own text writer
(so any file system that Spark can write to will do) and reads them back as binary files. An archive is
one output file: the dictionary frame, then a frame for each record. Spark's writer ends each piece with a
line feed; a one-byte skippable frame opened before it makes that byte part of a valid file. A task begins a new archive
after ``PIECES`` pieces or ``ARCHIVE_BYTES``, which ends with empty pieces, so that the writer's file ends there too.

Edge cases: null html is an empty payload; a null url becomes ``urn:x-none``; of equal payloads (of
``min_bytes`` at least) the largest page_id is the response, and rows that repeat that id and payload are
responses too; rows without an id revisit if any row with an id has the payload; where an archive has too few records to
train a dictionary, the beginnings of its records are the dictionary as they are; a very long page is one record and makes its piece
longer; extra columns, also of names used here, are ignored; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import staged

DICT_MAGIC, PAD_MAGIC = 0x184D2A5D, 0x184D2A50
#: Bytes of records that a dictionary is trained on, and its own size; this bounds a writer's memory and time.
SAMPLE_BYTES, SAMPLE_EACH, DICT_BYTES, PIECE_BYTES, LEVEL = 1 << 20, 1 << 16, 1 << 15, 4 << 20, 5
#: Pieces and bytes of one archive; binary files of 2 GB and more can't be read back.
PIECES, ARCHIVE_BYTES = 128, 1 << 30
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- records


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    found = (urn or "").strip("<>").rpartition(":")[2]
    return None if found in ("", "none") else int(found)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """A response with its HTTP head and payload, or a revisit with the head alone; both carry the payload's digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "urn:x-none"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a record; the payload's length and digest are measured where the payload is there, else as stated."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length")))
        payload, digest = None, stated
    else:
        length, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != stated:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload's digest is not the stated one")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest, "refers_to": page_of(fields.get("WARC-Refers-To")), "payload": payload}


# ---- archives


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; their beginnings where they are too few or too short for training."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL)
    except zstandard.ZstdError:
        each = max(64, DICT_BYTES // len(samples))
        return zstandard.ZstdCompressionDict(b"".join(s[:each] for s in samples)[:DICT_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_pieces(records: Iterable[bytes], pieces: int = PIECES, most: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Pieces of archives, each lacking the line feed that its writer adds; ``pieces`` of them are one archive, the last may have fewer."""
    end = struct.pack("<II", PAD_MAGIC, 1)
    records = iter(records)
    while True:
        first, left = [], SAMPLE_BYTES
        for r in records:
            first.append(r)
            left -= min(len(r), SAMPLE_EACH)
            if left <= 0:
                break
        if not first:
            return
        trained = _dictionary([r[:SAMPLE_EACH] for r in first])
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True)
        body = trained.as_bytes()
        parts, size, done, written = [struct.pack("<II", DICT_MAGIC, len(body)), body], 0, 0, 0
        records = itertools.chain(first, records)
        for r in records:
            parts.append(packer.compress(r))
            size += len(parts[-1])
            if size >= PIECE_BYTES:
                yield b"".join([*parts, end])
                done, written, parts, size = done + 1, written + size, [], 0
                if done >= pieces or written >= most:
                    break
        else:
            if parts:
                yield b"".join([*parts, end])
            return
        yield from [end] * (pieces - done)


def frames(data: bytes) -> Iterator[tuple[int, int, bool]]:
    """(start, end, skippable) of each frame of a Zstandard file, from its block heads alone."""
    at = 0
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at) if len(data) - at >= 8 else (0, 0)
        if magic & 0xFFFFFFF0 == PAD_MAGIC:
            yield at, at + 8 + size, True
            at += 8 + size
            continue
        if magic != 0xFD2FB528:
            raise ValueError(f"no frame at {at}")
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            head = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
        yield at, end, False
        at = end


def read_archive(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each record; the dictionary, trained or not, is the leading frame's, if there is one."""
    unpacker = zstandard.ZstdDecompressor()
    for start, end, skip in frames(data):
        if skip:
            if start == 0 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:end]))
        else:
            yield start, end - start, unpacker.decompress(data[start:end])


# ---- Spark jobs


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, is_revisit. Only ids and digests meet by payload; html is dealt out by page."""
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    digest = F.sha1("html").alias("digest")
    keys = own.where(F.octet_length("html") >= min_bytes).select("page_id", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("name"), digest)
    # staged, so that Spark can split the rows of a payload that many pages share
    groups = staged(keys.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null"), "payloads")
    revisits = (
        keys.join(groups, "digest").where("page_id is null or page_id < keeper")
        .groupBy("name", "digest").agg(F.first("keeper").alias("refers_to"))
    )
    named = own.withColumn("name", F.coalesce(F.col("page_id").cast("string"), F.lit(""))).withColumn("digest", F.sha1("html"))
    return named.join(revisits, ["name", "digest"], "left").select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("is_revisit"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) into the archives of folder ``path``."""

    def write(batches):
        def records():
            for batch in batches:
                for page_id, url, html, refers_to, is_revisit in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns))):
                    yield make_record(page_id, url, html.as_py(), refers_to, is_revisit)

        for piece in archive_pieces(records()):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.binary())], ["piece"])

    pieces = captures(pages, min_bytes).mapInArrow(write, "piece binary")
    pieces.select(F.col("piece").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", PIECES).text(path)


READ_SCHEMA = "archive string, offset long, length long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record of the archives in ``path``; ``payload=False`` leaves payloads out (null)."""
    names = [f.split(" ")[0] for f in READ_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for offset, length, raw in read_archive(content.as_py()):
                    got = parse_record(raw)
                    rows.append((name.as_py(), offset, length, *(got[n] for n in names[3:9]), got["payload"] if payload else None))
                    size += len(raw) if payload else 200
                    if size >= PIECE_BYTES:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select("path", "content").mapInArrow(read, READ_SCHEMA)
