"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle is its frames and a skippable frame with the seek table
(compressed and decompressed size of each frame) and its footer. An index beside the bundle maps a record's id to
(frame, offset in the frame, length). Bundles are rows of a table that Spark's writer commits in the shared folder, so
that a lost executor leaves no partial archive and any file system that Spark can write will do;
`export_files` puts them out as .warc.zst files where the folder is mounted, from which `fetch` reads single records by
their `places`.

Of records with equal payloads of at least `least` bytes the one of the largest id is a response and the others are
revisits, which hold no payload but its digest and length and whom they refer to.

Defined cases: a null payload is empty; a null or repeated id: a row is a revisit only if a larger id has its payload,
so rows of one id are alike, and rows without an id are responses; an empty table makes no bundle and reads back empty;
a null url is written as an empty target.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
import uuid
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_join, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BUNDLES = "bundle_id string, archive binary, index array<struct<record_id: string, frame: int, offset: int, length: int>>"
READ = "record_id string, page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
READ_NAMES = [x.split(" ")[0] for x in READ.split(", ")]
READ_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(rid: str) -> int | None:
    return int(rid[10:-1]) if len(rid) > 11 else None


def write_record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {(uri or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length")
    return fields, rest[:n]


class Bundle:
    """Collects records into frames and frames into an archive."""

    def __init__(self, frame_bytes: int, level: int):
        self.limit, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.sizes, self.index, self.open, self.held, self.bytes = [], [], [], [], 0, 0

    def add(self, rid: str, raw: bytes) -> None:
        self.index.append((rid, len(self.frames), self.held, len(raw)))
        self.open.append(raw)
        self.held += len(raw)
        if self.held >= self.limit:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = self.zstd.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.held))
            self.bytes += len(packed)
            self.open, self.held = [], 0

    def archive(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.sizes)
        foot = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(foot)) + entries + foot


def seek_table(f: BinaryIO) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame; only the footer and its table are read."""
    f.seek(-9, os.SEEK_END)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(-9 - 8 * n, os.SEEK_END)
    at, out = 0, []
    for packed, raw in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, packed, raw))
        at += packed
    return out


def frame(f: BinaryIO, entry: tuple[int, int, int]) -> bytes:
    f.seek(entry[0])
    return zstandard.ZstdDecompressor().decompress(f.read(entry[1]), max_output_size=max(1, entry[2]))


def checked(raw: bytes, keep_payload: bool) -> tuple:
    """A record's row in the columns of READ; a response's payload must have the length and digest it states."""
    f, body = read_record(raw)
    digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if f["WARC-Type"] == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(f["X-Payload-Length"])):
        raise ValueError(f"payload of {f['WARC-Record-ID']} is damaged")
    refers = page_of(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None
    return f["WARC-Record-ID"], page_of(f["WARC-Record-ID"]), f["WARC-Target-URI"], int(f["X-Payload-Length"]), digest, f["WARC-Type"], refers, body if keep_payload else None


def read_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, READ_KINDS, strict=True)], READ_NAMES)


def with_digests(pages: DataFrame, least: int = 1000, id_col: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, uri, payload, digest, refers_to): refers_to is null for responses."""
    held = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri).cast("string").alias("uri"), held.alias("payload"), F.sha1(held).alias("digest"))
    keyed = base.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    last = keyed.groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first < last").select("digest", "last")
    last = written(last, "payloads")
    return sized_join(base, last, "digest", "left", 64).select("page_id", "uri", "payload", "digest", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def write_bundles(records: DataFrame, frame_bytes: int = 256 << 10, bundle_bytes: int = 4 << 20, level: int = 6) -> DataFrame:
    """Bundles of the records of with_digests(), written to the shared folder."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        b = Bundle(frame_bytes, level)

        def out():
            nonlocal b, made
            row = {"bundle_id": f"{task:06d}-{made:06d}", "archive": b.archive(), "index": [dict(zip(("record_id", "frame", "offset", "length"), x, strict=True)) for x in b.index]}
            made, b = made + 1, Bundle(frame_bytes, level)
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("bundle_id", pa.string()), ("archive", pa.binary()), ("index", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))])
        for batch in batches:
            for i in range(batch.num_rows):
                page, uri, payload, digest, refers = (batch.column(c)[i].as_py() for c in range(5))
                b.add(record_id(page), write_record(page, uri, payload, digest, refers))
                if b.bytes >= bundle_bytes:
                    yield out()
        if b.index:
            yield out()

    return written(records.select("page_id", "uri", "payload", "digest", "refers_to").mapInArrow(run, BUNDLES), "bundles")


def read_bundles(bundles: DataFrame, only: list[str] | None = None, keep_payload: bool = False) -> DataFrame:
    """The records of bundles. `only`: just these ids, of which only their frames are decompressed."""
    wanted = None if only is None else set(only)
    if wanted is not None:
        bundles = bundles.where(F.exists("index", lambda x: x["record_id"].isin(list(wanted))))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                archive, index = io.BytesIO(batch.column(0)[i].as_py()), batch.column(1)[i].as_py()
                frames, at, raw, rows = seek_table(archive), -1, b"", []
                for x in index:
                    if wanted is not None and x["record_id"] not in wanted:
                        continue
                    if x["frame"] != at:
                        at = x["frame"]
                        raw = frame(archive, frames[at])
                    rows.append(checked(raw[x["offset"] : x["offset"] + x["length"]], keep_payload))
                yield read_batch(rows)

    return bundles.select("archive", "index").mapInArrow(run, READ)


def places(bundles: DataFrame) -> DataFrame:
    """The index of all bundles, one row a record: record_id, bundle_id, frame, offset, length. Archives are not read."""
    return bundles.select("bundle_id", F.explode("index").alias("x")).select("x.record_id", "bundle_id", "x.frame", "x.offset", "x.length")


def fetch(found: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records at rows of places(), from the files of export_files() in a folder that all executors mount.

    Of a file only its footer, its seek table and the frames asked for are read. Rows are dealt by frame, so that a
    frame is read once however many of its records are asked for; a place asked for twice gives its record twice.
    """

    def run(batches):
        name, at, f, frames, raw = None, -1, None, [], b""
        try:
            for batch in batches:
                rows = []
                for own, no, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if own != name:
                        if f is not None:
                            f.close()
                        name, at, f = own, -1, open(f"{folder}/{own}.warc.zst", "rb")
                        frames = seek_table(f)
                    if no != at:
                        at, raw = no, frame(f, frames[no])
                    rows.append(checked(raw[offset : offset + length], keep_payload))
                yield read_batch(rows)
        finally:
            if f is not None:
                f.close()

    order = found.select("bundle_id", "frame", "offset", "length").repartition("bundle_id", "frame").sortWithinPartitions("bundle_id", "frame")
    return order.mapInArrow(run, READ)


def export_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as <bundle_id>.warc.zst in a folder that all executors mount; a rename makes each whole."""

    def run(batches):
        for batch in batches:
            os.makedirs(folder, exist_ok=True)
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, f"{folder}/{name}.warc.zst")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["bundle_id"])

    return bundles.select("bundle_id", "archive").mapInArrow(run, "bundle_id string")
