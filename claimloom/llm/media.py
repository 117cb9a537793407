"""Media columns: interleaved sequences of text and media references, resolved by digest.

`parse_html` yields the ordered items of a page: text runs and media references with their captions. `sequences` makes
them an array column; `resolve` joins every reference with the stored media by digest and puts the features back at
the reference's position, so that order and captions stay aligned. `store` keeps payloads losslessly as 8-bit grey
PNG images, `width` samples to a row, keyed by the digest of the stored form.

Defined cases: a null page or text is empty (a payload is padded to at least one row); a reference that no stored
media has stays in its place with null features; repeated rows each give a row; an empty table gives an empty table;
long texts are encoded row by row of the table, one at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ITEM = "struct<position: int, kind: string, text: string, ref: string, caption: string>"
SCHEME = "media:"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
FEATURES = "ref string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Items(HTMLParser):
    HIDDEN, BLOCK = {"script", "style", "head"}, {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "figure", "article", "section", "ul", "ol", "table", "nav", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.caption, self.hidden, self.figure = [], [], None, 0, None

    def flush(self):
        if text := " ".join("".join(self.text).split()):
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCK:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        if tag == "figcaption":
            self.caption = []
        if tag in ("img", "video", "audio", "source") and not self.hidden and (ref := dict(attrs).get("src")):
            self.flush()
            self.items.append({"kind": "media", "text": None, "ref": ref, "caption": dict(attrs).get("alt")})

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for x in self.items[self.figure or 0 :]:
                if x["kind"] == "media":
                    x["caption"] = text
            self.caption = None
        if tag == "figure":
            self.figure = None
        if tag in self.BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    p = _Items()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"position": i} | x for i, x in enumerate(p.items)]


def sequences(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """(id, items): the ordered items of each page."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse_html(x) for x in b.column(1).to_pylist()], kind)], ["id", "items"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html).alias("html")).mapInArrow(run, f"id long, items array<{ITEM}>")


# ---------------------------------------------------------------- the stored form
def padded(payload: bytes, unit: int) -> bytes:
    return payload + b"\xff" * (-len(payload) % unit if payload else unit)


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def encode(samples: bytes, width: int, level: int = 6) -> bytes:
    """An 8-bit grey PNG of whole rows."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """The samples of encode()'s images, (rows, width)."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, b"", (0, 0)
    while at < len(media):
        (n,), name = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(name + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("chunk is damaged")
        if name == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            if (depth, colour) != (8, 0):
                raise ValueError("8-bit grey only")
            shape = (height, width)
        elif name == b"IDAT":
            data += body
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[0], shape[1] + 1)
    if raw[:, 0].any():
        raise ValueError("unfiltered rows only")
    return raw[:, 1:]


def store(docs: DataFrame, id_col: str, text: str, width: int = 576) -> DataFrame:
    """Media of texts: (id, html, ref, media), written. `html` is a page that shows the media with a caption.

    A task leaves out the bytes of media that it has already stored (media null): the reference is the same.
    """

    def run(batches):
        seen = set()
        for b in batches:
            rows, held = [], 0
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                media = encode(padded((t.as_py() or "").encode(), width), width)
                digest = hashlib.sha256(media).hexdigest()
                html = f'<article><h1>document {doc}</h1><figure><img src="{SCHEME}{digest}"><figcaption>text of document {doc}</figcaption></figure></article>'
                rows.append((doc, html, digest, None if digest in seen else media))
                seen.add(digest)
                held += len(media)
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "html", "ref", "media"])

    return written(docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, "id long, html string, ref string, media binary"), "media")


def feature_of(samples: np.ndarray) -> str:
    """Mean and deviation in thousandths, and the counts of the sixteen sample ranges."""
    counts = np.bincount(samples.ravel() >> 4, minlength=16)
    return f"mean={round(float(samples.mean()) * 1000)};dev={round(float(samples.std()) * 1000)};hist=" + ",".join(map(str, counts))


def features(media: DataFrame) -> DataFrame:
    """One row for each distinct reference of a store, computed from the stored bytes."""

    def run(batches):
        names = [x.split(" ")[0] for x in FEATURES.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 2, *[pa.string()] * 2]
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                held = b.column(1)[i].as_py()
                samples = decode(held)
                payload = samples.tobytes()
                rows.append((b.column(0)[i].as_py(), len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(held), hashlib.sha256(held).hexdigest(), feature_of(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

    made = media.where("media IS NOT NULL").select("ref", "media").mapInArrow(run, FEATURES)
    return made.groupBy("ref").agg(*[F.first(c).alias(c) for c in made.columns if c != "ref"])


def resolve(seqs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, position, caption, ref, features...): each reference of each sequence with what the store has for it."""
    refs = seqs.select("id", F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("x"))
    refs = refs.select("id", F.col("x.position").alias("position"), F.col("x.caption").alias("caption"), F.regexp_replace("x.ref", f"^{SCHEME}", "").alias("ref"))
    return refs.join(found, "ref", "left")
