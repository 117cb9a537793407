"""Substring dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if it lies in a string of `length` bytes that also starts in a document of a smaller id; strings are judged
on the input, and matches never cross documents. The steps:

1. Equal texts are found by digest: all but the smallest id go whole (texts of at least `length` bytes).
2. Every string of `length` bytes has one anchor, its leftmost smallest hashed k-gram, given by its content. Anchors
   are exchanged in packed binary buckets, and those that at least two documents hold come back. Within a task an
   anchor that several of its documents hold is settled at once and sent on only for the smallest id, so that a
   passage of very many documents does not gather in one bucket.
3. For shared anchors only, the segment that covers the anchor's strings is exchanged, packed by anchor. In a bucket
   equal segments are settled by their smallest id. The others are concatenated; from their Burrows-Wheeler transform
   breadth-first backward extension derives the positions whose common prefix with the one before is 0, 1, 2, ... and
   stops at `length`: what is still joined shares a string. A string goes wherever a smaller id holds it.
4. Covered ranges are united for each document and its remaining bytes digested.

Every string's comparison happens under its own anchor, so nothing rests on sampling; k-grams are 64-bit hashes, and a
collision only adds segments to compare; segments under one anchor are told apart by another 64-bit hash.

Defined cases: a null text is empty; texts shorter than `length` bytes stay whole; rows of one id are not each other's
source, whether their texts are equal or not, and each row gets the result of its own text; rows without an id come
after all others; empty tables give empty tables; texts of any length are processed whole (a long one in windows that
overlap by `length` - 1 bytes, so that every string lies in one); other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BUCKET_BYTES, GOLD, byte_prefix, pack, sized_join, span, text_chunks, unpack, written

PLACE = np.uint64((1 << 28) - 1)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int, window: int = 1 << 22):
    """Of the rows' strings: anchor positions, their hashes, and the first and last string that each is the anchor of.

    More than `window` bytes are taken in windows. An anchor is given by its string alone, so only the runs of strings
    of one anchor are cut at a window's end, never what is compared.
    """
    if len(data) < window + length:
        return _anchors(data, offsets, length, k)
    parts = []
    for at in range(0, len(data), window):
        piece = data[at : at + window + length - 1]
        place, h, first, last = _anchors(piece, np.clip(offsets - at, 0, len(piece)), length, k)
        parts.append((place + at, h, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none, none
    places = np.arange(len(data) - k + 1)
    hashed = span(byte_prefix(data), places, places + k)
    low = (hashed & ~PLACE) | places.astype(np.uint64)
    reach, width = low, 1
    want = length - k + 1
    while width * 2 <= want:
        reach = np.minimum(reach[:-width], reach[width:])
        width *= 2
    if width < want:
        reach = np.minimum(reach[: len(reach) - (want - width)], reach[want - width :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(offsets[1:][row[: len(reach)]] >= np.arange(len(reach)) + length)
    if not len(start):
        return none, none.astype(np.uint64), none, none
    at = (reach[start] & PLACE).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
    last = np.append(fresh[1:], len(at)) - 1
    return at[fresh], hashed[at[fresh]], start[fresh], start[last]


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in arrays sorted together."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def split_shared(h: np.ndarray, doc: np.ndarray):
    """Of (hash, document) pairs, sorted and distinct: a mask of the hashes' smallest documents, and of shared hashes."""
    first = firsts(h)
    size = np.diff(np.append(np.flatnonzero(first), len(h)))
    return first, np.repeat(size > 1, size)


def shared_anchors(docs: DataFrame, length: int, k: int, buckets: int) -> DataFrame:
    """(doc_id, h): the anchors of (doc_id, text) that at least two documents hold, written."""

    def run(batches):
        held_h, held_d, held = [], [], 0

        def flush():
            h, d = np.concatenate(held_h), np.concatenate(held_d)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            keep = firsts(h, d)
            h, d = h[keep], d[keep]
            first, known = split_shared(h, d)
            ask, salt = (h[first] % np.uint64(buckets)).astype(np.int64), (d[known] % buckets).astype(np.int64)
            rows = []
            for kind, at, hh, dd in ((0, ask, h[first], d[first]), (1, salt, h[known], d[known])):
                by = np.lexsort((hh, dd, at))
                at, hh, dd = at[by], hh[by], dd[by]
                cuts = np.flatnonzero(firsts(at))[1:]
                rows += [(int(a[0]), kind, pack(x), pack(np.diff(y, prepend=0))) for a, x, y in zip(np.split(at, cuts), np.split(hh, cuts), np.split(dd, cuts), strict=True) if len(a)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "kind", "h", "d"])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, data, offsets in text_chunks(b.column(1), 1 << 19):
                place, h, _, _ = anchors(data, offsets, length, k)
                held_h.append(h)
                held_d.append(ids[at + np.searchsorted(offsets, place, "right") - 1])
                held += len(h)
            if held > 700_000:
                yield flush()
                held_h, held_d, held = [], [], 0
        if held:
            yield flush()

    def meet(key, t):
        kind = t.column("kind").to_numpy()
        parts = [(unpack(x.as_py(), np.uint64)[0], np.cumsum(unpack(y.as_py(), np.int64)[0])) for x, y in zip(t.column("h"), t.column("d"), strict=True)]
        ask, sure = ([p for p, q in zip(parts, kind, strict=True) if q == w] for w in (0, 1))
        h, d = (np.concatenate([p[i] for p in ask]) if ask else np.zeros(0, (np.uint64, np.int64)[i]) for i in (0, 1))
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        keep = firsts(h, d)
        h, d = h[keep], d[keep]
        known = split_shared(h, d)[1]
        h, d = np.concatenate([h[known], *(p[0] for p in sure)]), np.concatenate([d[known], *(p[1] for p in sure)])
        return pa.table({"doc_id": d.astype(np.int64), "h": h.astype(np.uint64).view(np.int64)})

    packed = docs.select("doc_id", "text").mapInArrow(run, "bucket long, kind int, h binary, d binary")
    return written(packed.groupBy("bucket").applyInArrow(meet, "doc_id long, h long"), "anchors")


# ---------------------------------------------------------------- the transform
def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in order of at least their first `depth` symbols (below 512), by packing seven and doubling."""
    n = len(symbols)
    rank = np.zeros(n, np.uint64)
    for j in range(7):
        rank <<= np.uint64(9)
        rank[: n - j] |= symbols[j:].astype(np.uint64)
    order = np.argsort(rank, kind="stable")
    width = 7
    while True:
        level = np.cumsum(firsts(rank[order]))
        rank = np.empty(n, np.uint64)
        rank[order] = level.astype(np.uint64)
        if width >= depth or level[-1] == n:
            return order.astype(np.int32)
        key = rank << np.uint64(32)
        key[: n - width] |= rank[width:]
        order, rank = np.argsort(key, kind="stable"), key
        width *= 2


def common_strings(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): suffixes in order, and a number that is equal where the first `depth` symbols are.

    Breadth-first backward extension: with one more symbol in front, two neighbours in order part where their first
    symbols differ or where the suffixes after it (found by the transform's inverse last-to-first map) have parted
    before. Round l finds the neighbours of common prefix l, and only those still joined are looked at again.
    """
    order = suffix_order(symbols, depth)
    n = len(order)
    # The transform: the symbol before each suffix; a stable sort of it is the inverse of the last-to-first map.
    transform = symbols[order - 1]
    after = np.argsort(transform, kind="stable").astype(np.int32)
    parted = np.zeros(n, bool)
    parted[0] = True
    first = np.sort(transform)
    joined = np.arange(1, n, dtype=np.int32)
    for level in range(depth):
        if level == 0:
            part = first[joined] != first[joined - 1]
        else:
            group = np.cumsum(parted, dtype=np.int32)
            part = group[after[joined]] != group[after[joined - 1]]
        parted[joined[part]] = True
        joined = joined[~part]
        if not len(joined):
            break
    return order, np.cumsum(parted, dtype=np.int32)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of data[start : start + size], one after the other."""
    at = np.cumsum(size) - size
    return data[np.repeat(start - at, size) + np.arange(int(size.sum()))]


def covered(text: np.ndarray, size: np.ndarray, least: np.ndarray, length: int, shift: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (segment, first string, end) of distinct segments' strings that a segment of smaller least id also holds.

    The last `shift` bits of a number only tell rows of one id apart.

    `text` holds the segments one after the other.
    """
    begin = np.cumsum(size + 1) - size - 1
    symbols = np.zeros(int(size.sum()) + len(size), np.int16)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
    body = np.ones(len(symbols), bool)
    body[begin + size] = False
    symbols[body] = text.astype(np.int16) + 1
    order, group = common_strings(symbols, length)
    at, g = order, group
    inside = ((begin + size)[owner] - np.arange(len(symbols)) >= length)[order]
    at, g = at[inside], g[inside]
    low = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, g, least[owner[at]])
    hit = np.zeros(len(symbols) + 1, np.int8)
    hit[at] = (low[g] >> shift) < (least[owner[at]] >> shift)
    step = np.diff(hit, prepend=0)
    first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return owner[first], first - begin[owner[first]], end - begin[owner[first]]


def merged(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (id, a, b) with those of an id that touch or overlap made one."""
    if not len(d):
        return d, a, b
    order = np.lexsort((b, a, d))
    d, a, b = d[order], a[order], b[order]
    new = firsts(d)
    lift = np.cumsum(new) << 32  # texts are shorter than 2^32 bytes
    reach = np.maximum.accumulate(b + lift) - lift
    new[1:] |= a[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return d[at], a[at], reach[np.append(at[1:], len(d)) - 1]


def ranges(docs: DataFrame, hits: DataFrame, length: int, k: int, buckets: int, shift: int) -> DataFrame:
    """(doc_id, a, b): byte ranges to remove, for (doc_id, text) and its shared anchors, written."""
    per_doc = hits.groupBy("doc_id").agg(F.collect_set("h").alias("h"))
    ids = written(hits.select("doc_id").distinct(), "ids")
    joined = sized_join(docs.select("doc_id", "text"), ids, "doc_id", "left_semi", 16).join(per_doc, "doc_id")
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def run(batches):
        held, size = [], 0

        def flush():
            h, s, d, a, n = (np.concatenate([x[i] for x in held]) for i in range(5))
            data = np.concatenate([x[5] for x in held])
            start = np.cumsum(n) - n
            order = np.lexsort((a, d, s, h))
            h, s, d, a, n, start = (x[order] for x in (h, s, d, a, n, start))
            first = firsts(h, s)
            low = d[first][np.cumsum(first) - 1]
            ask = (d >> shift) == (low >> shift)
            sure = merged(d[~ask], a[~ask], a[~ask] + n[~ask])
            # Bytes go with the first row of a segment only; a row without bytes has size 0 there.
            size_ = np.where(first, n, 0)[ask]
            h, s, d, a, n, start = (x[ask] for x in (h, s, d, a, n, start))
            at = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((a, d, at))
            h, s, d, a, n, start, size_, at = (x[order] for x in (h, s, d, a, n, start, size_, at))
            cuts = np.flatnonzero(firsts(at))
            rows, squeeze = [], zstandard.ZstdCompressor(level=3)
            for x, y in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
                cols = pack(h[x:y], s[x:y], d[x:y], a[x:y], n[x:y], size_[x:y])
                rows.append((int(at[x]), 0, cols, squeeze.compress(gather(data, start[x:y], size_[x:y]).tobytes())))
            for x in range(0, len(sure[0]), 20_000):
                rows.append((int(sure[0][x]) % buckets, 1, pack(*(c[x : x + 20_000] for c in sure)), b""))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["bucket", "kind", "head", "body"])

        for b in batches:
            ids, wanted = b.column(0).to_numpy(), b.column(2)
            for row, data, offsets in text_chunks(b.column(1), 1 << 19):
                place, h, first, last = anchors(data, offsets, length, k)
                owner = np.searchsorted(offsets, place, "right") - 1
                lists = wanted.slice(row, len(offsets) - 1)
                known = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                with np.errstate(over="ignore"):
                    tag = lambda x, i: x * GOLD + i.astype(np.uint64)
                    live = np.isin(tag(h, owner), tag(lists.flatten().to_numpy().view(np.uint64), known))
                h, first, n, owner = h[live], first[live], last[live] + length - first[live], owner[live]
                if len(h):
                    held.append((h, span(byte_prefix(data), first, first + n), ids[row + owner], first - offsets[owner], n, gather(data, first, n)))
                    size += len(held[-1][5]) + 48 * len(h)
                if size > 24 << 20:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def meet(key, t):
        sure, cols, body = [], [], []
        for kind, head, raw in zip(t.column("kind").to_pylist(), t.column("head"), t.column("body"), strict=True):
            if kind:
                sure.append(unpack(head.as_py(), np.int64, np.int64, np.int64))
            else:
                cols.append(unpack(head.as_py(), np.uint64, np.uint64, *[np.int64] * 4))
                body.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_py()), np.uint8))
        out = [list(x) for x in zip(*sure, strict=True)] if sure else [[], [], []]
        if cols:
            h, s, d, a, n, size = (np.concatenate(x) for x in zip(*cols, strict=True))
            data = np.concatenate(body)
            start = np.cumsum(size) - size
            order = np.lexsort((a, d, s, h))
            h, s, d, a, n, size, start = (x[order] for x in (h, s, d, a, n, size, start))
            first = firsts(h, s)
            seg = np.cumsum(first) - 1
            low = d[first][seg]
            for o, x in zip(out, (d, a, a + n), strict=True):
                o.append(x[(d >> shift) > (low >> shift)])
            # Segments of an anchor that has several: the smallest id's bytes, which that row or another of it carries.
            anchor = np.cumsum(firsts(h[first])) - 1
            several = (np.bincount(anchor) > 1)[anchor][seg]
            if several.any():
                rows = several & ((d >> shift) == (low >> shift))
                holder = np.flatnonzero(several & (size > 0))
                holder = holder[firsts(seg[holder])]
                text = gather(data, start[holder], size[holder])
                part, x, y = covered(text, size[holder], low[holder], length, shift)
                # A run of a segment counts wherever the smallest id has the segment.
                at = np.flatnonzero(rows)
                left, right = np.searchsorted(seg[at], seg[holder][part], "left"), np.searchsorted(seg[at], seg[holder][part], "right")
                times = right - left
                where = at[np.repeat(left - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
                for o, v in zip(out, (d[where], a[where] + np.repeat(x, times), a[where] + np.repeat(y - 1 + length, times)), strict=True):
                    o.append(v)
        d, a, b = merged(*(np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64) for o in out))
        return pa.table({"doc_id": d, "a": a, "b": b})

    packed = joined.select("doc_id", "text", "h").mapInArrow(run, "bucket long, kind int, head binary, body binary")
    return written(packed.groupBy("bucket").applyInArrow(meet, "doc_id long, a long, b long"), "ranges")


def cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The results of the documents that lose bytes."""
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("r"))
    ids = written(found.select("doc_id").distinct(), "ids")
    joined = sized_join(docs.select("doc_id", "text"), ids, "doc_id", "left_semi", 16).join(per_doc, "doc_id")

    def run(batches):
        names = [x.split(" ")[0] for x in RESULT.split(", ")]
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                data = np.frombuffer((b.column(1)[i].as_py() or "").encode(), np.uint8)
                r = b.column(2)[i].values
                mark = np.zeros(len(data) + 1, np.int32)
                np.add.at(mark, r.field("a").to_numpy(), 1)
                np.add.at(mark, r.field("b").to_numpy(), -1)
                gone = np.cumsum(mark[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((b.column(0)[i].as_py(), len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (*[pa.int64()] * 4, pa.string()), strict=True)], names)

    return joined.select("doc_id", "text", "r").mapInArrow(run, RESULT)


def substring_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = 50, gram: int = 26) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Rows without an id come after all others, in the order they are read: each is a row of its own, deduplicated like any.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if not docs.where("doc_id IS NULL").isEmpty():
        top = docs.agg(F.max("doc_id")).first()[0]
        top = -1 if top is None else top
        nameless = written(docs.where("doc_id IS NULL").select((F.lit(top + 1).cast("long") + F.monotonically_increasing_id()).alias("doc_id"), "text"), "nameless")
        out = substring_dedup(docs.where("doc_id IS NOT NULL").unionByName(nameless), "text", "doc_id", length, gram)
        return out.withColumn("doc_id", F.when(F.col("doc_id") <= top, F.col("doc_id")))
    texts = docs.select("doc_id", F.sha2("text", 256).alias("sha"))
    many = texts.groupBy("doc_id").agg(F.count_distinct("sha").alias("m")).where("m > 1").agg(F.max("m")).first()[0]
    if many is None:
        return _dedup(docs, length, gram, 0)
    # Different texts of one id: rows are numbered in the ids' order, and the last bits tell an id's texts apart.
    shift = (many - 1).bit_length()
    ids = written(docs.select("doc_id").distinct().orderBy("doc_id").withColumn("at", F.monotonically_increasing_id()), "ids")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("sha")) - 1
    kinds = written(texts.distinct().withColumn("place", place).join(ids, "doc_id").select("doc_id", "sha", (F.shiftleft("at", shift) + F.col("place")).alias("number")), "numbers")
    told = docs.withColumn("sha", F.sha2("text", 256)).join(kinds, ["doc_id", "sha"])
    out = _dedup(told.select(F.col("number").alias("doc_id"), "text"), length, gram, shift)
    return out.withColumnRenamed("doc_id", "number").join(kinds.select("number", "doc_id"), "number").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _dedup(docs: DataFrame, length: int, gram: int, shift: int) -> DataFrame:
    """substring_dedup of (doc_id, text), where ids of which all but the last `shift` bits agree are one document's."""
    base = written(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    low = base.groupBy("sha").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("sha", "low")
    low = written(low, "copied")
    base = written(sized_join(base, low, "sha", "left", 100).select("doc_id", "n_bytes", "sha", (F.shiftright("doc_id", shift) > F.shiftright(F.coalesce("low", "doc_id"), shift)).alias("copy")), "texts")
    copies = base.where("copy").select("doc_id").distinct()
    own = sized_join(docs, written(copies, "copies"), "doc_id", "left_anti", 16)
    total = base.where("NOT copy").agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, math.ceil(total * 2 / (length - gram + 2) * 16 / BUCKET_BYTES))
    hits = shared_anchors(own, length, gram, buckets)
    wide = max(1, math.ceil(hits.count() * 90 / (BUCKET_BYTES // 3)))
    found = ranges(own, hits, length, gram, wide, shift)
    done = written(cut(own, found), "cut").distinct()
    empty = hashlib.sha256(b"").hexdigest()
    whole = base.where("copy").select("doc_id", "n_bytes", F.when(F.col("n_bytes") >= length, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("n_bytes") >= length, 1).otherwise(0).cast("long").alias("n_spans"), F.when(F.col("n_bytes") >= length, F.lit(empty)).otherwise(F.col("sha")).alias("kept_sha256"))
    rest = base.where("NOT copy").join(done.select("doc_id", "n_removed", "n_spans", "kept_sha256"), "doc_id", "left")
    rest = rest.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    return whole.union(rest)
