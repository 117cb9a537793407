"""Shared pieces: written tables in the shared folder, size-checked joins, graph components, text kernels."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes by count times width, that is ever broadcast on purpose.
BROADCAST_BYTES = 32 << 20
#: Bytes that one packed bucket should hold on average.
BUCKET_BYTES = 8 << 20

GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one is set only where none is configured and the master is local."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='claimloom-')}"
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/claimloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, bound: int = BROADCAST_BYTES) -> bool:
    """Whether a written table is proven to fit the broadcast bound (its rows are counted)."""
    return df.count() * row_bytes <= bound


def sized_join(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Join with the right side broadcast only where its counted size is within the bound; else a shuffle join."""
    return left.join(F.broadcast(right) if small(right, row_bytes) else right, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a long, b long) by alternating large-star and small-star steps.

    Returns (node, component), component being the smallest node reachable; nodes without an edge are absent.
    Each round is written to the shared folder, and the rounds end when one changes nothing, as each but the last
    lowers a label. A node's minimum is aggregated map-side; the join that hands it to the neighbours is a sort-merge
    join of which adaptive execution splits a hub's partition (spark.sql.adaptive.skewJoin.enabled, on by default).
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = written(step.where("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    label = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return label.union(label.select(F.col("component").alias("node"), "component").distinct())


class Forest:
    """Union-find over local numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of n nodes make a spanning forest: roots hook onto smaller ones, round by round."""
    root, live, out = np.arange(n), np.arange(len(i)), [np.zeros(0, np.int64)]
    while len(live):
        a, b = root[i[live]], root[j[live]]
        live, a, b = (x[a != b] for x in (live, a, b))
        high, first = np.unique(np.maximum(a, b), return_index=True)
        root[high] = np.minimum(a, b)[first]
        out.append(live[first])
        while not np.array_equal(root, up := root[root]):
            root = up
    return np.concatenate(out)


# ---------------------------------------------------------------- packed columns
def pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def unpack(raw: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    width = sum(np.dtype(k).itemsize for k in kinds)
    n, at, out = len(data) // width, 0, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def release() -> None:
    """Give freed memory back to the system at a task's end: idle workers would hold it through the next stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_LIBC = ctypes.CDLL(None)
_TRIM = getattr(_LIBC, "malloc_trim", None)  # of glibc; other C libraries have none
_MAIN = getattr(sys.modules.get("__main__"), "__spec__", None)
if (_MALLOPT := getattr(_LIBC, "mallopt", None)) is not None and _MAIN is not None and _MAIN.name.startswith("pyspark."):
    # In workers only, whose main module is Spark's: the driver trains models and is left as it is.
    # Blocks of a MiB and more (M_MMAP_THRESHOLD, -3) go back to the system when freed. Left alone, glibc raises that bound
    # as it meets large blocks, and a worker keeps its largest task's memory.
    _MALLOPT(-3, 1 << 20)


# ---------------------------------------------------------------- numpy text kernels
def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "b" not in _POW or len(_POW["b"]) < n + 1:
        size = max(1 << 20, 1 << int(n + 1).bit_length())
        for key, base in (("b", _BASE), ("i", _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POW[key] = np.multiply.accumulate(steps)
    return _POW["b"], _POW["i"]


def byte_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums P of a polynomial hash modulo 2^64; span(P, s, e) hashes bytes s..e."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * _powers(len(prefix))[1][start] + (end - start).astype(np.uint64) * GOLD)


def text_chunks(column: pa.Array, limit: int = 1 << 19):
    """Pieces (first row, byte array, offsets) of a string or binary column; null counts as empty, rows stay whole."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes, and the number of such words before each row's end."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    first[edge] = solid[edge]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = edge[edge > 0] - 1
    last[cut] = solid[cut]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5):
    """Yield, for each row, the sorted distinct 64-bit hashes of its k-word shingles.

    A-Z are lowered; words are runs of bytes outside x20 and x09-x0D. A row of one to k-1 words has one shingle, the
    whole sequence; a row without words none.
    """
    starts, ends, bound = words(data, offsets)
    if not len(starts):
        for _ in range(len(offsets) - 1):
            yield np.zeros(0, np.uint64)
        return
    hashed = span(byte_prefix(_LOWER[data]), starts, ends)
    odd = mix(np.arange(1, k + 1, dtype=np.uint64) * GOLD) | np.uint64(1)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(hashed) - k + 1), np.uint64)
        for j in range(k):
            full += hashed[j : j + len(full)] * odd[j]
        full = mix(full)
        for i in range(len(offsets) - 1):
            a, b = bound[i], bound[i + 1]
            if b - a >= k:
                own = np.sort(full[a : b - k + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
            elif b > a:
                yield mix(np.array([(hashed[a:b] * odd[: b - a]).sum() + np.uint64(b - a) * MIX1], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def set_id(values: np.ndarray) -> int:
    """A signed 64-bit identity of a sorted set of hashes."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(values ^ (GOLD * np.uint64(len(values)))).sum() + (values * (values >> np.uint64(7))).sum()], np.uint64)).view(np.int64)[0])
