"""Embedding near-dedup by int8 quantised tile products with rigorous error bounds.

Equal vectors are first collapsed (a vector's weight counts its copies) and numbered. Each distinct vector is scaled to
length 1 and quantised once: int8 codes q with x = s*q + e, |e| <= r known for each vector. The vectors are dealt to
blocks; a tile is a pair of blocks, and codes, scale and bound, never the doubles, go once to each tile of a vector's
block. The product of codes is exact in float32 (at most 64*127*127 < 2^24 per 64 components; wider vectors are summed
in slices), and the cosine lies within
    s_i s_j q_i.q_j +- (r_i (|x_j| + r_j) + r_j |x_i|).
Pairs surely above or below the threshold are settled by that. A tile gives each vector's sure links there, a spanning
forest of them, and the vectors that have pairs left open, never the pairs. The open vectors' doubles then go to the
tiles that asked for them, where just the open pairs are computed again in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing (kept, own
component); vectors of different lengths never link; repeated rows, of one id or several and with equal or different
vectors, are vectors of their own that link with each other; a row without an id links like any, but names no
component: its component is the smallest id it reaches, null if there is none; other columns, whatever their names,
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, components, mix, spanning, written

SLACK = 1e-12


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and bounds r of the residuals' norms, of rows of length 1."""
    scale = np.abs(vectors).max(1) / 127
    codes = np.rint(vectors / scale[:, None])
    bound = np.sqrt(((vectors - codes * scale[:, None]) ** 2).sum(1)) + SLACK
    return codes.astype(np.int8), scale, bound


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products of code rows, in float64 where one float32 sum could round."""
    width = a.shape[1]
    if width * 127 * 127 < 1 << 24:
        return a @ b.T
    step = ((1 << 24) - 1) // (127 * 127)
    return sum((a[:, i : i + step] @ b[:, i : i + step].T).astype(np.float64) for i in range(0, width, step))


def strips(codes, scale, bound, left, right, same: bool, threshold: float, rows: int = 512):
    """Yield (i, j, sure) arrays of a tile's pairs that link surely or are open, strip by strip; i < j if `same`.

    left and right are positions in codes; |x| is 1 up to rounding of about 1e-16 a component, which SLACK covers.
    """
    a, b = codes[left].astype(np.float32), codes[right].astype(np.float32)
    sa, ra, sb, rb = scale[left], bound[left], scale[right], bound[right]
    wide = 1 + SLACK + rb
    for at in range(0, len(a), rows):
        p = product(a[at : at + rows], b)
        # cos <= s_i s_j p + r_i (1 + r_j) + r_j; a cheap test with the strip's largest r_i first.
        reach = ra[at : at + rows].max()
        limit = (threshold - SLACK - reach * wide - rb) / sb
        limit = limit / np.where(limit >= 0, sa[at : at + rows].max(), sa[at : at + rows].min())
        i, j = np.nonzero(p >= (limit - np.abs(limit) * 1e-6)[None, :])
        if same:
            keep = i + at < j
            i, j = i[keep], j[keep]
        for part in range(0, len(i), 1 << 20):
            x, y = i[part : part + (1 << 20)], j[part : part + (1 << 20)]
            mid = sa[x + at] * sb[y] * p[x, y].astype(np.float64)
            err = ra[x + at] * (1 + SLACK + rb[y]) + rb[y] + SLACK
            some = mid + err >= threshold
            yield left[x[some] + at], right[y[some]], (mid - err >= threshold)[some]


def valid(column: str) -> F.Column:
    x = F.col(column)
    return F.coalesce((F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))


CODED = "num long, copies long, block int, width int, codes binary, scale double, bound double"


def coded(reps: DataFrame, blocks: int) -> DataFrame:
    """Each distinct vector's block and its int8 codes, written."""

    def run(batches):
        for b in batches:
            num, copies, column = b.column(0), b.column(1).to_numpy(), b.column(2)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            codes, scale, bound = [b""] * len(sizes), np.zeros(len(sizes)), np.zeros(len(sizes))
            for width in np.unique(sizes):
                own = np.flatnonzero(sizes == width)
                q, scale[own], bound[own] = quantise(unit(flat[starts[own][:, None] + np.arange(width)]))
                for i, c in zip(own.tolist(), q.astype(np.int8), strict=True):
                    codes[i] = c.tobytes()
            block = (mix(num.to_numpy().astype(np.uint64) * GOLD) % np.uint64(blocks)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([num, pa.array(copies), pa.array(block), pa.array(sizes.astype(np.int32)), pa.array(codes, pa.binary()), pa.array(scale), pa.array(bound)], [x.split(" ")[0] for x in CODED.split(", ")])

    return written(reps.select("num", "copies", "e").mapInArrow(run, CODED), "codes")


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by the largest component first, so that squares neither overflow nor vanish."""
    m = m / np.abs(m).max(1)[:, None]
    return m / np.sqrt((m * m).sum(1))[:, None]


def rows_of(x: int, y: int, t: pa.Table):
    """By width: positions of a tile's left and right vectors, their codes as a matrix, and where each lies."""
    width, side = t.column("width").to_numpy(), t.column("block").to_numpy()
    held = t.column("codes").combine_chunks()
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        codes = np.frombuffer(b"".join(held[int(i)].as_py() for i in own), np.int8).reshape(len(own), w)
        left, right = np.flatnonzero(side[own] == x), np.flatnonzero(side[own] == y)
        if len(left) and len(right):
            yield own, codes, left, right


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, block: int = 16384) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. A tile compares at most about `block` vectors with as many."""
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    base = base.select("vec_id", F.when(valid("e"), F.col("e")).alias("e"))
    # -0.0 and 0.0 are one key; the key is the vector itself, so nothing rests on a hash.
    keyed = base.where("e IS NOT NULL").select("vec_id", F.transform("e", lambda v: v + F.lit(0.0)).alias("e"))
    reps = written(keyed.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("num", F.monotonically_increasing_id()), "vectors")
    n = reps.count()
    # At least a few blocks where there are vectors for them, so that a small table keeps several tasks busy.
    blocks = max(1, math.ceil(n / block), min(6, n // 1024))
    codes = coded(reps, blocks)
    # Each block goes to the tiles (b, c) for c >= b and (c, b) for c < b.
    dealt = codes.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"x": F.least("block", "c"), "y": F.greatest("block", "c")}).drop("c")

    def run(key, t):
        x, y = key[0].as_py(), key[1].as_py()
        num, copies = t.column("num").to_numpy(), t.column("copies").to_numpy()
        scale, bound = t.column("scale").to_numpy(), t.column("bound").to_numpy()
        links, is_open, edges = np.zeros(len(num), np.int64), np.zeros(len(num), bool), [np.zeros((2, 0), np.int64)]
        for own, q, left, right in rows_of(x, y, t):
            for i, j, sure in strips(q, scale[own], bound[own], left, right, x == y, threshold):
                i, j = own[i], own[j]
                np.add.at(links, i[sure], copies[j[sure]])
                np.add.at(links, j[sure], copies[i[sure]])
                is_open[i[~sure]] = is_open[j[~sure]] = True
                edges.append(np.stack((i[sure], j[sure])))
                if sum(e.shape[1] for e in edges) > 1 << 22:  # keep a forest of what is found so far
                    e = np.concatenate(edges, 1)
                    edges = [e[:, spanning(len(num), *e)]]
        return found(num, links, np.concatenate(edges, 1), is_open)

    def found(num, links, e, is_open):
        tree, some, asked = e[:, spanning(len(num), *e)], np.flatnonzero(links), np.flatnonzero(is_open)
        kind = np.repeat(np.array([0, 1, 2], np.int32), [len(some), tree.shape[1], len(asked)])
        a = np.concatenate((num[some], num[tree[0]], num[asked]))
        b = np.concatenate((links[some], num[tree[1]], np.zeros(len(asked), np.int64)))
        return pa.table({"kind": kind, "a": a, "b": b})

    def tile(key, t):
        out = run(key, t)
        x, y = (pa.array([k.as_py()] * out.num_rows, pa.int32()) for k in key)
        return out.append_column("x", x).append_column("y", y)

    first = written(dealt.groupBy("x", "y").applyInArrow(tile, "kind int, a long, b long, x int, y int"), "tiles")

    def again(key, t):
        x, y = key[0].as_py(), key[1].as_py()
        num, copies = t.column("num").to_numpy(), t.column("copies").to_numpy()
        scale, bound, column = t.column("scale").to_numpy(), t.column("bound").to_numpy(), t.column("e").combine_chunks()
        links, edges = np.zeros(len(num), np.int64), [np.zeros((2, 0), np.int64)]
        for own, q, left, right in rows_of(x, y, t):
            m = unit(column.take(pa.array(own)).flatten().to_numpy().reshape(len(own), -1))
            for i, j, sure in strips(q, scale[own], bound[own], left, right, x == y, threshold):
                i, j = i[~sure], j[~sure]
                for part in range(0, len(i), 100_000):
                    p, r = i[part : part + 100_000], j[part : part + 100_000]
                    hit = np.einsum("ij,ij->i", m[p], m[r]) >= threshold
                    p, r = own[p[hit]], own[r[hit]]
                    np.add.at(links, p, copies[r])
                    np.add.at(links, r, copies[p])
                    e = np.concatenate((*edges, np.stack((p, r))), 1)
                    edges = [e[:, spanning(len(num), *e)]]
        return found(num, links, np.concatenate(edges, 1), np.zeros(len(num), bool))

    asked = first.where("kind = 2").select(F.col("a").alias("num"), "x", "y")
    doubles = asked.join(codes, "num").join(reps.select("num", "e"), "num")
    second = written(doubles.groupBy("x", "y").applyInArrow(again, "kind int, a long, b long"), "open")
    all_ = first.select("kind", "a", "b").union(second)
    comps = components(all_.where("kind = 1").select("a", "b"))
    counts = all_.where("kind = 0").groupBy(F.col("a").alias("num")).agg(F.sum("b").alias("n"))
    per_rep = reps.join(counts, "num", "left").join(comps.select(F.col("node").alias("num"), "component"), "num", "left")
    per_rep = per_rep.select("e", "rep", "copies", "n", F.coalesce("component", "num").alias("component"))
    named = per_rep.groupBy("component").agg(F.min("rep").alias("component_id"))  # numbers give way to ids
    per_rep = per_rep.join(named, "component").select("e", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    copied = keyed.join(per_rep, "e").select("vec_id", "n_links", "component_id")
    rest = base.where("e IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return copied.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
