"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are counted in words. Targets share a stated part of all words by weight, and stop at a multiple of the source's
size. Each source is split into shards (by a seeded hash of the document), a shard's documents are laid end to end in
seeded order and cut into blocks of equal size. Highest quotients (q / (2s + 1)) give each source its blocks and then,
within the source, each shard its quota; the shard takes whole passes over its blocks and a seeded choice of the rest.
A document's `taken` is the words of it that chosen blocks cover, so it is at most passes times its size.

Defined cases: a null text has size 0 and is returned with taken 0; a null source is a source of its own, last in
order; sources without words have target 0; repeated rows are documents of their own, ordered by the same seeded hash,
and equal rows are interchangeable; very long texts are counted whole; other columns pass through whatever their names,
but for the five result columns, which win; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import BROADCAST_BYTES, release, text_chunks, words, written

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """share * sum(sizes) dealt by weight; no target above cap * size, the excess dealt again by weight."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    while open_ and total > 0:
        w = sum(weights[i] for i in open_)
        full = {i for i in open_ if total * weights[i] / w > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = total * weights[i] / w
            break
        for i in full:
            out[i] = cap * sizes[i]
        total -= sum(out[i] for i in full)
        open_ -= full
    return out


def apportion(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Sainte-Lague with a ceiling for each party: seats go to the highest votes / (2s + 1).

    The divisor is bisected instead of dealing seat by seat, so the work does not grow with the number of seats; the
    last few seats go by quotient, ties to the earlier party.
    """
    seats = min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))
    at = lambda d: [min(m, int(v / d + 0.5)) if v > 0 else 0 for v, m in zip(votes, most, strict=True)]
    if seats <= 0:
        return [0] * len(votes)
    low, high = 1e-12, 2 * max(votes) + 1
    for _ in range(200):
        mid = math.sqrt(low * high)
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    got = at(high)
    while sum(got) < seats:
        best = max((i for i in range(len(votes)) if votes[i] > 0 and got[i] < most[i]), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


#: Columns of the work, under names that no table has.
_H, _SHARD, _TO, _FROM = (f"__claimloom_mix_{x}" for x in ("h", "shard", "to", "from"))
_S, _ORD, _SHARDS, _Q_ORD, _Q_SHARD, _BLOCKS, _QUOTA = (f"__claimloom_mix_{x}" for x in ("s", "ord", "shards", "q_ord", "q_shard", "blocks", "quota"))


def mix_sources(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, block: int = 32, shard_docs: int = 1000, even_shards: int = 4096, shard_words: int = 1 << 24, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, taken, and the spans taken: `spans` array<struct<pass, start, length>>.

    `weights` repeat over the sources in code-point order. spans count words of the document from 0. A source has a
    shard for each `shard_docs` documents up to `even_shards`, and a shard for each `shard_words` words beyond, so a
    shard's task stays bounded at any size. The driver holds one row for each source and shard.
    """
    spark = docs.sparkSession
    base = docs.drop("size", "source_size", "target", "taken", "spans").withColumn("size", size_of(F.col(text)))
    hashed = F.xxhash64(F.lit(seed), F.col(id_col))
    # Counting words is the dear step: sources and shards are summed from one small written table.
    counted = written(base.select(F.col(source).cast("string").alias("s"), hashed.alias("h"), "size"), "sizes")
    per_source = counted.groupBy("s").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    order = sorted(per_source, key=lambda r: (r["s"] is None, [ord(c) for c in r["s"] or ""]))
    shards = {r["s"]: max(1, min(even_shards, math.ceil(r["n"] / shard_docs)), math.ceil(r["size"] / shard_words)) for r in order}
    want = targets([r["size"] for r in order], [weights[i % len(weights)] for i in range(len(order))], share, cap)
    kinds = T.StructType([T.StructField(_S, T.StringType()), T.StructField(_ORD, T.IntegerType()), T.StructField(_SHARDS, T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    sources = spark.createDataFrame([(r["s"], i, shards[r["s"]], int(r["size"]), float(want[i])) for i, r in enumerate(order)], kinds)
    sources = _bounded(sources, sum(64 + len(r["s"] or "") for r in order))
    shard_of = lambda h: F.pmod(F.shiftright(h, 20), F.col(_SHARDS)).cast("int")
    dealt = counted.join(sources, counted["s"].eqNullSafe(sources[_S])).select(_ORD, shard_of(F.col("h")).alias(_SHARD), "size")
    sums = {(r[_ORD], r[_SHARD]): int(r["size"]) for r in dealt.groupBy(_ORD, _SHARD).agg(F.sum("size").alias("size")).collect()}
    quota = quotas(order, want, sums, block, cap)
    kinds = T.StructType([T.StructField(_Q_ORD, T.IntegerType()), T.StructField(_Q_SHARD, T.IntegerType()), T.StructField(_BLOCKS, T.LongType()), T.StructField(_QUOTA, T.LongType())])
    quota_df = _bounded(spark.createDataFrame([(o, s, -(-size // block), quota[o, s]) for (o, s), size in sorted(sums.items())], kinds), 48 * len(sums))
    out = base.withColumn(_H, hashed)
    out = out.join(sources, out[source].cast("string").eqNullSafe(sources[_S])).withColumn(_SHARD, shard_of(F.col(_H)))
    # Where the caller drops the text, Catalyst prunes it below this window: then only ids and sizes are moved.
    w = W.partitionBy(_ORD, _SHARD).orderBy(_H, id_col, "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = out.withColumn(_TO, F.sum("size").over(w)).withColumn(_FROM, F.col(_TO) - F.col("size"))
    out = out.join(quota_df, (F.col(_ORD) == F.col(_Q_ORD)) & (F.col(_SHARD) == F.col(_Q_SHARD)))
    out = out.withColumn("spans", spans_of(block, seed))
    out = out.withColumn("taken", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"]))
    return out.drop(_H, _SHARD, _TO, _FROM, _S, _ORD, _SHARDS, _Q_ORD, _Q_SHARD, _BLOCKS, _QUOTA)


def _bounded(df: DataFrame, size: int) -> DataFrame:
    """A frame made on the driver, to be broadcast only where its size is within the bound."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def taken_texts(mixed: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """One row for each pass of a mixed document: its text, or the words its chosen blocks cover, a line for each run.

    Columns of mix_sources() are dropped; `n_chars`, where given, is counted again. Documents without taken words go.
    """
    schema = mixed.drop("size", "source_size", "target", "taken", "spans").schema

    def run(batches):
        for b in batches:
            yield from passes(b, schema.fieldNames(), text, n_chars)
        release()

    return mixed.where("taken > 0").select(*schema.fieldNames(), "size", "spans").mapInArrow(run, schema)


def passes(b: pa.RecordBatch, names: list[str], text: str, n_chars: str | None, limit: int = 1 << 20):
    """The rows of taken_texts() of a batch of `names`, size and spans, in batches cut from about `limit` bytes of text.

    Words are found and cut as bytes, so that what a task holds beside its batch follows `limit` or its longest text.
    """
    at, n = names.index(text), len(names)
    for first, data, offsets in text_chunks(b.column(at), limit):
        part = b.slice(first, len(offsets) - 1)
        starts, ends, bound = words(data, offsets)
        sizes, spans = part.column(n).to_pylist(), part.column(n + 1)
        to = np.cumsum(pc.list_value_length(spans).to_numpy(zero_copy_only=False))
        pass_, start, length = (pc.struct_field(spans.flatten(), x).to_numpy() for x in ("pass", "start", "length"))
        source, out = [], []
        for i, (f, t) in enumerate(zip([0, *to[:-1]], to, strict=True)):
            for k in np.unique(pass_[f:t]):
                own = pass_[f:t] == k
                a, m = start[f:t][own], length[f:t][own]
                if m.sum() == sizes[i]:
                    out.append(data[offsets[i] : offsets[i + 1]].tobytes())
                else:
                    order = np.argsort(a)
                    a, z = a[order], (a + m)[order]
                    new = a[1:] != z[:-1]
                    runs = zip(bound[i] + a[np.concatenate(([True], new))], bound[i] + z[np.concatenate((new, [True]))] - 1, strict=True)
                    out.append(b"\n".join(data[starts[x] : ends[y]].tobytes() for x, y in runs))
                source.append(i)
        texts, rows = pa.array(out, pa.binary()).cast(pa.string()), pa.array(source, pa.int64())
        made = {at: texts} | ({names.index(n_chars): pc.utf8_length(texts).cast(b.column(names.index(n_chars)).type)} if n_chars else {})
        yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c).take(rows) for c in range(n)], names)


def quotas(order, want, sums, block, cap) -> dict[tuple[int, int], int]:
    """Blocks for each (source, shard): first among the sources, then within each source among its shards."""
    by_source: dict[int, list[int]] = {}
    for o, s in sorted(sums):
        by_source.setdefault(o, []).append(s)
    blocks = {k: -(-size // block) for k, size in sums.items()}
    keys = sorted(by_source)
    most = [sum(math.floor(cap * blocks[o, s]) for s in by_source[o]) for o in keys]
    got = apportion([want[o] for o in keys], round(sum(want) / block), most)
    out = {}
    for o, n in zip(keys, got, strict=True):
        parts = apportion([float(sums[o, s]) for s in by_source[o]], n, [math.floor(cap * blocks[o, s]) for s in by_source[o]])
        out.update({(o, s): q for s, q in zip(by_source[o], parts, strict=True)})
    return out


def spans_of(block: int, seed: int) -> Column:
    """The (pass, start, length) of a document's words that the shard's chosen blocks cover.

    quota = passes * blocks + rest: every block is chosen `passes` times, and `rest` of them once more: block i where
    floor((p(i) + 1) * rest / blocks) > floor(p(i) * rest / blocks), p(i) = (i + shift) mod blocks with a seeded shift,
    so exactly `rest` blocks are chosen, spread evenly over the seeded order of the documents.
    """
    quota, blocks, begin, end = F.col(_QUOTA), F.col(_BLOCKS), F.col(_FROM), F.col(_TO)
    some = F.greatest(blocks, F.lit(1).cast("long"))
    passes, rest = F.floor(quota / some).cast("long"), quota % some
    shift = F.pmod(F.xxhash64(F.lit(seed), F.col(_ORD), F.col(_SHARD)), some)
    none = F.array().cast("array<bigint>")
    counted = F.when((quota >= blocks) & (F.col("size") > 0), F.sequence(F.lit(1).cast("long"), passes)).otherwise(none)
    whole = F.transform(counted, lambda p: F.struct((p - 1).cast("int").alias("pass"), F.lit(0).cast("long").alias("start"), F.col("size").alias("length")))
    of = lambda x: F.floor(x / block).cast("long")
    ids = F.when(F.col("size") > 0, F.sequence(of(begin), of(end - 1))).otherwise(none)

    def inline(i):
        p = F.pmod(i + shift, blocks)
        return F.floor((p + 1) * rest / blocks) > F.floor(p * rest / blocks)

    part = F.transform(
        F.filter(ids, inline),
        lambda i: F.struct(
            passes.cast("int").alias("pass"),
            (F.greatest(begin, i * block) - begin).alias("start"),
            (F.least(end, (i + 1) * block) - F.greatest(begin, i * block)).alias("length"),
        ),
    )
    return F.concat(whole, part)
