"""N-gram Jaccard self-join over word shingles, by size-banded tiles with hashed bitmap signatures.

Two documents link when Jaccard >= percent/100 on their sets of distinct k-word shingles; the result is each
document's set size and component. The steps:

1. One pass gives each document its set's size and identity, so that equal sets become one class, and adds up a fixed-
   size count sketch of all shingles of all documents.
2. Shingles are ordered rare first (by the sketch, then by hash). Sets that link share a shingle among their first
   n - ceil(t*n) + 1, so only those are exchanged, packed in binary buckets by shingle; one task sends a shingle of a
   set once.
3. Homes: each set names the seeded leader that most of its shingles' groups name; leaders of leaders make homes. A
   large home is split by the sets' own hashes, and its leader and the sets whose shingles are most shared go to every
   part. A part's sets are resolved among themselves: bitmaps, then sorted arrays, skipping pairs that are joined
   already. This contracts groups of near copies without their pairs.
4. Tile round: where a shingle's group still spans several components, its sets are dealt to tiles of bounded size
   (the members of its largest component meet only the others) and compared there by size bands; the bit counts of
   XORed bitmaps bound the overlap from above. A tile gives a spanning forest of the pairs left open, never the pairs.
   The open sets that hang together are compared again, once each and in tiles, by wider bitmaps, and what these leave
   open by the sorted arrays; again only a forest of the links comes back.
5. Components of all links.

No task holds a whole group: parts and tiles are bounded by `part` and `tile`, and the exchange of step 2 deals a
shingle that the sketch calls common by set as well. What leaves a task is at most one row for each set it holds.
Every pair of linked sets is either verified or already in one component, so no link between components is lost.
Shingles are 64-bit hashes; set identity is 64 bits and the size.

Defined cases: A-Z are lowered, words are runs of bytes outside x20 and x09-x0D; fewer words than k make one shingle;
a null or wordless text has size 0, links with nothing and is its own component; repeated rows link as equal sets, and
of two texts under one id each keeps its own size while both carry their groups' smallest id; a row without an id takes the
group of an equal text that has one, else its component is null and it is compared with nothing; leaders that tie go by hash, then id; very long texts are
processed whole; an empty table gives an empty table; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BUCKET_BYTES, Forest, components, mix, pack, release, set_id, shingles, sized_join, spanning, text_chunks, unpack, written

SKETCH = 1 << 18
SLICE = 1 << 14
ENTRY = np.dtype([("token", "<u8"), ("sid", "<i8"), ("n", "<i4")])
#: Shingles of so many bits by the sketch are exchanged by set as well.
COMMON_BITS = 19


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def least_overlap(total, percent: int):
    """The smallest overlap of sets of this summed size that link: 100 i >= percent (total - i)."""
    return -(-total * percent // (100 + percent))


def linked(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if min(len(u), len(v)) * 100 < percent * max(len(u), len(v)) or not len(u):
        return False
    merged = np.sort(np.concatenate((u, v)), kind="stable")
    return int((merged[1:] == merged[:-1]).sum()) >= least_overlap(len(u) + len(v), percent)


def describe(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """Rows (doc_id, n, sid) of documents and (slice, counts) of the sketch, written."""

    def run(batches):
        sketch = np.zeros(SKETCH, np.uint32)
        for b in batches:
            ids, n, sid = b.column(0), [], []
            for _, data, offsets in text_chunks(b.column(1)):
                held = []
                for s in shingles(data, offsets, k):
                    n.append(len(s))
                    sid.append(set_id(s) if len(s) else None)
                    held.append(s)
                sketch += np.bincount((np.concatenate(held) >> np.uint64(46)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            yield _rows(ids, n, sid, [None] * len(n), [None] * len(n))
        parts = [(i, zlib.compress(sketch[i : i + SLICE].tobytes(), 1)) for i in range(0, SKETCH, SLICE) if sketch[i : i + SLICE].any()]
        yield _rows([None] * len(parts), [None] * len(parts), [None] * len(parts), [p[0] for p in parts], [p[1] for p in parts])
        release()

    def _rows(*columns):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k_) for c, k_ in zip(columns, kinds, strict=True)], ["doc_id", "n", "sid", "slice", "counts"])

    return written(docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, "doc_id long, n long, sid long, slice int, counts binary"), "sets")


def rarity(described: DataFrame) -> np.ndarray:
    """The sketch's bit lengths, one byte a counter: a fixed 256 KiB whatever the corpus."""

    def add(key, t):
        total = np.zeros(SLICE, np.uint64)
        for c in t.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        bits = np.where(total > 0, np.floor(np.log2(np.maximum(total, 1))) + 1, 0).astype(np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros(SKETCH, np.uint8)
    for r in described.where("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, bits binary").collect():
        out[r["slice"] : r["slice"] + SLICE] = np.frombuffer(r["bits"], np.uint8)
    return out


def prefixes(docs: DataFrame, id_col: str, text: str, k: int, percent: int, order, buckets: int) -> DataFrame:
    """(bucket, entries): the packed prefix shingles of every document."""

    def run(batches):
        bits = order.value
        open_, held = [], 0

        def flush():
            all_ = np.concatenate(open_)
            # A task sends each (shingle, set) once: equal copies do not pile up.
            all_ = np.unique(all_)
            common = bits[(all_["token"] >> np.uint64(46)).astype(np.int64)] >= COMMON_BITS
            spread = np.where(common, mix(all_["token"] ^ all_["sid"].view(np.uint64)), all_["token"])
            at = (spread % np.uint64(buckets)).astype(np.int64)
            rank = np.lexsort((all_["sid"], at))
            all_, at = all_[rank], at[rank]
            cuts = np.flatnonzero(np.diff(at)) + 1
            blobs = [pack(*(np.ascontiguousarray(p[c]) for c in ENTRY.names)) for p in np.split(all_, cuts)]
            return pa.RecordBatch.from_arrays([pa.array(at[np.concatenate(([0], cuts))]), pa.array(blobs, pa.binary())], ["bucket", "entries"])

        for b in batches:
            for _, data, offsets in text_chunks(b.column(0)):
                for s in shingles(data, offsets, k):
                    if len(s):
                        key = (bits[(s >> np.uint64(46)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                        p = prefix_size(len(s), percent)
                        e = np.empty(p, ENTRY)
                        e["token"], e["sid"], e["n"] = s[np.argsort(key, kind="stable")[:p]], set_id(s), len(s)
                        open_.append(e)
                        held += p
                if held > 500_000:
                    yield flush()
                    open_, held = [], 0
        if open_:
            yield flush()
        open_.clear()
        release()

    return docs.select(text).mapInArrow(run, "bucket long, entries binary")


def shared(packed: DataFrame, order) -> DataFrame:
    """(token, sid, n) of the prefix shingles that at least two different sets hold (or that are common), written."""

    def run(key, t):
        parts = [unpack(x.as_py(), *(ENTRY[c] for c in ENTRY.names)) for x in t.column("entries")]
        e = np.empty(sum(len(p[0]) for p in parts), ENTRY)
        for i, c in enumerate(ENTRY.names):
            e[c] = np.concatenate([p[i] for p in parts])
        e = np.unique(e)
        fresh = np.concatenate(([True], e["token"][1:] != e["token"][:-1]))
        size = np.diff(np.append(np.flatnonzero(fresh), len(e)))
        common = order.value[(e["token"] >> np.uint64(46)).astype(np.int64)] >= COMMON_BITS
        e = e[np.repeat(size > 1, size) | common]
        return pa.table({"token": e["token"].view(np.int64) if len(e) else pa.array([], pa.int64()), "sid": e["sid"].copy(), "n": e["n"].copy()})

    return written(packed.groupBy("bucket").applyInArrow(run, "token long, sid long, n int"), "shared")


def per_set(docs: DataFrame, id_col: str, text: str, k: int, wanted: DataFrame, name: str, form) -> DataFrame:
    """(sid, `name`): form(sorted shingles) of the wanted (sid, rep) sets, from their representatives' texts.

    Repeated rows of a representative give repeated rows, which only repeat links.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text).alias("t"))
    asked = wanted.groupBy("rep").agg(F.collect_set("sid").alias("sids"))  # the different texts of one id
    kept = sized_join(kept, asked, "rep", "inner", 48)

    def run(batches):
        for b in batches:
            sids = b.column(1).to_pylist()
            for at, data, offsets in text_chunks(b.column(0)):
                out = [(sid, form(s)) for i, s in enumerate(shingles(data, offsets, k)) if len(s) and (sid := set_id(s)) in sids[at + i]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["sid", name])
        release()

    return kept.select("t", "sids").mapInArrow(run, f"sid long, {name} binary")


def dealt(members: DataFrame, key: str, tile: int, seed: int) -> DataFrame:
    """(key, sid, n, comp, home, i, j, side): the tiles (i, j) of each set of (key, sid, n, comp, home).

    A key's sets are split by their hash into parts of about `tile` sets, those of the key's largest component apart.
    Two parts meet in one tile, side telling them apart; parts of the largest component do not meet one another, as
    their sets are joined already. A key of at most `tile` sets is one tile.
    """
    sizes = members.groupBy(key, "comp").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy(key).agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.max("c").alias("many"), F.sum("c").alias("all"))
    large = sizes.where(F.col("all") > tile).select(
        key, "top", F.greatest(F.ceil((F.col("all") - F.col("many")) / tile), F.lit(1)).cast("int").alias("few_parts"), F.ceil(F.col("many") / tile).cast("int").alias("top_parts")
    )
    rows = sized_join(members, written(large, "large"), key, "left", 40)
    few, top = F.coalesce("few_parts", F.lit(1)), F.coalesce("top_parts", F.lit(1))
    h = F.xxhash64(F.lit(seed), "sid")
    mine = F.when(F.col("top").isNull(), 0).when(F.col("comp") == F.col("top"), few + F.pmod(h, top)).otherwise(F.pmod(h, few)).cast("int")
    rows = rows.withColumn("mine", mine)
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    met = F.when(F.col("mine") >= few, F.sequence(F.lit(0), few - 1)).otherwise(F.sequence(F.lit(0), few + top - 1))
    pairs = F.transform(met, lambda x: F.struct(F.least("mine", x).alias("i"), F.greatest("mine", x).alias("j")))
    rows = rows.withColumn("tile", F.explode(F.when(F.col("top").isNull(), whole).otherwise(pairs)))
    return rows.select(key, "sid", "n", "comp", "home", "tile.i", "tile.j", (F.col("mine") == F.col("tile.i")).alias("side"))


def component_of(links: DataFrame) -> DataFrame:
    """(sid, comp) of the sets that have a link, written."""
    return written(components(links).select(F.col("node").alias("sid"), F.col("component").alias("comp")), "comps")


def labelled(members: DataFrame, state: DataFrame) -> DataFrame:
    """members with `comp`, the component so far, and `home` (the set itself where it has no link or home)."""
    return sized_join(members, state, "sid", "left", 32).select("token", "sid", "n", F.coalesce("comp", "sid").alias("comp"), F.coalesce("home", "sid").alias("home"))


def open_tokens(members: DataFrame) -> DataFrame:
    """The members of the shingles whose groups span several components, written."""
    spans = members.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    return written(members.join(spans, "token", "left_semi"), "open")


def homes(members: DataFrame, percent: int, seed: int, part: int, hops: int = 2, pivots: int = 8) -> DataFrame:
    """(sid, leader, salt): the home of each set that names a leader or is one, and its part there, written.

    A set names the leader of fitting size that most of its shingles' groups name. A leader's seeded hash is the
    smallest of its groups, so chains of leaders have no cycle; a home is the leader a few steps up. A home of more
    than `part` sets is split by the sets' own hashes. Its leader and the `pivots` sets whose shingles' groups are
    largest are rows of every part, so that parts are joined through them.
    """
    lead = members.groupBy("token").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "sid").alias("h"), "sid", "n")).alias("l"), F.count("*").alias("crowd"))
    fit = F.least("n", "l.n") * 100 >= F.greatest("n", "l.n") * percent
    named = members.join(lead, "token").where((F.col("sid") != F.col("l.sid")) & fit)
    votes = named.groupBy("sid", F.col("l.sid").alias("leader")).agg(F.count("*").alias("votes"), F.sum("crowd").alias("crowd"))
    best = votes.groupBy("sid").agg(F.max_by("leader", F.struct("votes", "leader")).alias("leader"), F.sum("crowd").alias("crowd"))
    best = written(best, "leaders")
    direct = best.select(F.col("sid").alias("leader"), F.col("leader").alias("next"))
    for _ in range(hops):
        best = written(sized_join(best, direct, "leader", "left", 24).select("sid", "crowd", F.coalesce("next", "leader").alias("leader")), "leaders")
    tops = best.select("leader").distinct().join(best.select(F.col("sid").alias("leader")), "leader", "left_anti")
    best = best.unionByName(tops.select(F.col("leader").alias("sid"), F.lit(1 << 62).alias("crowd"), "leader"))
    parts = written(best.groupBy("leader").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")), "parts")
    large = parts.where("parts > 1")
    own = sized_join(best, large, "leader", "left", 20).select("sid", "leader", F.pmod(F.xxhash64(F.lit(seed + 1), "sid"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"))
    # row_number up to a constant is cut map-side before the exchange, so a large home does not gather.
    crowded = sized_join(best, large, "leader", "inner", 20)
    w = W.partitionBy("leader").orderBy(F.desc("crowd"), "sid")
    shared_by_all = crowded.withColumn("place", F.row_number().over(w)).where(F.col("place") <= pivots + 1)
    every = shared_by_all.select("sid", "leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    return written(own.union(every).distinct(), "homes")


def forest_of(t: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links among the sets (sid, values[, comp, home, side, i, j]) of one task.

    Sets of one comp are joined already; with home, pairs of one home are left out; with tiles i <> j, those of a side.
    """
    sid, at = np.unique(t.column("sid").to_numpy(), return_index=True)
    column = t.column("values").combine_chunks()
    sets = [np.frombuffer(column[int(i)].as_buffer(), np.uint64) for i in at]
    n = np.array([len(x) for x in sets], np.int64)
    rank = np.argsort(n, kind="stable")
    sid, sets, n, at = sid[rank], [sets[i] for i in rank], n[rank], at[rank]
    comp = np.unique(t.column("comp").to_numpy()[at], return_inverse=True)[1] if "comp" in t.column_names else np.arange(len(n))
    home, side = tile_sides(t, at)
    i, j = band_pairs(n, [bitmap(x, 8) for x in sets], comp, percent, 8, home, side)
    forest, edges = Forest(len(n)), []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if forest.find(comp[x]) != forest.find(comp[y]) and linked(sets[x], sets[y], percent):
            forest.join(comp[x], comp[y])
            edges.append((min(sid[x], sid[y]), max(sid[x], sid[y])))
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def tile_sides(t: pa.Table, at: np.ndarray):
    """(home, side) of the rows `at` of a tile; None where they do not part pairs."""
    if "home" not in t.column_names:
        return None, None
    apart = t.column("i")[0] != t.column("j")[0]
    return t.column("home").to_numpy()[at], t.column("side").to_numpy(zero_copy_only=False)[at] if apart else None


def resolve(docs: DataFrame, reps: DataFrame, placed: DataFrame, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """A spanning forest (a, b) of the links within each part of a home, written."""
    wanted = written(placed.select("sid").distinct().join(reps, "sid").select("sid", "rep"), "wanted")
    held = sized_join(per_set(docs, id_col, text, k, wanted, "values", bytes), placed, "sid", "inner", 28)
    return written(held.groupBy("leader", "salt").applyInArrow(lambda key, t: forest_of(t, percent), "a long, b long"), "links")


def bitmap_bits(n: int, per: int) -> int:
    return max(128, 1 << (per * n - 1).bit_length())


def fold(raw: bytes, words: int) -> np.ndarray:
    """A bitmap in fewer words: what the same shingles set there."""
    return np.bitwise_or.reduce(np.frombuffer(raw, np.uint64).reshape(-1, words), 0)


def bitmap(values: np.ndarray, per: int) -> bytes:
    """A bit for each shingle, in `per` times as many bits as shingles, rounded up to a power of two."""
    wide = bitmap_bits(len(values), per)
    out = np.zeros(wide // 64, np.uint64)
    at = mix(values) & np.uint64(wide - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.tobytes()


def band_pairs(n: np.ndarray, raw: list[bytes], comp: np.ndarray, percent: int, per: int, home=None, side=None):
    """Index pairs of one task's sets (sorted by size) that may link: tiles of fitting sizes, bit counts.

    A tile compares in the width of its smallest set's bitmap; larger sets' bitmaps are folded to it. Pairs of one
    comp, of one home or of one side are left out.
    """
    i_out, j_out, i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while i < len(n):
        words = bitmap_bits(int(n[i]), per) // 64
        edge = max(8, int(((1 << 21) / words) ** 0.5))
        # A band ends a quarter above its smallest set, or folding would fill the others' bitmaps.
        a = slice(i, min(i + edge, int(np.searchsorted(n, n[i] + n[i] // 4, "right"))))
        reach = int(np.searchsorted(n, n[a.stop - 1] * 100 // percent, "right"))
        left = np.stack([fold(x, words) for x in raw[a]])
        for j in range(i, reach, edge):
            b = slice(j, min(j + edge, reach))
            right = left if j == i and b == a else np.stack([fold(x, words) for x in raw[b]])
            total = n[a, None] + n[None, b]
            away = np.bitwise_count(left[:, None, :] ^ right[None, :, :]).sum(2, dtype=np.int64)
            ok = (total - away >= 2 * least_overlap(total, percent)) & (comp[a, None] != comp[None, b])
            ok &= np.minimum(n[a, None], n[None, b]) * 100 >= np.maximum(n[a, None], n[None, b]) * percent
            for parts in (home, side):
                if parts is not None:
                    ok &= parts[a, None] != parts[None, b]
            x, y = np.nonzero(ok)
            keep = x + i < y + j
            i_out.append(x[keep] + i)
            j_out.append(y[keep] + j)
        i = a.stop
    return np.concatenate(i_out), np.concatenate(j_out)


def open_forest(members: DataFrame, docs: DataFrame, reps: DataFrame, id_col: str, text: str, k: int, percent: int, per: int, tile: int, seed: int) -> DataFrame:
    """(a, b), written: a spanning forest of the pairs of a shingle's sets that bitmaps of `per` bits a shingle leave open."""
    wanted = written(members.select("sid").distinct().join(reps, "sid").select("sid", "rep"), "wanted")
    signed = per_set(docs, id_col, text, k, wanted, "bits", lambda x: bitmap(x, per))
    held = dealt(members, "token", tile, seed).join(signed, "sid")

    def run(key, t):
        n = t.column("n").to_numpy().astype(np.int64)
        rank = np.argsort(n, kind="stable")
        sid, comp = t.column("sid").to_numpy()[rank], t.column("comp").to_numpy()[rank]
        raw = t.column("bits").to_pylist()
        i, j = band_pairs(n[rank], [raw[r] for r in rank], comp, percent, per, *tile_sides(t, rank))
        tree = spanning(len(sid), i, j)
        return pa.table({"a": sid[i[tree]], "b": sid[j[tree]]})

    return written(held.groupBy("token", "i", "j").applyInArrow(run, "a long, b long").distinct(), "open")


def once_each(members: DataFrame) -> DataFrame:
    """members without the shingles whose sets are those of another shingle, written: they give the same pairs."""
    groups = members.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(3), "sid"), 20)).alias("s"))
    once = groups.groupBy("c", "x", "s").agg(F.min("token").alias("token")).select("token")
    return written(members.join(once, "token", "left_semi"), "once")


def heaps(open_: DataFrame, state: DataFrame, reps: DataFrame) -> DataFrame:
    """(heap, sid, n, comp, home), written: the sets that open pairs hold together, each once.

    state: (sid, comp, home) of every set with a component or a home.
    """
    groups = components(open_).select(F.col("node").alias("sid"), F.col("component").alias("heap"))
    return written(groups.join(state, "sid", "left").join(reps, "sid").select("heap", "sid", "n", F.coalesce("comp", "sid").alias("comp"), F.coalesce("home", "sid").alias("home")), "heaps")


def settle(members: DataFrame, docs: DataFrame, reps: DataFrame, id_col: str, text: str, k: int, percent: int, tile: int, seed: int) -> DataFrame:
    """A spanning forest (a, b) of the links within heaps, written."""
    wanted = written(members.select("sid").join(reps, "sid").select("sid", "rep"), "wanted")
    held = per_set(docs, id_col, text, k, wanted, "values", bytes)
    held = sized_join(held, written(dealt(members, "heap", tile, seed), "dealt"), "sid", "inner", 64)
    return written(held.groupBy("heap", "i", "j").applyInArrow(lambda key, t: forest_of(t, percent), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = 5, percent: int = 80, seed: int = 5, part: int = 1024, tile: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row. A task resolves about `part` sets by arrays, `tile` by bitmaps."""
    spark = docs.sparkSession
    described = describe(docs, id_col, text, k)
    rows = described.where("slice IS NULL").select("doc_id", "n", "sid")
    order = spark.sparkContext.broadcast(rarity(described))
    reps = written(rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "reps")
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total * (100 - percent) / 100 * ENTRY.itemsize / BUCKET_BYTES))
    members = shared(prefixes(docs, id_col, text, k, percent, order, buckets), order)
    placed = homes(members, percent, seed, part)
    links = resolve(docs, reps, placed, id_col, text, k, percent)
    # A set's home for pairs that need no second look: any part that holds it, pivots being in several.
    at_home = placed.groupBy("sid").agg(F.min(F.struct("salt", F.xxhash64("leader", "salt").alias("home")))["home"].alias("home"))
    state = written(at_home.join(component_of(links), "sid", "full"), "state")
    members = open_tokens(labelled(members, state))
    open_ = open_forest(once_each(members), docs, reps, id_col, text, k, percent, 2, tile, seed)
    links = links.union(settle(heaps(open_, state, reps), docs, reps, id_col, text, k, percent, part, seed))
    comps = components(links).select(F.col("node").alias("sid"), "component")
    grouped = reps.join(comps, "sid", "left").select("sid", "rep", "copies", F.coalesce("component", "sid").alias("component"), F.col("component").isNotNull().alias("linked"))
    low = grouped.where("linked").groupBy("component").agg(F.min("rep").alias("low"))
    named = grouped.where("linked OR copies > 1").join(low, "component", "left").select("sid", F.coalesce("low", "rep").alias("component_id"))
    out = sized_join(rows, written(named, "named"), "sid", "left", 24)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
