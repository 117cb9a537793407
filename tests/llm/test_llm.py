"""The ten operators against brute force and on awkward rows: nulls, empties, ties, repeats, empty tables, extra columns."""

import hashlib
import io
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.llm import embedding_dedup, line_dedup, media, mixing, ngram_join, packing, quality, suffix_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, component_id string, kept_text string, length string"


def corpus(n=120, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    text = lambda k: "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(k))
    rows = [[i, text(r.randint(1, 8)), f"s{i % 3}"] for i in range(n)]
    for i in range(20, 40):  # near copies
        rows[i][1] = rows[i - 20][1] + " extra"
    for i in range(40, 50):  # exact copies
        rows[i][1] = rows[3][1]
    for i in range(50, 65):
        rows[i][1] += "\n  A Common Line \t\nmore"
    rows[70][1], rows[71][1], rows[72][1], rows[73][1] = None, "", " \n\t ", "one two"
    rows[74][1] = "One TWO"
    rows[75][1] = "long " * 30_000
    rows[76][2] = None
    rows.append(list(rows[5]))  # a repeated row
    return [(i, t, "en", s, len(t or ""), "x", "y", None, "z") for i, t, s in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def find(up, i):
    while up[i] != i:
        i = up[i]
    return i


def test_ngram_join(docs, none, rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(up, a), find(up, b)
                up[max(x, y)] = min(x, y)
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), find(up, i)) for i, s in sets.items()}
    assert ngram_join.jaccard_components(none).count() == 0


def near_copies(n, seed, size=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    base = [r.choice(words) for _ in range(size)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            w[r.randrange(size)] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(r.choice(words) for _ in range(size))) for i in range(n, n + n // 3)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,limits", [(150, {"part": 2, "tile": 2}), (3200, {})])
def test_ngram_join_splits_a_large_group(spark, n, limits):
    rows = near_copies(n, n)
    sets, up = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in sets.items():  # only sets that share a shingle can link
        both = {}
        for g in s:
            for j in holders[g]:
                both[j] = both.get(j, 0) + 1
        for j, c in both.items():
            if j < i and 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                x, y = find(up, i), find(up, j)
                up[max(x, y)] = min(x, y)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), **limits).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(up, i) for i in sets}


def test_spanning_forest_and_bands():
    from claimloom.llm.common import spanning

    r = np.random.default_rng(2)
    for n, m in ((1, 0), (30, 20), (200, 3000)):
        i, j = r.integers(0, n, m), r.integers(0, n, m)
        tree = spanning(n, i, j)
        up = {x: x for x in range(n)}
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(up, x), find(up, y)
            up[max(a, b)] = min(a, b)
        assert len(tree) == n - len({find(up, x) for x in range(n)})
    sets = sorted((np.unique(r.integers(0, 1 << 63, int(k), dtype=np.uint64)) for k in (1, 2, 3, *r.integers(300, 1000, 40))), key=len)
    # A very small set in the task does not blur the bitmaps of large ones.
    assert not len(ngram_join.band_pairs(np.array([len(s) for s in sets]), [ngram_join.bitmap(s, 2) for s in sets], np.arange(len(sets)), 80, 2)[0])


def test_quality(docs, none, rows, spark):
    model = quality.fit(docs)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.keep for r in got}[70] == 1
    assert quality.filter_quality(docs, model).columns == docs.columns
    assert quality.score(none, quality.fit(none)).count() == 0
    junk = [(i, "WORD!! SHOUT!! LOUD!! " * 20 if i % 4 == 0 else f"The plain words of text {i} go on and on, as they do.") for i in range(80)]
    d = spark.createDataFrame(junk, "doc_id long, text string")
    kept = {r.doc_id for r in quality.filter_quality(d, quality.fit(d)).collect()}
    assert kept == {i for i, _ in junk if i % 4}


def test_warc(spark, tmp_path):
    big, half = "x" * 1500, "é" * 600
    pages = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", None), (7, "u7", half), (8, "u\r\n8", half), (8, "u8", half), (None, "n", half), (9, "u9", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    bundles = warc.write_bundles(warc.with_digests(df), frame_bytes=2000)
    got = warc.read_bundles(bundles, keep_payload=True).collect()
    assert len(got) == len(pages)
    last = {big: 3, half: 8}
    for r in got:
        texts = {h or "" for i, _, h in pages if i == r.page_id}
        assert r.payload_digest in {hashlib.sha1(t.encode()).hexdigest() for t in texts}
        want = next((v for t, v in last.items() if t in texts and r.page_id is not None and r.page_id < v), None)
        assert (r.record_type, r.refers_to) == (("revisit", want) if want else ("response", None))
        if r.record_type == "response":
            assert bytes(r.payload).decode() in texts
    assert [r.page_id for r in warc.read_bundles(bundles, only=[warc.record_id(4)], keep_payload=True).collect()] == [4]
    assert warc.export_files(bundles, str(tmp_path)).count() == bundles.count() == len(list(tmp_path.glob("*.warc.zst")))
    at = warc.places(bundles)
    assert at.count() == len(pages)
    found = {r.record_id: r for r in warc.fetch(at.where("record_id LIKE '%:3>' OR record_id LIKE '%:2>' OR record_id LIKE '%:6>'"), str(tmp_path)).collect()}
    assert {i: (r.record_type, r.refers_to, bytes(r.payload).decode()) for i, r in found.items()} == {
        warc.record_id(2): ("revisit", 3, ""), warc.record_id(3): ("response", None, big), warc.record_id(6): ("response", None, "")
    }
    assert warc.fetch(at.union(at), str(tmp_path)).count() == 2 * len(pages)
    assert warc.fetch(at.limit(0), str(tmp_path)).count() == 0
    assert warc.read_bundles(warc.write_bundles(warc.with_digests(df.limit(0)))).count() == 0


class Counting(io.BytesIO):
    """A file that counts the bytes it hands out."""

    given = 0

    def read(self, n=-1):
        out = super().read(n)
        self.given += len(out)
        return out


def test_seek_reads_only_what_is_asked():
    b, r = warc.Bundle(4000, 3), random.Random(5)
    bodies = [r.randbytes(3000) for _ in range(200)]
    for i, body in enumerate(bodies):
        b.add(warc.record_id(i), warc.write_record(i, "u", body, hashlib.sha1(body).hexdigest(), None))
    f = Counting(b.archive())
    frames = warc.seek_table(f)
    for i in (0, 117, 199):
        f.given = 0
        _, no, offset, length = b.index[i]
        assert warc.checked(warc.frame(f, frames[no])[offset : offset + length], True)[-1] == bodies[i]
        assert f.given == frames[no][1] < len(f.getbuffer()) / 50


def test_media(docs, none, rows):
    held = media.store(docs, "doc_id", "text")
    got = {r.id: r for r in media.resolve(media.sequences(held, "id"), media.features(held)).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = media.padded(raw, 576)
        r = got[i]
        assert len(payload) % 576 == 0 and payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.caption == f"text of document {i}"
    assert got[40].feature == got[3].feature and got[40].media_sha256 == got[3].media_sha256
    empty = media.store(none, "doc_id", "text")
    assert media.resolve(media.sequences(empty, "id"), media.features(empty)).count() == 0
    items = media.parse_html('<p>a <b>b</b></p><script>x</script><figure><img src="media:1"><figcaption>cap</figcaption></figure><p>c</p>')
    assert [(x["kind"], x["text"], x["caption"]) for x in items] == [("text", "a b", None), ("media", None, "cap"), ("text", "c", None)]


def test_toxicity(spark, docs, none):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    data = [(i, " ".join([word() for _ in range(20)] + (["nastyword" if i % 7 else "nasstyword"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(400)]
    d = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    got = toxicity.score(d, toxicity.fit(d, d.select("doc_id", "toxic"))).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    held = [x for x in got if x.held_out]
    assert np.mean([x.predicted == (x.doc_id % 3 == 0) for x in held]) > 0.9
    labels = spark.createDataFrame([(1, None), (2, 0), (3, 0), (3, 0)], "doc_id long, toxic int")
    assert {x.predicted for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0}
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_packing(docs, none, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=256).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(packing.cut(len(ids), 256))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    bins = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    hist = {}
    for *_, n, _ in want:
        hist[n] = hist.get(n, 0) + 1
    plain = packing.Plan(256)  # best-fit decreasing alone
    for n in sorted(hist, reverse=True):
        plain.best_fit(n, hist[n])
    assert max(bins.values()) <= 256 and len(bins) <= sum(c[0] for c in plain.classes) * 1.01
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_plan_groups_large_lengths():
    r = random.Random(4)
    hist = {}
    for _ in range(5000):
        n = r.randint(1, 2048)
        hist[n] = hist.get(n, 0) + 1
    few = packing.best_plan({1500: 2, 1300: 1, 700: 2, 548: 2, 90: 5}, 2048)
    assert few.grouped >= 3  # the scheme places pieces, however few there are
    p = packing.best_plan(hist, 2048)
    assert p.grouped >= sum(n for k, n in hist.items() if k > 1024) * 0.9
    assert {k: sum(c[0] * m for c in p.classes for n, m in c[2] if n == k) for k in hist} == hist
    assert all(sum(n * m for n, m in c[2]) + c[1] == 2048 for c in p.classes)


def test_line_dedup(docs, none, rows):
    strip, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(lower)
    count = {}
    for _, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    want = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 1 and count[key(x)] >= 10)]
        want[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == want
    assert line_dedup.line_dedup(none).count() == 0


def clashing(docs, *names):
    return docs.select("*", *[F.lit("own").alias(n) for n in names])


def test_line_dedup_keeps_other_columns_and_counts_ids_once(spark, docs):
    names = ["id", "t", "h", "pos", "__gone", "n_lines", "__l"]
    got = line_dedup.line_dedup(clashing(docs, *names))
    assert got.columns == [*docs.columns[:7], "length", *[n for n in names if n != "n_lines"], "kept_text", "n_lines", "n_dropped", "kept_sha256"]
    assert {r.id for r in got.select("id").collect()} == {"own"}
    rows = [(1, "same\nother")] * 12 + [(i, "often") for i in range(20, 30)] + [(None, "often"), (2, "x" * 2_000_000 + "\noften")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.n_dropped for r in out if r.doc_id == 1} == {0} and {r.n_dropped for r in out if r.doc_id != 1} == {1}


def test_mixing_keeps_other_columns(docs, rows):
    names = ["h", "shard", "to", "from", "s", "ord", "shards", "blocks", "quota", "q_ord", "n"]
    got = mixing.mix_sources(clashing(docs, *names))
    assert {r[0] for r in got.select("shard").collect()} == {"own"} and set(names) <= set(got.columns)
    assert sorted((r.doc_id, r.taken) for r in got.collect()) == sorted((r.doc_id, r.taken) for r in mixing.mix_sources(docs).collect())


def removed(rows, length=50):
    """Brute force over (id, text): for each row (id, bytes, removed, runs, digest of the rest)."""
    source, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - length + 1):
            source[b[a : a + length]] = min(i, source.get(b[a : a + length], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if source[b[a : a + length]] < i:
                gone[a : a + length] = b"\1" * length
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(b, gone, strict=True) if not x)).hexdigest()))
    return sorted(out)


def test_suffix_dedup_of_texts_that_share_an_id(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(200)]
    runs = [" ".join(r.choice(words) for _ in range(20)) for _ in range(12)]
    rows = [(i // 3 * 10**15, " ".join(r.choice(runs) for _ in range(r.randint(1, 4))) + f" {i % 5}") for i in range(60)]
    rows += [rows[4], rows[4], (10**15, None), (10**15, "")]
    got = suffix_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == removed(rows)


def test_suffix_anchors_in_windows_are_those_of_the_whole():
    r = np.random.default_rng(3)
    data = r.integers(97, 101, 3000).astype(np.uint8)
    offsets = np.array([0, 700, 710, 2900, 3000])
    runs = lambda w: sorted((int(p), int(h), s) for p, h, a, b in zip(*suffix_dedup.anchors(data, offsets, 50, 26, w), strict=True) for s in range(a, b + 1))
    assert runs(1 << 22) == runs(64) == runs(333)


def test_suffix_dedup(docs, none, rows):
    source = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for a in range(len(b) - 49):
            source[b[a : a + 50]] = min(i, source.get(b[a : a + 50], i))
    want = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if source[b[a : a + 50]] < i:
                gone[a : a + 50] = b"\1" * 50
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        want[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(b, gone, strict=True) if not x)).hexdigest())
    got = suffix_dedup.substring_dedup(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert suffix_dedup.substring_dedup(none).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    vectors = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.25, base[:5], base[:5] * 3])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [None] + [1.0] * 15), (104, []), (105, [1e200] * 16), (106, [1e-200] * 16), (107, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = {i: np.array(v) / max(map(abs, v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ok = {i: v / np.sqrt(v @ v) for i, v in ok.items()}
    links, up = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                x, y = find(up, a), find(up, b)
                up[max(x, y)] = min(x, y)
    for block in (4096, 16):
        got = embedding_dedup.near_duplicates(df, block=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (links[i], find(up, i), find(up, i) == i) for i, _ in rows}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_that_share_an_id(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 80))
    rows = [(int(i) if i >= 0 else None, [float(x) for x in base[k % 6] + rng.normal(size=80) * 0.1 * (k // 6)]) for k, i in enumerate([1, 1, 2, 3, -1, -1, 4, 1, 5, -1, 6, -1, 7, 8, 9])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=4).collect()
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    near = [[k for k in range(len(rows)) if k != j and unit[j] @ unit[k] >= 0.9] for j in range(len(rows))]
    want = []
    for j, (i, _) in enumerate(rows):
        reach, todo = {j}, [j]
        while todo:
            fresh = set(near[todo.pop()]) - reach
            reach |= fresh
            todo += fresh
        low = min((rows[k][0] for k in reach if rows[k][0] is not None), default=None)
        want.append((i, len(near[j]), low, i == low))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=key) == sorted(want, key=key)
    assert any(want[j][1] for j in range(len(rows)) if rows[j][0] is None)


def test_mixing(docs, none, rows):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    size = {}
    for _, t, _, s, *_ in rows:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    # Water-filling by bisection: target = min(2 size, level * weight), the level such that targets sum to 1.5 of all.
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 2.0 * sum(size.values())
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(2 * size[s], level * weight[s]) for s in order) < 1.5 * sum(size.values()):
            low = level
        else:
            high = level
    want = {s: min(2 * size[s], high * weight[s]) for s in order}
    for s in order:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == size[s] and abs(own[0].target - want[s]) < 1e-6
        assert abs(sum(r.taken for r in own) - want[s]) <= 70
    assert len(got) == len(rows) and all(int(r.size) * 2 >= r.taken for r in got)
    mixed = mixing.mix_sources(docs)
    made = mixing.taken_texts(mixed.select("doc_id", "text", "n_chars", "size", "source_size", "target", "taken", "spans")).collect()
    assert sum(len(r.text.encode().split()) for r in made) == sum(r.taken for r in got)
    assert mixing.mix_sources(none).count() == 0


def test_apportion():
    assert mixing.apportion([53.0, 24.0, 23.0], 7, [9, 9, 9]) == [3, 2, 2]
    assert sum(mixing.apportion([5.0, 5.0], 7, [3, 9])) == 7


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert out.count() > 0


def test_taken_texts_come_in_bounded_batches():
    r = random.Random(4)
    span = pa.list_(pa.struct([("pass", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
    texts, spans = [], []
    for i in range(120):
        texts.append("  " * (i % 2) + "".join(r.choice(["é", "ab", "漢字"]) + r.choice([" ", "\n", "\x0b ", " x "]) for _ in range(0 if i == 7 else 9000)))
        n, whole = len(re.findall(mixing.WORD, texts[-1])), [{"pass": 0, "start": 0, "length": 0}]
        whole[0]["length"] = n
        cuts = [{"pass": 1, "start": s, "length": min(32, n - s)} for s in range(0, n, 32) if r.random() < 0.5]
        spans.append((whole if i % 3 and n else []) + r.sample(cuts, len(cuts)))
    sizes = [len(re.findall(mixing.WORD, t)) for t in texts]
    b = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array(texts), pa.array([0] * 120, pa.int32()), pa.array(sizes, pa.int64()), pa.array(spans, span)], ["doc_id", "text", "n_chars", "size", "spans"])
    made = list(mixing.passes(b.slice(1), ["doc_id", "text", "n_chars"], "text", "n_chars"))
    assert len(made) > 2 and max(x.nbytes for x in made) < 3 << 20 and made[0].schema.field("n_chars").type == pa.int32()
    want = []
    for i, (t, own) in list(enumerate(zip(texts, spans, strict=True)))[1:]:
        found = list(re.finditer(mixing.WORD, t))
        for p in sorted({s["pass"] for s in own}):
            taken = sorted(x for s in own if s["pass"] == p for x in range(s["start"], s["start"] + s["length"]))
            runs = [list(g) for _, g in itertools.groupby(taken, key=lambda x, at=iter(range(len(taken))): x - next(at))]
            text = t if len(taken) == sizes[i] else "\n".join(t[found[g[0]].start() : found[g[-1]].end()] for g in runs)
            want.append((i, text, len(text)))
    assert [tuple(x.values()) for m in made for x in m.to_pylist()] == want
