"""Each stage of the pipeline against a brute-force version of it, and all of them on awkward rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from claimloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    plain = lambda n: ". ".join(" ".join(r.choice(words) for _ in range(9)).capitalize() for _ in range(n)) + "."
    out = [[i, plain(r.randint(2, 9)), "en", f"s{i % 3}"] for i in range(150)]
    for i in range(0, 150, 6):
        out[i][1] = " ".join(f"{r.choice(words).upper()}!!! $$$%%%" for _ in range(40))
    for i in range(40, 60):
        out[i][1] = out[3][1] + " " + words[i]
    for i in range(61, 80):
        out[i][1] += "\nShared Line Of Text\n" + words[i]
    out[81][1], out[83][1], out[85][1], out[87][3] = None, "", " \n ", None
    out[89][1] = plain(20_000)
    out += [list(out[7]), list(out[7]), [None, plain(3), "en", None]]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def test_quality_stage(spark, docs, rows):
    """EM written out row by row, the scorer by plain gradient steps of the same rule."""
    votes = [tuple(quality.describe(*[(d, o) for _, d, o in quality.text_chunks(pa.array([t], pa.string()))][0])[0][0].tolist()) for _, t, *_ in rows]
    post = [0.9 if 1 in v else 0.05 for v in votes]
    for _ in range(100):
        bad = (sum(post) + 0.5) / (len(votes) + 1)
        rate = {}
        for c in (0, 1):
            w = [p if c else 1 - p for p in post]
            for j in range(len(votes[0])):
                for x in (-1, 0, 1):
                    rate[c, j, x] = (sum(a for a, v in zip(w, votes, strict=True) if v[j] == x) + 0.5) / (sum(w) + 1.5)
        new = []
        for v in votes:
            ll = [sum(math.log(rate[c, j, x]) for j, x in enumerate(v)) + math.log(bad if c else 1 - bad) for c in (0, 1)]
            new.append(1 / (1 + math.exp(max(-50, min(50, ll[0] - ll[1])))))
        if max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9:
            break
        post = new
    model = quality.fit(docs)
    got = {(r.doc_id, r.pattern): r.posterior for r in quality.score(docs, model).collect()}
    want = {(i, int(quality.pattern(np.array([v]))[0])): p for (i, *_), v, p in zip(rows, votes, post, strict=True)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    kept = texts(STAGES["quality"](spark, docs, ""))
    junk = {i for i, t, *_ in rows if t and "!!!" in t}
    assert kept == sorted(((i, t, s) for i, t, _, s, _ in rows if i not in junk), key=str)


def test_line_stage(spark, docs, rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    held = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).update({i} - {None})
    cut = lambda t: "\n".join(x for x in (t or "").split("\n") if not (key(x) and len(held[key(x)]) >= 10))
    out = STAGES["line_dedup"](spark, docs, "")
    assert out.columns == docs.columns
    assert texts(out) == sorted(((i, cut(t), s) for i, t, _, s, _ in rows), key=str)
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_group_stage(spark, docs, rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    got = texts(STAGES["ngram_jaccard"](spark, docs, ""))
    of = {}
    for n, (i, t, _, s, _) in enumerate(rows):
        of.setdefault(str((i, t, s)), find(n))
    assert len(got) == len({find(n) for n in range(len(rows))})
    assert len({of[str(x)] for x in got}) == len(got)  # one of each group
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    low = {}
    for n, (i, *_) in enumerate(rows):
        if i is not None:
            low[find(n)] = min(i, low.get(find(n), i))
    assert {x[0] for x in texts(STAGES["ngram_jaccard"](spark, unique, ""))} == set(low.values())


def test_mix_stage(spark, docs, rows):
    out = texts(STAGES["mix"](spark, docs, ""))
    words, own = {}, {}
    for i, t, _, s, _ in rows:
        words[s] = words.get(s, 0) + len((t or "").split())
        own.setdefault((i, s), []).append((t or "").split())
    taken = {}
    for i, t, s in out:
        w, at = t.split(), 0
        taken[s] = taken.get(s, 0) + len(w)
        full = next(x for x in own[i, s] if set(w) <= set(x))
        for x in w:  # a pass takes words of the document in their order
            at = full.index(x, at) + 1
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 2.0 * sum(words.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * words[s], mid * weight[s]) for s in order) < 1.5 * sum(words.values()) else (low, mid)
    for s in order:
        assert abs(taken.get(s, 0) - min(2 * words[s], high * weight[s])) <= 70


def test_pack_stage(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = STAGES["pack"](spark, docs, "").collect()
    want = []
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        starts = [(0, first)] * bool(first) + [(a, 2048) for a in range(first, len(ids), 2048)]
        want += [(i, p, a, n, zlib.crc32(ids[a : a + n].tobytes())) for p, (a, n) in enumerate(starts)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    place = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert place.get(r.sequence_id, 0) == r.offset
        place[r.sequence_id] = r.offset + r.length
    assert max(place.values()) <= 2048 and len(place) <= -(-sum(place.values()) // 2048) + 1


def test_stages_on_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
