"""Queries that do the whole job, against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import packing, suffix_dedup
from claimloom.operators import retrieval as R
from claimloom.operators import claims as C
from claimloom.plans.queries import Q


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def tokens(t):
    return {x for x in re.findall(r"[a-z0-9]+|[一-鿿]+", (t or "").lower()) if len(x) > 1}


def greedy(items, k, lam=0.3):
    """items: (score, id, tokens) by falling score and id."""
    if len(items) <= k:
        return [x[1] for x in items]
    near = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    left, out = list(items), []
    while left and len(out) < k:
        value = [x[0] if not out else (1 - lam) * x[0] - lam * max(near(x[2], y[2]) for y in out) for x in left]
        out.append(left.pop(value.index(max(value))))
    return [x[1] for x in out]


def test_mmr_query_reads_whole_texts(spark, tmp_path):
    """Documents that differ or agree only after character 200, and more candidates than 20."""
    rows = []
    for i in range(40):
        head = " ".join(f"h{i}w{j}" for j in range(60)) if i % 2 else "same opening words " * 15
        rows.append((i, f"{head} " + " ".join(f"t{i % 3}x{j}" for j in range(200)) + " nation" * (60 - i // 2), "en", f"s{i // 30}", 0))
    folder = write(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {}
    for r in Q["q14_mmr"](spark, folder).orderBy("query_id", "pick").collect():
        got.setdefault(r.query_id, []).append(r.sentence_id)
    want = {}
    for source in ("s0", "s1"):
        items = sorted((-round(t.lower().count("tion") / (len(t) + 1), 6), i, tokens(t)) for i, t, _, s, _ in rows if s == source)[:25]
        want[source] = greedy([(-v, i, k) for v, i, k in items], 5)
    assert got == want


def test_rules_see_whole_texts(spark, tmp_path):
    texts = ["本研究发现基因调控植物的发育过程，并阐明其机制与表型变化的关系。", "短句", "plain words that go on for more than forty characters in all"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", C.drop_role(F.col("t")).alias("role"), C.default_keep(F.col("t"), F.lit("")).alias("keep"))
    assert [(r.role, r.keep) for r in rows.orderBy("i").collect()] == [(None, True), (None, False), (None, True)]
    # Whole turns stand behind the heads: a cue at a turn's very end counts.
    long = "plain words " * 400 + "基因"
    folder = write(spark, tmp_path, "conversations", [(0, 14, "user", long), (0, 2, "user", long)], "conv_id long, turn long, role string, text string")
    assert {r.turn: r.role for r in Q["q18_rule_roles"](spark, folder).collect()} == {14: None, 2: "publication_meta"}


@pytest.mark.parametrize("most", [1, 4, 7, 4096])
def test_dense_topk_deals_blocks(spark, most):
    """More queries than a block holds, ties and a zero vector."""
    r = np.random.default_rng(5)
    v = r.integers(-2, 3, (60, 4)).astype(float)
    v[7] = 0
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>").repartition(3)
    queries = vectors.where("vec_id % 4 = 0").selectExpr("vec_id AS query_id", "v AS q")
    unit = v / np.where((n := np.linalg.norm(v, axis=1)) > 0, n, 1)[:, None]
    want = {}
    for q in range(0, 60, 4):
        score = np.round(unit @ unit[q], 6) + 0.0
        want[q] = [(i, score[i]) for i in sorted(range(60), key=lambda i: (-score[i], i))[:5]]
    got = {}
    for x in R.dense_topk(queries, vectors, 5, most_queries=most).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert got == want


def test_neighbours_of_every_document(spark, tmp_path):
    text = "first one here. a nation and a station. last one here. far away"
    rows = [(i, text, "en", "s", len(text)) for i in (3, 10, 17)]
    folder = write(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.chunk_id, r.offset, r.score) for r in Q["q07_neighbour_expand"](spark, folder).collect()}
    assert got == {(i, o, v) for i in (3, 10, 17) for o, v in ((0, 0.1), (1, 0.2), (2, 0.1))}


class Brute:
    """The searches of q47 and q51 over a few documents, in plain loops."""

    def __init__(self, docs):
        self.s = {(i, o): x for i, t in docs for o, x in enumerate(y for y in (z.strip() for z in re.split(r"[.!?\n]+", t)) if y)}
        self.tok = {k: tokens(x) for k, x in self.s.items()}
        self.name = {k: f"{k[0]}:{k[1]}" for k in self.s}

    def rarity(self, w):
        return math.log1p(len(self.s) / max(1, sum(w in t for t in self.tok.values())))

    def first(self, scores, limit):
        return dict(sorted(scores.items(), key=lambda x: (-x[1], self.name[x[0]]))[:limit])

    def recall(self, query, limit):
        q = tokens(query)
        total = sum(map(self.rarity, q))
        return self.first({k: round(sum(map(self.rarity, q & t)) / total, 6) for k, t in self.tok.items() if q & t}, limit)

    def search(self, query, recalled, k):
        q = tokens(query)
        scores = self.first({i: round(len(q & self.tok[i]) / len(q | self.tok[i]), 6) for i in recalled}, 10**9)
        kept = {i: v for n, (i, v) in enumerate(scores.items()) if v >= 0.08 or n == 0}
        near = dict(kept)
        for (c, o), v in kept.items():
            for d in (-1, 0, 1):
                x = round(v * 0.5 ** abs(d), 6)
                if x >= 0.08 and (c, o + d) in self.s:
                    near[c, o + d] = max(near.get((c, o + d), 0), x)
        items = self.first(near, 10**9)
        return {i: items[i] for i in greedy([(v, i, self.tok[i]) for i, v in items.items()], k)}


def gate(scores):
    if not scores:
        return "NO_EVIDENCE"
    return "SUPPORTED" if sum(x >= 0.7 for x in scores) >= 2 else "NO_EVIDENCE" if max(scores) < 0.3 else "INCONCLUSIVE"


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    """Short words only in some claims, claims of up to 30 words, and a hot word in all sentences."""
    folder, r = tmp_path_factory.mktemp("searched"), random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.choice([2, 3, 4, 5, 8, 11]))) for _ in range(90)]
    docs = [(i, ". ".join("the " + " ".join(r.sample(words, r.randint(4, 14))) for _ in range(12))) for i in range(30)]
    short = [w for w in words if len(w) < 5]
    sentences = [x for _, t in docs for x in t.split(". ")]
    claims = [(i, " ".join(r.sample(short if i % 4 == 0 else words, r.randint(5, 16)))) for i in range(12)]
    claims += [(i, " ".join(sentences[7 * i].split()[: 7 + i % 3]) + " " + " ".join(r.sample(words, i % 6))) for i in range(12, 24)]
    claims += [(24, "zz yy"), (25, "the"), (26, " ".join(r.sample(words, 80)))]
    write(spark, folder, "documents", [(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    return write(spark, folder, "benchmark", claims, "item_id long, text string"), Brute(docs), claims


def test_semantic_query_finds_by_short_words(spark, searched):
    folder, brute, claims = searched
    got = {r.claim_id: (r.candidate_count, r.top_score, r.verdict) for r in Q["q47_semantic_e2e"](spark, folder).collect()}
    want = {}
    for i, text in claims:
        scores = list(brute.search(text, brute.recall(text, 50), 5).values())
        want[i] = (len(scores), max(scores, default=0.0), gate(scores))
    assert got == want and want[0][0] == 5


def test_search_rounds_query(spark, searched):
    folder, brute, claims = searched
    got = {r.claim_id: (r.verdict, r.candidate_count, r.evidence_ids) for r in Q["q51_search_rounds"](spark, folder).collect()}
    want, most = {}, 0
    for i, text in claims:
        order = sorted(dict.fromkeys(x for x in re.findall("[a-z0-9]+", text) if len(x) > 1), key=lambda x: -len(x))
        board = {}
        for r in range(12):
            both = brute.recall(text, 25)
            for k, v in brute.first(brute.recall(" ".join(order[6 * r : 6 * r + 6]), 25), 20).items():
                both[k] = max(both.get(k, 0), v)
            for k, v in brute.search(text, brute.first(both, 25), 5).items():
                board[k] = max(board.get(k, 0), v)
            most = max(most, r + 1)
            if gate(board.values()) != "INCONCLUSIVE":
                break
        ids = [brute.name[k] for k, v in brute.first(board, 10**9).items() if v >= 0.08][:12]
        want[i] = (gate(board.values()), len(board), ids)
    assert got == want and most == 12


def test_containments_of_all_pairs(spark, tmp_path):
    items = [(0, "alpha beta gamma delta epsilon"), (1, "short one"), (2, "The alpha, beta gamma delta epsilon"), (3, "?!")]
    docs = [(1, "xalpha beta gamma delta epsilons", "fr"), (2, "it is a short one here", "en"), (3, "alpha beta gamma", "de"), (4, None, "en"), (5, "alpha beta gamma delta epsilon, short ones", "es")]
    write(spark, tmp_path, "benchmark", items, "item_id long, text string")
    folder = write(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string")
    assert {r.doc_id: r["items"] for r in Q["q43_contain_match"](spark, folder).collect()} == {1: [0, 2], 2: [1], 3: [], 4: [], 5: [0, 1, 2]}
    got = {(r.a, r.b): r.overlap for r in Q["q13_ngram_containment"](spark, folder).collect()}
    assert len(got) == 6 and got[0, 2] == 1.0 and got[1, 3] == 0.0


def test_suffix_dedup_keeps_rows_without_id(spark):
    r = random.Random(2)
    a, b, c = ("".join(r.choice("abcdefghijklmnop ") for _ in range(200)) for _ in range(3))
    rows = [(None, a), (1, a), (None, b), (None, b), (None, c + a[20:120]), (2, None), (None, "x")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = suffix_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = [(1, 200, 0, 0, sha(a)), (2, 0, 0, 0, sha("")), (None, 200, 200, 1, sha("")), (None, 200, 0, 0, sha(b)), (None, 200, 200, 1, sha("")), (None, 300, 100, 1, sha(c)), (None, 1, 0, 0, sha("x"))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    lone = suffix_dedup.substring_dedup(spark.createDataFrame([(None, a), (None, a)], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_removed) for x in lone) == [(None, 0), (None, 200)]


@pytest.mark.parametrize("run", [" ", "\n"])
def test_packing_takes_long_white_space(spark, run):
    import public_tokenizers
    from tokenizers import Tokenizer

    text = "a b<|endoftext|>" + run * 1_000_000 + "c é"
    df = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    got = packing.pieces(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).where("doc_id = 1").orderBy("piece").collect()
    ids = np.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text).ids, packing.END).astype("<u4")
    assert [(r.start, r.length) for r in got] == packing.cut(len(ids), 2048)
    assert [r.ids_crc32 for r in got] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in got]
