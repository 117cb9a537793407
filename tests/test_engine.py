"""The evidence engine: literal expectations, properties, and every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from claimloom.functions import labels as L
from claimloom.functions import text as T
from claimloom.operators import claims as C
from claimloom.operators import evaluate as E
from claimloom.operators import ingest as I
from claimloom.operators import retrieval as R
from claimloom.plans.queries import SQL, Q
from claimloom.sources import tables as S
from claimloom.streaming import resume

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return repr(float(v)) if isinstance(v, float) or type(v).__name__ == "Decimal" else repr(v)


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, name):
    df = Q[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    if name not in SQL:
        assert got
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(DATA, t)}.parquet'")
    found = con.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in found.fetchall())


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("scores", "t", "verdict", "stop"), [([0.82, 0.41, 0.05], R.Thresholds(min_hits=1), "SUPPORTED", True), ([0.91, 0.44], R.Thresholds(), "INCONCLUSIVE", False), ([0.21, 0.08], R.Thresholds(), "NO_EVIDENCE", True), ([], R.Thresholds(), "NO_EVIDENCE", True)])
def test_gate(spark, scores, t, verdict, stop):
    claims = spark.createDataFrame([(1,)], "claim_id long")
    rows = spark.createDataFrame([(1, s) for s in scores], "claim_id long, score double")
    r = R.gate(claims, rows, t).first()
    assert (r.verdict, r.should_stop) == (verdict, stop)


def test_gate_round_limit(spark):
    r = R.gate(spark.createDataFrame([(1,)], "claim_id long"), spark.createDataFrame([(1, 0.55)], "claim_id long, score double"), round_index=3, max_rounds=3).first()
    assert (r.verdict, r.reason) == ("INCONCLUSIVE", "round_limit_reached")


@pytest.mark.parametrize("bad", [{"high": 0.3, "low": 0.3}, {"high": 1.1}, {"min_hits": 0}])
def test_thresholds(bad):
    with pytest.raises(ValueError):
        R.Thresholds(**bad)


def test_mmr_prefers_new_words(spark):
    rows = [(1, 1, 0.9, ["a", "b"]), (1, 2, 0.8, ["a", "b"]), (1, 3, 0.7, ["c"])]
    df = spark.createDataFrame(rows, "query_id long, sentence_id long, score double, tokens array<string>")
    picks = lambda lam: [r.sentence_id for r in R.mmr(df, 2, lam).orderBy("pick").collect()]
    assert picks(0.3) == [1, 3] and picks(0) == [1, 2]


def test_claims(spark):
    text = "研究背景\n植物发育受多种基因调控，这是一个重要的问题。\n图1 植物的表型\n总结\n本研究首次揭示了植物发育的调控机制；结果很重要。"
    got = C.article_sentences(spark.createDataFrame([("A", text)], "article_id string, text string")).orderBy("ordinal").collect()
    assert [r.section for r in got] == ["研究背景", "总结"] and "；" in got[1].text
    roles = {"该成果发表了题为《基因调控机制》的论文，刊于某期刊": "publication_meta", "综上所述，": "discourse", "（1）短句": "fragment", "本研究发现基因调控植物的发育过程": None}
    for t, role in roles.items():
        assert one(spark, C.drop_role(F.col("t")), t=t) == role
    rows = [("A", 1, "总结", "甲乙丙丁戊己庚辛"), ("A", 2, "总结", "甲乙丙丁戊己庚辛。"), ("A", 3, "总结", "甲乙丙丁戊己庚辛首次")]
    kept = C.dedup_summaries(spark.createDataFrame(rows, "article_id string, ordinal int, section string, text string")).collect()
    assert sorted(r.ordinal for r in kept) == [1, 3]


def test_labels(spark):
    assert one(spark, L.level1_of(F.col("x")), x="mechanism_substitution") == "substitution"
    assert one(spark, L.has_distortion(F.col("x"), F.col("y")), x="Weak_Evidence", y="context_omission") is None
    assert one(spark, L.level_of(F.col("x")), x="weak") == "Weak_Evidence"


def test_text(spark):
    assert one(spark, T.occurrences(F.col("a"), F.col("b")), a="Aaaa", b="AA") == 2
    assert one(spark, T.occurrences(F.col("a"), F.col("b")), a="abc", b="") == 0
    assert one(spark, T.cited_ids(F.col("a")), a="see id=3/4 and id: 9") == [3, 4, 9]
    assert one(spark, T.json_block(F.col("a")), a='say ```json\n{"k": 1}\n``` end').strip() == '{"k": 1}'
    assert one(spark, T.normal_answer(F.col("a")), a="The  Cat, sat!") == "cat sat"
    assert one(spark, T.paper_id(F.col("a")), a="x_p012_y") == "P012" and one(spark, T.paper_id(F.col("a")), a="other") == "other"
    assert one(spark, T.int_ids(F.col("a")), a=["3", "x", "-1", "3", "2"]) == [3, 2]
    assert one(spark, T.nullish(F.col("a")), a=" None ") is None
    assert one(spark, T.citation(F.col("a"), F.col("y"), F.col("t")), a=["Li", "Wu"], y="2020", t="On leaves") == "Li et al. (2020) On leaves"


def test_metrics(spark):
    m = lambda g, p: one(spark, E.retrieval_metrics(F.col("g"), F.col("p"), 5), g=g, p=p)
    assert tuple(m([], [])) == (1.0, 1.0, 1.0) and tuple(m([], ["1"])) == (0.0, 0.0, 0.0)
    assert tuple(m(["1", "2"], ["1", "9"])) == (1.0, 0.5, 0.5) and tuple(m(["1"], [])) == (0.0, 0.0, 0.0)


def test_reading_order(spark):
    lines = [(1, 1, 0.0, 600.0, 10.0), (2, 1, 0.0, 280.0, 30.0), (3, 1, 320.0, 600.0, 20.0), (4, 1, 0.0, 280.0, 20.0), (5, 1, 0.0, 600.0, 50.0), (6, 1, 320.0, 600.0, 60.0), (7, 1, 0.0, 280.0, 60.0)]
    df = spark.createDataFrame(lines, "line_id int, page int, x0 double, x1 double, y double")
    got = [r.line_id for r in I.reading_order(df, 600.0).orderBy("position").collect()]
    assert got.index(4) < got.index(2) < got.index(3) < got.index(7) < got.index(6)


def test_chunks_and_index(spark):
    rows = [("P1", i, 1, i // 3, i == 4, "Heading" if i == 4 else f"Sentence {i} of the text. More.") for i in range(8)]
    df = spark.createDataFrame(rows, "paper_id string, ordinal int, page int, block int, is_heading boolean, text string")
    chunks = I.chunk_lines(df, target=60)
    got = chunks.orderBy("chunk").collect()
    assert {r.section for r in got} == {"Front Matter", "Heading"} and " ".join(r.text for r in got).count("Sentence") == 7
    index = I.sentence_index(chunks, "paper_id", "chunk", "text")
    prints = I.index_fingerprint(index)
    assert I.stale(index, prints).count() == 0 and I.stale(index, prints.withColumn("fingerprint", F.lit("old"))).count() == 1


def test_sentence_table_round_trip(spark, tmp_path):
    kept = spark.createDataFrame([(0, "1", 'A "quoted", text', "P1"), (1, "1", "Next", "P1")], "sentence_id long, chunk_id string, text string, paper_id string")
    dropped = spark.createDataFrame([("1", "gone", "P1", "too_short")], "chunk_id string, text string, paper_id string, drop_reason string")
    S.write_sentences(kept, dropped, str(tmp_path / "t"))
    a, b = S.read_sentences(spark, str(tmp_path / "t"))
    assert [(r.sentence_id, r.text) for r in a.collect()] == [(0, 'A "quoted", text'), (1, "Next")] and b.first().drop_reason == "too_short"


def test_append_new_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    sink = resume.append_new(str(tmp_path / "out"), "id")
    sink(rows, 0)
    sink(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), 1)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
