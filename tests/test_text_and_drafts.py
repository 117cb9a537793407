"""Segmentation, verdicts, repairs, drafts and search rounds against literal expectations."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import english as G
from claimloom.functions import jsonish as J
from claimloom.operators import drafts as D
from claimloom.operators import ingest as I
from claimloom.operators import retrieval as R
from claimloom.operators import search as X


@pytest.mark.parametrize(
    ("text", "sentences"),
    [
        (None, []),
        (" \n", []),
        ("Roots grew fast in the field. Leaves did not.", ["Roots grew fast in the field.", "Leaves did not."]),
        ("We compared it with A. thaliana plants. They differ.", ["We compared it with A. thaliana plants.", "They differ."]),
        ("It was kept there for 30 min. The buffer was changed.", ["It was kept there for 30 min.", "The buffer was changed."]),
        ("It was bought (Sigma, cat. no. 3683) by our group. Then it was used.", ["It was bought (Sigma, cat. no. 3683) by our group.", "Then it was used."]),
        ("These are ovary positions (as seen. 3c,d). These insights help.", ["These are ovary positions (as seen. 3c,d).", "These insights help."]),
        ("Kurz. And then more of it follows here.", ["Kurz. And then more of it follows here."]),
    ],
)
def test_segmentation(text, sentences):
    assert G.sentences_of(text) == sentences


def test_segmentation_loses_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(100).select("text").toPandas()["text"]
    for t in docs:
        assert " ".join(G.sentences_of(t)) == " ".join((t or "").split())


VERDICTS = {
    "12 34": "no_letters",
    "abc d": "too_short",
    "Cell wall growth": "too_short",
    "Scale bars, 200 um in every panel above": "scale_bar",
    "Ad, adaxial side of leaf; ab, abaxial side of leaf": "abbrev_glossary",
    "3a and Supplementary Table of the other genes": "citation_residue",
    "1Institute of Vegetables and Flowers, Beijing, China": "affiliation",
    "Received: 1 October 2024, in its revised form": "front_matter",
    "Anna Miller1, Karl Weber2, Jane Smith1,2, Tom Brown3": "front_matter",
    "Nature Plants volume ten, pages one to twenty": "journal_header",
    "The first two authors contributed equally to it": "equal_contribution",
    "AtKNAT1 label on the map of the third panel": "locus_label",
    "The gene was expressed in young leaves of cucumber.": "",
}


def test_verdicts(spark):
    df = spark.createDataFrame([(t,) for t in [*VERDICTS, None]], "t string").select("t", G.verdict(F.col("t")).alias("v"))
    got = {r.t: r.v for r in df.collect()}
    assert {t: v.reason for t, v in got.items() if t is not None} == VERDICTS
    assert got[None].reason == "no_letters" and got[None].text == ""


def test_verdict_removes_residue(spark):
    text = "3c,d). These insights were confirmed in mutants 865 a b Basal sepal"
    v = spark.createDataFrame([(text,)], "t string").select(G.verdict(F.col("t")).alias("v")).first().v
    assert (v.text, v.keep, v.removed) == ("These insights were confirmed in mutants", True, ["3c,d).", "865 a b Basal sepal"])


def test_sections_and_front_matter(spark):
    cases = {"3.1 Encoder design": "3.1 Encoder design", "6. References": "6 References", "Results": "Results", "Fig. 2 shows": "", "0 DPA": "", "Plain text": "", "x" * 81: ""}
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", G.section_of(F.col("t")).alias("s")).collect()}
    assert got == cases
    glued = "Received: 1 October 2024 Accepted: 3 May 2025 Here we show how ovaries vary"
    out = spark.createDataFrame([(glued,), ("No header here at all. However, the ovary position varies",)], "t string").select(G.peel_front_matter(F.col("t")).alias("s")).collect()
    assert out[0].s == "Here we show how ovaries vary" and out[1].s.startswith("No header")


def test_chunk_repair(spark):
    rows = [("P", 0, "S", 1, "The genes show evo-"), ("P", 1, "S", 1, "lution of form."), ("P", 2, "S", 2, "Organs grow and"), ("P", 3, "S", 2, "are present there. More of this follows here."), ("P", 4, "T", 3, "Next one."), ("Q", 0, "S", 1, None)]
    got = I.repaired_chunks(spark.createDataFrame(rows, "paper_id string, chunk int, section string, page int, text string")).orderBy("paper_id", "chunk").collect()
    assert [r.text for r in got] == ["The genes show evolution of form.", "Organs grow and are present there.", "More of this follows here.", "Next one.", ""]


def test_json_repair(spark):
    raw = '{"a": "x, ] // y，z \\" q", // note\n "b": [1，2,, ], }'
    row = spark.createDataFrame([(raw,), (None,)], "r string").select(J.repair_json(F.col("r")).alias("x")).collect()
    assert json.loads(row[0].x) == {"a": 'x, ] // y，z " q', "b": [1, 2]} and row[1].x == ""


def test_notes_and_objects(spark):
    raw = '{"sample_id": "s1", "human_verified": True: 检索效果差}\n{"sample_id": "s2", "human_verified": false}\n{"sample_id": "s3", "human_verified": true}'
    df = spark.createDataFrame([(raw,)], "raw string")
    got = {r.sample_id: (r.human_verified, r.human_note, r.retrieval_quality) for r in J.verified_notes(df).collect()}
    assert got == {"s1": (True, "检索效果差}"[:-1], "poor"), "s3": (True, None, None)}
    assert json.loads(df.select(J.without_notes(F.col("raw")).alias("x")).first().x.split("\n")[0])["human_verified"] is True
    files = spark.createDataFrame([("f", '{"samples": [{"sample_id": "a", "v": "}"}, {"sample_id": "b"}]} junk {"samples": [{"sample_id": "a", "v": 2}]} {bad}'), ("e", None)], "f string, raw string")
    rows = J.merged_samples(files, "f").orderBy("position").collect()
    assert [(r.sample_id, json.loads(r.sample)) for r in rows] == [("a", {"sample_id": "a", "v": 2}), ("b", {"sample_id": "b"})]


def reply(cid, level="with", **more):
    return {"claim_id": cid, "evidence_level": level, "is_answerable": level == "with", "analysis": {"evidence_judgement": "id=3", "ai_confidence": "high"}} | more


def test_draft_retries_and_flags(spark):
    claims = spark.createDataFrame([(f"C0{i}", "A", f"claim {i}") for i in range(1, 6)], "claim_id string, article string, claim string")
    good = {"has_distortion": False, "primary_level2": "no_distortion", "gold_sentence_ids": [3]}
    bad_until = {"C02": 1, "C03": 99}
    asked = []

    def generate(rows, attempt):
        out = {}
        for r in rows.collect():
            asked.append((attempt, r.claim_id))
            s = reply(r.claim_id, **good) if attempt >= bad_until.get(r.claim_id, 0) else reply(r.claim_id, "odd")
            out.setdefault(r.batch, []).append(s)
        return rows.sparkSession.createDataFrame([(b, json.dumps({"samples": s})) for b, s in out.items()], "batch string, reply string")

    valid, failed = D.draft(claims, "article", generate, size=3, retries=1)
    assert sorted(r.claim_id for r in valid.collect()) == ["C01", "C02", "C04", "C05"]
    assert [(r.claim_id, r.errors) for r in failed.collect()] == [("C03", ["level_unknown"])]
    assert [c for a, c in asked if a == 1] == ["C02", "C03"] and asked[-1] == (3, "C03")
    pool = spark.createDataFrame([("C01", 3, "A plain sentence.", 1), ("C02", 4, "Another one.", 1)], "claim_id string, sentence_id int, text string, rank int")
    table = spark.createDataFrame([(3, "Nature Plants page")], "sentence_id int, text string")
    rows = {r.claim_id: r for r in D.flagged(valid, pool, table).collect()}
    assert rows["C01"].flags == [] and not rows["C01"].needs_review and rows["C01"].top5_is_best and rows["C01"].severity == "none"
    assert rows["C02"].flags == ["outside_pool:3", "dirty:3"] and rows["C02"].needs_review and rows["C02"].evidences[0].text == "Nature Plants page"


def test_missing_and_extra_samples(spark):
    asked = spark.createDataFrame([("C01",), ("C02",)], "claim_id string")
    replies = spark.createDataFrame([("b", json.dumps([reply("C01", "no"), reply("C09")])), ("c", "no JSON"), ("d", None)], "batch string, reply string")
    got = {r.claim_id: r.errors for r in D.validated(asked, replies).collect()}
    assert got == {"C01": [], "C02": ["missing"]}
    assert [r.claim_id for r in D.extra_samples(asked, replies).collect()] == ["C09"]


def test_search_rounds_stop(spark):
    claims = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "claim_id long, query string")
    seen = []

    def search(rows, r):
        ids = sorted(x.claim_id for x in rows.collect())
        seen.append(ids)
        out = [(1, 7, "s1", 0.9), (1, 7, "s2", 0.8), (2, 7, "s1", 0.5), (3, 8, "s3", 0.1)] if r == 1 else [(2, 7, "s1", 0.6), (2, 9, f"t{r}", 0.95 if r > 2 else 0.4), (2, 9, "u", 0.75)]
        return rows.sparkSession.createDataFrame(out, "claim_id long, chunk_id long, sentence_id string, rerank_score double").join(rows.select("claim_id"), "claim_id", "left_semi")

    board, decisions = X.search_rounds(claims, search, max_rounds=5)
    assert seen == [[1, 2, 3], [2], [2]]
    assert {r.claim_id: (r.verdict, r.round_index) for r in decisions.collect()} == {1: ("SUPPORTED", 1), 3: ("NO_EVIDENCE", 1), 2: ("SUPPORTED", 3)}
    kept = board.where("claim_id = 2 AND sentence_id = 's1'").collect()
    assert [(r.rerank_score, r.round_index) for r in kept] == [(0.6, 2)]


def test_term_query_and_reading(spark):
    terms = spark.createDataFrame([(["Root", " root ", "", "leaf", "a", "b", "c", "d", "e"],)], "t array<string>")
    assert terms.select(X.term_query(F.col("t")).alias("x")).first().x == "Root leaf a b c d"
    sentences = spark.createDataFrame([("7:0", 7, 0, "roots grow"), ("7:1", 7, 1, "leaves turn green")], "sentence_id string, chunk_id long, offset int, text string")
    wanted = spark.createDataFrame([(1, 7, "green leaves"), (1, 9, "green leaves")], "claim_id long, chunk_id long, query string")
    board = spark.createDataFrame([], "claim_id long, chunk_id long, sentence_id string, rerank_score double")
    chunks = spark.createDataFrame([(7, "roots grow. leaves turn green")], "chunk_id long, text string")
    got = {r.chunk_id: (r.found, r.best_sentence) for r in X.read_chunks(wanted, chunks, sentences, board).collect()}
    assert got == {7: (True, "7:1"), 9: (False, None)}
    assert R.gate(spark.createDataFrame([(1,)], "claim_id long"), board.select("claim_id", F.col("rerank_score").alias("score"))).select(X.gate_message().alias("m")).first().m.startswith("STOP")


def test_drop_reasons_equal_sql_on_odd_letters(spark, tmp_path):
    import duckdb

    from claimloom.plans.queries import SQL, Q

    odd = [
        "Our\u00e9eux, queai enpation", "Ou\u00e8 \u00e9our\u00e9 r\u00e8ment ou\u00e7", "\u00a0Nbsp at both ends of it\u00a0", "Wa\u017f it a long \u017f or no verb here at all",
        "5 \u00b5m (bar of a scale) without any of them", "Some University of the far north, China\u2028", "\u00a0Received in the month of a far year", "A b c d e f g h i j k l m n o\u00e9 p q r s t x",
        "\u0663\u0664 Department of a far country, USA\u0085", "Ann Lee, Bob Ray, Cy Dow", "Cla97C01\u00e9 stands by the leaf 97 at Homo \u00e9lan", "Ab,\u00a0long word; Cd,\u00a0other word for this one",
    ]
    rows = [(i, t, "en") for i, t in enumerate(odd)] + [(99, None, "en"), (100, "Ein Satz", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("q04_drop_reasons", "q03_sentence_explode"):
        got = sorted(map(tuple, Q[name](spark, str(tmp_path)).collect()))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert got == sorted(con.execute(SQL[name]).fetchall()), name


def test_texts_are_segmented_once(spark):
    from claimloom.operators.ingest import sentences_with_verdicts

    rows = spark.createDataFrame([(1, "We found it here. " * 2), (2, None), (3, " ")], "doc_id long, text string")
    got = sentences_with_verdicts(rows)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = rows.select("doc_id", F.explode(G.segment("text")).alias("t")).select("doc_id", G.verdict(F.col("t")).alias("v")).select("doc_id", "v.text", "v.keep", "v.reason", "v.removed")
    assert sorted(map(repr, got.select("doc_id", F.col("sentence").alias("text"), "keep", "reason", "removed").collect())) == sorted(map(repr, want.collect())) and got.count() == 2
