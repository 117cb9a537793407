"""The claim path, terms, model adapters, agent loop, reports and sources against literal expectations."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import labels as L
from claimloom.operators import adapters as M
from claimloom.operators import agent as A
from claimloom.operators import claims as C
from claimloom.operators import evaluate as E
from claimloom.operators import ingest as I
from claimloom.operators import report as P
from claimloom.operators import terms as TM
from claimloom.sources import tables as S

ARTICLE = """# 标题
来源：公众号
---
**发布日期**：2025
[A12] 存档

研究背景
在开花植物中，子房相对于其他花器官的位置是重要分类学特征之一。
图1 黄瓜单性花与子房下位的进化、
和发育的比较
研究结果
说明黄瓜子房下位形成的必要条件为：
（1）花分生组织膨大，改变花器官轮相对位置；
（2）花托迅速生长；
（3）花托和心皮融合。
（4）另一件事在此之后发生。
3. 小标题不算
敲除![图](a.png)基因[改变](http://x)了**表型**的形成！对吗？
"""


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_article_to_candidates(spark):
    got = [(r.section, r.text) for r in C.article_candidates(frame(spark, [("a", ARTICLE)], "article_id string, text string")).orderBy("cand_id").collect()]
    assert got == [
        ("研究背景", "在开花植物中，子房相对于其他花器官的位置是重要分类学特征之一。"),
        ("研究结果", "说明黄瓜子房下位形成的必要条件为：；（1）花分生组织膨大，改变花器官轮相对位置；（2）花托迅速生长；（3）花托和心皮融合。；（4）另一件事在此之后发生。"),
        ("研究结果", "敲除基因改变了表型的形成！"),
    ]


def test_candidates_keep_the_type_of_ids(spark):
    rows = frame(spark, [(2**53 + 1, ARTICLE), (7, ARTICLE), (None, ARTICLE), (8, None)], "article_id long, text string")
    got = C.article_candidates(rows)
    assert got.schema["article_id"].dataType.simpleString() == "bigint"
    one = [(r.cand_id, r.section, r.text) for r in C.article_candidates(frame(spark, [("a", ARTICLE)], "article_id string, text string")).orderBy("cand_id").collect()]
    held = {}
    for r in got.orderBy("cand_id").collect():
        held.setdefault(r.article_id, []).append((r.cand_id, r.section, r.text))
    assert held == {2**53 + 1: one, 7: one, None: one}


ROLES = {
    "某某团队联合某某院在Nature Plants期刊上发表了题为“Developmental innovation 发现”的研究论文。": ("publication_meta", False),
    "某某团队在Nature Plants期刊上发表论文，首次揭示了黄瓜下位子房的发育机制。": ("paper_lead", True),
    "在某某Plant上一起发表。": ("publication_meta", False),
    "（2）花托迅速生长": ("fragment", False),
    "综上所述": ("discourse", False),
    "如图所示。": ("discourse", False),
    "值得注意的是，它更大": ("fragment", False),
    "综上所述，某某基因在花托生长中起关键性作用。": ("paper_lead", True),
    "构建了两种突变植株": ("paper_method", False),
    "植物的性状多种多样而且一直在改变，这里还有更多的文字说明": ("paper_result", True),
}


def test_roles_and_decisions(spark):
    rows = frame(spark, [(i, t, "") for i, t in enumerate(ROLES)], "cand_id int, text string, section string")
    got = rows.select("text", C.role_guess(F.col("text"), F.col("section")).alias("role"), C.default_keep(F.col("text"), F.col("section")).alias("keep")).collect()
    assert {r.text: (r.role, r.keep) for r in got} == ROLES
    told = frame(spark, [(3, "paper_lead", "false"), (1, "textbook_bg", "true"), (5, "", "no"), (8, "odd", "yes"), (4, None, None)], "cand_id int, role string, keep string")
    out = {r.cand_id: (r.keep, r.role) for r in C.decided(rows, told, ["cand_id"]).collect()}
    assert (out[3], out[1], out[5], out[8], out[4], out[7]) == ((True, "paper_lead"), (False, "textbook_bg"), (False, "fragment"), (True, "paper_method"), (False, "discourse"), (True, "paper_lead"))


def test_summaries_compare_with_the_nearest_row(spark):
    base = "敲除基因后花托生长受阻，导致下位子房转变为类似番茄的上位子房"
    rows = [("a", 1, "研究结果", base + "。"), ("a", 2, "研究结果", "首次为作物育种提供了新的依据和方法论。"), ("a", 3, "总结", base + "！"), ("a", 4, "总结", base + "，为作物育种提供了新靶点。")]
    got = C.dedup_summaries(frame(spark, rows, "article_id string, ordinal int, section string, text string")).collect()
    assert sorted(r.ordinal for r in got) == [1, 2, 4]


def test_terms(spark):
    texts = frame(spark, [(1, "黄瓜 KNAT2 与 knat2 和 FIM Gene"), (2, "缓存 的文本"), (3, None), (4, "模型答的")], "id int, text string")
    cache = texts.where("id = 2").select(TM.T.term_key(F.col("text")).alias("doc_key"), F.expr("array(named_struct('zh', '词', 'en', 'word', 'aliases', array('Word', 'term')))").alias("terms"))
    model = lambda asked: asked.where("text = '模型答的'").select("doc_key", F.expr("array(named_struct('zh', ' 答 ', 'en', ' answer ', 'aliases', array('', 'reply')), named_struct('zh', 'x', 'en', '', 'aliases', array('')))").alias("terms"))
    out = TM.extract(texts, cache, model)
    got = {r.id: (r.hit, list(r.words)) for r in out.select("id", "hit", TM.flat_terms(F.col("terms")).alias("words")).collect()}
    assert got == {1: (False, ["KNAT2", "FIM Gene"]), 2: (True, ["word", "term"]), 3: (False, []), 4: (False, ["answer", "reply"])}
    assert TM.cache_stats(out).first().asDict() == {"cache_hits": 1, "cache_misses": 3}
    words = TM.learned(out)
    wanted = frame(spark, [(1, 1, "词"), (1, 2, " 新 "), (1, 3, "无"), (1, 4, " ")], "request int, position int, zh string")
    new = lambda asked: asked.where("zh = '新'").select("zh", F.lit("new").alias("en"), F.array().cast("array<string>").alias("aliases"))
    assert [(r.zh, r.en, r.hit) for r in TM.translate(wanted, words, new).collect()] == [("词", "word", True), ("新", "new", False)]
    assert "词 => word" in TM.glossary_hint(words).first().hint


def test_adapters(spark):
    calls = []

    def embed(texts):
        calls.append(len(texts))
        return M.hashed_embedding(8)(texts)

    rows = frame(spark, [(i, "word " * (i % 3)) for i in range(70)], "id int, t string").coalesce(1)
    got = rows.select("id", M.embedded(embed)(F.col("t")).alias("v")).collect()
    assert len(got) == 70 and got[0].v == got[3].v != got[1].v
    with pytest.raises(Exception, match="vectors for"):
        rows.select(M.embedded(lambda x: [[1.0]])(F.col("t"))).collect()
    hits = frame(spark, [("a b", "a b c"), ("a b", "x"), (None, "a")], "query string, text string")
    assert {(r.query, r.text): r.rerank_score for r in M.reranked(hits, M.token_overlap).collect()} == {("a b", "a b c"): 1.0, ("a b", "x"): 0.0, (None, "a"): 0.0}

    def chat(p):
        if p == "fail":
            raise TimeoutError("slow")
        return p

    reply = json.dumps({"evidence_level": "with", "primary_label": "mechanism_omission", "severity": "mild"})
    out = M.classified(frame(spark, [(1, reply), (2, "fail"), (3, "no json")], "id int, p string"), chat, F.col("p"))
    got = {r.id: (r.classification.evidence_level, r.classification.primary, r.classification.needs_review, r.error) for r in out.collect()}
    assert got[1] == ("With_Evidence", "mechanism_omission", False, None)
    assert got[2] == ("Weak_Evidence", None, True, "TimeoutError: slow") and got[3][:3] == ("Weak_Evidence", None, True)
    cands = frame(spark, [(1, "该研究首次揭示了黄瓜下位子房的发育机制。", ""), (2, "综上所述", "")], "cand_id int, text string, section string")

    def broken(some):
        raise ConnectionError

    assert {r.cand_id: (r.keep, r.role) for r in M.verified_roles(cands, broken, ["cand_id"]).collect()} == {1: (True, "paper_lead"), 2: (False, "discourse")}
    assert {r.cand_id: r.role for r in M.verified_roles(cands, lambda some: [{"cand_id": 1, "role": "paper_intro"}], ["cand_id"]).collect()} == {1: "paper_intro", 2: "discourse"}
    qa = M.judged(frame(spark, [("yes", "yes"), ("", "yes"), ("no", "yes")], "answer string, gold string"), lambda a, g: a == g)
    assert sorted(r.judged for r in qa.collect()) == [0.0, 0.0, 1.0]
    cache = frame(spark, [("one text", "一")], "key string, zh string")
    done, fresh = M.translated(frame(spark, [(1, "one  text"), (2, "two"), (3, "two "), (4, "bad"), (5, None)], "id int, t string"), "t", cache, lambda t: "二" if t == "two" else "none")
    assert {r.id: r.t_zh for r in done.collect()} == {1: "一", 2: "二", 3: "二", 4: None, 5: None} and [(r.key, r.zh) for r in fresh.collect()] == [("two", "二")]


def test_agent_loop_and_answers(spark):
    tools = A.Tools(A.Tool("read", "reads", {"type": "object"}, lambda n: (f"text {n}", {"retrieved_tokens": 5})), A.Tool("fails", "", {}, lambda: 1 / 0))
    steps = iter([[{"name": "read", "arguments": '{"n": 1}'}, {"name": "fails", "arguments": {}}], [{"name": "none", "arguments": "{"}], []])
    out = A.run_agent(lambda m, s: {"tool_calls": next(steps), "content": "VERDICT: SUPPORTED", "tokens": 10}, tools, "q")
    assert (out["loops"], out["forced"], out["context"].tokens) == (3, False, 5)
    assert [t["result"][:5] for t in out["trajectory"]] == ["text ", "Error", "Error"]
    seen = []
    forced = A.run_agent(lambda m, s: seen.append(len(s)) or {"tool_calls": [{"name": "read", "arguments": {"n": 2}}], "tokens": 70_000}, tools, "q")
    assert forced["forced"] and seen == [2, 2, 0] and tools.names() == ["read", "fails"] and tools.schemas()[0]["function"]["name"] == "read"
    context = A.Context()
    assert context.fresh(["a", "b", "a"]) == ["a", "b"] and context.fresh(["b", "c"]) == ["c"] and context.summary()["chunks_read"] == 3
    text = "intro\nVerdict: SUPPORTED\nEVIDENCE_CHUNKS: 3， 4,\nREASON: it\n goes on\n"
    rows = frame(spark, [(1, text), (2, None), (3, "EVIDENCE_CHUNKS: none")], "i int, t string").select("i", A.final_answer(F.col("t")).alias("a"))
    got = {r.i: r.a.asDict() for r in rows.collect()}
    assert got[1] == {"verdict": "SUPPORTED", "evidence_chunks": ["3", "4"], "papers": "", "reason": "it goes on"}
    assert got[2]["evidence_chunks"] == got[3]["evidence_chunks"] == []


def test_reports(spark):
    rows = [("a", 1, "one", "With_Evidence", True, "mechanism_omission", ["e1", "e2"]), ("a", 2, "two", "No_Evidence", None, None, None), ("a", 10, "ten", "With_Evidence", False, "no_distortion", [])]
    text = P.chain_report(frame(spark, rows, "article string, n int, claim string, evidence_level string, has_distortion boolean, primary string, evidences array<string>"), "article", "n").first().markdown
    assert "claims: 3" in text and "unverifiable: 1" in text and text.index("## 2\ntwo") < text.index("## 10\nten") and "  - e2" in text
    t = "abcde fghij klmno"
    wrapped = frame(spark, [(t,)], "t string").select(P.wrap(F.col("t"), 5).alias("w"), P.unwrap(P.wrap(F.col("t"), 5)).alias("u")).first()
    assert wrapped.u == t and all(not x.startswith(" ") for x in wrapped.w.split("\n"))
    samples = frame(spark, [("s1", '{"a": 1,}', "true"), ("s2", '{"a": 1}', "maybe"), ("", "{", None)], "sample_id string, raw string, human_verified string")
    assert {(r.sample_id, r.problem) for r in P.lint(samples).collect()} >= {("s1", "trailing_comma"), ("s2", "human_verified"), ("", "no_id"), ("", "unreadable")}
    draft, said = frame(spark, [("1", "x", "y"), ("2", "x", "y")], "sample_id string, a string, b string"), frame(spark, [("1", "new", None), ("9", "z", "z")], "sample_id string, a string, b string")
    assert sorted(tuple(r) for r in P.readable_into_draft(draft, said).collect()) == [("1", "new", "y"), ("2", "x", "y")]
    assert frame(spark, [(1,)], "i int").select(P.evidence_text(F.lit(" "), F.lit(None).cast("string"), F.lit("s "), F.lit("t")).alias("x")).first().x == "s"


def test_read_view_and_cost(spark):
    none = F.lit(None).cast("string")
    view = lambda lev, prim, dist, acc: L.read_view(F.lit(lev), none, F.lit(prim), F.lit("b"), F.array(F.lit("b"), F.lit("c")), F.lit(dist).cast("boolean"), F.lit(acc).cast("boolean"))
    r = frame(spark, [(1,)], "i int").select(view("With_Evidence", "causality_distortion", None, None).alias("a"), view("Weak_Evidence", "accurate", None, True).alias("b"), view("With_Evidence", None, None, False).alias("c"), L.is_legacy(F.lit("accurate")).alias("d")).first()
    assert (r.a.has_distortion, r.a.is_accurate, r.a.primary, r.a.secondary) == (True, False, "causality_distortion", ["b", "c"])
    assert (r.b.has_distortion, r.b.is_accurate, r.c.has_distortion, r.c.is_accurate, r.d) == (None, True, True, False, True)
    cost = frame(spark, [(1000, 400, 100)], "p int, c int, o int").select(E.discounted_cost(F.col("p"), F.col("c"), F.col("o"), F.lit(2.0), F.lit(1.0), F.lit(4.0)).alias("x")).first().x
    assert cost == 0.002


def test_ingest_helpers(spark):
    with pytest.raises(ValueError, match="one paper"):
        I.one_paper(frame(spark, [("a",), ("b",)], "paper_id string"))
    assert I.one_paper(frame(spark, [("a",), ("a",)], "paper_id string")) == "a"


def test_sources(spark, tmp_path):
    for name, data in (("list", [{"id": "1", "n": 2}]), ("items", {"items": [{"id": "2", "n": 3}], "samples": []}), ("none", {"other": []})):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    read = lambda n: [(r.id, r.n) for r in S.read_predictions(spark, str(tmp_path / f"{n}.json"), "id: string, n: int").collect()]
    assert read("list") == [("1", 2)] and read("items") == [("2", 3)]
    with pytest.raises(Exception, match="no list of predictions"):
        read("none")
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": "a"}, {"qid": "2", "question": "b"}]))
    assert [r.qid for r in S.read_questions(spark, str(tmp_path / "q.json")).collect()] == ["1", "2"] and S.read_questions(spark, str(tmp_path / "q.json"), 1).count() == 1
    S.replace_json(str(tmp_path / "c.json"), {"gate": {"high": 0.7}})
    config = S.read_config(str(tmp_path / "c.json"), {"CLAIMLOOM_GATE__LOW": "0.2", "OTHER": "x"})
    assert (S.get(config, "gate.high"), S.get(config, "gate.low"), S.get(config, "gate.none", 5)) == (0.7, "0.2", 5)
    assert S.claims_source(claims="f", article="a") == ("claims", "f")
    with pytest.raises(ValueError):
        S.claims_source()
    assert S.batch_names(["P_C11_C20.json", "P_C1_C10.json", "P_C1_C10_translated.json", "Q_C1_C2.json", "P_C1_Cx.json"], "P") == ["C1_C10", "C11_C20", "C1_Cx"]
    S.write_pairs(frame(spark, [("1", "a"), ("2", " "), ("3", None)], "claim_id string, claim_zh string"), str(tmp_path / "pairs"))
    assert spark.read.json(str(tmp_path / "pairs")).count() == 1
