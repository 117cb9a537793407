"""Queries of the claim path, evaluation, terms, ingest and reports, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels as L
from ..functions import text as T
from ..operators import agent as A
from ..operators import claims as C
from ..operators import evaluate as E
from ..operators import ingest as I
from ..operators import report as P
from ..operators import terms as M
from ..sources.tables import table
from .queries import _GUESS, _KEEP, _ROLE, _ZH, headed, query


@query("q57_role_guess", f"WITH {_ZH} SELECT conv_id, turn, section, {_GUESS} AS role FROM z")
def q57(spark: SparkSession, d: str) -> DataFrame:
    return headed(spark, d).select("conv_id", "turn", "section", C.role_guess(F.col("x"), F.col("section")).alias("role"))


@query("q58_claim_like", f"""WITH {_ZH} SELECT conv_id, turn, length(trim(x)) >= 8 AND regexp_matches(x, '[一-鿿]') AND NOT regexp_matches(x, '^\\s*[（(]?[图表]\\s*\\d')
 AND NOT regexp_matches(x, '^\\s*\\d+\\s*[.、]') AND NOT regexp_matches(x, '^\\s*公众号\\s*[:：]') AND NOT regexp_matches(x, '^\\s*(参考文献|来源|编辑|排版|责编|图片来源)\\s*[:：]?\\s*$') AS claim FROM z""")
def q58(spark: SparkSession, d: str) -> DataFrame:
    return headed(spark, d).select("conv_id", "turn", C.claim_like(F.col("x")).alias("claim"))


_SAID = """CASE turn % 7 WHEN 0 THEN 'paper_lead' WHEN 1 THEN 'textbook_bg' WHEN 2 THEN 'unheard_of' WHEN 3 THEN '' WHEN 4 THEN ' ' ELSE NULL END"""
_FLAG = """CASE conv_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'No' WHEN 2 THEN 'maybe' ELSE NULL END"""


@query("q59_decision_merge", f"""
WITH {_ZH}, s AS (SELECT *, trim(coalesce({_SAID}, '')) AS r, lower({_FLAG}) AS f, {_GUESS} AS guess, {_KEEP} AS dk FROM z),
t AS (SELECT *, CASE WHEN r = 'paper_lead' THEN true WHEN r = 'textbook_bg' THEN false WHEN f IN ('true', 'yes', '1') THEN true WHEN f IN ('false', 'no', '0') THEN false END AS told FROM s)
SELECT conv_id, turn, coalesce(told, dk) AS keep, CASE WHEN told IS NULL THEN CASE WHEN r = '' THEN guess ELSE r END WHEN r = '' THEN CASE WHEN told THEN guess ELSE 'fragment' END
 WHEN r = 'unheard_of' AND told THEN guess ELSE r END AS role FROM t""")
def q59(spark: SparkSession, d: str) -> DataFrame:
    rows = headed(spark, d).withColumnRenamed("x", "text")
    said = F.when(F.col("turn") % 7 == 0, "paper_lead").when(F.col("turn") % 7 == 1, "textbook_bg").when(F.col("turn") % 7 == 2, "unheard_of").when(F.col("turn") % 7 == 3, "").when(F.col("turn") % 7 == 4, " ")
    flag = F.when(F.col("conv_id") % 5 == 0, "true").when(F.col("conv_id") % 5 == 1, "No").when(F.col("conv_id") % 5 == 2, "maybe")
    told = rows.select("conv_id", "turn", said.alias("role"), flag.alias("keep"))
    return C.decided(rows, told, ["conv_id", "turn"]).select("conv_id", "turn", "keep", "role")


# An article for each conversation: section lines, captions that wrap, lists over several lines, plain turns.
_LINES = """CASE turn % 6 WHEN 0 THEN '研究结果' WHEN 1 THEN '图' || turn || ' 各部分的比较' WHEN 2 THEN '续行的图注文字' WHEN 3 THEN '说明形成的必要条件为：' || replace(text, chr(10), ' ')
 WHEN 4 THEN '（2）花托和心皮融合；' WHEN 5 THEN '（3）' || replace(text, chr(10), ' ') || '。' END"""


@query("q60_article_sentences", f"""
WITH l AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace({_LINES}, '\\r', ' ', 'g'), '[ \\t]+', ' ', 'g')) AS line FROM conversations),
n AS (SELECT *, coalesce(lag(regexp_matches(line, '^[（(]?[图表]\\s*\\d') AND NOT regexp_matches(line, '[。！？!?]$')) OVER w, false) AS after_caption,
 coalesce(last_value(CASE WHEN line = '研究结果' THEN line END IGNORE NULLS) OVER w, '') AS section FROM l WHERE line <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT * FROM n WHERE line <> '研究结果' AND NOT regexp_matches(line, '^[（(]?[图表]\\s*\\d') AND NOT regexp_matches(line, '^\\d{{1,2}}$')
 AND NOT (after_caption AND NOT regexp_matches(line, '[。！？!?]$') AND length(regexp_replace(line, '\\s+', '', 'g')) <= 40)),
p AS (SELECT conv_id, section, trim(x) AS x FROM b, unnest(regexp_extract_all(line, '[^。！？!?]*[。！？!?]|[^。！？!?]+$')) AS u(x))
SELECT conv_id, section, count(*) AS n, sum(length(x)) AS chars FROM p WHERE length(x) >= 8 AND regexp_matches(x, '[一-鿿]') AND NOT regexp_matches(x, '^\\d+\\s*[.、]') GROUP BY ALL""")
def q60(spark: SparkSession, d: str) -> DataFrame:
    s = C.article_sentences(_articles(spark, d))
    return s.groupBy(F.col("article_id").alias("conv_id"), "section").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _articles(spark: SparkSession, d: str) -> DataFrame:
    t, flat = F.col("turn") % 6, F.replace("text", F.lit("\n"), F.lit(" "))
    line = F.when(t == 0, F.lit("研究结果")).when(t == 1, F.concat(F.lit("图"), "turn", F.lit(" 各部分的比较"))).when(t == 2, F.lit("续行的图注文字"))
    line = line.when(t == 3, F.concat(F.lit("说明形成的必要条件为："), flat)).when(t == 4, F.lit("（2）花托和心皮融合；")).when(t == 5, F.concat(F.lit("（3）"), flat, F.lit("。")))
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(line, "\r", " ").alias("line"))
    texts = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return turns.groupBy(F.col("conv_id").alias("article_id")).agg(F.array_join(F.transform(texts, lambda x: F.coalesce(x["line"], F.lit(""))), "\n").alias("text"))


@query("q61_article_candidates")
def q61(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of whole articles; the fold that joins list items is held against literal cases in the tests."""
    return C.article_candidates(_articles(spark, d))


# Gold and predicted classifications from labels and documents.
_GOLD = """g AS (SELECT l.doc_id, CASE l.doc_id % 5 WHEN 0 THEN 'No_Evidence' WHEN 1 THEN 'Weak_Evidence' WHEN 2 THEN NULL ELSE 'With_Evidence' END AS level,
 CASE WHEN toxic = 1 THEN 'mechanism_omission' WHEN quality = 0 THEN 'accurate' WHEN l.doc_id % 3 = 0 THEN 'magnitude_substitution' END AS prim,
 CASE WHEN l.doc_id % 7 = 0 THEN true WHEN l.doc_id % 7 = 1 THEN false END AS dist, CASE WHEN l.doc_id % 11 = 0 THEN true WHEN l.doc_id % 11 = 1 THEN false END AS acc,
 n_chars >= 800 AS long FROM labels l JOIN documents USING (doc_id))"""
_VIEW = """SELECT doc_id, long, level AS evidence_level, coalesce(dist, CASE WHEN level IN ('No_Evidence', 'Weak_Evidence') THEN NULL WHEN acc IS NOT NULL THEN NOT acc
 WHEN coalesce(prim, '') IN ('', 'no_distortion', 'accurate') THEN CASE WHEN level = 'With_Evidence' THEN false END ELSE true END) AS has_distortion, acc, coalesce(prim, '') AS "primary",
 CASE prim WHEN 'mechanism_omission' THEN 'omission' WHEN 'magnitude_substitution' THEN 'substitution' ELSE '' END AS level1 FROM g"""
_VIEW2 = f"SELECT *, coalesce(acc, CASE WHEN evidence_level = 'With_Evidence' THEN coalesce(NOT has_distortion, false) END) AS is_accurate FROM ({_VIEW})"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") >= 800).alias("long"))
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    level = F.when(i % 5 == 0, "No_Evidence").when(i % 5 == 1, "Weak_Evidence").when(i % 5 == 2, none).otherwise("With_Evidence")
    prim = F.when(F.col("toxic") == 1, "mechanism_omission").when(F.col("quality") == 0, "accurate").when(i % 3 == 0, "magnitude_substitution")
    flag = lambda m: F.when(i % m == 0, True).when(i % m == 1, False)
    view = L.read_view(level, none, prim, none, F.lit(None).cast("array<string>"), flag(7), flag(11))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "long", view.alias("gold"))


@query("q62_classification_read", f"WITH {_GOLD} SELECT doc_id, evidence_level, has_distortion, is_accurate, \"primary\", level1 FROM ({_VIEW2})")
def q62(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).select("doc_id", *[f"gold.{c}" for c in ("evidence_level", "has_distortion", "is_accurate", "primary", "level1")])


_RATE = lambda ok, counts: f"round(coalesce(avg(CASE WHEN {ok} THEN 1.0 ELSE 0.0 END) FILTER ({counts}), 0.0), 6)"


@query("q63_six_accuracies", f"""
WITH {_GOLD}, v AS ({_VIEW2}),
p AS (SELECT *, CASE WHEN long THEN evidence_level ELSE 'With_Evidence' END AS p_level, CASE WHEN long THEN "primary" ELSE 'mechanism_omission' END AS p_prim, CASE WHEN long THEN level1 ELSE 'omission' END AS p_level1,
 CASE WHEN doc_id % 2 = 0 THEN long END AS p_dist, CASE WHEN doc_id % 2 = 0 THEN NOT long END AS p_acc, CASE WHEN doc_id % 4 = 0 THEN 'mild' END AS sev, CASE WHEN long THEN 'mild' END AS p_sev FROM v)
SELECT {_RATE("evidence_level = p_level", "evidence_level IS NOT NULL")} AS evidence_level_accuracy, {_RATE('"primary" = p_prim', '"primary" IS NOT NULL')} AS primary_accuracy,
 {_RATE("level1 = p_level1", "level1 <> '' AND p_level1 <> ''")} AS level1_accuracy, {_RATE("has_distortion = p_dist", "has_distortion IS NOT NULL AND p_dist IS NOT NULL")} AS has_distortion_accuracy,
 {_RATE("is_accurate = p_acc", "is_accurate IS NOT NULL AND p_acc IS NOT NULL")} AS is_accurate_accuracy, {_RATE("sev = p_sev", "sev IS NOT NULL")} AS severity_accuracy FROM p""")
def q63(spark: SparkSession, d: str) -> DataFrame:
    rows, even, long = _gold(spark, d), F.col("doc_id") % 2 == 0, F.col("long")
    gold = F.col("gold").withField("severity", F.when(F.col("doc_id") % 4 == 0, "mild"))
    pred = F.struct(
        F.when(long, F.col("gold.evidence_level")).otherwise("With_Evidence").alias("evidence_level"), F.when(long, F.col("gold.primary")).otherwise("mechanism_omission").alias("primary"),
        F.when(long, F.col("gold.level1")).otherwise("omission").alias("level1"), F.when(even, long).alias("has_distortion"), F.when(even, ~long).alias("is_accurate"), F.when(long, "mild").alias("severity"),
    )
    out = E.accuracies(rows.select(gold.alias("gold"), pred.alias("pred")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("q64_id_integrity", """
WITH c AS (SELECT doc_id + CASE WHEN doc_id % 9 = 0 THEN 1000000000 ELSE 0 END AS sentence_id, CASE doc_id % 4 WHEN 0 THEN '  ' || text || chr(10) WHEN 1 THEN 'something else' WHEN 2 THEN '' ELSE text || ' and more' END AS text FROM documents),
k AS (SELECT c.*, d.doc_id IS NOT NULL AS known, lower(trim(regexp_replace(c.text, '\\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(coalesce(d.text, ''), '\\s+', ' ', 'g'))) AS b FROM c LEFT JOIN documents d ON d.doc_id = c.sentence_id)
SELECT count(*) FILTER (known AND text <> '' AND NOT contains(a, b) AND NOT contains(b, a)) AS id_text_mismatches, count(*) FILTER (NOT known) AS ids_missing_in_table, true AS version_mismatch FROM k""")
def q64(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sentence_id"), "text")
    i = F.col("sentence_id")
    text = F.when(i % 4 == 0, F.concat(F.lit("  "), "text", F.lit("\n"))).when(i % 4 == 1, "something else").when(i % 4 == 2, "").otherwise(F.concat("text", F.lit(" and more")))
    cited = docs.select((i + F.when(i % 9 == 0, 1000000000).otherwise(0)).alias("sentence_id"), text.alias("text"))
    return E.integrity(cited, docs, "2024#a", "2025#b")


@query("q65_qa_summary", r"""
WITH a AS (SELECT CASE WHEN event_id % 6 = 0 THEN '  ' WHEN event_id % 6 = 1 THEN NULL ELSE 'The answer: ' || event_type END AS answer, CASE WHEN event_id % 4 = 0 THEN 'none' ELSE event_type END AS gold, event_id % 3 AS j,
 round(value / 1000, 4) AS cost, user_id AS tokens, event_id % 5 AS loops FROM events), s AS (SELECT *, trim(coalesce(answer, '')) <> '' AS ok FROM a)
SELECT count(*) AS total_samples, count(*) FILTER (ok) AS answered_samples, count(*) FILTER (NOT ok) AS failed_samples, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 4) AS answer_rate,
 round(sum(CASE WHEN ok AND j = 0 THEN 1.0 ELSE 0.0 END) / count(*) FILTER (ok), 6) AS llm_accuracy, round(sum(CASE WHEN ok AND contains(answer, gold) THEN 1.0 ELSE 0.0 END) / count(*) FILTER (ok), 6) AS contain_accuracy,
 round(sum(cost), 1) AS total_cost, round(avg(tokens), 1) AS avg_retrieved_tokens, round(avg(loops), 2) AS avg_loops FROM s""")
def q65(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    answer = F.when(i % 6 == 0, "  ").when(i % 6 == 1, F.lit(None)).otherwise(F.concat(F.lit("The answer: "), "event_type"))
    rows = table(spark, d, "events").select(answer.alias("answer"), F.when(i % 4 == 0, "none").otherwise(F.col("event_type")).alias("gold"), (i % 3 == 0).cast("double").alias("judged"), F.round(F.col("value") / 1000, 4).alias("cost"), F.col("user_id").alias("retrieved_tokens"), (i % 5).alias("loops"))
    s = E.qa_summary(rows)
    return s.select("total_samples", "answered_samples", "failed_samples", "answer_rate", F.round("llm_accuracy", 6).alias("llm_accuracy"), F.round("contain_accuracy", 6).alias("contain_accuracy"), F.round("total_cost", 1).alias("total_cost"), "avg_retrieved_tokens", "avg_loops")


@query("q66_verdict_summary", """SELECT count(*) AS claims, count(*) FILTER (event_id % 4 = 0) AS supported, count(*) FILTER (event_id % 4 = 1) AS inconclusive, count(*) FILTER (event_id % 4 = 2) AS no_evidence,
 CAST(sum(user_id % 10) AS BIGINT) AS evidences, round(sum(round(value, 2)), 2) AS cost, count(*) FILTER (event_id % 13 = 0) AS errors FROM events""")
def q66(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    verdict = F.when(i % 4 == 0, "SUPPORTED").when(i % 4 == 1, "INCONCLUSIVE").when(i % 4 == 2, "NO_EVIDENCE").otherwise("")
    rows = table(spark, d, "events").select(verdict.alias("verdict"), (F.col("user_id") % 10).alias("evidence_count"), F.round("value", 2).alias("cost"), F.when(i % 13 == 0, "failed").alias("error"))
    return E.verdict_summary(rows).withColumn("cost", F.round("cost", 2))


@query("q67_latin_terms", r"""
WITH t AS (SELECT doc_id, [x for x in regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9\-.]{2,}(?:\s+[A-Z][A-Za-z0-9\-.]+)*')] AS l FROM documents)
SELECT doc_id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:8] AS terms FROM t""")
def q67(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.transform(M.latin_terms(F.col("text")), lambda t: t["en"]).alias("terms"))


@query("q68_term_cache", r"""
WITH k AS (SELECT doc_id, text, substr(sha1(regexp_replace(text, '\s+', '', 'g')), 1, 16) AS key FROM documents), c AS (SELECT DISTINCT key FROM k JOIN labels USING (doc_id))
SELECT count(*) FILTER (c.key IS NOT NULL) AS cache_hits, count(*) FILTER (c.key IS NULL) AS cache_misses FROM k LEFT JOIN c USING (key)""")
def q68(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    known = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(T.term_key(F.col("text")).alias("doc_key")).distinct()
    return M.cache_stats(M.extract(docs, known.withColumn("terms", F.array().cast(M.TERM))))


@query("q69_final_answer", """
SELECT event_id, event_type AS verdict, CASE WHEN event_id % 3 = 0 THEN [] ELSE [CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR)] END AS evidence_chunks, 'P' || user_id AS papers, 'first line second: line' AS reason FROM events""")
def q69(spark: SparkSession, d: str) -> DataFrame:
    chunks = F.when(F.col("event_id") % 3 == 0, F.lit("none")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit(" ，"), "event_id", F.lit(",")))
    reply = F.concat(F.lit("Here it is\nverdict: "), "event_type", F.lit("\n\n EVIDENCE_CHUNKS : "), chunks, F.lit("\nREASON: first line\n  second: line\nPapers:P"), "user_id")
    return table(spark, d, "events").select("event_id", A.final_answer(reply).alias("a")).select("event_id", "a.*")


@query("q70_body_size", """
WITH s AS (SELECT user_id, event_type AS size, sum(event_id % 50) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM s) WHERE k = 1""")
def q70(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("chars", F.col("event_id") % 50)
    return I.body_size(e, "user_id", "event_type", "chars", "event_id")


@query("q71_joined_headings", """
WITH l AS (SELECT user_id, event_id, event_type AS text, event_id % 3 = 0 AS head, CAST(floor(value / 40) AS INTEGER) AS block FROM events),
r AS (SELECT *, CASE WHEN head AND lag(head) OVER w AND lag(block) OVER w = block THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r)
SELECT user_id, min(event_id) AS event_id, string_agg(text, ' ' ORDER BY event_id) AS text FROM g GROUP BY user_id, run""")
def q71(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    lines = e.select("user_id", "event_id", F.col("event_type").alias("text"), (F.col("event_id") % 3 == 0).alias("is_heading"), F.lit(1).alias("page"), F.floor(F.col("value") / 40).cast("int").alias("block"))
    return I.joined_headings(lines, "user_id", "event_id").select("user_id", "event_id", "text")


@query("q72_heading_lines", r"""
SELECT event_id, length(t) <= 90 AND regexp_matches(t, '[A-Za-z]{3}') AND NOT regexp_matches(t, '(?i)^(fig(ure)?\.?\s*\d|table\s*\d)') AND NOT regexp_matches(t, '[.,;:]$') AND NOT regexp_matches(t, '\.\s+[A-Z]')
 AND event_id % 4 <= 2 AND (value >= 50.8 OR (event_id % 2 = 0 AND value >= 49.7)) AS heading
FROM (SELECT event_id, value, CASE event_id % 5 WHEN 0 THEN 'Fig. ' || event_id || ' of ' || event_type WHEN 1 THEN 'Results. The ' || event_type WHEN 2 THEN event_type || ':' ELSE 'The ' || event_type END AS t FROM events)""")
def q72(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    t = F.when(i % 5 == 0, F.concat(F.lit("Fig. "), i, F.lit(" of "), "event_type")).when(i % 5 == 1, F.concat(F.lit("Results. The "), "event_type")).when(i % 5 == 2, F.concat("event_type", F.lit(":"))).otherwise(F.concat(F.lit("The "), "event_type"))
    return table(spark, d, "events").select("event_id", I.is_heading(t, F.col("value"), i % 2 == 0, F.lit(50.0), i % 4).alias("heading"))


@query("q73_hyphens_and_metadata", r"""
WITH l AS (SELECT doc_id, text, list_filter([trim(x) for x in string_split(coalesce(text, ''), chr(10))], lambda x: length(x) > 15 AND regexp_matches(x, '[A-Za-z]')) AS lines FROM documents)
SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '([0-9A-Za-z_])-\s+([0-9A-Za-z_])', '\1\2', 'g')) AS joined, coalesce(lines[1], '') AS title,
 coalesce(list_max(regexp_extract_all(coalesce(text, ''), '\b((?:19|20)\d{2})\b')), '') AS year FROM l""")
def q73(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = docs.select("paper_id", F.md5(I.join_hyphens(F.col("text"))).alias("joined"))
    return I.paper_metadata(docs).join(joined, "paper_id").select(F.col("paper_id").alias("doc_id"), "joined", "title", "year")


@query("q74_sidecar", """SELECT d.doc_id, CASE WHEN l.doc_id % 3 = 0 THEN 'stated' ELSE d.source END AS source, d.lang FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def q74(spark: SparkSession, d: str) -> DataFrame:
    side = table(spark, d, "labels").select("doc_id").distinct().withColumns({"source": F.when(F.col("doc_id") % 3 == 0, "stated").otherwise(""), "lang": F.lit(None).cast("string")})
    return I.overridden(table(spark, d, "documents").select("doc_id", "source", "lang"), side, "doc_id")


@query("q75_numbered_chunks", "SELECT doc_id, CAST(row_number() OVER (ORDER BY source, doc_id) - 1 AS VARCHAR) AS id FROM documents")
def q75(spark: SparkSession, d: str) -> DataFrame:
    return I.numbered_chunks(table(spark, d, "documents").select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", "id")


@query("q76_report_counts", f"""WITH {_GOLD}, v AS ({_VIEW2}) SELECT doc_id % 20 AS article, count(*) AS total, count(*) FILTER (evidence_level = 'With_Evidence') AS with_evidence, count(*) FILTER (evidence_level = 'Weak_Evidence') AS weak_evidence,
 count(*) FILTER (evidence_level = 'No_Evidence') AS no_evidence, count(*) FILTER (has_distortion) AS distorted, count(*) FILTER (has_distortion IS NULL) AS unverifiable FROM v GROUP BY 1""")
def q76(spark: SparkSession, d: str) -> DataFrame:
    return P.report_counts(_gold(spark, d).select((F.col("doc_id") % 20).alias("article"), "gold.*"), "article")


@query("q77_wrapped_texts", r"SELECT doc_id, md5(replace(replace(coalesce(text, ''), chr(13), ''), chr(10), '')) AS flat FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '\n[ \t]+')")
def q77(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~F.col("text").rlike(r"\n[ \t]+"))
    return docs.select("doc_id", F.md5(P.unwrap(P.wrap(F.col("text")))).alias("flat"))


@query("q78_review_queue", """SELECT 'P001-A001-C' || l.doc_id AS sample_id FROM (SELECT DISTINCT doc_id, quality, toxic FROM labels) l WHERE NOT (doc_id % 3 = 0) AND (coalesce(quality, 0) <> 1 OR coalesce(toxic, 0) = 1 OR doc_id % 17 = 0)""")
def q78(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    flags = F.when(F.col("toxic") == 1, F.array(F.lit("dirty"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "labels").select("doc_id", "quality", "toxic").distinct()
    rows = rows.select(F.concat(F.lit("P001-A001-C"), "doc_id").alias("sample_id"), (i % 3 == 0).alias("human_verified"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("confidence"), flags.alias("flags"), F.when(i % 17 == 0, "other").alias("uncovered"))
    return P.review_queue(rows)


@query("q79_best_chunks", "SELECT source AS file, count(DISTINCT doc_id) AS covered FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id) GROUP BY source ORDER BY covered DESC, file LIMIT 1")
def q79(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("chunk_id"))
    return I.best_chunks(table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id")), files)


@query("q80_after_and_limit", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n > 2 AND n <= 5")
def q80(spark: SparkSession, d: str) -> DataFrame:
    """The rows after a position and up to a limit, for every conversation."""
    rows = table(spark, d, "conversations").select("conv_id", "turn").withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    return rows.where((F.col("n") > 2) & (F.col("n") <= 5)).select("conv_id", "turn")
