"""The engine's queries over the driver's tables, and the SQL they must equal.

documents stand for chunks (source: paper), embeddings for sentence vectors (label: chunk), benchmark for claims,
labels for gold, pages for raw articles, conversations for ordered turns and events for incremental records.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import english as G
from ..functions import jsonish as J
from ..functions import labels as L
from ..functions import text as T
from ..operators import claims as C
from ..operators import drafts as D
from ..operators import evaluate as E
from ..operators import ingest as I
from ..operators import retrieval as R
from ..operators import search as X
from ..sources.tables import settled, table
from ..streaming import resume as S

KEYWORDS = ["tion", "the", "ment", "keit"]
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# A quote inside SQL text is doubled.
_NAME = G.NAME.replace("'", "''")
_SCORE = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{k}', ''))) // {len(k)} * {len(k)}" for k in KEYWORDS)
_SPLIT = "list_filter([trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) for x in regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+')], lambda x: x <> '')"


@query("q01_keyword_topk", f"SELECT doc_id, CAST({_SCORE} AS BIGINT) AS score FROM documents WHERE {_SCORE} > 0 ORDER BY score DESC, doc_id LIMIT 20")
def q01(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_search(table(spark, d, "documents"), KEYWORDS, 20, "doc_id").select("doc_id", "score")


@query("q02_keyword_snippets", f"""
WITH t AS (SELECT doc_id, text, CAST({_SCORE} AS BIGINT) AS score FROM documents WHERE {_SCORE} > 0 ORDER BY score DESC, doc_id LIMIT 20)
SELECT doc_id, list_filter({_SPLIT}, lambda s: {' OR '.join(f"contains(lower(s), '{k}')" for k in KEYWORDS)})[1:5] AS snippets FROM t""")
def q02(spark: SparkSession, d: str) -> DataFrame:
    return R.snippets(R.keyword_search(table(spark, d, "documents"), KEYWORDS, 20, "doc_id")).select("doc_id", "snippets")


@query("q03_sentence_explode", f"SELECT doc_id, len({_SPLIT}) AS n, sum(length(s)) AS chars FROM documents, unnest({_SPLIT}) AS u(s) GROUP BY doc_id, len({_SPLIT})")
def q03(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.explode(T.naive_sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


_VERB, _LOW = f"regexp_matches(x, '{G.SCIENTIFIC_VERB}')", "lower(x)"
_PERSON = lambda x: f"(regexp_matches({x}, '^\\s*{_NAME}(\\s+{_NAME}){{1,3}}\\s*$') AND NOT regexp_matches(lower({x}), '{G.PUBLISHING_NOISE}') AND NOT regexp_matches({x}, '(?i)(^|\\s)({G.MONTHS})($|\\s)'))"
_PARTS = f"list_filter([regexp_replace(p, '^[ ,&]+|[ ,&]+$', '', 'g') for p in regexp_split_to_array(regexp_replace(x, '{G.BYLINE_MARKS}', '', 'g'), '[,&]')], lambda p: p <> '')"
_NAMES = f"len(list_filter({_PARTS}, lambda p: {_PERSON('p')}))"
_BYLINE = f"(length(x) <= 500 AND x NOT LIKE '%.' AND len({_PARTS}) >= 3 AND {_NAMES} >= greatest(2, floor(len({_PARTS}) * 0.6)))"
_WORDS = "list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')"
_CORE = "regexp_replace(w, '[^A-Za-z0-9]', '', 'g')"
_SHORT = f"len(list_filter({_WORDS}, lambda w: length({_CORE}) BETWEEN 1 AND 2 AND lower({_CORE}) NOT IN ({', '.join(repr(w) for w in G.COMMON_SHORT)})))"
_DROP = f"""CASE WHEN NOT regexp_matches(x, '[A-Za-z]{{3}}') THEN 'no_letters' WHEN length(x) < 12 OR (NOT verb AND length(x) < 30) THEN 'too_short'
 WHEN NOT verb AND regexp_matches(x, '{G.SCALE_BAR}') THEN 'scale_bar' WHEN NOT verb AND regexp_matches(x, '{G.GLOSSARY}') THEN 'abbrev_glossary'
 WHEN NOT verb AND regexp_matches(x, '{G.PANEL_RESIDUE}') THEN 'citation_residue'
 WHEN NOT verb AND regexp_matches({_LOW}, '{G.AFFILIATION}') AND (regexp_matches(x, '^[0-9]') OR regexp_matches(x, '{G.AFFILIATION_END}')) THEN 'affiliation'
 WHEN NOT verb AND (regexp_matches({_LOW}, '^({G.FRONT_MATTER})') OR {_PERSON('x')} OR {_BYLINE}) THEN 'front_matter'
 WHEN NOT verb AND starts_with({_LOW}, '{G.JOURNAL}') THEN 'journal_header' WHEN contains({_LOW}, 'contributed equally') THEN 'equal_contribution'
 WHEN NOT verb AND len({_WORDS}) >= 16 AND {_SHORT} / len({_WORDS}) >= 0.35 THEN 'figure_ocr'
 WHEN NOT verb AND len(regexp_extract_all(x, '{G.LONG_NAME}')) >= 10 THEN 'figure_ocr'
 WHEN NOT verb AND regexp_matches(x, '{G.LOCUS}') AND (regexp_matches(x, '\\b[0-9]{{2,3}}\\b') OR regexp_matches(x, '{G.SPECIES}')) THEN 'phylo_leaf'
 WHEN NOT verb AND regexp_matches(x, '^{G.LOCUS}') AND length(x) < 60 THEN 'locus_label' ELSE 'kept' END"""


@query("q04_drop_reasons", f"""
WITH u AS (SELECT unnest({_SPLIT}) AS x FROM documents WHERE lang = 'en'), v AS (SELECT x, {_VERB} AS verb FROM u)
SELECT {_DROP} AS reason, count(*) AS n FROM v GROUP BY 1""")
def q04(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").where("lang = 'en'").select(F.explode(T.naive_sentences(F.col("text"))).alias("s"))
    s = s.withColumn("verb", G.has_verb(F.col("s"), G.ascii_))
    return s.groupBy(F.coalesce(G.drop_reason(F.col("s"), verb=F.col("verb"), ascii_only=True), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_TOP = """SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) + 0.0 AS score
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0"""


def _queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v.select("vec_id", F.col("embedding").alias("v"))


@query("q05_dense_topk", f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_TOP})) WHERE rank <= 5")
def q05(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_topk(*_queries(spark, d), 5)


@query("q06_merge_recall", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_TOP}))
SELECT label, vec_id, max(score) AS score FROM (SELECT e.label, r.vec_id, r.score FROM r JOIN embeddings e ON e.vec_id = r.query_id WHERE rank <= 10) GROUP BY ALL""")
def q06(spark: SparkSession, d: str) -> DataFrame:
    hits = R.dense_topk(*_queries(spark, d), 10)
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    return R.merge_hits([hits.join(own, "query_id")], ["label", "vec_id"])


_SENT = f"""s AS (SELECT doc_id AS chunk_id, CAST(unnest(generate_series(0, len(l) - 1)) AS BIGINT) AS off, unnest(l) AS text
 FROM (SELECT doc_id, {_SPLIT} AS l FROM documents))"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.posexplode(T.naive_sentences(F.col("text"))).alias("offset", "text"))
    return rows.withColumn("sentence_id", F.concat_ws(":", "chunk_id", "offset"))


@query("q07_neighbour_expand", f"""
WITH {_SENT}, h AS (SELECT chunk_id, off, round(len(regexp_extract_all(lower(text), 'tion')) / 10.0, 6) AS score FROM s WHERE contains(lower(text), 'tion')),
n AS (SELECT chunk_id, off + d AS off, round(score * power(0.5, abs(d)), 6) AS score FROM h, (VALUES (-1), (0), (1)) AS v(d))
SELECT n.chunk_id AS query_id, n.chunk_id, CAST(n.off AS INTEGER) AS "offset", max(n.score) AS score, n.chunk_id || ':' || n.off AS sentence_id
FROM n JOIN s ON s.chunk_id = n.chunk_id AND s.off = n.off WHERE n.score >= 0.08 GROUP BY n.chunk_id, n.off""")
def q07(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    hits = s.where(F.contains(F.lower("text"), F.lit("tion")))
    hits = hits.select(F.col("chunk_id").alias("query_id"), "chunk_id", "offset", F.round(T.occurrences(F.col("text"), F.lit("tion")) / 10, 6).alias("score"))
    return R.expand_neighbours(hits, s).select("query_id", "chunk_id", "offset", "score", "sentence_id")


@query("q08_paragraph_context", """SELECT conv_id, turn, coalesce(string_agg(text, ' ') OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS prev_text,
coalesce(string_agg(text, ' ') OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def q08(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("chunk_id"), F.col("turn").alias("offset"), "text")
    return R.paragraph_context(rows).select(F.col("chunk_id").alias("conv_id"), F.col("offset").alias("turn"), "prev_text", "next_text")


@query("q09_board_dedup", "SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def q09(spark: SparkSession, d: str) -> DataFrame:
    return R.board_dedup(table(spark, d, "events"), ["user_id", "event_type"], "value", "event_id").select("user_id", "event_type", "value", "event_id")


_SCORES = "scores AS (SELECT user_id AS claim_id, value / 100 AS score FROM events WHERE event_type = 'purchase')"


@query("q10_gate", f"""
WITH {_SCORES}, c AS (SELECT DISTINCT user_id AS claim_id FROM events),
a AS (SELECT c.claim_id, count(score) AS n, count(*) FILTER (score >= 0.7) AS strong, coalesce(max(score), 0.0) AS top FROM c LEFT JOIN scores USING (claim_id) GROUP BY c.claim_id)
SELECT claim_id, n AS candidate_count, strong AS strong_hits, top AS top_score,
CASE WHEN n = 0 THEN 'NO_EVIDENCE' WHEN strong >= 2 THEN 'SUPPORTED' WHEN top < 0.3 THEN 'NO_EVIDENCE' ELSE 'INCONCLUSIVE' END AS verdict,
(n = 0 OR strong >= 2 OR top < 0.3) AS should_stop,
CASE WHEN n = 0 THEN 'no_candidate_retrieved' WHEN strong >= 2 THEN 'high_threshold_met' WHEN top < 0.3 THEN 'low_threshold_all_below' ELSE 'continue_search' END AS reason FROM a""")
def q10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    scores = e.where("event_type = 'purchase'").select(F.col("user_id").alias("claim_id"), (F.col("value") / 100).alias("score"))
    return R.gate(e.select(F.col("user_id").alias("claim_id")).distinct(), scores)


@query("q11_label", "SELECT event_id, CASE WHEN value / 100 >= 0.7 THEN 'SUPPORTED' WHEN value / 100 < 0.3 THEN 'NO_EVIDENCE' ELSE 'INCONCLUSIVE' END AS label FROM events")
def q11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", R.label(F.col("value") / 100).alias("label"))


_TOK = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1))"


@query("q12_jaccard_pairs", f"""
WITH t AS (SELECT item_id, {_TOK} AS k FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN len(a.k) = 0 OR len(b.k) = 0 THEN 0.0 ELSE len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) END, 6) AS jaccard
FROM t a JOIN t b ON a.item_id < b.item_id""")
def q12(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "benchmark").select("item_id", T.token_set(F.col("text")).alias("k"))  # a few hundred items
    a, b = t.select(F.col("item_id").alias("a"), F.col("k").alias("x")), t.select(F.col("item_id").alias("b"), F.col("k").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


_BI = "list_distinct([substr(k, CAST(i AS BIGINT), 2) for i in generate_series(1, greatest(length(k) - 1, 0))])"


@query("q13_ngram_containment", f"""
WITH t AS (SELECT item_id, regexp_replace(text, '[^0-9A-Za-z]', '', 'g') AS k FROM benchmark), g AS (SELECT item_id, {_BI} AS g FROM t)
SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN least(len(a.g), len(b.g)) = 0 THEN 0.0 ELSE len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)) END, 6) AS overlap
FROM g a JOIN g b ON a.item_id < b.item_id""")
def q13(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "benchmark").select("item_id", T.char_ngrams(F.col("text")).alias("g"))  # a few hundred items
    a, b = t.select(F.col("item_id").alias("a"), F.col("g").alias("x")), t.select(F.col("item_id").alias("b"), F.col("g").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(T.containment(F.col("x"), F.col("y")), 6).alias("overlap"))


@query("q14_mmr")
def q14(spark: SparkSession, d: str) -> DataFrame:
    k, limit = X.recall_budget(5)
    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("sentence_id"), F.round(T.occurrences(F.col("text"), F.lit("tion")) / (F.length("text") + 1), 6).alias("score"), "text")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "sentence_id")
    top = docs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return R.mmr(top.select("query_id", "sentence_id", "score", T.token_set(F.col("text")).alias("tokens")), k)


@query("q15_finalize_pools", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_TOP}))
SELECT query_id AS claim_id, list(vec_id ORDER BY rank) FILTER (rank <= 5) AS classify_ids, list(vec_id ORDER BY rank) FILTER (rank <= 10) AS review_ids FROM r GROUP BY query_id""")
def q15(spark: SparkSession, d: str) -> DataFrame:
    hits = R.dense_topk(*_queries(spark, d), 12)
    return R.pools(hits.select(F.col("query_id").alias("claim_id"), F.col("vec_id").alias("sentence_id"), "rank"))


@query("q16_claim_context", """SELECT conv_id, turn, printf('C%02d', row_number() OVER w) AS claim_id, coalesce(lag(text) OVER w, '') AS context_before, coalesce(lead(text) OVER w, '') AS context_after
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def q16(spark: SparkSession, d: str) -> DataFrame:
    return C.with_context(table(spark, d, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "claim_id", "context_before", "context_after")


@query("q17_section_carry", """SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '') AS section FROM conversations""")
def q17(spark: SparkSession, d: str) -> DataFrame:
    return C.carry_section(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", "text").select("conv_id", "turn", "section")


# The rules in SQL, from the literal values and not from the module that they test.
_SCI = "揭示|发现|表明|证明|显示|阐明|证实|暗示|敲除|突变体|表型|调控|表达|共表达|机制|转录因子|基因|测序|聚类|原位杂交|切片|发育|生长|融合|原基|分生组织|本研究|该研究|结果显示|作者发现|首次|构建了|必要条件|分类学|性状|进化|模式植物"
_PUB = "发表了题为|发表题为|刊于|期刊上发表|在[\\w\\sA-Za-z\\p{L}]{0,40}(期刊|杂志|Nature|Science|Cell|Plant)[^。]{0,24}发表|通讯作者|团队联合|DOI[:：]|doi\\.org"
_LEAD_IN = "^\\s*(下面我们来看|接下来(我们)?(来看)?|值得注意的是|综上所述|由此可见|总而言之|我们可以看出|让我们来看)"
_OUTSIDE = "regexp_replace(x, '[《「“\"].*?[》」”\"]', '', 'g')"
_REST = f"regexp_replace(regexp_replace(trim(x), '{_LEAD_IN}[，,]?', ''), '^[\\s，,。；;]+|[\\s，,。；;]+$', '', 'g')"
_ROLE = f"""CASE WHEN regexp_matches({_OUTSIDE}, '{_PUB}') AND NOT regexp_matches({_OUTSIDE}, '{_SCI}') THEN 'publication_meta'
 WHEN {_REST} = '' OR regexp_matches(x, '^\\s*如图所示\\s*[，,。！!？?]?\\s*$') THEN 'discourse'
 WHEN regexp_matches(x, '^\\s*[（(]\\s*\\d+\\s*[）)]\\s*\\S') AND length(regexp_replace(x, '\\s+', '', 'g')) < 24 THEN 'fragment'
 WHEN regexp_matches(x, '{_LEAD_IN}') AND length({_REST}) < 16 AND NOT regexp_matches({_REST}, '{_SCI}') THEN 'fragment' END"""
_KEEP = f"CASE WHEN {_ROLE} IS NOT NULL THEN false WHEN section IN ('研究背景', '引言', '前言', '背景介绍', '总结与讨论', '总结', '讨论', '研究结论') THEN length(trim(x)) >= 12 WHEN regexp_matches(x, '{_SCI}') AND length(trim(x)) >= 20 THEN true ELSE length(trim(x)) >= 40 END"
_GUESS = f"""CASE WHEN {_ROLE} IS NOT NULL THEN {_ROLE} WHEN section IN ('研究背景', '引言', '前言', '背景介绍') THEN 'paper_intro' WHEN section IN ('总结与讨论', '总结', '讨论', '研究结论') THEN 'paper_conclusion'
 WHEN regexp_matches(x, '测序|构建.{{0,8}}突变|CRISPR|切片|杂交|实验设计') THEN 'paper_method' WHEN regexp_matches(x, '首次|揭示了|以上结果说明|综上所述') THEN 'paper_lead' ELSE 'paper_result' END"""
# The tables hold no Chinese: each turn gets a Chinese head, and some are that head alone, so that each rule meets rows.
_HEADS = ["综上所述，", "（1）", "该成果发表了题为", "本研究揭示了", "在某某Nature期刊上一起发表。", "经CRISPR构建的单突变，", "首次", "如图所示", "（2）原基融合聚类", "值得注意的是，分类学性状", "图1 ", "3. "]
_SECTIONS = ["", "研究背景", "研究结果", "总结与讨论", "讨论", "引言", "方法"]
_AT = f"(conv_id * 5 + turn) % {len(_HEADS) * 2}"
_ZH = f"""z AS (SELECT conv_id, turn, CASE (conv_id + turn) % {len(_SECTIONS)} {' '.join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_SECTIONS))} END AS section,
 CASE {_AT} {' '.join(f"WHEN {i} THEN '{h}' WHEN {i + len(_HEADS)} THEN '{h}' || coalesce(text, '')" for i, h in enumerate(_HEADS))} END AS x FROM conversations)"""


def headed(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, section, x): whole turns behind a Chinese head, or that head alone."""
    at, of = (F.col("conv_id") * 5 + F.col("turn")) % (len(_HEADS) * 2), (F.col("conv_id") + F.col("turn")) % len(_SECTIONS)
    head, section = F.array(*map(F.lit, _HEADS)), F.array(*map(F.lit, _SECTIONS))
    text = F.when(at >= len(_HEADS), F.coalesce("text", F.lit(""))).otherwise(F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.get(section, of.cast("int")).alias("section"), F.concat(F.get(head, (at % len(_HEADS)).cast("int")), text).alias("x"))


@query("q18_rule_roles", f"WITH {_ZH} SELECT conv_id, turn, {_ROLE} AS role, {_KEEP} AS keep FROM z")
def q18(spark: SparkSession, d: str) -> DataFrame:
    return headed(spark, d).select("conv_id", "turn", C.drop_role(F.col("x")).alias("role"), C.default_keep(F.col("x"), F.col("section")).alias("keep"))


@query("q19_rule_counts", f"WITH {_ZH} SELECT coalesce({_ROLE}, 'kept') AS role, count(*) AS n FROM z GROUP BY 1")
def q19(spark: SparkSession, d: str) -> DataFrame:
    return headed(spark, d).groupBy(F.coalesce(C.drop_role(F.col("x")), F.lit("kept")).alias("role")).agg(F.count("*").alias("n"))


@query("q20_html_clean", r"""
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))) AS cleaned FROM pages""")
def q20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(I.clean_html(F.col("html"))).alias("cleaned"))


@query("q21_repeated_lines", """
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT source, count(DISTINCT doc_id) AS total FROM documents GROUP BY source),
h AS (SELECT source, line, count(DISTINCT doc_id) AS pages FROM l WHERE length(line) <= 80 AND trim(line) <> '' GROUP BY ALL)
SELECT source, line, pages FROM h JOIN t USING (source) WHERE total >= 4 AND pages >= greatest(3, floor(total * 0.02))""")
def q21(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return I.repeated_lines(lines, "source", "doc_id", "line", ratio=0.02)


@query("q22_style_runs", """
WITH e AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(event_type) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
SELECT event_id, CAST(run AS BIGINT) AS run, count(*) OVER (PARTITION BY user_id, run) AS run_length FROM r""")
def q22(spark: SparkSession, d: str) -> DataFrame:
    return I.style_runs(table(spark, d, "events"), "user_id", ["event_id"], "event_type").select("event_id", "run", "run_length")


@query("q23_reading_order", """
WITH l AS (SELECT user_id AS page, event_id AS line_id, event_id % 5 * 60.0 AS x0, event_id % 5 * 60.0 + CASE WHEN event_id % 11 = 0 THEN 400 ELSE 200 END AS x1, value AS y FROM events),
s AS (SELECT *, CASE WHEN x0 < 276 AND x1 > 324 AND x1 - x0 > 330 THEN 2 WHEN (x0 + x1) / 2 < 300 THEN 0 ELSE 1 END AS side, CAST(round(y * 10) AS BIGINT) AS yy FROM l),
b AS (SELECT *, bool_or(side = 0) OVER (PARTITION BY page) AND bool_or(side = 1) OVER (PARTITION BY page) AS two,
 coalesce(sum(CAST(side = 2 AS INT)) OVER (PARTITION BY page ORDER BY yy RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS band FROM s)
SELECT page, line_id, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN two THEN band ELSE 0 END, CASE WHEN two THEN side ELSE 0 END, yy, x0, line_id) AS position FROM b""")
def q23(spark: SparkSession, d: str) -> DataFrame:
    left = F.col("event_id") % 5 * 60.0
    lines = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("line_id"), left.alias("x0"), (left + F.when(F.col("event_id") % 11 == 0, 400).otherwise(200)).alias("x1"), F.col("value").alias("y"))
    return I.reading_order(lines, 600.0).select("page", "line_id", "position")


@query("q24_fingerprint", f"SELECT doc_id, substr(sha256(array_to_string({_SPLIT}, chr(10)) || CASE WHEN len({_SPLIT}) > 0 THEN chr(10) ELSE '' END), 1, 16) AS fingerprint FROM documents")
def q24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fingerprint(T.naive_sentences(F.col("text"))).alias("fingerprint"))


@query("q25_term_key", r"SELECT doc_id, substr(sha1(regexp_replace(text, '\s+', '', 'g')), 1, 16) AS term_key FROM documents")
def q25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.term_key(F.col("text")).alias("term_key"))


@query("q26_hit_recall_precision", f"""
WITH r AS (SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_TOP}) t),
p AS (SELECT query_id, list(vec_id ORDER BY rank) FILTER (rank <= 5) AS pred FROM r GROUP BY query_id),
g AS (SELECT q.vec_id AS query_id, list(v.vec_id) AS gold FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id)
SELECT query_id, CASE WHEN len(list_intersect(gold, pred)) > 0 THEN 1.0 ELSE 0.0 END AS hit, round(len(list_intersect(gold, pred)) / len(gold), 6) AS recall, round(len(list_intersect(gold, pred)) / len(pred), 6) AS "precision" FROM p JOIN g USING (query_id)""")
def q26(spark: SparkSession, d: str) -> DataFrame:
    pred = R.pools(R.dense_topk(*_queries(spark, d), 5).select(F.col("query_id").alias("claim_id"), F.col("vec_id").alias("sentence_id"), "rank")).select(F.col("claim_id").alias("query_id"), F.col("classify_ids").alias("pred"))
    v = table(spark, d, "embeddings")
    gold = v.groupBy("label").agg(F.collect_list("vec_id").alias("gold"))
    rows = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(gold, "label").join(pred, "query_id")
    m = rows.select("query_id", E.retrieval_metrics(F.col("gold"), F.col("pred"), 5).alias("m"))
    return m.select("query_id", "m.hit", F.round("m.recall", 6).alias("recall"), F.round("m.precision", 6).alias("precision"))


_PRED = "CASE WHEN n_chars >= 800 THEN 1 ELSE 0 END"


@query("q27_label_accuracy", f"SELECT round(avg(CASE WHEN quality = {_PRED} THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id)")
def q27(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    return rows.agg(F.round(E.accuracy(F.col("quality"), F.col("predicted")), 6).alias("accuracy"), F.count("*").alias("n"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") >= 800, 1).otherwise(0).alias("predicted"), "lang", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id")


@query("q28_confusion", f"SELECT quality, {_PRED} AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def q28(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(_labelled(spark, d), "quality", "predicted")


@query("q29_micro_f1", f"""
WITH r AS (SELECT list_distinct(['q' || quality, 't' || toxic]) AS g, list_distinct(['q' || {_PRED}, 't0']) AS p FROM labels JOIN documents USING (doc_id)),
s AS (SELECT sum(len(list_intersect(g, p))) AS tp, sum(len(p)) AS p, sum(len(g)) AS g FROM r)
SELECT CAST(tp AS BIGINT) AS tp, CAST(p AS BIGINT) AS p, CAST(g AS BIGINT) AS g, round(tp / p, 6) AS "precision", round(tp / g, 6) AS recall, round(2 * (tp / p) * (tp / g) / (tp / p + tp / g), 6) AS f1 FROM s""")
def q29(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = _labelled(spark, d).select(F.array(tag("q", "quality"), tag("t", "toxic")).alias("g"), F.array(tag("q", "predicted"), F.lit("t0")).alias("p"))
    return E.micro_f1(rows, "g", "p").select("tp", "p", "g", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_CASES = """c AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'No_Evidence' WHEN doc_id % 4 = 1 THEN 'Weak_Evidence' ELSE 'With_Evidence' END AS level,
CASE WHEN toxic = 1 THEN 'mechanism_omission' WHEN quality = 0 THEN 'magnitude_substitution' END AS prim FROM labels)"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("doc_id") % 4 == 0, "No_Evidence").when(F.col("doc_id") % 4 == 1, "Weak_Evidence").otherwise("With_Evidence")
    primary = F.when(F.col("toxic") == 1, "mechanism_omission").when(F.col("quality") == 0, "magnitude_substitution")
    return table(spark, d, "labels").select("doc_id", level.alias("level"), primary.alias("prim"))


@query("q30_classification_standardise", f"""
WITH {_CASES} SELECT doc_id, level AS evidence_level, CASE WHEN level = 'With_Evidence' THEN prim IS NOT NULL END AS has_distortion,
CASE WHEN level = 'With_Evidence' THEN coalesce(prim, 'no_distortion') END AS "primary",
CASE WHEN level = 'With_Evidence' THEN CASE prim WHEN 'mechanism_omission' THEN 'omission' WHEN 'magnitude_substitution' THEN 'substitution' END END AS level1,
CASE WHEN level <> 'With_Evidence' THEN '' WHEN prim IS NULL THEN 'none' ELSE 'moderate' END AS severity FROM c""")
def q30(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    s = _cases(spark, d).select("doc_id", L.standardise(F.col("level"), F.col("prim"), none, none, none).alias("s"))
    return s.select("doc_id", "s.evidence_level", "s.has_distortion", "s.primary", "s.level1", "s.severity")


@query("q31_shape_errors", f"""
WITH {_CASES} SELECT doc_id, list_filter([CASE WHEN level <> 'With_Evidence' THEN 'has_distortion_present' END, CASE WHEN level <> 'With_Evidence' AND prim IS NOT NULL THEN 'primary_present' END, CASE WHEN level = 'With_Evidence' AND prim IS NOT NULL THEN 'severity' END,
CASE WHEN level = 'With_Evidence' AND prim IS NULL THEN 'primary_undistorted' END], lambda x: x IS NOT NULL) AS errors FROM c""")
def q31(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return _cases(spark, d).select("doc_id", L.shape_errors(F.col("level"), F.col("prim").isNotNull(), F.col("prim"), none, F.lit("none")).alias("errors"))


@query("q32_reader_notes", f"WITH {_CASES} SELECT doc_id, CASE WHEN level <> 'With_Evidence' THEN 'caution' WHEN prim IS NULL THEN 'ok' ELSE 'correct:' || prim END AS note FROM c")
def q32(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("doc_id", L.reader_note(F.col("level"), L.has_distortion(F.col("level"), F.col("prim")), F.col("prim")).alias("note"))


@query("q33_distribution", f"WITH {_CASES} SELECT level, coalesce(prim, 'no_distortion') AS label, count(*) AS n FROM c GROUP BY ALL")
def q33(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).groupBy("level", F.coalesce("prim", F.lit("no_distortion")).alias("label")).agg(F.count("*").alias("n"))


@query("q34_resume_pending", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q34(spark: SparkSession, d: str) -> DataFrame:
    return C.pending(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("q35_missing", "SELECT doc_id FROM labels l WHERE quality = 1 AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND n_chars >= 800)")
def q35(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").where("n_chars >= 800")
    return C.pending(table(spark, d, "labels").where("quality = 1").select("doc_id"), found, "doc_id")


@query("q36_append_new", """SELECT doc_id, 'old' AS origin FROM labels UNION ALL
SELECT doc_id, 'new' AS origin FROM documents d WHERE lang = 'fr' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q36(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "labels").select("doc_id", F.lit("old").alias("origin"))
    new = table(spark, d, "documents").where("lang = 'fr'").select("doc_id", F.lit("new").alias("origin"))
    return old.unionByName(C.pending(new, old, "doc_id"))


@query("q37_last_wins", "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def q37(spark: SparkSession, d: str) -> DataFrame:
    return C.last_wins(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts").select("user_id", "event_id", "event_type")


@query("q38_first_wins", "SELECT user_id, arg_min(event_id, ts) AS event_id, arg_min(event_type, ts) AS event_type FROM events GROUP BY user_id")
def q38(spark: SparkSession, d: str) -> DataFrame:
    return C.first_wins(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts").select("user_id", "event_id", "event_type")


@query("q39_locked_merge", """
WITH r AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 2 THEN 'merge' WHEN turn % 5 = 4 THEN 'drop' ELSE '' END AS decision, CASE WHEN turn % 3 = 2 THEN 0 END AS into_ FROM conversations),
m AS (SELECT conv_id, into_ AS turn, string_agg(text, '；' ORDER BY turn) AS more FROM r WHERE decision = 'merge' AND into_ <> turn GROUP BY conv_id, into_)
SELECT r.conv_id, r.turn, md5(r.text || coalesce('；' || more, '')) AS merged FROM r LEFT JOIN m USING (conv_id, turn) WHERE decision NOT IN ('drop', 'merge')""")
def q39(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    review = table(spark, d, "conversations").select("conv_id", "turn", t.alias("ordinal"), "text", F.when(t % 3 == 2, "merge").when(t % 5 == 4, "drop").otherwise("").alias("decision"), F.when(t % 3 == 2, 0).cast("long").alias("merge_into"))
    return C.locked(review, "conv_id", "turn").select("conv_id", "turn", F.md5("text").alias("merged"))


@query("q40_two_stage_match", r"""
WITH l AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN item_id ELSE -1 END AS key, regexp_replace(text, '\s+', '', 'g') AS k FROM benchmark)
SELECT l.item_id, coalesce((SELECT max(item_id) FROM benchmark b WHERE b.item_id = l.key), (SELECT max(item_id) FROM benchmark b WHERE regexp_replace(b.text, '\s+', '', 'g') = l.k)) AS found FROM l""")
def q40(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    left = b.select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("item_id")).otherwise(F.lit(-1)).alias("key"), "text")
    right = b.select(F.col("item_id").alias("key"), F.col("text"), F.col("item_id").alias("found"))
    return C.two_stage_match(left, right, "key", "text", "found").select("item_id", "found")


@query("q41_resolve_text", r"""
WITH b AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS p FROM benchmark), s AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS p FROM documents)
SELECT item_id, coalesce(min(doc_id), -1) AS sentence_id FROM b LEFT JOIN s ON contains(s.p, b.p) OR contains(b.p, s.p) GROUP BY item_id""")
def q41(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sentence_id"), "text")
    return R.resolve_text(table(spark, d, "benchmark"), docs)


@query("q42_cost", "SELECT event_id, round(value * CASE WHEN contains(event_type, 'view') THEN 0.8 WHEN contains(event_type, 'c') THEN 2.4 ELSE 0.0 END / 1000, 6) AS cost FROM events")
def q42(spark: SparkSession, d: str) -> DataFrame:
    return E.model_cost(table(spark, d, "events"), [("view", 0.8), ("c", 2.4)], "event_type", "value").select("event_id", "cost")


_ANSWER = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query("q43_contain_match", f"""
WITH p AS (SELECT doc_id, {_ANSWER} AS p FROM documents), g AS (SELECT item_id, {_ANSWER} AS g FROM benchmark)
SELECT doc_id, list_sort(coalesce(list(item_id) FILTER (p <> '' AND g <> '' AND contains(p, g)), [])) AS items FROM p, g GROUP BY doc_id""")
def q43(spark: SparkSession, d: str) -> DataFrame:
    return E.answers_held(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("q44_translation_pending", r"""
SELECT DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS p FROM documents WHERE lang <> 'en' AND lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) NOT IN (SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) FROM documents JOIN labels USING (doc_id))""")
def q44(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", T.plain(F.col("text")).alias("p"))
    cached = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return C.pending(docs.where("lang <> 'en'").select("p").distinct(), cached, "p")


@query("q45_json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q45(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object(T.json_block(F.col("props")), "$.k").cast("long").alias("k"))


@query("q46_stream_resume", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type <> 'view' GROUP BY user_id")
def q46(spark: SparkSession, d: str) -> DataFrame:
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='claimloom-')}"
    at = f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    for _ in range(2):  # the second run finds nothing new
        done = S.run_available(spark, d, schema, f"{at}/out", f"{at}/checkpoint", lambda x: x.where("event_type <> 'view'").select("user_id", "value"), "events.parquet")
    return done.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("q47_semantic_e2e")
def q47(spark: SparkSession, d: str) -> DataFrame:
    """Recall by all words, token rerank, keep, neighbours, diversity and the gate, for all benchmark claims at once."""
    claims = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    s = settled(_sentences(spark, d), "sentences")
    _, limit = X.recall_budget(None)
    recalled = settled(X.keyword_recall(claims, X.token_index(claims, s), limit), "recalled")
    chosen = X.semantic_search(claims, _around(s, recalled, 1), recalled, top_k=5)
    return R.gate(claims.select(F.col("query_id").alias("claim_id")), chosen.select(F.col("query_id").alias("claim_id"), F.col("rerank_score").alias("score")))


def _around(s: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """The sentences found and those within `window` of them: as many as the recall budget allows, whatever the corpus."""
    at = F.split("sentence_id", ":")
    places = found.select(at[0].cast("long").alias("chunk_id"), F.explode(F.sequence(at[1].cast("int") - window, at[1].cast("int") + window)).alias("offset")).distinct()
    return settled(s.join(F.broadcast(places), ["chunk_id", "offset"], "left_semi"), "around")


@query("q48_segment_verdicts")
def q48(spark: SparkSession, d: str) -> DataFrame:
    """English segmentation of whole texts, counted by verdict; the fold is held against literal cases in the tests."""
    s = I.sentences_with_verdicts(table(spark, d, "documents").select("doc_id", "text"))
    return s.groupBy("doc_id", "reason").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


@query("q49_json_repair", """SELECT event_id, '{"k": ' || event_id || ', ' || chr(10) || '"t": "a,]//' || event_type || '，b" , "l": [1,2]}' AS repaired FROM events""")
def q49(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('{"k": '), "event_id", F.lit(', // a "note"，\n"t": "a,]//'), "event_type", F.lit('，b" ， "l": [1,2,, ],}'))
    return table(spark, d, "events").select("event_id", J.repair_json(raw).alias("repaired"))


@query("q50_draft_rules", """
WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'With_Evidence' WHEN 1 THEN 'Weak_Evidence' WHEN 2 THEN 'No_Evidence' ELSE 'odd' END AS level, quality = 0 AS bad, doc_id % 3 = 0 AS ids, doc_id % 5 = 0 AS prim FROM labels WHERE quality IS NOT NULL)
SELECT doc_id, CASE WHEN level = 'odd' THEN ['level_unknown'] ELSE list_filter([
 CASE WHEN level = 'With_Evidence' AND NOT ids THEN 'with_evidence_without_ids' END,
 CASE WHEN level = 'With_Evidence' AND bad AND NOT prim THEN 'distorted_without_primary' END, CASE WHEN level = 'With_Evidence' AND bad THEN 'distorted_without_severity' END,
 CASE WHEN level = 'With_Evidence' AND bad AND NOT prim THEN 'secondary_is_primary' END,
 CASE WHEN level = 'With_Evidence' AND NOT bad THEN 'undistorted_with_primary' END,
 CASE WHEN level <> 'With_Evidence' THEN 'answerable_without_evidence' END, CASE WHEN level <> 'With_Evidence' THEN 'distortion_without_evidence' END,
 CASE WHEN level <> 'With_Evidence' AND prim THEN 'primary_without_evidence' END, CASE WHEN level = 'No_Evidence' AND ids THEN 'ids_without_evidence' END], lambda x: x IS NOT NULL) END AS errors FROM s""")
def q50(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").where("quality IS NOT NULL")
    c, none = F.col("doc_id"), F.lit(None).cast("string")
    level = F.when(c % 4 == 0, "with").when(c % 4 == 1, "weak_evidence").when(c % 4 == 2, "No_Evidence").otherwise("odd")
    sample = F.struct(
        c.cast("string").alias("claim_id"), level.alias("evidence_level"), F.lit("yes").alias("is_answerable"), (F.col("quality") == 0).alias("has_distortion"), F.when(c % 3 == 0, F.array(F.lit(7), F.lit(7), F.lit(-1))).alias("gold_sentence_ids"),
        F.when(c % 5 == 0, F.struct(F.lit("mechanism_omission").alias("level2"))).alias("primary_label"), none.alias("severity"), F.struct(F.lit("id=7").alias("evidence_judgement")).alias("analysis"),
    )
    replies = rows.select(c.cast("string").alias("batch"), F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.array(sample).alias("samples"))), F.lit("\n```")).alias("reply"))
    judged = D.validated(rows.select(c.cast("string").alias("claim_id")), replies)
    return judged.select(F.col("claim_id").cast("long").alias("doc_id"), "errors")


@query("q51_search_rounds")
def q51(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of search over all benchmark claims: whole claim first, then their longest words alone; final evidence."""
    claims = table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("query"))
    s = settled(_sentences(spark, d), "sentences")
    index = X.token_index(claims, s)

    def search(open_claims: DataFrame, r: int) -> DataFrame:
        terms = F.slice(F.array_sort(T.token_set(F.col("query")), lambda a, b: F.length(b) - F.length(a)), 1 + 6 * (r - 1), 6)
        q = open_claims.select(F.col("claim_id").alias("query_id"), "query", X.term_query(terms).alias("terms"))
        k, limit = X.recall_budget(5)
        more = X.keyword_recall(q.select("query_id", F.col("terms").alias("query")), index, limit)
        recalled = settled(X.recall_union(X.keyword_recall(q, index, limit), more, limit), "recalled")
        return X.semantic_search(q, _around(s, recalled, 1), recalled, top_k=k).withColumnRenamed("query_id", "claim_id")

    board, _ = X.search_rounds(claims, search)
    out = X.finalize(claims.select("claim_id"), board, _around(s, board, 2))
    return out.select("claim_id", "verdict", "candidate_count", F.transform(F.coalesce("evidences", F.array()), lambda e: e["sentence_id"].cast("string")).alias("evidence_ids"))
