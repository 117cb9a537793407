"""Claim operators: rules, context, sections, review merges, deduplication and record matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as T

# The cue words of the Chinese rules.
SECTIONS = "研究背景|研究结果|研究结论|总结与讨论|总结|讨论|方法|引言|前言|背景介绍|主要内容|未来展望|展望"
SUMMARY_SECTIONS = ("总结与讨论", "总结", "讨论", "研究结论")
INTRO_SECTIONS = ("研究背景", "引言", "前言", "背景介绍")
SIGNIFICANCE = "首次|新靶点|育种|意义重大|为作物|突破|核心作用"
CAPTION = r"^\s*[（(]?[图表]\s*\d"
NUMBERED = r"^\s*[（(]\s*\d+\s*[）)]\s*\S"
PUBLICATION = r"(?U)发表了题为|发表题为|刊于|期刊上发表|在[\w\sA-Za-z]{0,40}(期刊|杂志|Nature|Science|Cell|Plant)[^。]{0,24}发表|通讯作者|团队联合|DOI[:：]|doi\.org"
SCIENCE = (
    "揭示|发现|表明|证明|显示|阐明|证实|暗示|敲除|突变体|表型|调控|表达|共表达|机制|转录因子|基因|测序|聚类|原位杂交|切片|发育|生长|融合|原基|分生组织|"
    "本研究|该研究|结果显示|作者发现|首次|构建了|必要条件|分类学|性状|进化|模式植物"
)
DISCOURSE = r"^\s*(下面我们来看|接下来(?:我们)?(?:来看)?|值得注意的是|综上所述|由此可见|总而言之|我们可以看出|让我们来看)"
DISCOURSE_ONLY = r"^\s*(下面我们来看|接下来(?:我们)?(?:来看)?|值得注意的是|综上所述|由此可见|总而言之|我们可以看出|让我们来看|如图所示)\s*[，,。！!？?]?\s*$"
METHOD = r"测序|构建.{0,8}突变|CRISPR|切片|杂交|实验设计"
LEAD = "首次|揭示了|以上结果说明|综上所述"
LIST_CUES = "必要条件|包括以下|分别为|包括：|（1）|\\(1\\)"
NOT_CLAIMS = (r"^\s*[（(]?[图表]\s*\d", r"^\s*\d+\s*[.、]", r"^\s*公众号\s*[:：]", r"^\s*(参考文献|来源|编辑|排版|责编|图片来源)\s*[:：]?\s*$")
META_LINES = r"[-*]?\s*(?:来源|来源类型|发布日期|原文链接|对应论文|存档日期|作者)\s*[:：]|\[A\d+\]"
KEEP_ROLES = ("paper_result", "paper_method", "paper_conclusion", "paper_lead", "paper_intro")
DROP_ROLES = ("textbook_bg", "publication_meta", "discourse", "caption_heading", "fragment")
MARKDOWN = (
    (r"\A[\s\S]*?(?m:^---\s*\n)", ""),
    (r"!\[.*?\]\(.*?\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"(?m)^---+$", ""),
    (r"(?m)^>\s+", ""),
)


def clean_markdown(text: Column) -> Column:
    """The body without its archive header, images, link targets, emphasis, heading and quotation marks."""
    for pattern, put in MARKDOWN:
        text = F.regexp_replace(text, pattern, put)
    return text


def without_meta_lines(text: Column) -> Column:
    """From the first line on that is neither blank nor an archive field."""
    return F.regexp_replace(text, rf"\A(?:[^\S\n]*(?:(?:{META_LINES})[^\n]*)?(?:\n|\z))+", "")


def claim_like(x: Column, min_chars: int = 8) -> Column:
    """Long enough, holds Chinese, and is no caption, numbered heading or credit line."""
    s = T.strip(x)
    out = (F.length(s) >= min_chars) & s.rlike("[一-鿿]")
    for pattern in NOT_CLAIMS:
        out &= ~s.rlike(pattern)
    return out


def article_sentences(articles: DataFrame, min_chars: int = 8) -> DataFrame:
    """(article_id, ordinal, section, text): lines to sentences, sections carried forward, captions left out.

    Sentences end at 。！？!? and not at a semicolon, so that numbered lists stay whole. A caption without a full stop
    goes on in the next line if that is short and has none either.
    """
    text = F.regexp_replace(F.regexp_replace("text", "\r", "\n"), r"[ \t]+", " ")
    lines = articles.select("article_id", F.posexplode(F.split(text, r"\n")).alias("line_no", "line")).withColumn("line", T.strip(F.col("line")))
    lines = lines.where("line <> ''")
    head, number, caption = F.col("line").rlike(rf"^({SECTIONS})$"), F.col("line").rlike(r"^\d{1,2}$"), F.col("line").rlike(CAPTION)
    ended, w = F.col("line").rlike("[。！？!?]$"), W.partitionBy("article_id").orderBy("line_no")
    lines = lines.withColumn("section", F.coalesce(F.last(F.when(head, F.col("line")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit("")))
    lines = lines.withColumn("wrapped", F.coalesce(F.lag(caption & ~ended).over(w), F.lit(False)) & ~ended & (F.length(T.squeeze(F.col("line"))) <= 40))
    body = lines.where(~head & ~number & ~caption & ~F.col("wrapped"))
    parts = body.select("article_id", "section", "line_no", F.posexplode(F.split("line", r"(?<=[。！？!?])")).alias("k", "text")).withColumn("text", T.strip(F.col("text")))
    parts = parts.where(claim_like(F.col("text"), min_chars))
    return parts.withColumn("ordinal", F.row_number().over(W.partitionBy("article_id").orderBy("line_no", "k"))).drop("line_no", "k")


def merged_items(sentences: DataFrame) -> DataFrame:
    """(article_id, cand_id, section, text): numbered items joined to the sentence of their section that lists them.

    A fold over each article's sentences in order, as what was joined decides about the next item. Ids are of any type.
    """
    import re

    import pyarrow as pa

    numbered, cue = re.compile(NUMBERED), re.compile(LIST_CUES)

    def fold(key: tuple, t: pa.Table) -> pa.Table:
        out: list[tuple[str, str]] = []
        t = t.sort_by("ordinal")
        for section, text in zip(t["section"].to_pylist(), t["text"].to_pylist(), strict=True):
            text, (at, last) = text.strip(), out[-1] if out else (None, "")
            lists = numbered.match(last) or last.strip()[-1:] in tuple("：:；;") or cue.search(last)
            if out and at == section and numbered.match(text) and lists:
                out[-1] = (at, f"{last.rstrip('；;、，, ')}；{text}")
            else:
                out.append((section, text))
        ids = pa.array([key[0].as_py()] * len(out), t.schema.field("article_id").type)
        return pa.table([ids, pa.array(range(1, len(out) + 1), pa.int32()), pa.array([x for x, _ in out]), pa.array([x for _, x in out])], ["article_id", "cand_id", "section", "text"])

    schema = StructType([sentences.schema["article_id"], *(StructField(n, k) for n, k in (("cand_id", IntegerType()), ("section", StringType()), ("text", StringType())))])
    return sentences.groupBy("article_id").applyInArrow(fold, schema)


def article_candidates(articles: DataFrame, min_chars: int = 8) -> DataFrame:
    """The candidates of articles (article_id, text), from Markdown to merged sentences."""
    body = articles.select("article_id", without_meta_lines(clean_markdown(F.col("text"))).alias("text"))
    return merged_items(article_sentences(body, min_chars))


def drop_role(text: Column) -> Column:
    """publication_meta, discourse or fragment, or null for a candidate claim."""
    outside = F.regexp_replace(text, r"[《「“\"].*?[》」”\"]", "")
    rest = F.regexp_replace(F.regexp_replace(T.strip(text), DISCOURSE + r"[，,]?", ""), r"^[\s，,。；;]+|[\s，,。；;]+$", "")
    return (
        F.when(outside.rlike(PUBLICATION) & ~outside.rlike(SCIENCE), "publication_meta")
        .when(text.rlike(DISCOURSE_ONLY) | (rest == ""), "discourse")
        .when(text.rlike(NUMBERED) & (F.length(T.squeeze(text)) < 24), "fragment")
        .when(text.rlike(DISCOURSE) & (F.length(rest) < 16) & ~rest.rlike(SCIENCE), "fragment")
    )


def default_keep(text: Column, section: Column) -> Column:
    n = F.length(T.strip(text))
    listed = section.isin(*INTRO_SECTIONS, *SUMMARY_SECTIONS)
    return F.when(drop_role(text).isNotNull(), False).when(listed, n >= 12).when(text.rlike(SCIENCE) & (n >= 20), True).otherwise(n >= 40)


def role_guess(text: Column, section: Column) -> Column:
    """The role without a model: what the rules drop, then by section, then by cue words."""
    role = F.coalesce(drop_role(text), F.when(section.isin(*INTRO_SECTIONS), "paper_intro"), F.when(section.isin(*SUMMARY_SECTIONS), "paper_conclusion"))
    return F.coalesce(role, F.when(text.rlike(METHOD), "paper_method"), F.when(text.rlike(LEAD), "paper_lead"), F.lit("paper_result"))


def kept_by_role(role: Column) -> Column:
    return F.when(role.isin(*KEEP_ROLES), True).when(role.isin(*DROP_ROLES), False)


def decided(candidates: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """candidates (text, section, ...) with `keep` and `role`, from decisions (keys, role, keep as text).

    A known role decides, else the flag, else the default; a missing or unknown role of a kept row is guessed, a
    missing one of a dropped row is fragment.
    """
    said = F.lower(T.strip(F.col("__keep")))
    flag = F.when(said.isin("1", "true", "yes", "y", "keep"), True).when(said.isin("0", "false", "no", "n", "drop"), False)
    text, section = F.col("text"), F.coalesce("section", F.lit(""))
    rows = candidates.join(decisions.select(*keys, T.strip(F.coalesce("role", F.lit(""))).alias("__role"), F.col("keep").cast("string").alias("__keep")), keys, "left")
    rows = rows.withColumn("__role", F.coalesce("__role", F.lit(""))).withColumn("__told", F.coalesce(kept_by_role(F.col("__role")), flag))
    keep, guess, blank = F.coalesce("__told", default_keep(text, section)), role_guess(text, section), F.col("__role") == ""
    role = F.when(F.col("__told").isNull(), F.when(blank, guess).otherwise(F.col("__role")))
    role = F.coalesce(role, F.when(blank, F.when(keep, guess).otherwise("fragment")), F.when(kept_by_role(F.col("__role")).isNull() & keep, guess), F.col("__role"))
    return rows.withColumns({"keep": keep, "role": role}).drop("__role", "__keep", "__told")


def with_context(claims: DataFrame, by: str, order: list[str], text: str = "text") -> DataFrame:
    """claim_id C01.., context_before and context_after within each group."""
    w = W.partitionBy(by).orderBy(*order)
    return claims.withColumns(
        {
            "claim_id": F.format_string("C%02d", F.row_number().over(w)),
            "context_before": F.coalesce(F.lag(text).over(w), F.lit("")),
            "context_after": F.coalesce(F.lead(text).over(w), F.lit("")),
        }
    )


def carry_section(rows: DataFrame, by: str, order: str, is_head: Column, name: str) -> DataFrame:
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("section", F.coalesce(F.last(F.when(is_head, F.col(name)), ignorenulls=True).over(w), F.lit("")))


def locked(review: DataFrame, by: str, key: str = "claim_id", ordinal: str = "ordinal", text: str = "text") -> DataFrame:
    """The kept rows with the texts of rows merged into them appended by ；, in file order.

    decision drop and merge rows go; a merge into an unknown, dropped or own id is lost; other decisions keep.
    """
    merged = review.where((F.col("decision") == "merge") & (F.col("merge_into") != F.col(key)))
    texts = merged.groupBy(by, F.col("merge_into").alias(key)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, text))), lambda x: x[text]), "；").alias("more"))
    kept = review.where(~F.coalesce(F.col("decision"), F.lit("")).isin("drop", "merge"))
    return kept.join(texts, [by, key], "left").withColumn(text, F.concat_ws("；", text, "more")).drop("more")


def dedup_summaries(rows: DataFrame, overlap: float = 0.75) -> DataFrame:
    """Rows of summary sections that repeat an earlier kept row of their article go, unless they bring significance
    that the kept row nearest to them lacks.

    A fold over each article's rows in order, as a row is compared with those kept so far.
    """
    import re

    import pandas as pd

    grams = lambda t: {x for i in range(len(t) - 1) if len(x := t[i : i + 2]) == 2}

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        for i, (t, section) in enumerate(zip(p["text"], p["section"], strict=True)):
            g = grams(re.sub(r"[^0-9A-Za-z一-鿿]", "", t))
            if section in SUMMARY_SECTIONS and kept:
                near, text = max(((len(g & h) / min(len(g), len(h)) if g and h else 0.0, u) for h, u in kept), key=lambda x: x[0])
                if near >= overlap and not set(re.findall(SIGNIFICANCE, t)) - set(re.findall(SIGNIFICANCE, text)):
                    continue
            kept.append((g, t))
            out.append(i)
        return p.iloc[out]

    return rows.groupBy("article_id").applyInPandas(lambda p: fold(p.sort_values("ordinal")), rows.schema)


def pending(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: what is not done yet."""
    return all_rows.join(done.select(key).distinct(), key, "left_anti")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("x")).select(key, "x.*")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("x")).select(key, "x.*")


def two_stage_match(left: DataFrame, right: DataFrame, key: str, text: str, value: str) -> DataFrame:
    """`value` of the right row of equal key, else of equal text without white space; the later duplicate wins."""
    r = right.withColumn("__k", T.squeeze(F.col(text)))
    by_id = r.groupBy(key).agg(F.max(value).alias("__a"))
    by_text = r.groupBy("__k").agg(F.max(value).alias("__b"))
    out = left.withColumn("__k", T.squeeze(F.col(text))).join(by_id, key, "left").join(by_text, "__k", "left")
    return out.withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b", "__k")
