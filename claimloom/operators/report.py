"""Reports and readable texts: the Markdown report of an article, its counts, wrapped texts and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L


def report_counts(rows: DataFrame, by: str) -> DataFrame:
    """(by, total, one column a level, distorted, unverifiable) over rows (evidence_level, has_distortion, primary)."""
    level = lambda v: F.count_if(F.col("evidence_level") == v)
    return rows.groupBy(by).agg(
        F.count("*").alias("total"),
        *[level(v).alias(v.lower()) for v in L.EVIDENCE_LEVELS],
        F.count_if("has_distortion").alias("distorted"),
        F.count_if(F.col("has_distortion").isNull()).alias("unverifiable"),
    )


def chain_report(rows: DataFrame, by: str, order: str) -> DataFrame:
    """(by, markdown): counts, then each claim in order with its level, label and evidence texts.

    rows: by, order, claim, evidence_level, has_distortion, primary, evidences array<string>. A group is one article.
    """
    bullets = F.array_join(F.transform(F.coalesce("evidences", F.array().cast("array<string>")), lambda e: F.concat(F.lit("  - "), e)), "\n")
    state = F.when(F.col("has_distortion").isNull(), "not applicable").when(F.col("has_distortion"), F.concat(F.lit("distorted: "), "primary")).otherwise("accurate")
    item = F.concat(F.lit("## "), F.col(order).cast("string"), F.lit("\n"), F.col("claim"), F.lit("\n- level: "), F.coalesce("evidence_level", F.lit("Unknown")), F.lit("\n- state: "), state, F.when(F.length(bullets) > 0, F.concat(F.lit("\n- evidence:\n"), bullets)).otherwise(""))
    items = rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("t")))), lambda x: x["t"]), "\n\n").alias("items"))
    head = F.concat(F.lit("# Evidence report\n\nclaims: "), F.col("total"), *[x for v in L.EVIDENCE_LEVELS for x in (F.lit(f"\n{v}: "), F.col(v.lower()))], F.lit("\ndistorted: "), F.col("distorted"), F.lit("\nunverifiable: "), F.col("unverifiable"))
    return report_counts(rows, by).join(items, by).select(by, F.concat(head, F.lit("\n\n"), "items").alias("markdown"))


def unwrap(text: Column) -> Column:
    """A wrapped text in one line: line feeds go with the indentation after them."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r", ""), r"\n[ \t]+(?=\S)", ""), "\n", "")


def wrap(text: Column, width: int = 45) -> Column:
    """Lines of `width` characters, of which none but the first starts with white space: it ends the line before."""
    lines = F.regexp_replace(unwrap(text), rf"(?s)(.{{{width}}})(?=.)", "$1\n")
    return F.regexp_replace(lines, r"\n([ \t]+)", "$1\n")


def evidence_text(english: Column, text: Column, sentence: Column, target: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (english, text, sentence, target)], F.lit(""))


def lint(samples: DataFrame) -> DataFrame:
    """(sample_id, problem) of samples (sample_id, raw, human_verified as text): what a readable file must not have."""
    rules = {
        "unreadable": F.try_parse_json("raw").isNull(),
        "trailing_comma": F.col("raw").rlike(r",\s*[}\]]"),
        "full_width_comma": F.col("raw").rlike('"\\s*，\\s*"'),
        "human_verified": ~F.lower(F.coalesce("human_verified", F.lit("false"))).isin("true", "false"),
        "no_id": F.coalesce("sample_id", F.lit("")) == "",
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return samples.select("sample_id", F.explode(found).alias("problem"))


def review_queue(samples: DataFrame) -> DataFrame:
    """The samples (sample_id, human_verified, confidence, flags, uncovered) that a person has to look at, in order of claims."""
    asks = ~F.coalesce("human_verified", F.lit(False)) & ((F.coalesce("confidence", F.lit("")) != "high") | (F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0) | (F.coalesce("uncovered", F.lit("")) != ""))
    return samples.where(asks).select("sample_id").orderBy(F.regexp_extract("sample_id", r"C(\d+)$", 1).try_cast("int"), "sample_id")


def readable_into_draft(draft: DataFrame, readable: DataFrame, key: str = "sample_id") -> DataFrame:
    """draft with the readable file's values where it has any; rows that only it has are left out."""
    fields = [c for c in readable.columns if c != key and c in draft.columns]
    said = readable.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    return draft.join(said, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in draft.columns])
