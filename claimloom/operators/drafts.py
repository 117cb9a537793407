"""Annotation drafts: model replies to samples, the rules they must obey, flags for review, and bounded retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import jsonish as J
from ..functions import labels as L
from ..functions import text as T
from ..sources.tables import settled

# Fixed values of the draft format.
CONFIDENCES = ("high", "medium", "low")
DIAGNOSES = ("not_applicable", "likely_retrieval_miss", "likely_claim_error", "uncertain")
DIRTY_SOURCE = r"(?i)https?://doi\.org|^\s*(nature |science |pnas )"
DIRTY_AUTHORS = r"\d{1,2},\d{1,2},\s+[A-Z][a-z]+|[A-Z][a-z]+ [A-Z]\.\s+\S+1,\d+"
MOST_GOLD = 5


def replied_samples(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """One row for each sample of each reply (a list, an object with samples, or one sample), further columns kept."""
    v = F.try_parse_json(J.repair_json(F.coalesce(T.json_block(F.col(reply)), F.col(reply))))
    single = (F.try_variant_get("v", "$.claim_id", "string").isNotNull()) | F.try_variant_get("v", "$.primary_level2", "string").isNotNull() | F.try_variant_get("v", "$.gold_classification", "variant").isNotNull()
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.samples", "array<variant>"), F.when(single, F.array("v")))
    return replies.withColumn("v", v).select(*[c for c in replies.columns if c != reply], F.posexplode(items).alias("at", "sample"))


def coerced(v: Column) -> dict[str, Column]:
    """A sample's fields under any of the names that models give them."""
    clf, gold, an = "$.gold_classification", "$.gold_retrieval", "$.analysis"
    label = lambda key, old: J.field(v, f"$.{key}_level2", f"{clf}.{key}_label.level2", f"$.{key}_label.level2", f"{clf}.{key}_label", f"$.{key}_label", f"{clf}.{old}", f"$.{old}")
    flag = lambda *paths: T.as_bool(J.field(v, *paths))
    lists = [F.try_variant_get(v, p, "array<variant>") for p in ("$.gold_sentence_ids", "$.sentence_ids", f"{gold}.sentence_ids", f"{gold}.evidences")]
    ids = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<variant>"))
    number = lambda x: F.coalesce(F.try_variant_get(x, "$", "int"), F.try_variant_get(x, "$.sentence_id", "int"))
    kinds = F.transform(F.coalesce(F.try_variant_get(v, f"{an}.key_differences", "array<variant>"), F.array().cast("array<variant>")), lambda d: F.coalesce(F.try_variant_get(d, "$.type", "string"), F.lit("")))
    return {
        "claim_id": J.field(v, "$.claim_id"),
        "gold_ids": F.array_distinct(F.filter(F.transform(ids, number), lambda i: i >= 0)),
        "is_answerable": flag("$.is_answerable", f"{gold}.is_answerable"),
        "evidence_level": F.coalesce(L.level_of(J.field(v, "$.evidence_level", f"{clf}.evidence_level")), F.lit("")),
        "has_distortion": flag("$.has_distortion", f"{clf}.has_distortion"),
        "primary": T.nullish(label("primary", "primary_type")),
        "secondary": T.nullish(F.coalesce(label("secondary", "secondary_types[0]"))),
        "severity": T.nullish(J.field(v, "$.severity", f"{clf}.severity")),
        "uncovered": F.coalesce(J.field(v, "$.uncovered_phenomenon", f"{clf}.uncovered_phenomenon"), F.lit("")),
        "reason": F.coalesce(J.field(v, "$.reason", f"{clf}.reason", f"{clf}.reasoning"), F.lit("")),
        "judgement": F.coalesce(J.field(v, f"{an}.evidence_judgement"), F.lit("")),
        "class_reason": F.coalesce(J.field(v, f"{an}.classification_reason"), F.lit("")),
        "differences": kinds,
        "top5_is_best": flag(f"{an}.rag_review.top5_is_best"),
        "diagnosis": F.coalesce(J.field(v, f"{an}.unsupported_diagnosis.verdict"), F.lit("not_applicable")),
        "needs_review": F.coalesce(flag(f"{an}.needs_manual_review"), F.lit(False)) | F.coalesce(flag(f"{clf}.needs_manual_review", "$.needs_manual_review"), F.lit(False)),
        "confidence": F.coalesce(J.field(v, f"{an}.ai_confidence"), F.lit("medium")),
    }


def rule_errors() -> Column:
    """The rules that a coerced row breaks, in order; an unknown level is the only error of its row."""
    c = F.col
    level, primary, secondary, bad = c("evidence_level"), c("primary"), c("secondary"), c("has_distortion")
    known = [*L.LEVEL1, L.NO_DISTORTION]
    has, no = level == L.EVIDENCE_LEVELS[0], level == L.EVIDENCE_LEVELS[2]
    false = lambda x: F.coalesce(x, F.lit(False))
    rules = [
        (primary.isNotNull() & ~primary.isin(known), "primary_unknown"),
        (secondary.isNotNull() & ~secondary.isin(known), "secondary_unknown"),
        ((c("uncovered") != "") & ~c("uncovered").isin(*L.UNCOVERED), "uncovered_unknown"),
        (has & ~false(c("is_answerable")), "with_evidence_not_answerable"),
        (has & (F.size("gold_ids") == 0), "with_evidence_without_ids"),
        (has & bad.isNull(), "with_evidence_undecided"),
        (has & bad & (F.coalesce(primary, F.lit(L.NO_DISTORTION)) == L.NO_DISTORTION), "distorted_without_primary"),
        (has & bad & ~false(c("severity").isin(*L.SEVERITIES[1:])), "distorted_without_severity"),
        (has & bad & secondary.eqNullSafe(primary), "secondary_is_primary"),
        (has & ~bad & ~primary.eqNullSafe(F.lit(L.NO_DISTORTION)), "undistorted_with_primary"),
        (has & ~bad & secondary.isNotNull(), "undistorted_with_secondary"),
        (has & ~bad & (F.coalesce(c("severity"), F.lit("none")) != "none"), "undistorted_with_severity"),
        (~has & ~c("is_answerable").eqNullSafe(F.lit(False)), "answerable_without_evidence"),
        (~has & bad.isNotNull(), "distortion_without_evidence"),
        (~has & primary.isNotNull(), "primary_without_evidence"),
        (~has & secondary.isNotNull(), "secondary_without_evidence"),
        (no & (F.size("gold_ids") > 0), "ids_without_evidence"),
        ((c("judgement") == "") & (c("class_reason") == ""), "analysis_empty"),
    ]
    found = F.array_compact(F.array(*[F.when(false(x), F.lit(n)) for x, n in rules]))
    return F.when(level.isin(*L.EVIDENCE_LEVELS), found).otherwise(F.array(F.lit("level_unknown")))


def validated(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """Every asked claim_id with its sample's fields and `errors`: missing, or the rules it breaks; none where valid.

    Of several samples of a claim the last in (batch, reply order) counts. Samples of claims that were not asked for
    are left out; extra_samples() counts them.
    """
    got = replied_samples(replies)
    rows = got.select(F.struct("batch", "at").alias("__at"), *[x.alias(n) for n, x in coerced(F.col("sample")).items()])
    rows = rows.where("claim_id <> ''").groupBy("claim_id").agg(F.max_by(F.struct(*[x for x in rows.columns if x not in ("claim_id", "__at")]), "__at").alias("x")).select("claim_id", "x.*")
    rows = rows.withColumn("errors", rule_errors())
    return asked.join(rows, "claim_id", "left").withColumn("errors", F.coalesce("errors", F.array(F.lit("missing"))))


def extra_samples(asked: DataFrame, replies: DataFrame) -> DataFrame:
    ids = replied_samples(replies).select(J.field(F.col("sample"), "$.claim_id").alias("claim_id")).distinct()
    return ids.join(asked.select("claim_id").distinct(), "claim_id", "left_anti")


def is_dirty(sentence_id: Column, text: Column) -> Column:
    """Sentences of front matter: id 0, sources, or author marks in a short text."""
    return (sentence_id == 0) | text.rlike(DIRTY_SOURCE) | (text.rlike(DIRTY_AUTHORS) & (F.length(text) < 280))


def flagged(samples: DataFrame, pool: DataFrame, sentences: DataFrame) -> DataFrame:
    """Valid samples with `evidences`, `flags` and the final `needs_review`, `severity` and `top5_is_best`.

    pool: claim_id, sentence_id, text, rank (from 1). sentences: sentence_id, text. Gold ids are looked up in the
    claim's pool and then in the sentence table.
    """
    gold = samples.select("claim_id", F.posexplode("gold_ids").alias("at", "sentence_id"))
    here = pool.groupBy("claim_id", "sentence_id").agg(F.min_by("text", "rank").alias("pool_text"), F.min("rank").alias("rank"))
    found = gold.join(here, ["claim_id", "sentence_id"], "left").join(sentences.groupBy("sentence_id").agg(F.first("text").alias("table_text")), "sentence_id", "left")
    text = F.coalesce("pool_text", "table_text", F.lit(""))
    sid = F.col("sentence_id").cast("string")
    out = F.when(F.col("pool_text").isNull(), F.concat(F.when(F.col("table_text").isNotNull(), F.lit("outside_pool:")).otherwise(F.lit("unknown_id:")), sid))
    marks = F.array_compact(F.array(out, F.when(is_dirty(F.col("sentence_id"), text), F.concat(F.lit("dirty:"), sid))))
    found = found.select("claim_id", "at", F.struct("sentence_id", text.alias("text")).alias("e"), marks.alias("marks"), F.coalesce(F.col("rank") <= 5, F.lit(False)).alias("top"))
    in_order = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("at", x))), lambda y: y[x])
    found = found.groupBy("claim_id").agg(in_order("e").alias("evidences"), F.flatten(in_order("marks")).alias("marks"), F.count_if("top").alias("in_top"))
    rows = samples.join(found, "claim_id", "left").withColumn("in_top", F.coalesce("in_top", F.lit(0)))
    c, has = F.col, F.col("evidence_level") == L.EVIDENCE_LEVELS[0]
    cited = T.cited_ids(F.concat_ws(" ", "judgement", "class_reason", "reason"))
    astray = F.array_except(cited, "gold_ids")
    rules = [
        (has & (F.size("gold_ids") > MOST_GOLD), F.lit("too_many_gold_ids")),
        (~c("confidence").isin(*CONFIDENCES), F.lit("confidence_unknown")),
        (~c("diagnosis").isin(*DIAGNOSES), F.lit("diagnosis_unknown")),
        (c("has_distortion") & (F.size("differences") == 0), F.lit("differences_missing")),
        (c("has_distortion") & c("primary").isNotNull() & ~F.array_contains("differences", c("primary")), F.lit("primary_not_in_differences")),
        (c("secondary").isNotNull() & ~F.array_contains("differences", c("secondary")), F.lit("secondary_not_in_differences")),
        (F.size(astray) > 0, F.concat(F.lit("cited_not_gold:"), F.array_join(astray.cast("array<string>"), ","))),
        (has & (F.size("gold_ids") > 0) & (c("in_top") == 0) & c("top5_is_best"), F.lit("top5_is_best_contradicted")),
    ]
    flags = F.concat(F.coalesce("marks", F.array().cast("array<string>")), F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), n) for x, n in rules])))
    rows = rows.withColumn("flags", flags).withColumn("confidence", F.when(c("confidence").isin(*CONFIDENCES), c("confidence")).otherwise("medium"))
    return rows.withColumns(
        {
            "evidences": F.coalesce("evidences", F.array().cast("array<struct<sentence_id:int,text:string>>")),
            "needs_review": c("needs_review") | (c("confidence") != "high") | (c("uncovered") != "") | (F.size("flags") > 0),
            "diagnosis": F.when(c("diagnosis").isin(*DIAGNOSES), c("diagnosis")).otherwise("uncertain"),
            "severity": F.when(~has, F.lit(None)).when(~c("has_distortion"), F.lit("none")).otherwise(c("severity")),
            "top5_is_best": F.coalesce("top5_is_best", (F.size("gold_ids") > 0) & (c("in_top") == F.size("gold_ids"))),
        }
    ).drop("marks", "in_top")


def draft(claims: DataFrame, by: str, generate: Callable[[DataFrame, int], DataFrame], size: int = 3, retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(valid samples, failed claims with their errors) of a model asked for batches of claims.

    generate(rows, attempt) gets claim_id, the claims' columns, batch and the errors so far, and returns batch, reply.
    Batches hold claims of one `by`. A round asks for all open claims at once; those that fail are asked again, after retries + 1 rounds one by one. Each
    round's replies are written before they are judged, so that no model is paid twice for a lost task.
    """
    valid, tried = [], claims.withColumn("errors", F.array().cast("array<string>"))
    for attempt in range(2 * (retries + 1)):
        each = size if attempt <= retries else 1
        place = F.floor((F.row_number().over(W.partitionBy(by).orderBy("claim_id")) - 1) / each)
        asked = settled(tried.withColumn("batch", F.concat_ws(":", by, place)), "asked")
        replies = settled(generate(asked, attempt), "replies")
        judged = settled(validated(asked.drop("errors", "batch"), replies), "judged")
        valid.append(judged.where(F.size("errors") == 0).drop("errors"))
        tried = settled(judged.where(F.size("errors") > 0).select(*claims.columns, "errors"), "open")
        if tried.isEmpty():
            break
    out = valid[0]
    for x in valid[1:]:
        out = out.unionByName(x)
    return out, tried
