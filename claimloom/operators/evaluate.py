"""Evaluation: retrieval at k, label accuracies, confusion, micro scores and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def retrieval_metrics(gold: Column, predicted: Column, k: int) -> Column:
    """hit, recall and precision at k. Without gold all are 1 if nothing is predicted, else 0."""
    top = F.slice(predicted, 1, k)
    n_hit = F.size(F.array_intersect(gold, top))
    in_gold = F.size(F.filter(top, lambda x: F.array_contains(gold, x)))
    bare = F.when(F.size(top) == 0, 1.0).otherwise(0.0)
    pick = lambda x: F.when(F.size(gold) == 0, bare).otherwise(x)
    return F.struct(
        pick((n_hit > 0).cast("double")).alias("hit"),
        pick(n_hit / F.size(gold)).alias("recall"),
        pick(F.when(F.size(top) == 0, 0.0).otherwise(in_gold / F.size(top))).alias("precision"),
    )


def answers_held(docs: DataFrame, golds: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, items): for every document, the item_ids whose normal answer its own normal text contains.

    An answer's inner words are whole words of a text that contains it, so both sides meet by the answer's second run of
    `words` words; answers of fewer than words + 2 are compared with every text, as they are few.
    """
    a = golds.select("item_id", T.normal_answer(F.col("text")).alias("g")).where("g <> ''").withColumn("w", F.split("g", " "))
    b = docs.select("doc_id", T.normal_answer(F.col("text")).alias("p")).where("p <> ''")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, words), " "))
    long = a.where(F.size("w") >= words + 2).select("item_id", "g", F.array_join(F.slice("w", 2, words), " ").alias("key"))
    keys = b.withColumn("w", F.split("p", " ")).select("doc_id", F.explode(F.array_distinct(runs)).alias("key"))  # without the text, which a row a run would copy
    may = keys.join(long, "key").select("doc_id", "item_id", "g")
    met = b.join(may, "doc_id").where(F.contains("p", "g")).select("doc_id", "item_id")
    met = met.union(b.join(a.where(F.size("w") < words + 2), F.contains("p", "g")).select("doc_id", "item_id"))
    lists = met.groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return docs.select("doc_id").join(lists, "doc_id", "left").select("doc_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def accuracy(gold: Column, predicted: Column, counts: Column | None = None) -> Column:
    """Share of equal values among the rows that count, 0 without any."""
    equal = F.coalesce(gold.eqNullSafe(predicted), F.lit(False)).cast("double")
    return F.coalesce(F.avg(equal if counts is None else F.when(counts, equal)), F.lit(0.0))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def micro_f1(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Micro precision, recall and F1 of label sets (arrays)."""
    s = rows.agg(F.sum(F.size(F.array_intersect(gold, predicted))).alias("tp"), F.sum(F.size(predicted)).alias("p"), F.sum(F.size(gold)).alias("g"))
    div = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    s = s.withColumns({"precision": div("tp", "p"), "recall": div("tp", "g")})
    return s.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


ACCURACIES = ("evidence_level", "primary", "level1", "has_distortion", "is_accurate", "severity")


def accuracies(rows: DataFrame, gold: str = "gold", predicted: str = "pred") -> DataFrame:
    """One row: the six accuracies over the rows that count for each, of structs with the fields of ACCURACIES.

    A level, primary label or severity counts where gold has one, the flags where both sides have them, level1 where
    both are not empty.
    """
    out = []
    for name in ACCURACIES:
        g, p = F.col(f"{gold}.{name}"), F.col(f"{predicted}.{name}")
        counts = g.isNotNull()
        if name in ("has_distortion", "is_accurate", "level1"):
            counts &= p.isNotNull()
        if name == "level1":
            counts &= (g != "") & (p != "")
        out.append(accuracy(g, p, counts).alias(f"{name}_accuracy"))
    return rows.agg(*out)


def id_issues(cited: DataFrame, sentences: DataFrame) -> DataFrame:
    """cited (sentence_id, text, ...) with `issue`: missing_in_table, text_mismatch or null, against (sentence_id, text)."""
    table = sentences.select("sentence_id", F.col("text").alias("__known"))
    said = F.coalesce("text", F.lit("")) != ""
    issue = F.when(F.col("__known").isNull(), "missing_in_table").when(said & ~T.texts_align(F.col("text"), F.col("__known")), "text_mismatch")
    return cited.join(table, "sentence_id", "left").withColumn("issue", issue).drop("__known")


def integrity(cited: DataFrame, sentences: DataFrame, expected: str = "", actual: str = "") -> DataFrame:
    """One row: counts of the issues, and whether two stated index versions differ."""
    issues = id_issues(cited, sentences)
    count = lambda x: F.count_if(F.col("issue") == x)
    other = bool(expected and actual and expected != actual)
    return issues.agg(count("text_mismatch").alias("id_text_mismatches"), count("missing_in_table").alias("ids_missing_in_table"), F.lit(other).alias("version_mismatch"))


def qa_status(answer: Column) -> Column:
    return F.when(T.strip(F.coalesce(answer, F.lit(""))) != "", "answered").otherwise("failed")


def qa_summary(rows: DataFrame, judged: str = "judged") -> DataFrame:
    """One row over (answer, gold, `judged`, cost, retrieved_tokens, loops): accuracies are over answered rows alone."""
    ok = qa_status(F.col("answer")) == "answered"
    part = lambda x: F.coalesce(F.try_divide(F.sum(F.when(ok, x).otherwise(0.0)), F.count_if(ok)), F.lit(0.0))
    mean = lambda c, d: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(0))), F.lit(0.0)), d)
    return rows.agg(
        F.count("*").alias("total_samples"),
        F.count_if(ok).alias("answered_samples"),
        F.count_if(~ok).alias("failed_samples"),
        F.round(F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)), 4).alias("answer_rate"),
        part(F.col(judged).cast("double")).alias("llm_accuracy"),
        part(T.contains_answer(F.col("answer"), F.col("gold")).cast("double")).alias("contain_accuracy"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"),
        mean("cost", 6).alias("avg_cost_per_question"),
        mean("retrieved_tokens", 1).alias("avg_retrieved_tokens"),
        mean("loops", 2).alias("avg_loops"),
    )


def verdict_summary(records: DataFrame) -> DataFrame:
    """One row over (verdict, evidence_count, cost, error): what a batch of claims came to."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    return records.agg(
        F.count("*").alias("claims"),
        *[of(v).alias(v.lower()) for v in ("SUPPORTED", "INCONCLUSIVE", "NO_EVIDENCE")],
        F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("evidences"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
    )


def macro_retrieval(rows: DataFrame) -> DataFrame:
    """One row: the means of (hit, recall, precision) over the matched samples, 0 without any."""
    return rows.agg(F.count("*").alias("matched"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_at_k") for c in ("hit", "recall", "precision")])


def discounted_cost(prompt: Column, cached: Column, completion: Column, price: Column, cached_price: Column, out_price: Column, per: int = 1_000_000) -> Column:
    """Cost of a call whose cached prompt tokens have a price of their own, to six places."""
    fresh = F.greatest(prompt - F.coalesce(cached, F.lit(0)), F.lit(0))
    return F.round((fresh * price + F.coalesce(cached, F.lit(0)) * cached_price + completion * out_price) / per, 6)


def model_cost(usage: DataFrame, prices: list[tuple[str, float]], model: str, tokens: str) -> DataFrame:
    """cost by the first price whose key the model's name contains, to six places; unknown models cost nothing."""
    price = F.lit(0.0)
    for key, value in reversed(prices):
        price = F.when(F.contains(F.lower(F.col(model)), F.lit(key)), F.lit(value)).otherwise(price)
    return usage.withColumn("cost", F.round(F.col(tokens) * price / 1000, 6))
