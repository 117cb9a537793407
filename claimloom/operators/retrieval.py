"""Retrieval operators: keyword and dense search, merging, neighbours, diversity, board, gate and evidence.

All take whole relations of claims or queries: there is no loop over claims. Ties are always broken by position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

SUPPORTED, INCONCLUSIVE, NO_EVIDENCE = "SUPPORTED", "INCONCLUSIVE", "NO_EVIDENCE"


@dataclass(frozen=True)
class Thresholds:
    high: float = 0.70
    low: float = 0.30
    min_hits: int = 2
    keep: float = 0.08

    def __post_init__(self):
        if not (0 <= self.low < self.high <= 1 and self.min_hits >= 1):
            raise ValueError("thresholds need 0 <= low < high <= 1 and min_hits >= 1")


def keyword_search(chunks: DataFrame, keywords: list[str], top_k: int = 5, id_col: str = "chunk_id", text: str = "text") -> DataFrame:
    """Chunks by the sum of count * length over the keywords, positive only, at most 20, ties in chunk order.

    The keywords are literals of one projection: no join, no shuffle before the final top-k.
    """
    counts = F.array(*[F.struct(F.lit(k).alias("k"), T.occurrences(F.col(text), F.lit(k)).alias("n")) for k in keywords])
    scored = chunks.withColumn("hits", F.filter(counts, lambda x: x["n"] > 0))
    scored = scored.withColumn("score", F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["n"] * F.length(x["k"])))
    return scored.where("score > 0").orderBy(F.desc("score"), id_col).limit(max(1, min(20, top_k)))


def snippets(hits: DataFrame, text: str = "text", limit: int = 5) -> DataFrame:
    """The first naive sentences that hold a matched keyword."""
    held = F.filter(T.naive_sentences(F.col(text)), lambda s: F.exists("hits", lambda h: F.contains(F.lower(s), F.lower(h["k"]))))
    return hits.withColumn("snippets", F.slice(held, 1, limit))


def best_rows(best: pd.DataFrame | None, got: pd.DataFrame, least: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of each q by score, then id; `least` (each q's k-th score so far, ties pass) is brought up to date."""
    got = got[got["score"].to_numpy() >= least[got["q"].to_numpy()]]
    if best is not None and not len(got):
        return best
    best = (got if best is None else pd.concat([best, got])).sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(k)
    kth = best.groupby("q")["score"].agg(["size", "min"])
    kth = kth[kth["size"] == k]
    least[kth.index.to_numpy()] = kth["min"].to_numpy()
    return best


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, most_queries: int = 4096) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine top-k of each (query_id, q) among (vec_id, v).

    The queries are dealt into blocks of at most most_queries, whatever their number; each block goes to the tasks as one
    matrix in a pass of its own over the vectors. A task keeps its best k of each query, so the shuffle before the final
    ranks has k rows for each query and task.
    """
    if most_queries < 1:
        raise ValueError("most_queries must be at least 1")
    held = queries.select("query_id", T.l2_normalise(F.col("q")).alias("q")).collect()

    def block(rows: list) -> DataFrame:
        ids = np.array([r["query_id"] for r in rows], np.int64)
        m = np.array([r["q"] for r in rows], np.float64)
        step = max(1, 2**20 // len(ids))  # vectors at a time: a task holds about a million scores

        def run(parts):
            best, least = None, np.full(len(ids), -np.inf)
            for p in parts:
                v, names = np.stack(p["v"].to_numpy()).astype(np.float64), p["vec_id"].to_numpy()
                norm = np.sqrt((v * v).sum(1))
                v /= np.where(norm > 0, norm, 1)[:, None]
                for at in range(0, len(v), step):
                    s = np.round(m @ v[at : at + step].T, 6) + 0.0
                    q, i = np.nonzero(s >= least[:, None])
                    best = best_rows(best, pd.DataFrame({"q": q, "id": names[at : at + step][i], "score": s[q, i]}), least, k)
            if best is not None and len(best):
                yield pd.DataFrame({"query_id": ids[best["q"].to_numpy()], "vec_id": best["id"].to_numpy(), "score": best["score"].to_numpy()})

        return vectors.select("vec_id", "v").mapInPandas(run, "query_id long, vec_id long, score double")

    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for at in range(0, len(held), most_queries):
        rows = block(held[at : at + most_queries])
        found = found.unionByName(rows) if at else rows
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_hits(lists: list[DataFrame], key: list[str], score: str = "score") -> DataFrame:
    """The union of hit lists with each key's highest score."""
    union = lists[0].select(*key, score)
    for x in lists[1:]:
        union = union.unionByName(x.select(*key, score))
    return union.groupBy(*key).agg(F.max(score).alias(score))


def keep_filter(ranked: DataFrame, by: str, score: str = "rerank_score", keep: float = 0.08) -> DataFrame:
    """Scores of at least keep; where a group has none, its first alone."""
    w = W.partitionBy(by).orderBy(F.desc(score), "sentence_id")
    return ranked.withColumn("__n", F.row_number().over(w)).where((F.col(score) >= keep) | ((F.col("__n") == 1))).drop("__n")


def rerank_by_tokens(pairs: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """The local stand-in of a cross-encoder: Jaccard of token sets, to six places."""
    return pairs.withColumn("rerank_score", F.round(T.jaccard(T.token_set(F.col(query)), T.token_set(F.col(text))), 6))


def expand_neighbours(hits: DataFrame, sentences: DataFrame, window: int = 1, decay: float = 0.5, keep: float = 0.08) -> DataFrame:
    """Hits and their neighbours within a chunk; a sentence keeps its highest score.

    hits: query_id, chunk_id, offset, score. sentences: chunk_id, offset, sentence_id. The range join is an equi-join:
    every hit is exploded to its 2 * window + 1 places first.
    """
    near = hits.select("query_id", "chunk_id", "score", F.col("offset").alias("at"), F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("d"))
    near = near.select("query_id", "chunk_id", (F.col("at") + F.col("d")).alias("offset"), F.round(F.col("score") * F.pow(F.lit(decay), F.abs("d")), 6).alias("score")).where(F.col("score") >= keep)
    best = near.groupBy("query_id", "chunk_id", "offset").agg(F.max("score").alias("score"))
    return best.join(sentences.select("chunk_id", "offset", "sentence_id"), ["chunk_id", "offset"])


def mmr(candidates: DataFrame, k: int, lam: float = 0.3) -> DataFrame:
    """(query_id, sentence_id, pick): greedy choice of (1 - lam) * relevance - lam * highest Jaccard to what is chosen.

    candidates: query_id, sentence_id, score, tokens; a query's candidates are bounded by its recall budget.
    """
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "sentence_id")
    ranked = candidates.withColumn("rn", F.row_number().over(w))
    items = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", "sentence_id", "score", "tokens"))).alias("c"))

    def value(x, chosen):
        near = F.aggregate(chosen, F.lit(0.0), lambda a, y: F.greatest(a, T.jaccard(x["tokens"], y["tokens"])))
        return F.when(F.size(chosen) == 0, x["score"]).otherwise((1 - lam) * x["score"] - lam * near)

    def step(chosen, _):
        left = F.filter("c", lambda x: ~F.exists(chosen, lambda y: y["rn"] == x["rn"]))
        best = F.array_max(F.transform(left, lambda x: F.struct(value(x, chosen).alias("v"), (-x["rn"]).alias("o"))))
        return F.concat(chosen, F.array(F.get("c", -best["o"] - 1)))  # rn is the place in c; best is worked out once

    start = F.filter("c", lambda x: F.lit(False))
    prefix = F.slice("c", 1, k)
    chosen = prefix if lam == 0 else F.when(F.size("c") <= k, prefix).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step))
    return items.select("query_id", F.posexplode(chosen).alias("pick", "x")).select("query_id", "x.sentence_id", (F.col("pick") + 1).alias("pick"))


def board_dedup(candidates: DataFrame, key: list[str], score: str = "rerank_score", order: str = "round_index") -> DataFrame:
    """One row a key: the highest score, then the earliest round."""
    w = W.partitionBy(*key).orderBy(F.desc(score), order)
    return candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def label(score: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(score >= t.high, SUPPORTED).when(score < t.low, NO_EVIDENCE).otherwise(INCONCLUSIVE)


def gate(claims: DataFrame, scores: DataFrame, t: Thresholds = Thresholds(), round_index: int | None = None, max_rounds: int | None = None) -> DataFrame:
    """A decision for every claim_id, those without candidates included."""
    s = F.col("score")
    agg = scores.groupBy("claim_id").agg(F.count("*").alias("n"), F.count_if(s >= t.high).alias("strong"), F.max("score").alias("top"))
    rows = claims.select("claim_id").join(agg, "claim_id", "left").select("claim_id", F.coalesce("n", F.lit(0)).alias("candidate_count"), F.coalesce("strong", F.lit(0)).alias("strong_hits"), F.coalesce("top", F.lit(0.0)).alias("top_score"))
    none, strong, weak = F.col("candidate_count") == 0, F.col("strong_hits") >= t.min_hits, F.col("top_score") < t.low
    over = F.lit(bool(max_rounds is not None and round_index is not None and round_index >= max_rounds))
    return rows.withColumns(
        {
            "verdict": F.when(none, NO_EVIDENCE).when(strong, SUPPORTED).when(weak, NO_EVIDENCE).otherwise(INCONCLUSIVE),
            "should_stop": none | strong | weak | over,
            "reason": F.when(none, "no_candidate_retrieved").when(strong, "high_threshold_met").when(weak, "low_threshold_all_below").when(over, "round_limit_reached").otherwise("continue_search"),
        }
    )


def paragraph_context(sentences: DataFrame, window: int = 2) -> DataFrame:
    """prev_text and next_text: up to `window` sentences of the same chunk on either side, joined by spaces."""
    w = W.partitionBy("chunk_id").orderBy("offset")
    before, after = F.collect_list("text").over(w.rowsBetween(-window, -1)), F.collect_list("text").over(w.rowsBetween(1, window))
    return sentences.withColumns({"prev_text": F.array_join(before, " "), "next_text": F.array_join(after, " ")})


def resolve_text(texts: DataFrame, sentences: DataFrame, words: int = 3) -> DataFrame:
    """(item_id, sentence_id): the first sentence that contains the text or lies in it, else -1.

    Instead of a nested loop over all pairs, both sides are blocked by their words' runs: a containment of plain texts
    shares every inner run of `words` words. Texts of fewer words than that are compared by the loop, as they are few.
    """
    runs = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - words + 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, words), " "))
    norm = lambda df, key: df.select(key, T.plain(F.col("text")).alias("p")).withColumn("w", F.split("p", " "))
    a, b = norm(texts, "item_id"), norm(sentences, "sentence_id")
    inner = lambda w: F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(1)))
    # The shorter text's second run is whole in the longer one.
    key = lambda w: F.array_join(F.slice(inner(w), 1, words), " ")
    one = a.where(F.size("w") >= words + 2).select("item_id", F.col("p").alias("pa"), key(F.col("w")).alias("g"))
    all_b = b.select("sentence_id", F.col("p").alias("pb"), F.explode(F.array_distinct(runs(F.col("w")))).alias("g"))
    two = b.where(F.size("w") >= words + 2).select("sentence_id", F.col("p").alias("pb"), key(F.col("w")).alias("g"))
    all_a = a.select("item_id", F.col("p").alias("pa"), F.explode(F.array_distinct(runs(F.col("w")))).alias("g"))
    met = one.join(all_b, "g").where(F.contains("pb", "pa")).select("item_id", "sentence_id").union(all_a.join(two, "g").where(F.contains("pa", "pb")).select("item_id", "sentence_id"))
    short_a, short_b = a.where(F.size("w") < words + 2), b.where(F.size("w") < words + 2)
    loop = lambda x, y: x.select("item_id", F.col("p").alias("pa")).join(y.select("sentence_id", F.col("p").alias("pb")), F.contains("pa", "pb") | F.contains("pb", "pa")).select("item_id", "sentence_id")
    met = met.union(loop(short_a, b)).union(loop(a, short_b))
    low = met.groupBy("item_id").agg(F.min("sentence_id").alias("sentence_id"))
    return texts.select("item_id").join(low, "item_id", "left").select("item_id", F.coalesce("sentence_id", F.lit(-1)).alias("sentence_id"))


def pools(evidences: DataFrame, classify: int = 5, review: int = 10) -> DataFrame:
    """(claim_id, classify_ids, review_ids): first occurrences by rank; the smaller pool is a prefix of the larger."""
    first = evidences.groupBy("claim_id", "sentence_id").agg(F.min("rank").alias("rank"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence_id"))), lambda x: x["sentence_id"])
    return first.groupBy("claim_id").agg(ids.alias("ids")).select("claim_id", F.slice("ids", 1, classify).alias("classify_ids"), F.slice("ids", 1, review).alias("review_ids"))
