"""Evidence search over whole sets of claims: one search as a plan, and rounds of it until the gate stops every claim."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..sources.tables import settled
from . import retrieval as R


def term_query(terms: Column, most: int = 6) -> Column:
    """The first `most` terms, distinct whatever their case, joined by spaces: the second query of a search."""
    low = F.transform(terms, lambda x: F.lower(T.strip(x)))
    first = F.filter(F.transform(terms, lambda x, i: F.when((F.array_position(low, F.lower(T.strip(x))) == i + 1) & (T.strip(x) != ""), T.strip(x))), lambda x: x.isNotNull())
    return F.array_join(F.slice(first, 1, most), " ")


def recall_budget(top_k: int | None, multiplier: int = 5) -> tuple[int, int]:
    """(k, recall): k between 1 and 20 (10 if not given), recall its multiple."""
    k = max(1, min(20, 10 if top_k is None else top_k))
    return k, k * multiplier


@dataclass(frozen=True)
class TokenIndex:
    """The sentences that hold a word of the queries, as codes of those words, and each code's rarity."""

    codes: dict[str, int]
    rarity: np.ndarray
    coded: DataFrame  # sentence_id, codes


def token_index(queries: DataFrame, sentences: DataFrame) -> TokenIndex:
    """One pass over the sentences: words of every length, hot ones included; rarity is ln(1 + sentences / sentences with it)."""
    words = sorted(r["t"] for r in queries.select(F.explode(T.token_set(F.col("query"))).alias("t")).distinct().collect())
    kind = sentences.schema["sentence_id"].dataType.simpleString()

    def run(batches):
        held = pa.array(words, pa.string())
        for b in batches:
            lists = b.column(1)
            at = pc.index_in(lists.flatten(), value_set=held)
            row = pc.list_parent_indices(lists).to_numpy()
            known = at.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.bincount(row[known], minlength=b.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, at.drop_null().cast(pa.int32()))], ["sentence_id", "codes"])

    coded = settled(sentences.select("sentence_id", T.token_set(F.col("text")).alias("t")).mapInArrow(run, f"sentence_id {kind}, codes array<int>"), "coded")
    n = np.ones(len(words))
    for r in coded.select(F.explode("codes").alias("c")).groupBy("c").count().collect():
        n[r["c"]] = r["count"]
    return TokenIndex({w: i for i, w in enumerate(words)}, np.log1p(coded.count() / n), coded.where(F.size("codes") > 0))


def keyword_recall(queries: DataFrame, index: TokenIndex, limit: int, most_queries: int = 4096) -> DataFrame:
    """(query_id, sentence_id, score): the `limit` sentences that share most of the query's words by rarity, ties by id.

    Stands in for dense recall where there are no vectors. Words of every length count. Queries go to the tasks in blocks
    of most_queries; a task keeps its best `limit` of each, so no hot word is ever a key of a shuffle.
    """
    held = queries.select("query_id", T.token_set(F.col("query")).alias("t")).collect()
    kinds = ", ".join(f"{c} {t.simpleString()}" for c, t in (("query_id", queries.schema["query_id"].dataType), ("sentence_id", index.coded.schema["sentence_id"].dataType)))

    def block(rows: list) -> DataFrame:
        lists = [np.array([index.codes[t] for t in r["t"] if t in index.codes], np.int64) for r in rows]
        code, q = np.concatenate(lists), np.repeat(np.arange(len(rows)), [len(x) for x in lists])
        weight = index.rarity[code]
        weight = weight / np.bincount(q, weights=weight, minlength=len(rows))[q]
        size = np.bincount(code, minlength=len(index.codes))
        # The words of most work, by sentences and queries, are columns of one matrix; others add up pair by pair.
        hot = np.argsort(-size * np.expm1(index.rarity) ** -1.0, kind="stable")[:64]
        place = np.full(len(index.codes), -1)
        place[hot] = np.arange(len(hot))
        wide = np.zeros((len(hot), len(rows)))
        wide[place[code[place[code] >= 0]], q[place[code] >= 0]] = weight[place[code] >= 0]
        order = np.argsort(code, kind="stable")
        start, q_of, w_of = np.cumsum(size) - size, q[order], weight[order]
        ids, n = [r["query_id"] for r in rows], len(rows)
        step = max(1, 2**20 // n)  # sentences at a time: a task holds about a million scores

        def run(batches):
            best, least = None, np.zeros(n)
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    c, row = b.column(1).flatten().to_numpy(), pc.list_parent_indices(b.column(1)).to_numpy()
                    m = place[c] >= 0
                    x = np.zeros((b.num_rows, len(hot)))
                    x[row[m], place[c[m]]] = 1
                    s = x @ wide
                    c, row = c[~m], row[~m]
                    many = size[c]
                    entry = np.arange(many.sum()) + np.repeat(start[c] - (np.cumsum(many) - many), many)
                    s += np.bincount(np.repeat(row, many) * n + q_of[entry], weights=w_of[entry], minlength=s.size).reshape(s.shape)
                    i, k = np.nonzero((s > 0) & (s >= least - 1e-6))
                    names = b.column(0).to_numpy(zero_copy_only=False)
                    best = R.best_rows(best, pd.DataFrame({"q": k, "id": names[i], "score": np.round(s[i, k], 6)}), least, limit)
            if best is not None and len(best):
                yield pa.RecordBatch.from_arrays([pa.array(best["q"].to_numpy(), pa.int32()), pa.array(best["id"]), pa.array(best["score"].to_numpy())], ["q", "sentence_id", "score"])

        names = index.coded.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"q int, {kinds.rsplit(', ', 1)[0]}")
        found = index.coded.select("sentence_id", "codes").mapInArrow(run, f"q int, {kinds.rsplit(', ', 1)[1]}, score double")
        return found.join(F.broadcast(names), "q").select("query_id", "sentence_id", "score")

    met = index.coded.sparkSession.createDataFrame([], f"{kinds}, score double")
    for at in range(0, len(held), most_queries):
        rows = block(held[at : at + most_queries])
        met = met.unionByName(rows) if at else rows
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "sentence_id")
    return met.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def recall_union(primary: DataFrame, secondary: DataFrame | None, limit: int) -> DataFrame:
    """Both recalls' best score for each sentence, cut to `limit` a query; the second gives max(limit / 2, min(20, limit))."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "sentence_id")
    lists = [primary]
    if secondary is not None:
        share = max(limit // 2, min(20, limit))
        lists.append(secondary.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= share))
    return R.merge_hits(lists, ["query_id", "sentence_id"]).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def semantic_search(queries: DataFrame, sentences: DataFrame, recalled: DataFrame, rerank: Callable[[DataFrame], DataFrame] = R.rerank_by_tokens, top_k: int | None = None, keep: float = 0.08, window: int = 1, lam: float = 0.3) -> DataFrame:
    """(query_id, chunk_id, sentence_id, rerank_score, pick): rerank, keep, neighbours, diversity.

    queries: query_id, query. sentences: sentence_id, chunk_id, offset, text. recalled: query_id, sentence_id, score, of
    bounded size a query. Everything is reranked with the original query, whatever query recalled it.
    """
    k, _ = recall_budget(top_k)
    pairs = recalled.select("query_id", "sentence_id").join(sentences, "sentence_id").join(queries.select("query_id", "query"), "query_id")
    kept = R.keep_filter(rerank(pairs), "query_id", keep=keep)
    hits = kept.select("query_id", "chunk_id", "offset", F.col("rerank_score").alias("score"))
    # A query whose best hit is below keep keeps that one, which expansion by itself would drop.
    near = R.merge_hits([R.expand_neighbours(hits, sentences, window, keep=keep).select("query_id", "sentence_id", "score"), kept.select("query_id", "sentence_id", F.col("rerank_score").alias("score"))], ["query_id", "sentence_id"])
    items = near.join(sentences.select("sentence_id", "chunk_id", T.token_set(F.col("text")).alias("tokens")), "sentence_id")
    chosen = R.mmr(items.select("query_id", "sentence_id", "score", "tokens"), k, lam)
    return chosen.join(items.select("query_id", "sentence_id", "chunk_id", F.col("score").alias("rerank_score")), ["query_id", "sentence_id"])


def search_rounds(claims: DataFrame, search: Callable[[DataFrame, int], DataFrame], thresholds: R.Thresholds = R.Thresholds(), max_rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """(board, decisions): rounds of `search` over the claims that the gate has not stopped, one job a round.

    search(open claims, round) returns claim_id, chunk_id, sentence_id, rerank_score. The gate judges all that a claim
    has gathered. Rounds, not claims, are looped over; each round's board and decisions are written before the next.
    """
    open_claims, board, decisions = claims, None, None
    for r in range(1, max_rounds + 1):
        found = search(open_claims, r).select("claim_id", "chunk_id", "sentence_id", "rerank_score").withColumn("round_index", F.lit(r))
        board = settled(R.board_dedup(found if board is None else board.unionByName(found), ["claim_id", "chunk_id", "sentence_id"]), "board")
        now = R.gate(open_claims, board.select("claim_id", F.col("rerank_score").alias("score")), thresholds, r, max_rounds).withColumn("round_index", F.lit(r))
        now = settled(now, "decisions")
        done = now.where("should_stop")
        decisions = done if decisions is None else decisions.unionByName(done)
        open_claims = open_claims.join(now.where("NOT should_stop").select("claim_id"), "claim_id", "left_semi")
        if now.where("NOT should_stop").isEmpty():
            break
    return board, decisions


def finalize(claims: DataFrame, board: DataFrame, sentences: DataFrame, thresholds: R.Thresholds = R.Thresholds(), most: int = 12, window: int = 2) -> DataFrame:
    """One row a claim: the gate's last word and at most `most` evidences above keep, numbered, with their context."""
    w = W.partitionBy("claim_id").orderBy(F.desc("rerank_score"), "sentence_id")
    best = board.where(F.col("rerank_score") >= thresholds.keep).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    best = best.join(R.paragraph_context(sentences.select("sentence_id", "chunk_id", "offset", "text"), window).drop("chunk_id", "offset"), "sentence_id")
    item = F.struct("rank", F.format_string("ev_%d", "rank").alias("evidence_id"), "sentence_id", "chunk_id", "rerank_score", "prev_text", "text", "next_text")
    lists = best.groupBy("claim_id").agg(F.array_sort(F.collect_list(item)).alias("evidences"))
    verdicts = R.gate(claims, board.select("claim_id", F.col("rerank_score").alias("score")), thresholds)
    return verdicts.join(lists, "claim_id", "left")


def gate_message(decision: str = "reason") -> Column:
    """STOP or CONTINUE and why."""
    said = F.when(F.col(decision) == "high_threshold_met", F.format_string("STOP: %d candidates reach the high threshold", "strong_hits"))
    said = said.when(F.col(decision) == "low_threshold_all_below", F.format_string("STOP: the best score %.3f is below the low threshold", "top_score"))
    said = said.when(F.col(decision) == "no_candidate_retrieved", F.lit("STOP: no candidate was found")).when(F.col(decision) == "round_limit_reached", F.lit("STOP: the round limit is reached"))
    return said.otherwise(F.lit("CONTINUE: the evidence is not decisive yet"))


def read_chunks(wanted: DataFrame, chunks: DataFrame, sentences: DataFrame, board: DataFrame, first: int = 20, most: int = 4000) -> DataFrame:
    """(claim_id, chunk_id, found, text, best_sentence, best_score) of the chunks that claims ask to read.

    wanted: claim_id, chunk_id, query. A chunk without a score on the claim's board is scored on its first sentences,
    the best of which stands for it; a missing chunk is a row that is not found. Texts are cut to `most` characters for
    reading, as the feature asks; scores come from whole sentences.
    """
    seen = board.groupBy("claim_id", "chunk_id").agg(F.max_by("sentence_id", "rerank_score").alias("b"), F.max("rerank_score").alias("s"))
    fresh = wanted.join(seen, ["claim_id", "chunk_id"], "left_anti").join(sentences.where(F.col("offset") < first), "chunk_id")
    scored = R.rerank_by_tokens(fresh).groupBy("claim_id", "chunk_id").agg(F.max_by("sentence_id", F.struct("rerank_score", -F.col("offset"))).alias("b"), F.max("rerank_score").alias("s"))
    text = chunks.select("chunk_id", F.substring("text", 1, most).alias("text"), F.lit(True).alias("found"))
    out = wanted.select("claim_id", "chunk_id").join(text, "chunk_id", "left").join(seen.unionByName(scored), ["claim_id", "chunk_id"], "left")
    return out.select("claim_id", "chunk_id", F.coalesce("found", F.lit(False)).alias("found"), "text", F.col("b").alias("best_sentence"), F.col("s").alias("best_score"))
