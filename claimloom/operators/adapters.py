"""Remote models as column functions: batches, checks and errors kept to their own rows, with local stand-ins.

A model is a plain function on lists that the caller passes (a client with its keys and retries lives there); here are
the batching, truncation, order and count checks around it, on Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from . import claims as C

Embed = Callable[[list[str]], list[list[float]]]
Score = Callable[[str, list[str]], list[float]]
Ask = Callable[[str], str]


def hashed_embedding(width: int = 64) -> Embed:
    """Local stand-in: signed counts of hashed words, equal for equal texts."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for word in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % width] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out

    return run


def token_overlap(query: str, texts: list[str]) -> list[float]:
    """Local stand-in for a reranker: the share of the query's words that a text has."""
    words = set(query.lower().split())
    return [len(words & set(t.lower().split())) / len(words) if words else 0.0 for t in texts]


def embedded(model: Embed, batch: int = 32, longest: int = 8000):
    """A column function from text to array<double>: texts cut to `longest` characters, `batch` a call, counts checked."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            cut = [(t or "")[:longest] for t in texts]
            out: list[list[float]] = []
            for at in range(0, len(cut), batch):
                got = model(cut[at : at + batch])
                if len(got) != len(cut[at : at + batch]):
                    raise ValueError(f"{len(got)} vectors for {len(cut[at : at + batch])} texts")
                out += got
            yield pd.Series(out)

    return run


def reranked(hits: DataFrame, model: Score, query: str = "query", text: str = "text", shard: int = 64) -> DataFrame:
    """hits with `rerank_score`, the texts of one query sent together, `shard` a call; scores stay with their rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = pd.Series(0.0, index=b.index)
            for q, rows in b.groupby(query, sort=False, dropna=False):
                for at in range(0, len(rows), shard):
                    some = rows.iloc[at : at + shard]
                    scores.loc[some.index] = model(q if isinstance(q, str) else "", [t if isinstance(t, str) else "" for t in some[text]])
            yield b.assign(rerank_score=scores)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)
    return hits.mapInPandas(run, f"{schema}, rerank_score double")


def guarded(model: Ask):
    """A column function from prompt to struct<reply, error>: a failing call is its own row's error."""

    @F.pandas_udf("reply string, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in parts:
            rows = []
            for p in prompts:
                try:
                    rows.append((model(p or ""), None))
                except Exception as e:  # noqa: BLE001  a remote call may fail in any way
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["reply", "error"])

    return run


def classified(rows: DataFrame, model: Ask, prompt: Column) -> DataFrame:
    """rows with `classification` and `error`: a reply is read as JSON and made legal, a failed one is Weak and for review."""
    fields = "evidence_level string, primary_label string, secondary_label string, severity string, uncovered_phenomenon string"
    out = rows.withColumn("__r", guarded(model)(prompt)).withColumn("__c", F.from_json("__r.reply", fields))
    out = out.withColumn("__s", L.standardise(L.level_of(F.col("__c.evidence_level")), *[F.col(f"__c.{c}") for c in ("primary_label", "secondary_label", "severity", "uncovered_phenomenon")]))
    unread = F.col("__c.evidence_level").isNull()
    kept = [F.col(f"__s.{c}").alias(c) for c in ("evidence_level", "has_distortion", "primary", "level1", "secondary", "severity")]
    review = (F.col("__s.needs_review") | unread).alias("needs_review")
    error = F.coalesce("__r.error", F.when(unread, "unreadable reply"))
    return out.withColumns({"classification": F.struct(*kept, review), "error": error}).drop("__r", "__c", "__s")


def verified_roles(candidates: DataFrame, model: Callable[[list[dict]], list[dict]], keys: list[str], batch: int = 25) -> DataFrame:
    """candidates with `keep` and `role` by a model on `batch` rows a call; a failed call leaves its rows to the rules."""
    kinds = ", ".join(f"`{k}` {candidates.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b.to_dict("records")
            for at in range(0, len(rows), batch):
                some = rows[at : at + batch]
                try:
                    told = model(some)
                except Exception:  # noqa: BLE001
                    told = []
                yield pd.DataFrame([{**{k: d.get(k) for k in keys}, "role": d.get("role"), "keep": None if d.get("keep") is None else str(d["keep"])} for d in told], columns=[*keys, "role", "keep"])

    said = candidates.mapInPandas(run, f"{kinds}, role string, keep string").groupBy(*keys).agg(F.max("role").alias("role"), F.max("keep").alias("keep"))
    return C.decided(candidates, said, keys)


def judged(rows: DataFrame, model: Callable[[str, str], bool], answer: str = "answer", gold: str = "gold") -> DataFrame:
    """rows with `judged` (1.0, 0.0; 0.0 too where the judge fails) for every non-empty answer."""

    @F.pandas_udf("double")
    def run(a: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, g, strict=True):
            try:
                out.append(float(bool(x and x.strip() and model(x, y or ""))))
            except Exception:  # noqa: BLE001
                out.append(0.0)
        return pd.Series(out, dtype=float)

    return rows.withColumn("judged", run(answer, gold))


def translated(rows: DataFrame, column: str, cache: DataFrame, model: Ask) -> tuple[DataFrame, DataFrame]:
    """(rows with `{column}_zh`, new cache rows): each distinct text missing from cache (key, zh) is translated once.

    A translation that fails or holds no Chinese is left out, so that a later run asks again.
    """
    squeezed = lambda c: F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " ")
    keyed = rows.withColumn("__key", squeezed(F.col(column)))
    missing = keyed.where("__key <> ''").select(F.col("__key").alias("key")).distinct().join(cache.select("key"), "key", "left_anti")
    told = missing.withColumn("r", guarded(model)(F.col("key"))).where(F.col("r.error").isNull() & F.col("r.reply").rlike("[一-鿿]"))
    fresh = told.select("key", F.col("r.reply").alias("zh"))
    known = cache.select("key", "zh").unionByName(fresh).select(F.col("key").alias("__key"), F.col("zh").alias(f"{column}_zh"))
    return keyed.join(known, "__key", "left").drop("__key"), fresh
