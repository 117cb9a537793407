"""Bilingual terms: cached extraction and translation, with Latin tokens where no model answers.

A cache is two tables: texts (doc_key, terms) and words (zh, en, aliases). A model is a function from a frame of misses
to a frame of answers, so that hits cost no call; answers are appended to the cache by the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

TERM = "array<struct<zh: string, en: string, aliases: array<string>>>"
# Fixed value: a mixed-in Latin word, with capitalised ones after it.
LATIN = r"([A-Za-z][A-Za-z0-9\-.]{2,}(?:\s+[A-Z][A-Za-z0-9\-.]+)*)"


def _distinct(words: Column, most: int | None = None) -> Column:
    """The first `most` without blanks and, whatever the case, repeats; the first spelling stays."""

    def add(kept: Column, w: Column) -> Column:
        new = (w != "") & ~F.exists(kept, lambda x: F.lower(x) == F.lower(w))
        return F.when(new if most is None else new & (F.size(kept) < most), F.concat(kept, F.array(w))).otherwise(kept)

    return F.aggregate(words, F.array().cast("array<string>"), add)


def latin_terms(text: Column, most: int = 8) -> Column:
    """The words of at least three characters that a text has in Latin letters, as their own translations."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LATIN), F.lit(1)), lambda w: F.length(w) >= 3)
    return F.transform(_distinct(found, most), lambda w: F.struct(w.alias("zh"), w.alias("en"), F.array().cast("array<string>").alias("aliases")))


def cleaned_terms(terms: Column, most: int = 8) -> Column:
    """A model's terms stripped, without those that have no English, at most `most`."""
    trim = lambda x: F.trim(F.coalesce(x, F.lit("")))
    named = F.transform(terms, lambda t: F.struct(trim(t["zh"]).alias("zh"), trim(t["en"]).alias("en"), F.filter(F.transform(F.coalesce(t["aliases"], F.array().cast("array<string>")), trim), lambda a: a != "").alias("aliases")))
    return F.slice(F.filter(named, lambda t: t["en"] != ""), 1, most)


def flat_terms(terms: Column) -> Column:
    """Keywords for a search: each term's English and aliases in order, distinct whatever the case."""
    return _distinct(F.flatten(F.transform(terms, lambda t: F.concat(F.array(F.trim(t["en"])), F.transform(t["aliases"], lambda a: F.trim(a))))))


def extract(texts: DataFrame, cache: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None, most: int = 8) -> DataFrame:
    """texts (text, ...) with `terms` and `hit`, from a cache (doc_key, terms); the model sees each missing text once.

    model: (doc_key, text) to (doc_key, terms); a text it leaves out or answers emptily gets its Latin words.
    """
    rows = texts.withColumn("doc_key", T.term_key(F.col("text")))
    known = cache.select("doc_key", F.col("terms").alias("__held"))
    rows = rows.join(known, "doc_key", "left").withColumn("hit", F.col("__held").isNotNull())
    told = F.lit(None).cast(TERM)
    if model is not None:
        asked = rows.where("NOT hit").groupBy("doc_key").agg(F.min("text").alias("text"))
        rows = rows.join(model(asked).select("doc_key", cleaned_terms(F.col("terms"), most).alias("__told")), "doc_key", "left")
        told = F.when(F.size("__told") > 0, F.col("__told"))
    return rows.withColumn("terms", F.coalesce("__held", told, latin_terms(F.col("text"), most))).drop("__held", "__told")


def translate(wanted: DataFrame, cache: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """wanted (request, position, zh) with en, aliases and hit, in the order of the request; unresolved words go."""
    words = wanted.withColumn("zh", F.trim("zh")).where("zh <> ''")
    held = words.join(cache.select("zh", "en", "aliases"), "zh", "left").withColumn("hit", F.col("en").isNotNull())
    if model is not None:
        asked = held.where("NOT hit").select("zh").distinct()
        told = model(asked).select("zh", F.col("en").alias("__en"), F.col("aliases").alias("__aliases"))
        held = held.join(told, "zh", "left").withColumns({"en": F.coalesce("en", "__en"), "aliases": F.coalesce("aliases", "__aliases")}).drop("__en", "__aliases")
    return held.where("en IS NOT NULL").orderBy("request", "position")


def learned(extracted: DataFrame) -> DataFrame:
    """The words (zh, en, aliases) that extractions teach; the later text wins."""
    rows = extracted.select("doc_key", F.posexplode("terms").alias("at", "t")).where("trim(t.zh) <> ''")
    last = W.partitionBy("t.zh").orderBy(F.desc("doc_key"), F.desc("at"))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").select(F.trim("t.zh").alias("zh"), "t.en", "t.aliases")


def cache_stats(extracted: DataFrame) -> DataFrame:
    return extracted.agg(F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"))


def glossary_hint(words: DataFrame, most: int = 30) -> DataFrame:
    """One row: the first words of a cache as lines for a prompt, so that translations stay the same."""
    top = words.where("coalesce(en, '') <> ''").orderBy("zh").limit(most)
    lines = F.array_sort(F.collect_list(F.concat_ws(" => ", "zh", "en")))
    return top.agg(F.array_join(lines, "\n").alias("hint"))
