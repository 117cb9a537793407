"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

run() writes each stage's rows to the shared folder and reads them again, so a lost executor repeats one stage's tasks
at most. Repeated documents of the mix keep their doc_id; packing numbers pieces within each copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import line_dedup, mixing, ngram_join, packing, quality
from claimloom.llm.common import sized_join, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the weakly labelled scorer rejects."""
    return quality.filter_quality(docs, quality.fit(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines that at least ten documents hold; a document that loses all its lines stays, empty."""
    out = line_dedup.line_dedup(docs).withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")})
    return out.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document of the smallest id; documents without words all stay.

    Where ids repeat or are missing, rows are numbered, so that of a group's rows one stays whatever their ids.
    """
    row = "__claimloom_row"
    odd = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows") if odd else docs.withColumn(row, F.col("doc_id"))
    groups = written(ngram_join.jaccard_components(keyed.select(row, "text"), id_col=row), "groups")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(row))
    return sized_join(keyed, written(gone, "gone"), row, "left_anti", 16).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's share: whole copies, and the words of the chosen blocks."""
    return mixing.taken_texts(mixing.mix_sources(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", one_of_each_group),
    ("mix", mix),
    ("pack", pack),
]

#: EM, tokenisation and packing are beyond SQL: tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
