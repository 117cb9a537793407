"""Readers and writers: chunks, sentence tables, claims, JSON lines, registries and reports."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SENTENCES = "sentence_id string, chunk_id string, text string, paper_id string, status string, drop_reason string"
CHUNK = "id string, text string, paper_id string, title string, year string, source_file string, section string, page string, authors array<string>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of chunks; the first two authors are kept."""
    return spark.read.schema(CHUNK).json(path, multiLine=True).withColumn("authors", F.slice("authors", 1, 2))


def read_legacy_chunks(rows: DataFrame, column: str = "value") -> DataFrame:
    """"id:text" strings, cut at the first colon."""
    parts = F.split(column, ":", 2)
    return rows.select(F.trim(parts[0]).alias("id"), T.strip(F.get(parts, F.lit(1))).alias("text"))


def read_sentences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of a sentence table; blank texts are skipped, a kept row of a bad id fails the read."""
    rows = spark.read.schema(SENTENCES).csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    rows = rows.where(T.strip(F.col("text")) != "")
    kept = rows.where("status <> 'dropped'").withColumn("sentence_id", F.col("sentence_id").cast("long"))
    return kept.orderBy("sentence_id", "chunk_id"), rows.where("status = 'dropped'")


def write_sentences(kept: DataFrame, dropped: DataFrame, path: str) -> None:
    rows = kept.select(F.col("sentence_id").cast("string"), "chunk_id", "text", "paper_id", F.lit("kept").alias("status"), F.lit("").alias("drop_reason"))
    gone = dropped.select(F.lit("").alias("sentence_id"), "chunk_id", "text", "paper_id", F.lit("dropped").alias("status"), "drop_reason")
    rows.unionByName(gone).write.mode("overwrite").csv(path, header=True, escape='"')


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims of JSON lines under any of their field names."""
    rows = spark.read.schema("claim_id string, id string, claim_zh string, claim string, text string, section string").json(path)
    return rows.select(F.coalesce("claim_id", "id").alias("claim_id"), F.coalesce("claim_zh", "claim", "text").alias("text"), "section").where(F.coalesce("text", F.lit("")) != "")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row for each paper and article of a registry: a JSON map of papers."""
    kind = "map<string, struct<title: string, doi: string, journal: string, year: string, pdf: string, articles: array<struct<id: string, type: string, path: string, source: string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("paper", "x"))
    return raw.select(T.paper_id(F.col("paper")).alias("paper_id"), "x.title", "x.doi", "x.journal", "x.year", "x.pdf", F.explode_outer("x.articles").alias("article"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]+$", 1).alias("article_id"), F.col("value").alias("text"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Records without their null fields."""
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def markdown_report(rows: DataFrame, by: str, title: str, lines: list[str]) -> DataFrame:
    """One Markdown text for each group: its rows' columns as a list in order."""
    item = F.concat(F.lit("- "), F.concat_ws(" | ", *lines))
    body = F.array_join(F.array_sort(F.collect_list(item)), "\n")
    return rows.groupBy(by).agg(F.concat(F.lit("# "), F.first(title), F.lit("\n\n"), body).alias("markdown"))


def read_predictions(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Rows of type `row` from a JSON list, or from the first of results, predictions, items and samples that is one."""
    names = ("results", "predictions", "items", "samples")
    raw = spark.read.text(path, wholetext=True)
    inner = F.coalesce(*[F.from_json("value", f"{n} array<struct<{row}>>")[n] for n in names])
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{row}>>")).otherwise(inner)
    return raw.select(F.inline(F.coalesce(rows, F.raise_error(F.lit("no list of predictions in the file")).cast(f"array<struct<{row}>>"))))


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Questions (qid, question, answer) of a JSON list, the first `limit` of them where one is given."""
    rows = spark.read.schema("id string, qid string, question string, answer string").json(path, multiLine=True)
    rows = rows.select(F.coalesce("qid", "id").alias("qid"), "question", "answer")
    return rows if limit is None else rows.limit(limit)


def read_config(path: str, environment: dict[str, str] | None = None, prefix: str = "CLAIMLOOM_") -> dict:
    """A JSON configuration, over which variables PREFIX_SECTION__KEY of the environment go."""
    with open(path, encoding="utf-8") as f:
        out = json.load(f)
    for name, value in (environment if environment is not None else os.environ).items():
        if name.startswith(prefix):
            put(out, name.removeprefix(prefix).lower().replace("__", "."), value)
    return out


def get(config: dict, dotted: str, default=None):
    for part in dotted.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def put(config: dict, dotted: str, value) -> None:
    *path, last = dotted.split(".")
    for part in path:
        config = config.setdefault(part, {})
    config[last] = value


def claims_source(claim: str | None = None, claims: str | None = None, article: str | None = None, legacy: str | None = None) -> tuple[str, str]:
    """(kind, value) of the input that counts: one claim before a claims file, an article and a legacy folder."""
    for kind, value in (("claim", claim), ("claims", claims), ("article", article), ("legacy", legacy)):
        if value:
            return kind, value
    raise ValueError("no claim, claims file, article or folder is given")


def batch_names(names: list[str], prefix: str) -> list[str]:
    """Batches C01_C10 of `prefix_C01_C10.json` names by number, others after them by name; translations are left out."""
    found = set()
    for name in names:
        m = re.fullmatch(rf"{re.escape(prefix)}_(C[^.]*_C[^.]*)\.json", name)
        if m and "_translated" not in name:
            found.add(m[1])

    def place(batch: str):
        m = re.fullmatch(r"C(\d+)_C(\d+)", batch, re.IGNORECASE)
        return (0, int(m[1]), int(m[2]), batch) if m else (1, 0, 0, batch)

    return sorted(found, key=place)


def replace_json(path: str, data) -> None:
    """Write a file of the driver whole or not at all: beside it, then renamed over it."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2)
    os.replace(part, path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Claim and evidence pairs as JSON lines; pairs without a claim are left out."""
    write_json_lines(pairs.where(T.strip(F.coalesce("claim_zh", F.lit(""))) != ""), path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder of spark.checkpoint.dir and read again: lost executors repeat no earlier work.

    Where that is unset and the master is local, as in tests, a temporary folder of this machine is taken.
    """
    root = df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not df.sparkSession.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='claimloom-')}"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
