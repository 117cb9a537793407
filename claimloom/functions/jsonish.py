"""Nearly-JSON text: repairs of hand-edited files, notes behind flags, files of several objects, fields under many names.

All on the JVM side but for cutting a file into its objects, which counts braces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, StringType

_STRING = r'"(?:[^"\\]++|\\.)*+"'
_MARK = "\u0001"
_FLAG = r'(?i)("human_verified"\s*:\s*)(true|false)'


def repair_json(raw: Column) -> Column:
    """Without // comments and trailing commas, full-width commas as commas; strings stay as they are."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), rf"(?s)({_STRING})|//[^\r\n]*", "$1")
    # A mark follows every string and stands for every wide comma: those right behind a closing quote are the former.
    marked = F.regexp_replace(F.replace(bare, F.lit(_MARK), F.lit("")), rf"(?s)({_STRING})|，", f"$1{_MARK}")
    commas = F.replace(F.replace(marked, F.lit('"' + _MARK), F.lit('"')), F.lit(_MARK), F.lit(","))
    return F.regexp_replace(commas, rf"(?s)({_STRING})|,[\s,]*(?=[\]}}])", "$1")


def without_notes(raw: Column) -> Column:
    """`"human_verified": true: a note` without its note, in lower case."""
    cut = F.regexp_replace(raw, _FLAG + r"\s*:\s*[^\n\r,}]+", "$1$2")
    return F.regexp_replace(F.regexp_replace(cut, r'("human_verified"\s*:\s*)(?i:true)', "$1true"), r'("human_verified"\s*:\s*)(?i:false)', "$1false")


def verified_notes(files: DataFrame, raw: str = "raw") -> DataFrame:
    """(sample_id, human_verified, human_note, retrieval_quality): the n-th flag of a file belongs to its n-th sample.

    Samples that are neither verified nor noted are left out.
    """
    ids = F.regexp_extract_all(raw, F.lit(r'"sample_id"\s*:\s*"([^"]+)"'), F.lit(1))
    # The flag and its note as one text, with an empty note where there is none.
    flags = F.regexp_extract_all(raw, F.lit(r'(?i)"human_verified"\s*:\s*((?:true|false)(?:\s*:\s*[^\n\r,}]+)?)'), F.lit(1))
    n = F.least(F.size("ids"), F.size("flags"))
    rows = files.select(ids.alias("ids"), flags.alias("flags")).where(n > 0)
    rows = rows.select(F.explode(F.arrays_zip(F.slice("ids", 1, n), F.slice("flags", 1, n)).cast("array<struct<id: string, flag: string>>")).alias("x"))
    parts = F.split("x.flag", r"\s*:\s*", 2)
    note = F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit(""))
    out = rows.select(F.col("x.id").alias("sample_id"), (F.lower(parts[0]) == "true").alias("human_verified"), F.when(~F.lower(note).isin("true", "false"), note).alias("human_note"))
    return out.where("human_verified OR human_note IS NOT NULL").withColumn("retrieval_quality", note_quality(F.col("human_note")))


def note_quality(note: Column) -> Column:
    """poor, good or fair by the words of a note, else null."""
    # The reviewers' words.
    poor = note.contains("rag检索效果很差") | note.contains("检索效果差") | note.contains("检索效果很差")
    return F.when(poor, "poor").when(note.contains("检索效果比较好"), "good").when(note.contains("翻译有问题"), "fair")


def objects_of(text: str | None) -> list[str]:
    """The top-level objects of a text, braces in strings not counted; what does not parse is left out."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}]', text or "", re.S):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    out.append(json.dumps(json.loads(text[start : m.end()], strict=False), ensure_ascii=False))
                except ValueError:
                    continue
    return out


@F.pandas_udf(ArrayType(StringType()))
def json_objects(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(objects_of)


def merged_samples(files: DataFrame, by: str, raw: str = "raw") -> DataFrame:
    """(by, position, sample_id, sample): the samples of a file's objects; the last of an id stays, at its first place."""
    objects = files.select(by, F.posexplode(json_objects(raw)).alias("batch", "o"))
    items = F.try_variant_get(F.try_parse_json("o"), "$.samples", "array<variant>")
    samples = objects.select(by, "batch", F.posexplode(items).alias("at", "v")).select(by, F.struct("batch", "at").alias("place"), F.try_variant_get("v", "$.sample_id", "string").alias("sample_id"), F.to_json("v").alias("sample"))
    best = samples.where("sample_id <> ''").groupBy(by, "sample_id").agg(F.min("place").alias("place"), F.max_by("sample", "place").alias("sample"))
    return best.select(by, (F.row_number().over(W.partitionBy(by).orderBy("place")) - 1).alias("position"), "sample_id", "sample")


def field(v: Column, *paths: str) -> Column:
    """The first non-blank text under the given paths of a variant; objects and arrays are no texts."""
    found = [F.try_variant_get(v, p, "string") for p in paths]
    return F.coalesce(*[F.when(~x.rlike(r"^\s*[\[{]") & (F.trim(x) != ""), F.trim(x)) for x in found])
