"""Line dedup (DataFrame functions only).

Lines are normalised, hashed and exploded; distinct documents per hash are counted; lines whose hash reaches the
threshold are dropped and the rest reassembled by position.

Defined cases: a null or empty text is one empty line; a key counts once for each document id that has it, so repeated
rows of one id count once together and rows without an id do not count, though they lose common lines like any; a line
of fewer than `min_chars` code points (after stripping) is never dropped; very long texts are processed whole; keys
that tie at the threshold all go; an empty table gives an empty table; other columns pass through whatever their names,
but for the four result columns, which win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: Columns of the work, under names that no table has.
_TAG, _ID, _HIT, _GONE, _LINES, _KEPT = (f"__claimloom_line_{x}" for x in ("tag", "id", "hit", "gone", "lines", "kept"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(text: Column) -> Column:
    """The lines' keys: stripped of x20 and x09-x0D at both ends, A-Z lowered."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.transform(F.split(lowered, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))


def hashes_of(keys: Column, min_chars: int) -> Column:
    """One 64-bit hash a line, null where the key is too short to be dropped."""
    return F.transform(keys, lambda x: F.when(F.char_length(x) >= min_chars, F.xxhash64(x)))


def line_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with `kept_text`, `n_lines`, `n_dropped` and `kept_sha256` appended."""
    base = docs.drop("kept_text", "n_lines", "n_dropped", "kept_sha256")
    base = base.withColumn(_TAG, F.xxhash64(F.col(text)))
    # Normalising is the dear step: the hashes are made once and written, and later steps read only them. Rows of one
    # id are told apart by their text's hash, so positions never mix.
    keyed = written(base.select(F.col(id_col).alias("id"), F.col(_TAG).alias("t"), hashes_of(keys_of(F.col(text)), min_chars).alias("h")), "keys")
    lines = keyed.select("id", F.explode(F.array_distinct(F.array_compact("h"))).alias("h"))
    common = written(lines.groupBy("h").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= min_docs).select("h"), "lines")
    common = F.broadcast(common) if small(common, 16) else common
    hit = keyed.select("id", "t", F.posexplode("h").alias("pos", "h")).join(common, "h", "left_semi")
    hit = written(hit.groupBy(F.col("id").alias(_ID), F.col("t").alias(_HIT)).agg(F.collect_set("pos").alias(_GONE)), "hits")
    if small(hit.select(F.explode(_GONE)), 24):
        hit = F.broadcast(hit)
    out = base.join(hit, base[id_col].eqNullSafe(hit[_ID]) & (base[_TAG] == hit[_HIT]), "left").drop(_ID, _HIT)
    out = out.withColumn(_LINES, lines_of(F.col(text)))
    kept = F.when(F.col(_GONE).isNull(), F.col(_LINES)).otherwise(F.filter(F.col(_LINES), lambda x, i: ~F.array_contains(F.col(_GONE), i)))
    out = out.withColumn(_KEPT, kept)
    return out.withColumns(
        {
            "kept_text": F.array_join(_KEPT, "\n"),
            "n_lines": F.size(_LINES).cast("long"),
            "n_dropped": (F.size(_LINES) - F.size(_KEPT)).cast("long"),
        }
    ).withColumn("kept_sha256", F.sha2("kept_text", 256)).drop(_LINES, _TAG, _GONE, _KEPT)
