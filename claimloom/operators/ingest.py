"""Ingest operators on lines and text: verdicts, headers, reading order, style runs, chunk folds and indexes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import english as E
from ..functions import text as T


def sentences_with_verdicts(rows: DataFrame, text: str = "text", min_chars: int = 30) -> DataFrame:
    """The English sentences of each row, with offset, sentence, keep, reason and removed; dropped ones stay for review."""
    # An inner explode would be given a filter on the array's size, which segments every text a second time.
    cut = rows.withColumn("__s", E.segment(text)).select(*[c for c in rows.columns if c != text], F.posexplode_outer("__s").alias("offset", "sentence")).where("offset IS NOT NULL")
    # The steps of verdict(), each in a column that later ones read: inlined, the parts and the verb are made a dozen times.
    v = cut.withColumn("__p", E.sentence_parts(F.col("sentence"))).withColumn("__verb", E.has_verb(F.col("__p.text")))
    v = v.withColumn("__r", E.drop_reason(F.col("__p.text"), min_chars, F.col("__verb")))
    return v.select(*cut.columns[:-1], F.col("__p.text").alias("sentence"), F.col("__r").isNull().alias("keep"), F.coalesce("__r", F.lit("")).alias("reason"), F.col("__p.removed").alias("removed"))


def repaired_chunks(chunks: DataFrame) -> DataFrame:
    """Sentences cut by chunk ends put together again: chunks are paper_id, chunk, section, page, text.

    A residue goes back over the border by the rule of segmentation; a chunk that ends in no full stop takes the first
    sentence of the next one of its section, and a word cut by a hyphen is joined. A chunk left empty goes. A fold
    over a paper's chunks in order.
    """
    import pandas as pd

    def taken(head: str, piece: str, same: bool) -> tuple[int, str]:
        """How much of the next chunk goes to the one before, and what stands between the two."""
        if n := E.residue_size(head, piece):
            return n, " "
        if not (same and head and piece) or head.rstrip("\"')]")[-1:] in tuple(".!?"):
            return 0, ""
        if head[-1] == "-" and piece[0].islower():
            return len(piece), "-"
        return len(E.sentences_of(piece)[0]), " "

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for row in p.sort_values("chunk").to_dict("records"):
            row["text"] = row["text"] or ""
            if out:
                head, piece = out[-1]["text"].rstrip(), row["text"].lstrip()
                n, between = taken(head, piece, out[-1]["section"] == row["section"])
                if between == " " and n < len(piece):  # sentences are counted in squeezed text
                    piece = " ".join(piece.split())
                if n:
                    out[-1]["text"] = head[:-1] + piece if between == "-" else f"{head} {piece[:n].rstrip()}"
                    row["text"] = piece[n:].lstrip()
            if row["text"].strip() or not out:
                out.append(row)
        return pd.DataFrame(out, columns=p.columns)

    return chunks.groupBy("paper_id").applyInPandas(fold, chunks.schema)


def with_sections(lines: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """`section` (the last heading, at first Front Matter) and `skipped`, true from a stop heading to the next named one."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    head = F.nullif(E.section_of(F.col(text)), F.lit(""))
    rows = lines.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("Front Matter")))
    return rows.withColumn("skipped", E.is_stop_section(F.col("section")))


def repeated_lines(lines: DataFrame, by: str, page: str, line: str, ratio: float = 0.3, longest: int = 80) -> DataFrame:
    """(by, line, pages): lines on at least max(3, floor(ratio * pages)) pages of a group of at least four pages."""
    total = lines.groupBy(by).agg(F.count_distinct(page).alias("total")).where("total >= 4")
    held = lines.where((F.length(line) <= longest) & (F.trim(line) != "")).groupBy(by, line).agg(F.count_distinct(page).alias("pages"))
    return held.join(total, by).where(F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("total") * ratio))).select(by, line, "pages")


def without_repeated(lines: DataFrame, by: str, page: str, line: str) -> DataFrame:
    return lines.join(repeated_lines(lines, by, page, line).select(by, line), [by, line], "left_anti")


def style_runs(rows: DataFrame, by: str, order: list[str], style: str) -> DataFrame:
    """`run` (number of the island of equal style) and `run_length`."""
    w = W.partitionBy(by).orderBy(*order)
    new = F.coalesce((F.col(style) != F.lag(style).over(w)).cast("long"), F.lit(1))
    rows = rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__new")
    return rows.withColumn("run_length", F.count("*").over(W.partitionBy(by, "run")))


def reading_order(lines: DataFrame, page_width: float) -> DataFrame:
    """`position` of each line (page, x0, x1, y): left column, right column, then the full-width line below them.

    A line is full-width where it crosses the middle by 4 % of the page and is wider than 55 % of it; a page with one
    column only is read by (y, x).
    """
    mid, gap = page_width / 2, page_width * 0.04
    wide = (F.col("x0") < mid - gap) & (F.col("x1") > mid + gap) & (F.col("x1") - F.col("x0") > 0.55 * page_width)
    side = F.when(wide, 2).when((F.col("x0") + F.col("x1")) / 2 < mid, 0).otherwise(1)
    y = F.round(F.col("y") * 10).cast("long")
    rows = lines.withColumn("side", side).withColumn("yy", y)
    page = W.partitionBy("page")
    two = (F.sum((F.col("side") == 0).cast("int")).over(page) > 0) & (F.sum((F.col("side") == 1).cast("int")).over(page) > 0)
    # The band: how many full-width lines stand above.
    above = F.sum((F.col("side") == 2).cast("int")).over(page.orderBy("yy").rangeBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("two", two).withColumn("band", F.when(F.col("two"), F.coalesce(above, F.lit(0))).otherwise(0)).withColumn("column", F.when(F.col("two"), F.col("side")).otherwise(0))
    order = W.partitionBy("page").orderBy("band", "column", "yy", "x0", "line_id")
    return rows.withColumn("position", F.row_number().over(order)).drop("side", "yy", "two", "band", "column")


def chunk_lines(lines: DataFrame, target: int = 1200) -> DataFrame:
    """(paper_id, chunk, section, page, text): lines folded to chunks of about `target` characters.

    A heading closes a chunk and names the section; a chunk closes at a change of block once it holds `target`
    characters, and anywhere at 1.6 times that. A true fold over a paper's lines in order.
    """
    import pandas as pd

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        out, buffer, held, section, page, block = [], [], 0, "Front Matter", None, None

        def close():
            nonlocal buffer, held
            if buffer:
                out.append((p["paper_id"].iloc[0], len(out), section, page, " ".join(buffer)))
            buffer, held = [], 0

        for r in p.sort_values("ordinal").itertuples():
            if r.is_heading:
                close()
                section = r.text.strip()
                continue
            if buffer and r.block != block and held >= target:
                close()
            if not buffer:
                page = r.page
            buffer.append(r.text.strip())
            held, block = held + len(buffer[-1]), r.block
            if held >= 1.6 * target:
                close()
        close()
        return pd.DataFrame(out, columns=["paper_id", "chunk", "section", "page", "text"])

    return lines.groupBy("paper_id").applyInPandas(fold, "paper_id string, chunk int, section string, page int, text string")


def sentence_index(chunks: DataFrame, paper: str, chunk: str, text: str) -> DataFrame:
    """(paper, sentence_id, chunk_id, offset, text): dense ids within a paper, offsets within a chunk."""
    rows = chunks.select(F.col(paper).alias("paper_id"), F.col(chunk).alias("chunk_id"), F.posexplode(T.naive_sentences(F.col(text))).alias("offset", "text"))
    w = W.partitionBy("paper_id").orderBy("chunk_id", "offset")
    return rows.withColumn("sentence_id", F.row_number().over(w) - 1)


def index_fingerprint(index: DataFrame) -> DataFrame:
    """(paper_id, fingerprint, sentences): over a paper's sentences in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sentence_id", "text"))), lambda x: x["text"])
    return index.groupBy("paper_id").agg(T.fingerprint(ordered).alias("fingerprint"), F.count("*").alias("sentences"))


def stale(index: DataFrame, recorded: DataFrame) -> DataFrame:
    """The papers whose recorded fingerprint is missing or differs: those to build again."""
    now = index_fingerprint(index)
    return now.join(recorded.select("paper_id", F.col("fingerprint").alias("old")), "paper_id", "left").where(~F.col("fingerprint").eqNullSafe(F.col("old"))).select("paper_id", "fingerprint")


def clean_html(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, entities of & < > replaced, white space collapsed."""
    for pattern, to in ((r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]+>", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), (r"[ \t\r\n]+", " ")):
        html = F.regexp_replace(html, pattern, to)
    return F.trim(html)


def batches(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / size))


def header_pages(total: int, ratio: float = 0.3) -> int:
    return max(3, math.floor(total * ratio))


def join_hyphens(text: Column) -> Column:
    """A word cut by a hyphen and white space is one word again."""
    return F.regexp_replace(text, r"(?U)(\w)-\s+(\w)", "$1$2")


def is_heading(text: Column, size: Column, bold: Column, body_size: Column, style_run: Column) -> Column:
    """A short line of at most two of its style, larger or bolder than the body, that is no caption and no sentence."""
    s = T.strip(F.coalesce(text, F.lit("")))
    shaped = F.length(s).between(1, 90) & s.rlike("[A-Za-z]{3}") & ~s.rlike(E.CAPTION) & ~s.rlike(r"[.,;:]$") & ~s.rlike(r"\.\s+[A-Z]")
    return shaped & (style_run <= 2) & ((size >= body_size + 0.8) | (bold & (size >= body_size - 0.3)))


def body_size(lines: DataFrame, by: str, size: str = "size", chars: str = "chars", order: str = "line_no") -> DataFrame:
    """(by, body_size): the font size that most characters have; of equal ones the one met first."""
    sums = lines.groupBy(by, size).agg(F.sum(chars).alias("n"), F.min(order).alias("first"))
    return sums.groupBy(by).agg(F.max_by(size, F.struct("n", -F.col("first"))).alias("body_size"))


def joined_headings(lines: DataFrame, by: str, order: str = "line_no") -> DataFrame:
    """Headings that follow each other in one block of one page made one line, in the place of the first."""
    w = W.partitionBy(by).orderBy(order)
    goes_on = F.col("is_heading") & F.lag("is_heading").over(w) & (F.lag("block").over(w) == F.col("block")) & (F.lag("page").over(w) == F.col("page"))
    runs = lines.withColumn("__run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    texts = F.array_sort(F.collect_list(F.struct(order, "text")))
    joined = F.when(F.size(texts) > 1, F.array_join(F.transform(texts, lambda x: T.strip(x["text"])), " ")).otherwise(F.get(texts, F.lit(0))["text"])
    return runs.groupBy(by, "__run").agg(F.min(order).alias(order), joined.alias("text"), F.min("page").alias("page"), F.min("block").alias("block"), F.first("is_heading").alias("is_heading")).drop("__run")


def paper_metadata(heads: DataFrame) -> DataFrame:
    """(paper_id, title, year) of (paper_id, text): the first line of over fifteen characters with letters, and the latest year."""
    lines = F.transform(F.split("text", r"\n"), T.strip)
    title = F.get(F.filter(lines, lambda x: (F.length(x) > 15) & x.rlike("[A-Za-z]")), F.lit(0))
    years = F.regexp_extract_all("text", F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    return heads.select("paper_id", F.coalesce(title, F.lit("")).alias("title"), F.coalesce(F.array_max(years), F.lit("")).alias("year"))


def overridden(rows: DataFrame, sidecar: DataFrame, key: str) -> DataFrame:
    """rows with the sidecar's fields in place of theirs wherever the sidecar has one that is not empty."""
    fields = [c for c in sidecar.columns if c != key and c in rows.columns]
    said = sidecar.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    return rows.join(said, key, "left").select(*[F.coalesce(F.nullif(F.col(f"__{c}").cast("string"), F.lit("")).cast(rows.schema[c].dataType), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def numbered_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """chunks of all papers with `id`, their running number from 0 as text.

    Numbers run over all rows, so rows are sorted by range and counted a partition; no task holds them all.
    """
    rows = chunks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = rows.withColumns({"__part": F.shiftright("__at", 33), "__in": F.col("__at").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("__part").agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__part", "before")
    return rows.join(F.broadcast(before), "__part").withColumn("id", (F.col("before") + F.col("__in")).cast("string")).drop("__at", "__part", "__in", "before")


def one_paper(chunks: DataFrame) -> str:
    """The only paper id of chunks that are to be one index; several are an error."""
    found = [r[0] for r in chunks.select("paper_id").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"one index holds one paper, not {sorted(map(str, found))}")
    return found[0]


def best_chunks(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(file, covered) of the chunk file (file, chunk_id) that has most of the wanted chunk_ids; ties go to the first name."""
    hit = files.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("file").agg(F.count_distinct("chunk_id").alias("covered"))
    return hit.orderBy(F.desc("covered"), "file").limit(1)
