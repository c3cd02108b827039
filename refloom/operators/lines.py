"""Lines of documents: the references section, and its lines gathered into references.

Every step is a window or a fold over one document's lines. A document is bounded by the ingest size limit, so no window outgrows a task
however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.citations import bound

# Headings, ends, list markers and how a reference may start.
HEADING = (
    r"(?i)^\s*(?:(?:\d{1,2}|[IVXLC]{1,6})\.?\s+)?(?:references|bibliography|works\s+cited|literature\s+cited|reference\s+list"
    r"|cited\s+literature|references\s+and\s+notes|literature)\s*:?\s*$"
)
END = (
    r"(?i)^\s*(?:(?:[A-Z]|\d{1,2}|[IVXLC]{1,6})[.:]?\s+)?(?:appendix|appendices|supplementary\s+(?:materials?|information)|supporting\s+information"
    r"|author\s+biograph(?:y|ies)|about\s+the\s+authors?)\b"
)
MARKERS = {"bracket": r"^\s*\[(\d{1,4})\]\s*", "paren": r"^\s*\((\d{1,4})\)\s+", "dot": r"^\s*(\d{1,4})\.\s+(?=\D)"}
INLINE_BRACKET = r"(?<=\S)\s+(?=\[\d{1,4}\]\s)"
_NAME = r"[A-ZÀ-ɏ][\w'’-]+"
AUTHOR_START = rf"(?U)^(?:{_NAME}(?:[ -]{_NAME})?,\s+[A-Z]|{_NAME}\s+[A-Z]{{1,3}}[,.]|(?:[A-Z]\.\s?)+{_NAME})"
SENTENCE_END = r"[.)\]]$|\d$"
MAX_GAP, MIN_RUN = 3, 2
EDGE_LINES, MIN_PAGES, PAGE_SHARE = 2, 2, 0.5
PAGE_NUMBER = r"(?i)^\s*(?:page\s+)?\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?\s*$"


def text_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, line (from 1), text: the lines of each text."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\r\n?", "\n"), "\n")
    return docs.select("doc_id", F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line") + 1)


def section_lines(lines: DataFrame) -> DataFrame:
    """The lines after the last heading up to the next end section; all lines of a document without a heading."""
    of, before = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("line")
    start = F.max(F.when(F.col("text").rlike(HEADING), F.col("line"))).over(of)
    rows = lines.withColumn("start", start)
    # An end section ends the list only once it has a line.
    stop = F.col("text").rlike(END) & (F.col("line") > F.col("start") + 1)
    rows = rows.withColumn("stopped", F.coalesce(F.max(stop.cast("int")).over(before), F.lit(0)))
    return rows.where(F.col("start").isNull() | ((F.col("line") > F.col("start")) & (F.col("stopped") == 0))).drop("start", "stopped")


def exploded_brackets(lines: DataFrame) -> DataFrame:
    """Each [n] reference on a line of its own: doc_id, line, piece, text."""
    return lines.select("doc_id", "line", F.posexplode(F.split("text", INLINE_BRACKET)).alias("piece", "text"))


def sequence_starts(numbers: Column) -> Column:
    """The places (at) of an array of struct<at, n> where markers follow on: each at most MAX_GAP past the one expected."""
    present = F.filter(numbers, lambda x: x["n"].isNotNull())
    low = F.filter(present, lambda x: x["n"] <= 1)
    first = F.coalesce(F.get(low, F.lit(0))["n"], F.get(present, F.lit(0))["n"], F.lit(0))
    state = F.struct(first.alias("expected"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        taken = x["n"].between(acc["expected"], acc["expected"] + MAX_GAP)
        return F.when(taken, F.struct((x["n"] + 1).alias("expected"), F.concat(acc["starts"], F.array(x["at"])).alias("starts"))).otherwise(acc)

    return F.aggregate(present, state, step, lambda acc: acc["starts"])


def numbering(lines: DataFrame) -> DataFrame:
    """doc_id, marker, starts: the list marker of a document, null if it has none, and the places of lines that open a reference."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "piece"))
    number = {m: F.regexp_extract("text", p, 1) for m, p in MARKERS.items()}
    rows = lines.withColumn("at", at).select("doc_id", "at", "text", *(F.when(n != "", n.cast("int")).alias(m) for m, n in number.items()))
    per_doc = rows.groupBy("doc_id").agg(
        *(F.array_sort(F.collect_list(F.struct("at", F.col(m).alias("n")))).alias(m) for m in MARKERS),
        F.min_by(F.struct(*MARKERS), F.when(F.trim("text") != "", F.col("at"))).alias("first"),
    )
    per_doc = per_doc.select("doc_id", "first", *(sequence_starts(F.col(m)).alias(m) for m in MARKERS))
    names = list(MARKERS)
    longest = F.greatest(*(F.size(m) for m in names))
    by_run = F.coalesce(*(F.when((F.size(m) == longest) & (longest >= MIN_RUN), F.lit(m)) for m in names))
    lone = F.coalesce(*(F.when(F.col(f"first.{m}") <= 1, F.lit(m)) for m in names))
    marker = F.coalesce(by_run, lone)
    return per_doc.select("doc_id", marker.alias("marker"), F.coalesce(*(F.when(marker == m, F.col(m)) for m in names)).alias("starts"))


def joined(parts: Column) -> Column:
    """One line from wrapped lines; a hyphen at a line end goes if it splits a plain word, and stays, without a space, otherwise.

    How a line is put to the one before is decided by its beginning and the last word so far; the lines are joined once.
    """
    lines = F.filter(F.transform(parts, lambda t: F.trim(t)), lambda p: p != "")
    start = F.struct(F.lit("").alias("word"), F.array().cast("array<string>").alias("seams"))

    def step(acc: Column, line: Column) -> Column:
        split = acc["word"].rlike(r"(?U)[\w-]-$")
        plain = acc["word"].rlike(r"^\p{L}+-$") & line.rlike(r"^\p{Ll}")
        seam = F.when(F.size(acc["seams"]) == 0, "").when(~split, " ").when(plain, "-").otherwise("")
        last = F.regexp_extract(line, r"(?U)([\w-]*)$", 1)
        goes_on = split & (F.length(last) == F.length(line)) & (F.size(acc["seams"]) > 0)
        before = F.when(plain, F.substr(acc["word"], F.lit(1), F.length(acc["word"]) - 1)).otherwise(acc["word"])
        return F.struct(F.when(goes_on, F.concat(before, last)).otherwise(last).alias("word"), F.concat(acc["seams"], F.array(seam)).alias("seams"))

    def put_together(x: Column) -> Column:
        shown = F.transform(x["lines"], lambda line, i: F.concat(
            F.when(F.get(x["seams"], i) == " ", " ").otherwise(""), F.when(F.get(x["seams"], i + 1) == "-", F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line),
        ))
        return F.array_join(shown, "")

    seams = bound(lines, lambda of: F.struct(of.alias("lines"), F.aggregate(of, start, step, lambda a: a["seams"]).alias("seams")))
    return bound(seams, put_together)


def split_references(lines: DataFrame) -> DataFrame:
    """doc_id, idx (from 1), line, raw: numbered lists by their markers, others by blank lines or by lines that start like an author."""
    rows = exploded_brackets(lines).withColumn("text", F.trim("text"))
    order = Window.partitionBy("doc_id").orderBy("line", "piece")
    rows = rows.withColumn("at", F.row_number().over(order)).join(numbering(rows), "doc_id")
    blank = F.col("text") == ""
    opens = F.col("marker").isNotNull() & F.array_contains("starts", F.col("at"))
    body = F.when(opens, F.coalesce(*(F.when(F.col("marker") == m, F.regexp_replace("text", p, "")) for m, p in MARKERS.items()))).otherwise(F.col("text"))
    rows = rows.withColumn("body", body)
    rows = rows.withColumn("number_group", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(order))
    opens_block = ~blank & F.coalesce(F.lag(blank).over(order), F.lit(True))
    rows = rows.withColumn("block_group", F.sum(opens_block.cast("int")).over(order))
    # Of the lines with text: one that starts like an author after one that ended a sentence.
    last_text = F.last(F.when(~blank, F.col("text")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens_author = ~blank & (last_text.isNull() | (last_text.rlike(SENTENCE_END) & F.col("text").rlike(AUTHOR_START)))
    rows = rows.withColumn("author_group", F.sum(opens_author.cast("int")).over(order))
    doc = Window.partitionBy("doc_id")
    blocks, authors = F.max("block_group").over(doc), F.max("author_group").over(doc)
    by_block = (blocks > 1) & (blocks * 2 >= authors)
    rows = rows.withColumn("grp", F.when(F.col("marker").isNotNull(), F.col("number_group")).when(by_block, F.col("block_group")).otherwise(F.col("author_group")))
    kept = rows.where((F.col("grp") > 0) & (F.col("marker").isNotNull() | ~blank))
    out = kept.groupBy("doc_id", "grp").agg(F.min("line").alias("line"), joined(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"])).alias("raw"))
    return out.where("raw <> ''").select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("grp")).alias("idx"), "line", "raw")


def running_lines_removed(pages: DataFrame) -> DataFrame:
    """Page lines (doc_id, page, line, text) without headers and footers: of the EDGE_LINES lines at either end of a page, those whose
    text, digits apart, stands on many pages, and page numbers."""
    text = pages.where(F.trim("text") != "")
    up = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line"))
    down = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("line")))
    rows = text.withColumn("edge", (up <= EDGE_LINES) | (down <= EDGE_LINES)).withColumn("shape", F.trim(F.regexp_replace(F.lower("text"), r"\d+", "#")))
    n_pages = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    often = rows.where("edge").groupBy("doc_id", "shape").agg(F.countDistinct("page").alias("on")).join(n_pages, "doc_id")
    often = often.where(F.col("on") >= F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("n_pages") * PAGE_SHARE))).select("doc_id", "shape", F.lit(True).alias("runs"))
    rows = rows.join(often, ["doc_id", "shape"], "left")
    return rows.where(~(F.col("edge") & (F.coalesce("runs", F.lit(False)) | F.col("text").rlike(PAGE_NUMBER)))).select("doc_id", "page", "line", "text")
