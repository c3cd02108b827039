"""Positioned text fragments of pages to lines in reading order. Fragments (doc_id, page, x, y, width, text, page_width) are the contract; any reader may fill them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.config import INGEST, Ingest

# Points that a baseline may stray, and the shares that make a page two-column.
BASELINE_PT, GUTTER, RIGHT_SHARE, SPANNING_SHARE = 2.0, 0.04, 0.25, 0.10


def with_columns(fragments: DataFrame) -> DataFrame:
    """Adds `side`: 0, or 1 for the right column of a two-column page."""
    page = Window.partitionBy("doc_id", "page")
    middle, gutter = F.col("page_width") / 2, F.col("page_width") * GUTTER
    left = F.col("x") < middle - gutter
    n, n_left = F.count("*").over(page), F.sum(left.cast("int")).over(page)
    spanning = F.sum((left & (F.col("x") + F.col("width") > middle + gutter)).cast("int")).over(page)
    two = (n_left > 0) & (n - n_left >= RIGHT_SHARE * n) & (spanning <= SPANNING_SHARE * n_left)
    return fragments.withColumn("side", F.when(two & ~left, 1).otherwise(0))


def _grouped(page: pd.DataFrame) -> pd.DataFrame:
    """Lines of one column: a fragment joins the line whose first fragment's baseline is near enough."""
    page = page.sort_values(["y", "x"], ascending=[False, True], kind="stable")
    lines, anchor, number = [], None, 0
    for y in page["y"]:
        if anchor is None or abs(anchor - y) > BASELINE_PT:
            anchor, number = y, number + 1
        lines.append(number)
    page = page.assign(line=lines).sort_values(["line", "x"], kind="stable")
    out = page.groupby("line")["text"].agg(lambda t: " ".join(map(str.strip, t))).reset_index()
    return out.assign(doc_id=page["doc_id"].iloc[0], page=page["page"].iloc[0], side=page["side"].iloc[0])[["doc_id", "page", "side", "line", "text"]]


def page_lines(fragments: DataFrame) -> DataFrame:
    """doc_id, page, line, text: the left column's lines before the right one's. One page is one group, and a page is small."""
    schema = "doc_id long, page int, side int, line int, text string"
    found = with_columns(fragments.where(F.trim("text") != "")).select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "side", "x", "y", "text").groupBy("doc_id", "page", "side").applyInPandas(_grouped, schema)
    return found.withColumn("line", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("side", "line"))).drop("side")


def scanned(lines: DataFrame, pages: DataFrame, min_chars: int = 20) -> DataFrame:
    """doc_id, chars, n_pages, is_scan: documents whose pages hold too little text to be text."""
    chars = lines.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    return pages.join(chars, "doc_id", "left").select("doc_id", F.coalesce("chars", F.lit(0)).alias("chars"), "n_pages", (F.coalesce("chars", F.lit(0)) < min_chars * F.col("n_pages")).alias("is_scan"))


def guarded(pdfs: DataFrame, lines: DataFrame, cfg: Ingest = INGEST) -> DataFrame:
    """doc_id, error of PDFs (doc_id, n_pages, encrypted, damaged) with their page lines: the first reason not to read one, or null."""
    found = scanned(lines, pdfs.select("doc_id", F.coalesce("n_pages", F.lit(0)).alias("n_pages")), cfg.min_text_chars_per_page)
    yes = lambda name: F.coalesce(name, F.lit(False))
    said = (
        F.when(yes("encrypted"), "The PDF is encrypted.").when(yes("damaged"), "The PDF is damaged.").when(F.col("n_pages") > cfg.max_pdf_pages, F.concat(F.lit("The PDF has "), F.col("n_pages").cast("string"), F.lit(f" pages; the limit is {cfg.max_pdf_pages}.")))
        .when(F.col("is_scan"), "The PDF holds hardly any text; it may be a scan.")
    )
    return pdfs.select("doc_id", "encrypted", "damaged").join(found, "doc_id").select("doc_id", said.alias("error"))
