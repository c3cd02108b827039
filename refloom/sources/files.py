"""Files and stored tables as sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refloom.config import INGEST, PARSE, Ingest, Parse
from refloom.errors import InputError
from refloom.functions import citations, udfs
from refloom.functions.bibtex import parse_bibtex
from refloom.operators import lines as L
from refloom.operators import pages
from refloom.operators.control import cache_key, latest
from refloom.schema import EVAL_ROW, FIELDS, RESPONSE, RESPONSES

BIBTEX_ENTRY = r"(?m)^\s*@\s*[A-Za-z]+\s*[{(]"
NO_FRAGMENTS = "A PDF is read from a table of its page fragments, and none was given for this one."
BIBTEX_ROWS = f"doc_id long, idx int, raw string, key string, line int, fields {FIELDS}, warnings array<string>"


def source_name(path: Column) -> Column:
    """The file's own name, never its folder."""
    name = F.trim(F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1))
    return F.when(F.coalesce(name, F.lit("")) == "", "pasted-text").otherwise(F.substring(name, 1, 120))


def detected(files: DataFrame, cfg: Ingest = INGEST) -> DataFrame:
    """files: path, content. Adds name, text, format (pdf, bibtex, text) and error; content decides, the name only where content doesn't."""
    head, name = F.substring("content", 1, 1024), F.lower("path")
    pdf = F.regexp_replace(F.decode(head, "ISO-8859-1"), r"^\s+", "").startswith("%PDF-")
    rows = files.withColumn("name", source_name(F.col("path"))).withColumn("is_pdf", pdf)
    # UTF-8 stays in the JVM; only other bytes go through Arrow.
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), "^﻿", ""))
    has_nul = F.contains(F.decode("content", "ISO-8859-1"), F.lit("\0"))
    rows = rows.withColumn("text", F.when(~F.col("is_pdf") & ~has_nul, F.coalesce(utf8, udfs.decode_text(F.when(utf8.isNull(), F.col("content"))))))
    error = (
        F.when(F.length("content") > cfg.max_input_bytes, "The file is larger than the limit.").when(F.decode("content", "ISO-8859-1").rlike(r"^\s*$"), "The input is empty.")
        .when(F.col("is_pdf"), F.lit(None)).when(name.endswith(".pdf"), "This file has a .pdf name but is not a PDF document.")
        .when(F.hex(F.substring("content", 1, 4)) == "504B0304", "Zipped formats are not supported.").when(F.col("text").isNull(), "The file is not text.")
    )
    kind = F.when(F.col("is_pdf"), "pdf").when(name.endswith(".bib") | F.col("text").rlike(BIBTEX_ENTRY), "bibtex").otherwise("text")
    return rows.withColumn("error", error).withColumn("format", F.when(error.isNull(), kind)).drop("is_pdf")


def read_files(spark: SparkSession, path: str, cfg: Ingest = INGEST) -> DataFrame:
    """doc_id, name, text, format, error of the files under a path; any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return detected(files, cfg).select(F.xxhash64("path").alias("doc_id"), "name", "text", "format", "error")


def bibtex_references(docs: DataFrame) -> DataFrame:
    """doc_id, text to a row for each entry. A file is parsed whole, in the task that holds it."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found, warnings = parse_bibtex(text or "")
                rows += [{"doc_id": doc_id, **r, "warnings": warnings if r["idx"] == 1 else []} for r in found]
            out = pd.DataFrame(rows, columns=["doc_id", "idx", "raw", "key", "line", "fields", "warnings"])
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, BIBTEX_ROWS).withColumn("source_format", F.lit("bibtex"))


def text_references(docs: DataFrame, cfg: Parse = PARSE) -> DataFrame:
    """doc_id, text to a row for each reference of a pasted list or a document with a references section."""
    cleaned = docs.select("doc_id", udfs.clean_text(F.coalesce("text", F.lit(""))).alias("text"))
    return parsed_references(L.text_lines(cleaned), cfg)


def parsed_references(lines: DataFrame, cfg: Parse = PARSE) -> DataFrame:
    """doc_id, line, text to a row for each reference in the references section."""
    split = L.split_references(L.section_lines(lines))
    return split.select("doc_id", "idx", "raw", F.lit(None).cast("string").alias("key"), "line", citations.parse_fields(F.col("raw"), cfg).alias("fields"), F.lit("text").alias("source_format"))


def pasted(spark: SparkSession, text: str) -> DataFrame:
    """doc_id, name, text, format, error of one pasted text."""
    rows = spark.createDataFrame([("", bytearray(text.encode()))], "path string, content binary")
    return detected(rows).select(F.lit(0).cast("long").alias("doc_id"), "name", "text", "format", "error")


def page_fragments(spark: SparkSession, path: str) -> DataFrame:
    """The fragments of PDF pages that a reader of PDFs has made, a Parquet table: path (as the file is read by), page, x, y, width, text, page_width."""
    return spark.read.parquet(path).withColumn("doc_id", F.xxhash64("path")).drop("path")


def pdf_lines(fragments: DataFrame) -> DataFrame:
    """doc_id, line, text: the lines of all pages in reading order, without running headers and footers."""
    kept = L.running_lines_removed(pages.page_lines(fragments))
    order = Window.partitionBy("doc_id").orderBy("page", "line")
    return kept.select("doc_id", F.row_number().over(order).alias("line"), F.trim(udfs.clean_text(F.col("text"))).alias("text"))


def references(docs: DataFrame, cfg: Parse = PARSE, fragments: DataFrame | None = None) -> DataFrame:
    """doc_id, text, format to references of all formats; those of PDFs come from their fragments."""
    bib = bibtex_references(docs.where("format = 'bibtex'")).drop("warnings")
    out = text_references(docs.where("format = 'text'"), cfg).unionByName(bib)
    if fragments is None:
        return out
    wanted = docs.where("format = 'pdf'").select("doc_id")
    return out.unionByName(parsed_references(pdf_lines(fragments.join(wanted, "doc_id", "left_semi")), cfg))


def unreadable(docs: DataFrame, fragments: DataFrame | None = None) -> DataFrame:
    """doc_id, name, error: files that can't be read, PDFs without fragments among them."""
    known = docs.select("doc_id").where("false") if fragments is None else fragments.select("doc_id").distinct()
    rows = docs.join(known.withColumn("read", F.lit(True)), "doc_id", "left")
    lacking = F.when((F.col("format") == "pdf") & F.col("read").isNull(), NO_FRAGMENTS)
    return rows.select("doc_id", "name", F.coalesce("error", lacking).alias("error")).where("error IS NOT NULL")


def frozen(spark: SparkSession, path: str, sha256: str) -> None:
    """Raises an error if the file is not, byte for byte, the one that was frozen."""
    found = {r.hash for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("hash")).collect()}  # a row for each file of the dataset
    if found != {sha256}:
        raise InputError(f"{path} is not the frozen file: its SHA-256 is {', '.join(sorted(found)) or 'missing'}")


def guarded(refs: DataFrame, docs: DataFrame, cfg: Ingest = INGEST) -> DataFrame:
    """doc_id, n_references, error: documents without references, or with too many."""
    counts = refs.groupBy("doc_id").agg(F.count("*").alias("n_references"))
    n = F.coalesce("n_references", F.lit(0))
    said = F.when(n == 0, "No references were found.").when(n > cfg.max_references, F.concat(F.lit("Found "), n.cast("string"), F.lit(f" references; the limit is {cfg.max_references} per document.")))
    return docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", n.alias("n_references"), said.alias("error"))


def read_eval_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_ROW).json(path)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """A bundle of recorded responses {format, generated, entries: [{params, response}]} as rows of the response store."""
    entry = f"struct<format:int,generated:string,entries:array<struct<params:map<string,string>,response:{RESPONSE}>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", entry).alias("b")).where("b.format = 1")
    e = raw.select("b.generated", F.explode("b.entries").alias("e"))
    return e.select(cache_key(F.col("e.params")).alias("key"), F.col("e.params")["engine"].alias("engine"), F.col("e.params")["q"].alias("query"), F.try_to_timestamp("generated").alias("created"), F.to_json("e.response").alias("body"))


def bundle(responses: DataFrame, planned: DataFrame) -> DataFrame:
    """The stored responses that planned queries use, trimmed, in order of engine and query."""
    used = latest(responses).join(planned.select(F.col("cache_key").alias("key")), "key", "left_semi")
    params = planned.select(F.col("cache_key").alias("key"), "params").groupBy("key").agg(F.first("params").alias("params"))
    return used.join(params, "key").select("engine", "query", F.struct("params", F.from_json("body", RESPONSE).alias("response")).alias("entry")).orderBy("engine", "query")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSES).parquet(path)


def put_responses(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The store after new rows replaced older ones of their keys."""
    return latest(stored.unionByName(new))


def crossref_records(raw: DataFrame) -> DataFrame:
    """id, body (a work's JSON) to id, title, first_author, year, source."""
    kind = "struct<message:struct<title:array<string>,author:array<struct<family:string,name:string>>,editor:array<struct<family:string,name:string>>,issued:struct<`date-parts`:array<array<int>>>>>"
    m = F.from_json("body", kind)["message"]
    who = F.get(F.coalesce(F.when(F.size(m["author"]) > 0, m["author"]), m["editor"]), F.lit(0))
    title = F.trim(F.regexp_replace(F.coalesce(F.get(m["title"], F.lit(0)), F.lit("")), "<[^>]+>", ""))
    return raw.select("id", title.alias("title"), F.coalesce(who["family"], who["name"], F.lit("")).alias("first_author"), F.get(F.get(m["issued"]["date-parts"], F.lit(0)), F.lit(0)).alias("year"), F.lit("crossref").alias("source"))


def arxiv_records(raw: DataFrame) -> DataFrame:
    """id, body (an Atom feed) to id, title, first_author, year, source; an entry that says error is no record."""
    at = lambda path: F.xpath_string(F.regexp_replace("body", r"xmlns=\"[^\"]*\"", ""), F.lit(path))
    title = F.trim(F.regexp_replace(at("/feed/entry/title"), r"\s+", " "))
    year = F.regexp_extract(at("/feed/entry/published"), r"^(\d{4})", 1)
    rows = raw.select("id", title.alias("title"), F.substring_index(F.trim(at("/feed/entry/author/name")), " ", -1).alias("first_author"), F.when(year != "", year.cast("int")).alias("year"), F.lit("arxiv").alias("source"))
    return rows.where((F.col("title") != "") & (F.lower("title") != "error"))


def append_usage(spark: SparkSession, path: str, surface: str, searches: int, references: int, left: int | None) -> None:
    """A line in the usage log; the log is a folder of text files, in any store."""
    said = f"live run ({surface}) | searches={searches} | references={references} | account_left_before={'not checked (all cached)' if left is None else left}"
    spark.range(1).select(F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm 'UTC'"), F.lit(" | "), F.lit(said)).alias("value")).write.mode("append").text(path)
