"""The registry, and the views that several queries share: in Spark and in SQL.

`refs` makes a citation of each document: its first sentence is the title. `works` is a catalogue of the distinct folded titles, so that a join of the two gives
each citation one work, however many documents share a title.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            SQL[key] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(name: str):
    return F.col(name).cast("long").alias(name)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"), F.trim(F.regexp_extract(body, r"^[^.\n]*", 0)).alias("title"), (1990 + F.col("doc_id") % 35).cast("int").alias("year"),
        F.concat(F.lit("Journal of "), "lang", F.lit(" Studies")).alias("venue"), F.split_part(body, F.lit(" "), F.lit(3)).alias("surname"), "source", "lang",
    )


REFS = r"""refs AS (SELECT doc_id AS idx, trim(regexp_extract(coalesce(text, ''), '^[^.\n]*')) AS title, 1990 + doc_id % 35 AS year,
 'Journal of ' || lang || ' Studies' AS venue, split_part(coalesce(text, ''), ' ', 3) AS surname, source, lang FROM documents)"""


def folded_sql(column: str) -> str:
    """`fold` for Latin text without backslashes."""
    bare = f"strip_accents(lower(replace(regexp_replace(regexp_replace({column}, '[{{}}]', '', 'g'), '[$]', ' ', 'g'), 'ß', 'ss')))"
    return rf"trim(regexp_replace(replace({bare}, '&', ' and '), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each folded title: the least document, its year moved by a function of the document, how many documents there are."""
    rows = refs(spark, sf_dir).select(text.fold(F.col("title")).alias("work_key"), "idx", "venue", "surname")
    first = F.min(F.struct("idx", "venue", "surname"))
    return rows.groupBy("work_key").agg(first.alias("w"), F.count("*").alias("versions")).select(
        "work_key", F.col("w.idx").alias("work_id"), (1990 + (F.col("w.idx") * 7) % 35).cast("int").alias("work_year"), F.col("w.venue").alias("work_venue"), F.col("w.surname").alias("work_surname"), "versions"
    )


WORKS = f"""works AS (SELECT work_key, min(idx) AS work_id, 1990 + (min(idx) * 7) % 35 AS work_year, arg_min(venue, idx) AS work_venue, arg_min(surname, idx) AS work_surname,
 count(*) AS versions FROM (SELECT {folded_sql("title")} AS work_key, * FROM refs) GROUP BY work_key)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each citation with the work of its folded title."""
    rows = refs(spark, sf_dir).withColumn("key", text.fold(F.col("title")))
    return rows.join(works(spark, sf_dir), F.col("key") == F.col("work_key"))


PAIRS = f"""WITH {REFS}, {WORKS}, pairs AS (SELECT * FROM (SELECT {folded_sql("title")} AS key, * FROM refs) JOIN works ON key = work_key)"""

#: Events as verdicts, in the order of the verdicts.
EVENT_VERDICTS = {"view": "VERIFIED", "click": "METADATA_MISMATCH", "error": "NOT_FOUND", "signup": "UNPARSEABLE", "purchase": "SKIPPED_BUDGET"}


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.lit(None)
    for kind, verdict in EVENT_VERDICTS.items():
        out = F.when(F.col("event_type") == kind, verdict).otherwise(out)
    return table(spark, sf_dir, "events").withColumn("verdict", out)


VERDICTS_SQL = "verd AS (SELECT *, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_VERDICTS.items()) + " END AS verdict FROM events)"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as evaluation outcomes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    k = F.col("n_chars") % 5
    from refloom.config import VERDICTS
    from refloom.operators.evaluate import PERTURBATIONS

    real = F.col("quality") == 1
    p = F.element_at(F.array(*map(F.lit, PERTURBATIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return rows.select(
        F.col("doc_id").alias("id"), F.when(real, "real").otherwise("fabricated").alias("kind"), (F.col("lang") == "es").alias("indian"), F.when(~real, p).alias("perturbation"), "source",
        F.when(real, "VERIFIED").when(p == "invented", "NOT_FOUND").otherwise("METADATA_MISMATCH").alias("expected"), F.element_at(F.array(*map(F.lit, VERDICTS)), (k + 1).cast("int")).alias("verdict"),
    )


OUTCOMES = """outcomes AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'real' ELSE 'fabricated' END AS kind, lang = 'es' AS indian,
 CASE WHEN quality <> 1 THEN p END AS perturbation, source, CASE WHEN quality = 1 THEN 'VERIFIED' WHEN p = 'invented' THEN 'NOT_FOUND' ELSE 'METADATA_MISMATCH' END AS expected,
 ['VERIFIED', 'METADATA_MISMATCH', 'NOT_FOUND', 'UNPARSEABLE', 'SKIPPED_BUDGET'][n_chars % 5 + 1] AS verdict
 FROM (SELECT l.doc_id, l.quality, d.lang, d.source, d.n_chars, ['reworded_title', 'swapped_authors', 'wrong_year', 'fake_venue', 'invented'][l.doc_id % 5 + 1] AS p
 FROM labels l JOIN documents d ON l.doc_id = d.doc_id))"""
