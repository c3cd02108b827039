"""Evaluation data and metrics, styles, and registry records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.operators import evaluate
from refloom.queries.base import OUTCOMES, REFS, long, outcomes, query, refs, table
from refloom.sources import files

V = ("VERIFIED", "METADATA_MISMATCH", "NOT_FOUND", "UNPARSEABLE", "SKIPPED_BUDGET")
FLAGGED = "verdict IN ('NOT_FOUND', 'METADATA_MISMATCH')"


@query(f"WITH {OUTCOMES}, e AS (SELECT unnest(['VERIFIED', 'METADATA_MISMATCH', 'NOT_FOUND']) AS expected) SELECT e.expected, " + ", ".join(f"CAST(count(*) FILTER (o.verdict = '{v}') AS BIGINT) AS {v.lower()}" for v in V) + " FROM e LEFT JOIN outcomes o ON o.expected = e.expected GROUP BY e.expected")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(outcomes(spark, sf_dir))


@query(f"""WITH {OUTCOMES}, c AS (SELECT unnest(['NOT_FOUND', 'METADATA_MISMATCH']) AS class), n AS (SELECT class, count(*) FILTER (expected = class AND verdict = class) AS tp, count(*) FILTER (expected <> class AND verdict = class) AS fp, count(*) FILTER (expected = class AND verdict <> class) AS fn FROM c, outcomes GROUP BY class),
 p AS (SELECT *, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 4) AS prec, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 4) AS rec FROM n) SELECT class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, prec, rec, round(2 * prec * rec / nullif(prec + rec, 0), 4) AS f1 FROM p""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_scores(outcomes(spark, sf_dir), [])


_HEAD = f"""CAST(count(*) FILTER (kind = 'real') AS BIGINT) AS n_real, CAST(count(*) FILTER (kind = 'fabricated') AS BIGINT) AS n_fabricated, CAST(count(*) FILTER (kind = 'real' AND {FLAGGED}) AS BIGINT) AS false_alarms, CAST(count(*) FILTER (kind = 'real' AND verdict = 'VERIFIED') AS BIGINT) AS verified_real,
 CAST(count(*) FILTER (kind = 'real' AND verdict IN ('UNPARSEABLE', 'SKIPPED_BUDGET')) AS BIGINT) AS unchecked_real, CAST(count(*) FILTER (kind = 'fabricated' AND {FLAGGED}) AS BIGINT) AS detected, CAST(count(*) FILTER (kind = 'fabricated' AND verdict IN ('UNPARSEABLE', 'SKIPPED_BUDGET')) AS BIGINT) AS unchecked_fabricated"""
_RATES = "*, round(CAST(false_alarms AS DOUBLE) / nullif(n_real, 0), 4) AS false_alarm_rate, round(CAST(detected AS DOUBLE) / nullif(n_fabricated, 0), 4) AS detection_rate"


@query(f"WITH {OUTCOMES}, h AS (SELECT 'all' AS subset, {_HEAD} FROM outcomes UNION ALL SELECT 'indian', {_HEAD} FROM outcomes WHERE indian) SELECT {_RATES} FROM h")
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.headline_sets(outcomes(spark, sf_dir))


@query(f"WITH {OUTCOMES}, p AS (SELECT unnest(['reworded_title', 'swapped_authors', 'wrong_year', 'fake_venue', 'invented']) AS perturbation), n AS (SELECT p.perturbation, CAST(count(o.id) AS BIGINT) AS n_rows, CAST(count(*) FILTER ({FLAGGED}) AS BIGINT) AS detected FROM p LEFT JOIN outcomes o ON o.perturbation = p.perturbation GROUP BY p.perturbation) SELECT *, round(CAST(detected AS DOUBLE) / nullif(n_rows, 0), 4) AS detection_rate FROM n")
def per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_perturbation(outcomes(spark, sf_dir))


@query(f"""WITH {OUTCOMES}, n AS (SELECT source, CAST(count(*) FILTER (kind = 'real') AS DOUBLE) AS n, CAST(count(*) FILTER (kind = 'real' AND {FLAGGED}) AS DOUBLE) AS k FROM outcomes GROUP BY source), z AS (SELECT *, CAST(1.959964 AS DOUBLE) AS z, k / nullif(n, 0) AS p FROM n),
 w AS (SELECT source, (p + z * z / (2 * n)) / (1 + z * z / n) AS c, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM z WHERE n > 0) SELECT source, round(greatest(0.0, c - h), 9) AS low, round(least(1.0, c + h), 9) AS high FROM w""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evaluate.headline(outcomes(spark, sf_dir), ["source"]).where("n_real > 0")
    return evaluate.wilson(counts, "false_alarms", "n_real").select("source", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"WITH {OUTCOMES} SELECT id, CASE WHEN kind = 'real' AND {FLAGGED} THEN 'false alarm' WHEN kind = 'real' THEN 'real reference not checked' ELSE 'missed fabrication' END AS type, verdict FROM outcomes WHERE (kind = 'real' AND verdict <> 'VERIFIED') OR (kind = 'fabricated' AND NOT {FLAGGED})")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.failures(outcomes(spark, sf_dir)).select("id", "type", "verdict")


@query(f"WITH {OUTCOMES} SELECT id, expected, verdict FROM outcomes WHERE kind = 'fabricated' AND {FLAGGED} AND verdict <> expected")
def class_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_differences(outcomes(spark, sf_dir)).select("id", "expected", "verdict")


@query("""WITH s AS (SELECT doc_id, lang, source, row_number() OVER (ORDER BY lang, source, doc_id) - 1 AS place FROM documents) SELECT doc_id, CAST(place AS BIGINT) AS place, CASE WHEN floor((place + 1) * CAST(0.4 AS DOUBLE) + CAST(0.25 AS DOUBLE)) > floor(place * CAST(0.4 AS DOUBLE) + CAST(0.25 AS DOUBLE)) THEN 'tuning' ELSE 'test' END AS part FROM s""")
def systematic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return evaluate.systematic_split(rows, ["lang", "source"], ["doc_id"], 0.4, 0.25).select("doc_id", long("place"), "part")


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations as labelled rows: real ones, copies with something changed, and invented ones."""
    r, k = refs(spark, sf_dir), F.col("idx")
    none = F.lit(None).cast("string")
    kind = F.when(k % 3 == 0, "real").otherwise("fabricated")
    p = F.when(k % 3 == 1, "wrong_year").when(k % 3 == 2, "invented")
    authors = F.array(F.array(F.lit("Smith"), F.lit("Jane Q.")), F.array(F.col("lang"), F.lit("A-B")))
    cols = {
        "id": F.concat(F.lit("r"), k.cast("string")), "kind": kind, "field": F.col("lang"), "indian": F.col("lang") == "es", "entry_type": F.when(k % 2 == 0, "article").otherwise("book"), "title": F.concat(F.lit("On "), F.col("lang"), F.lit(" things")), "authors": authors, "year": F.col("year"),
        "venue": F.col("venue"), "volume": F.when(k % 5 > 0, (k % 5).cast("string")), "issue": F.when(k % 4 > 0, "2"), "pages": F.when(k % 7 > 0, "1-9"), "doi": F.when(k % 9 > 0, F.concat(F.lit("10.1000/x"), k.cast("string"))), "arxiv_id": none,
        "expected": F.when(k % 3 == 0, "VERIFIED").when(k % 3 == 1, "METADATA_MISMATCH").otherwise("NOT_FOUND"), "perturbation": p, "source": F.when(k % 3 == 1, F.concat(F.lit("r"), (k - 1).cast("string"))),
    }
    return r.select(k, *(c.alias(n) for n, c in cols.items()))


_ROWS = f"""{REFS}, rows AS (SELECT idx, 'r' || idx AS id, idx % 2 = 0 AS article, 'On ' || lang || ' things' AS title, lang, year, venue, CASE WHEN idx % 5 > 0 THEN CAST(idx % 5 AS VARCHAR) END AS volume, CASE WHEN idx % 4 > 0 THEN '2' END AS issue,
 CASE WHEN idx % 7 > 0 THEN '1-9' END AS pages, CASE WHEN idx % 9 > 0 THEN '10.1000/x' || idx END AS doi FROM refs)"""


@query(f"""WITH {_ROWS}, n AS (SELECT *, (row_number() OVER (ORDER BY idx) - 1) % 4 AS turn FROM rows) SELECT idx, ['apa', 'ieee', 'vancouver', 'indian'][turn + 1] AS style, CASE
 WHEN turn = 0 THEN 'Smith, J. Q., & ' || lang || ', A. B. (' || year || '). ' || title || '. ' || venue || CASE WHEN article THEN coalesce(', ' || volume, '') || CASE WHEN volume IS NULL THEN '' ELSE coalesce('(' || issue || ')', '') END || coalesce(', ' || pages, '') || '.' || coalesce(' https://doi.org/' || doi, '') ELSE '.' END
 WHEN turn = 1 AND article THEN 'J. Q. Smith and A. B. ' || lang || ', “' || title || ',” ' || venue || coalesce(', vol. ' || volume, '') || coalesce(', no. ' || issue, '') || coalesce(', pp. ' || pages, '') || ', ' || year || '.'
 WHEN turn = 1 THEN 'J. Q. Smith and A. B. ' || lang || ', ' || title || '. ' || venue || ', ' || year || '.'
 WHEN turn = 2 AND article THEN 'Smith JQ, ' || lang || ' AB. ' || title || '. ' || venue || '. ' || year || coalesce(';' || volume, '') || CASE WHEN volume IS NULL THEN '' ELSE coalesce('(' || issue || ')', '') END || coalesce(':' || pages, '') || '.'
 WHEN turn = 2 THEN 'Smith JQ, ' || lang || ' AB. ' || title || '. ' || venue || '; ' || year || '.'
 WHEN article THEN 'Smith, J.Q. and ' || lang || ', A.B. (' || year || '), "' || title || '", ' || venue || coalesce(', Vol. ' || volume, '') || coalesce(' No. ' || issue, '') || coalesce(', pp. ' || pages, '') || '.'
 ELSE 'Smith, J.Q. and ' || lang || ', A.B. (' || year || '), ' || title || ', ' || venue || '.' END AS citation FROM n""")
def style_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.with_style(eval_rows(spark, sf_dir), "idx").select("idx", "style", "citation")


@query(f"""WITH {_ROWS} SELECT idx, '@' || CASE WHEN article THEN 'article' ELSE 'book' END || '{{' || id || ',' || chr(10) || array_to_string([x FOR x IN ['  title = {{' || title || '}}', '  author = {{Smith, Jane Q. and ' || lang || ', A-B}}', '  year = {{' || year || '}}',
 '  ' || CASE WHEN article THEN 'journal' ELSE 'publisher' END || ' = {{' || venue || '}}', '  volume = {{' || volume || '}}', '  number = {{' || issue || '}}', '  pages = {{' || pages || '}}', '  doi = {{' || doi || '}}'] IF x IS NOT NULL], ',' || chr(10)) || chr(10) || '}}' AS entry FROM rows""")
def bibtex_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_rows(spark, sf_dir).select("idx", evaluate.bibtex_entry().alias("entry"))


@query(f"WITH {_ROWS} SELECT idx, title, 'Smith, ' || lang AS surnames, CAST(year AS BIGINT) AS year, venue, doi FROM rows")
def bibtex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows rendered as BibTeX and read again."""
    rendered = eval_rows(spark, sf_dir).select(F.col("idx").alias("doc_id"), evaluate.bibtex_entry().alias("text"))
    f = F.col("fields")
    return files.bibtex_references(rendered).select(F.col("doc_id").alias("idx"), f["title"].alias("title"), F.array_join(F.transform(f["authors"], lambda a: a["surname"]), ", ").alias("surnames"), f["year"].cast("long").alias("year"), f["venue"].alias("venue"), f["doi"].alias("doi"))


@query(f"""WITH {REFS}, r AS (SELECT idx, 'r' || idx AS id, idx % 3 AS k, idx % 9 > 0 AS has, (SELECT count(*) FROM refs p WHERE p.idx = refs.idx - 1) AS parent FROM refs)
 SELECT id, array_to_string([x FOR x IN [CASE WHEN k = 0 AND NOT has THEN 'real without an identifier' END, CASE WHEN k = 1 AND parent = 0 THEN 'unknown source' END] IF x IS NOT NULL], '; ') AS problems FROM r WHERE (k = 0 AND NOT has) OR (k = 1 AND parent = 0)""")
def dataset_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.row_problems(eval_rows(spark, sf_dir)).select("id", F.array_join("problems", "; ").alias("problems"))


@query(f"""WITH {REFS}, r AS (SELECT idx, idx % 3 AS k, CASE WHEN idx % 2 = 0 AND idx % 5 < 2 THEN 'year differs' WHEN idx % 2 = 1 THEN 'lookup failed' ELSE '' END AS bad FROM refs)
 SELECT 'r' || idx AS id, CASE k WHEN 0 THEN bad WHEN 1 THEN CASE WHEN (SELECT p.bad FROM r p WHERE p.idx = r.idx - 1) = '' THEN '' ELSE 'the source row did not validate' END ELSE CASE WHEN idx % 2 = 0 THEN 'a similar title exists' ELSE '' END END AS problems FROM r""")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows against a registry of the even ones, of which two in five have another year."""
    rows = eval_rows(spark, sf_dir)
    registry = rows.where(F.col("idx") % 2 == 0).select("id", F.upper("title").alias("title"), F.lit("J. Smith").alias("first_author"), (F.col("year") + F.when(F.col("idx") % 5 < 2, 7).otherwise(1)).alias("year"))
    return evaluate.validated(rows.drop("idx"), registry).select("id", F.array_join("problems", "; ").alias("problems"))


@query("SELECT doc_id AS id, 'On ' || source AS title, lang AS first_author, CAST(1990 + doc_id % 35 AS BIGINT) AS year, CASE doc_id % 2 WHEN 0 THEN 'crossref' ELSE 'arxiv' END AS source FROM documents")
def registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry answers in JSON and in Atom."""
    docs, year = table(spark, sf_dir, "documents"), F.col("doc_id") % 35 + 1990
    message = F.struct(F.array(F.concat(F.lit("<i>On</i> "), "source")).alias("title"), F.array(F.struct(F.col("lang").alias("family"))).alias("author"), F.struct(F.array(F.array(year)).alias("date-parts")).alias("issued"))
    crossref = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.to_json(F.struct(message.alias("message"))).alias("body"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>On\n  '), "source", F.lit("</title><author><name>Ann "), "lang", F.lit("</name></author><published>"), year.cast("string"), F.lit("-01-02T00:00:00Z</published></entry></feed>"))
    arxiv = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), atom.alias("body"))
    return files.crossref_records(crossref).unionByName(files.arxiv_records(arxiv)).select("id", "title", "first_author", long("year"), "source")


