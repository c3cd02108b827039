"""Whole runs: files in, lookups over a transport, reports out, evaluation of what the check said, and the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.config import VERDICTS
from refloom.functions import udfs
from refloom.operators import control, evaluate, live, match, pages, references, reports, search
from refloom.plans import check
from refloom.queries.base import OUTCOMES, VERDICTS_SQL, long, outcomes, query, refs, table
from refloom.queries.evaluation import _HEAD, _RATES
from refloom.queries.matching import _COUNTS, CHECK, SARIF_RULES, UNCUT, _results, _store
from refloom.schema import FIELDS
from refloom.sources import files
from refloom.sources.shared import shared_path
from refloom.streaming import jobs

# Files and pages


@query("SELECT doc_id, doc_id % 3 AS encoding, text FROM documents WHERE trim(text, ' ') <> ''")
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in three encodings, read as files."""
    docs = table(spark, sf_dir, "documents").where("trim(text) <> ''")
    utf8 = F.col("text").cast("binary")
    data = F.when(F.col("doc_id") % 3 == 0, utf8).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(b"\xef\xbb\xbf"), utf8)).otherwise(F.encode("text", "ISO-8859-1"))
    made = docs.select("doc_id", F.lit("/in/a.txt").alias("path"), data.alias("content"))
    return files.detected(made).select("doc_id", (F.col("doc_id") % 3).alias("encoding"), "text")


_ORDER = {0: "1 2|3 4|5 6", 1: "1|3|5|2|4|6"}


@query(f"SELECT conv_id AS doc_id, turn AS page, CASE turn % 2 WHEN 0 THEN '{_ORDER[0]}' ELSE '{_ORDER[1]}' END AS lines FROM conversations")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of pages, the odd ones with two columns, in reading order; baselines stray a little."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"))
    n = turns.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(5))))
    width = F.when(F.col("page") % 2 == 0, 500.0).otherwise(200.0)
    made = n.select(
        "doc_id", "page", F.when(F.col("n") % 2 == 0, 10.0).otherwise(330.0).alias("x"), (700.0 - 20 * F.floor(F.col("n") / 2) + F.when(F.col("n") == 3, 1.5).otherwise(0.0)).alias("y"), width.alias("width"),
        (F.col("n") + 1).cast("string").alias("text"), F.lit(600.0).alias("page_width"),
    )
    found = pages.page_lines(made).groupBy("doc_id", long("page")).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return found.select("doc_id", "page", F.array_join(F.transform("l", lambda x: x["text"]), "|").alias("lines"))


@query("""SELECT item_id AS doc_id, CASE item_id % 5 WHEN 0 THEN 'The PDF is encrypted.' WHEN 1 THEN 'The PDF is damaged.' WHEN 2 THEN 'The PDF has 401 pages; the limit is 400.'
 WHEN 3 THEN CASE WHEN length(text) < 2000 THEN 'The PDF holds hardly any text; it may be a scan.' END END AS error FROM benchmark""")
def pdf_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, k = table(spark, sf_dir, "benchmark"), F.col("item_id") % 5
    lines = items.select(F.col("item_id").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("line"), "text")
    n_pages = F.when(k == 2, 401).when(k == 3, 100).otherwise(1)
    pdfs = items.select(F.col("item_id").alias("doc_id"), n_pages.alias("n_pages"), (k == 0).alias("encrypted"), F.when(k == 1, True).alias("damaged"))
    return pages.guarded(pdfs, lines)


@query("SELECT conv_id AS doc_id, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(count(*) AS BIGINT) AS n_pages, sum(length(text)) < 20 * count(*) AS is_scan FROM conversations GROUP BY conv_id")
def scan_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    return pages.scanned(turns, turns.groupBy("doc_id").agg(F.count("*").alias("n_pages")))


# Lookups


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'retryable' WHEN 3 THEN 'retryable' WHEN 4 THEN 'fatal' ELSE 'fatal' END AS class FROM events")
def http_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    status = F.when(k < 3, 200).when(k == 3, 503).when(k == 4, 429).otherwise(404)
    error = F.when(k == 1, "It hasn't returned any results for this query.").when(k == 2, "We couldn't get valid results").when(k == 4, "You have run out of searches.")
    return table(spark, sf_dir, "events").select("event_id", live.classified(status, error).alias("class"))


@query("""SELECT event_id, '{"keep":[{"text":"api_key=[REDACTED]&n=' || event_id || '"}],"n":' || event_id || '}' AS body FROM events""")
def sanitized_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without an account's fields, endpoints and archive links."""
    k = F.col("event_id").cast("string")
    body = F.concat(F.lit('{"json_endpoint":"x","a_endpoint":1,"t":"https://s.example/searches/'), k, F.lit('.json","keep":[{"api_key":"k","text":"api_key=abc&n='), k, F.lit('"}],"n":'), k, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", udfs.sanitized_json(body).alias("body"))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN greatest(0, c_custkey % 7 - 2) WHEN c_custkey % 3 = 1 THEN c_nationkey ELSE 0 END AS BIGINT) AS searches_left, CAST(c_custkey % 100 AS BIGINT) AS hourly_limit FROM customer")
def account_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account's counts, whichever of its fields are there."""
    k = F.col("c_custkey")
    account = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, k % 7 - 2).alias("total_searches_left"), F.when(k % 3 == 1, F.col("c_nationkey")).alias("plan_searches_left"), (k % 100).alias("account_rate_limit_per_hour"))
    return control.quota(account, ["c_custkey"]).select("c_custkey", F.col("searches_left").cast("long").alias("searches_left"), long("hourly_limit"))


_TITLES = "'A study of item ' || translate(CAST(item_id AS VARCHAR), '0123456789', 'abcdefghij') || ' in print'"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.translate(F.col("item_id").cast("string"), "0123456789", "abcdefghij")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.concat(F.lit("A study of item "), number, F.lit(" in print")).alias("title"))


def _item_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    sure = F.struct(*(F.lit(1.0).alias(n) for n in ("title", "authors", "year", "venue", "doi")))
    author = F.struct(F.lit("Doe").alias("surname"), F.lit("J").alias("given"))
    fields = F.struct(F.col("title"), F.array(author).alias("authors"), F.lit(False).alias("et_al"), F.lit(2010).alias("year"), F.lit("Leaf Studies").alias("venue"), none.alias("doi"), F.lit("article").alias("entry_type"), sure.alias("confidence"))
    return _items(spark, sf_dir).select(F.lit(1).cast("long").alias("doc_id"), "idx", F.col("title").alias("raw"), F.lit("text").alias("source_format"), none.alias("key"), F.lit(1).alias("line"), fields.cast(FIELDS).alias("fields"))


def _transport(params: dict) -> dict:
    """A third of the items are found, a third has no results, and a third is refused."""
    letters = params["q"].strip('"').split(" in print")[0].rpartition(" ")[2]
    kind = int(letters.translate(str.maketrans("abcdefghij", "0123456789"))) % 3
    if kind == 2:
        raise live.TransportError("refused", retryable=False)
    if kind:
        return {"error": "The service hasn't returned any results", "organic_results": []}
    return {"organic_results": [{"title": params["q"].strip('"'), "publication_info": {"summary": "J Doe - Leaf Studies, 2010 - x.org"}}]}


@query("SELECT item_id AS idx, CASE item_id % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'NOT_FOUND' ELSE 'SKIPPED_BUDGET' END AS verdict, CAST(CASE item_id % 3 WHEN 0 THEN 1 ELSE 2 END AS BIGINT) AS asked FROM benchmark")
def search_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups over a scripted transport: what is stored, refused, empty or found."""
    nothing = spark.createDataFrame([], "key string, engine string, query string, created timestamp, body string")
    results, _, _ = check.check_live(_item_refs(spark, sf_dir), nothing, _transport, max_searches=1_000_000)
    return results.select("idx", "verdict", F.size("queries").cast("long").alias("asked"))


@query(f"SELECT item_id AS idx, CAST(ordinal AS BIGINT) AS ordinal, CASE ordinal WHEN 1 THEN '\"' || t || '\"' ELSE t || ' author:\"Doe\"' END AS query, '10' AS num, 'en' AS hl FROM (SELECT item_id, {_TITLES} AS t, unnest([1, 2]) AS ordinal FROM benchmark)")
def query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scholarly query asks for: the page size and the language."""
    planned = search.planned(_items(spark, sf_dir).withColumn("surname", F.lit("Doe")).withColumn("entry_type", F.lit("article")))
    p = F.col("params")
    return planned.select("idx", long("ordinal"), "query", p["num"].alias("num"), p["hl"].alias("hl"))


@query(f"SELECT '\"' || {_TITLES} || '\"' AS query, CAST(row_number() OVER (ORDER BY {_TITLES}) AS BIGINT) AS place, CAST(item_id AS VARCHAR) AS title FROM benchmark WHERE item_id % 2 = 0")
def replay_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored answers that planned queries use, written as a bundle in order and read again."""
    planned = search.planned(_items(spark, sf_dir).withColumn("surname", F.lit("")).withColumn("entry_type", F.lit("article"))).where("ordinal = 1")
    body = F.to_json(F.struct(F.array(F.struct(F.col("idx").cast("string").alias("title"))).alias("organic_results")))
    store = planned.where("idx % 2 = 0").select(F.col("cache_key").alias("key"), "engine", "query", F.lit("2026-01-01").cast("timestamp").alias("created"), body.alias("body"))
    used = files.bundle(store, planned)
    whole = used.agg(F.array_sort(F.collect_list(F.struct("engine", "query", F.to_json("entry").alias("entry")))).alias("e"))  # a bundle is one document
    path = shared_path(spark, "bundle")
    entries = F.array_join(F.transform("e", lambda x: x["entry"]), ",")
    whole.select(F.concat(F.lit('{"format":1,"generated":"2026-01-01 00:00:00","entries":['), entries, F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    order = F.transform("e", lambda x: x["query"])
    places = whole.select(F.posexplode(order).alias("place", "q"))
    again = files.read_bundle(spark, path)
    return again.join(places, F.col("query") == F.col("q")).select("query", (F.col("place") + 1).cast("long").alias("place"), F.get_json_object("body", "$.organic_results[0].title").alias("title"))


@query("""WITH p AS (SELECT item_id, item_id % 4 AS k FROM benchmark), n AS (SELECT CAST(count(*) FILTER (k = 0) AS BIGINT) AS first, CAST(count(*) FILTER (k = 0) * 2 + count(*) FILTER (k = 1) AS BIGINT) AS worst FROM p)
 SELECT CAST(least(50, ceil(first * 1.5)) AS BIGINT) AS estimate, least(50, worst) AS worst_case, CAST(40 AS BIGINT) AS searches_left, 40 >= least(50, ceil(first * 1.5)) AS allowed, CAST(40 AS BIGINT) AS "limit", CAST(80.0 AS DOUBLE) AS per_hour FROM n""")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a quarter of the items no answer is stored, and of another the first one only; each reference stands twice."""
    planned = search.planned(_items(spark, sf_dir).withColumn("surname", F.lit("Doe")).withColumn("entry_type", F.lit("article")))
    k = F.col("idx") % 4
    store = planned.where((k > 1) | ((k == 1) & (F.col("ordinal") == 1))).select(F.col("cache_key").alias("key"))
    lacking = control.uncached(planned, store).select(F.lit(1).alias("doc_id"), "idx", "ordinal", "cache_key")
    twice = lacking.unionByName(lacking.where("ordinal = 2").withColumn("doc_id", F.lit(2)))
    account = spark.createDataFrame([(None, 40, 100)], "total_searches_left int, plan_searches_left int, account_rate_limit_per_hour int")
    return control.preflight(twice, account).select(*(long(c) for c in ("estimate", "worst_case", "searches_left")), "allowed", long("limit"), "per_hour")


@query("WITH s AS (SELECT user_id || '-' || props AS key, 'b' || event_id AS body, ts, user_id FROM events) SELECT key, arg_max(body, (ts, body)) AS body FROM s WHERE user_id % 3 = 0 GROUP BY key")
def cache_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refloom.queries.control import _store as responses

    keys = table(spark, sf_dir, "events").where("user_id % 3 = 0").select(F.concat_ws("-", F.col("user_id").cast("string"), "props").alias("key"))
    none = spark.createDataFrame([("not stored",)], "key string")
    return control.exported(responses(spark, sf_dir), keys.union(none)).select("key", "body")


@query("""WITH RECURSIVE j AS (SELECT s_suppkey AS job_id, s_suppkey * 10 AS started, s_suppkey * 10 + s_nationkey * 3 + 1 AS ended, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier),
 r AS (SELECT n, job_id, true AS ok, [ended] AS ends FROM j WHERE n = 1 UNION ALL
 SELECT j.n, j.job_id, len([e FOR e IN r.ends IF e > j.started]) < 2, CASE WHEN len([e FOR e IN r.ends IF e > j.started]) < 2 THEN list_append([e FOR e IN r.ends IF e > j.started], j.ended) ELSE [e FOR e IN r.ends IF e > j.started] END FROM r JOIN j ON j.n = r.n + 1)
 SELECT job_id, ok AS admitted FROM r""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that are let in while fewer than two others run."""
    s = table(spark, sf_dir, "supplier")
    time = lambda seconds: F.timestamp_seconds(seconds)
    made = s.select(F.col("s_suppkey").alias("job_id"), time(F.col("s_suppkey") * 10).alias("started"), time(F.col("s_suppkey") * 10 + F.col("s_nationkey") * 3 + 1).alias("ended"))
    return control.admitted(made).select("job_id", "admitted")


@query("SELECT event_id, count(*) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 500 AS granted FROM events")
def global_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One budget for all requests."""
    return control.granted_by_all(table(spark, sf_dir, "events"), [([], 500)], ["ts", "event_id"]).select("event_id", "granted")


# References


@query("SELECT doc_id AS idx, min(doc_id) OVER (PARTITION BY lang, doc_id % 50) AS original FROM documents")
def dedupe_wide_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and names spelt with Vietnamese, decomposed, full-width, ligature and Cyrillic letters fold alike."""
    k = F.col("idx") % 4
    pick = lambda *forms: F.element_at(F.array(*map(F.lit, forms)), (k + 1).cast("int"))
    title = F.concat(pick("Nguyễn", "Nguyễn", "Ｎｇｕｙｅｎ", "nguyen"), F.lit(" works of "), pick("Ёлка", "ёлка", "Ёлка", "ЁЛКА"), F.lit(" "), pick("ﬁne", "fine", "Fine", "ｆｉｎｅ"), F.lit(" "), (F.col("idx") % 50).cast("string"))
    none = F.lit(None).cast("string")
    author = F.struct(pick("Trần", "Trần", "Ｔｒａｎ", "Tran").alias("surname"), F.lit("").alias("given"))
    fields = F.struct(title.alias("title"), F.array(author).alias("authors"), F.lit(2000).alias("year"), none.alias("venue"), none.alias("doi"), none.alias("entry_type"))
    rows = refs(spark, sf_dir).withColumn("dedupe_key", references.dedupe_key(fields, F.lit("")))
    return references.with_original(rows, ["lang"]).select("idx", "original")


# Reports


def _summary(results: DataFrame) -> DataFrame:
    return match.summarised(results, ["doc_id"])


@query(f"WITH {VERDICTS_SQL} SELECT user_id AS doc_id, CAST(count(*) AS BIGINT) AS total, string_agg(event_id || ' ' || verdict, ',' ORDER BY event_id) AS results FROM verd GROUP BY user_id")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in JSON, read again."""
    rows = _results(spark, sf_dir)
    made = reports.json_report(rows, _summary(rows))
    r = F.from_json("report", "struct<summary:struct<total:bigint>,results:array<struct<idx:bigint,verdict:string>>>")
    said = F.array_join(F.transform(r["results"], lambda x: F.concat_ws(" ", x["idx"].cast("string"), x["verdict"])), ",")
    return made.select("doc_id", r["summary"]["total"].alias("total"), said.alias("results"))


_SEVERITY = "CASE verdict WHEN 'NOT_FOUND' THEN 0 WHEN 'METADATA_MISMATCH' THEN 1 WHEN 'UNPARSEABLE' THEN 2 WHEN 'SKIPPED_BUDGET' THEN 3 ELSE 4 END"


@query(f"WITH {VERDICTS_SQL} SELECT user_id AS doc_id, CAST(count(*) FILTER (verdict = 'VERIFIED') AS VARCHAR) AS verified, string_agg(event_id, ',' ORDER BY {_SEVERITY}, event_id) AS rows FROM verd GROUP BY user_id")
def html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their counts and rows, the worst first."""
    rows = _results(spark, sf_dir)
    page = reports.html(rows, _summary(rows))
    return page.select("doc_id", F.regexp_extract("html", '<li class="verified">Verified: (\\d+)</li>', 1).alias("verified"), F.array_join(F.regexp_extract_all("html", F.lit("<tr><td>(\\d+)</td>"), F.lit(1)), ",").alias("rows"))


@query(f"WITH {VERDICTS_SQL} SELECT user_id AS doc_id, '2.1.0' AS version, CAST(4 AS BIGINT) AS n_rules, coalesce(string_agg({SARIF_RULES}, ',' ORDER BY event_id) FILTER (verdict <> 'VERIFIED'), '') AS rules FROM verd GROUP BY user_id")
def sarif_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole logs, read again."""
    rows = _results(spark, sf_dir)
    log = F.from_json("sarif", "struct<version:string,runs:array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,results:array<struct<ruleId:string>>>>>")
    run = F.get(log["runs"], F.lit(0))
    return reports.sarif(rows, _summary(rows)).select("doc_id", log["version"].alias("version"), F.size(run["tool"]["driver"]["rules"]).cast("long").alias("n_rules"), F.array_join(F.transform(run["results"], lambda r: r["ruleId"]), ",").alias("rules"))


@query(f"WITH {VERDICTS_SQL} SELECT user_id AS doc_id, CAST(count(*) FILTER (verdict IN ('NOT_FOUND', 'METADATA_MISMATCH')) AS BIGINT) AS problems FROM verd GROUP BY user_id")
def problem_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(_results(spark, sf_dir)).select("doc_id", (F.col("not_found") + F.col("metadata_mismatch")).alias("problems"))


# Evaluation


_LABELLED = CHECK + """, o2 AS (SELECT 'r' || idx AS id, CASE WHEN idx % 3 = 0 THEN 'real' ELSE 'fabricated' END AS kind, source = 'web' AS indian, CASE idx % 3 WHEN 1 THEN 'wrong_year' WHEN 2 THEN 'invented' END AS perturbation, source,
 CASE idx % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'METADATA_MISMATCH' ELSE 'NOT_FOUND' END AS expected, verdict FROM v)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check says of every document's citation, joined to labels for them by key."""
    cited, stored = _store(spark, sf_dir)
    k = F.col("idx")
    labels = cited.select(
        F.concat(F.lit("r"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "real").otherwise("fabricated").alias("kind"), (F.col("source") == "web").alias("indian"), F.when(k % 3 == 1, "wrong_year").when(k % 3 == 2, "invented").alias("perturbation"), "source",
        F.when(k % 3 == 0, "VERIFIED").when(k % 3 == 1, "METADATA_MISMATCH").otherwise("NOT_FOUND").alias("expected"),
    )
    results = check.check_references(cited.drop("source").withColumn("key", F.concat(F.lit("r"), k.cast("string"))), stored, searching=UNCUT)
    return evaluate.outcomes(results, labels)


@query(_LABELLED + " SELECT id, kind, perturbation, expected, verdict FROM o2")
def labelled_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("id", "kind", "perturbation", "expected", "verdict")


@query(_LABELLED.replace("o2 AS", "outcomes AS") + f", h AS (SELECT source, {_HEAD} FROM outcomes GROUP BY source) SELECT {_RATES} FROM h")
def labelled_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False alarms and detection of the check's own verdicts."""
    return evaluate.headline(_labelled(spark, sf_dir), ["source"])


@query(f"WITH {OUTCOMES}, e AS (SELECT unnest(['VERIFIED', 'METADATA_MISMATCH', 'NOT_FOUND']) AS expected), c AS (SELECT e.expected, {_COUNTS.replace('verdict', 'o.verdict')} FROM e LEFT JOIN outcomes o ON o.expected = e.expected GROUP BY e.expected) SELECT '| ' || expected || ' | ' || " + " || ' | ' || ".join(v.lower() for v in VERDICTS) + " || ' |' AS line FROM c")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion matrix of the report in Markdown."""
    text = reports.evaluation_markdown(outcomes(spark, sf_dir))
    table_at = text.index("| Expected |")
    lines = [line for line in text[table_at:].splitlines()[2:] if line]
    return spark.createDataFrame([(line,) for line in lines], "line string")


@query("SELECT doc_id AS id, doc_id % 3 = 0 AS kept, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'year differs' ELSE 'not validated' END AS problems FROM documents")
def kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows that validated, and the others with their reasons."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    k = F.col("id") % 3
    said = rows.where(k < 2).select("id", (k == 0).alias("ok"), F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("year differs"))).alias("problems"))
    kept, dropped = evaluate.kept_rows(rows, said)
    return kept.select("id", F.lit(True).alias("kept"), F.lit("").alias("problems")).unionByName(dropped.select("id", F.lit(False).alias("kept"), F.array_join("problems", "; ").alias("problems")))


# Streams


def _drained(spark: SparkSession, sf_dir: str, build, mode: str) -> DataFrame:
    """The events as a stream, run until all are read; the rows of each batch with its number."""
    schema = table(spark, sf_dir, "events").schema
    stream = build(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    path = shared_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{path}/rows")

    started = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).queryName(f"drained-{uuid.uuid4().hex}").start()
    started.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/rows")


@query("SELECT user_id AS job_id, CAST(count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS BIGINT) AS done FROM events GROUP BY user_id")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a stream of job events, as of its end."""
    out = _drained(spark, sf_dir, lambda s: jobs.progress(_events(s)), "update")
    return out.groupBy("job_id").agg(F.max_by("done", "batch").alias("done"))


def _events(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("progress")
    return rows.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("event_id").alias("idx"), F.lit("VERIFIED").alias("verdict"))


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 b AS (SELECT user_id, event_id, n, t, CAST(1.0 AS DOUBLE) AS tokens FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.event_id, r.n, r.t, least(CAST(2.0 AS DOUBLE), b.tokens + (CAST(r.t AS DOUBLE) - CAST(b.t AS DOUBLE)) * (CAST(2.0 AS DOUBLE) / 3600)) - 1.0 FROM b JOIN r ON r.user_id = b.user_id AND r.n = b.n + 1)
 SELECT event_id, round(greatest(0.0, -tokens / (CAST(2.0 AS DOUBLE) / 3600)), 3) AS wait_s FROM b""")
def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paced requests as a stream with state."""
    out = _drained(spark, sf_dir, lambda s: jobs.paced(s.select(F.col("user_id").alias("account"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts")), 2.0), "append")
    return out.select(F.col("request_id").alias("event_id"), F.round("wait_s", 3).alias("wait_s"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g), b AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, burst)
 SELECT user_id AS job_id, epoch_us(start) AS start_us, CAST(n AS BIGINT) AS n FROM b WHERE stop <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_quiet_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events that a quiet hour has ended."""
    out = _drained(spark, sf_dir, lambda s: jobs.quiet_periods(_events(s), "1 hour", "1 hour"), "append")
    return out.select("job_id", F.unix_micros("start").alias("start_us"), "n")
