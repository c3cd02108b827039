"""Planning, lookups, budgets, caches and job events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refloom.config import SEARCH
from refloom.operators import control, search
from refloom.queries.base import PAIRS, REFS, long, pairs, query, refs, table
from refloom.sources import files
from refloom.streaming import jobs

_Q = """q AS (SELECT idx, trim(regexp_replace(regexp_replace(title, '["“”«»]', ' ', 'g'), '\\s+', ' ', 'g')) AS t, list_last(string_split_regex(trim(surname), '\\s+')) AS s, idx % 4 = 0 AS web FROM refs WHERE title <> ''),
 c AS (SELECT *, CASE WHEN length(t) <= 256 THEN t WHEN contains(substr(t, 1, 256), ' ') THEN regexp_replace(substr(t, 1, 256), ' [^ ]*$', '') ELSE substr(t, 1, 256) END AS u FROM q),
 plan AS (SELECT idx, 1 AS ordinal, 'google_scholar' AS engine, '"' || u || '"' AS query FROM c UNION ALL SELECT idx, 2, 'google_scholar', u || CASE WHEN s <> '' THEN ' author:"' || s || '"' ELSE '' END FROM c
 UNION ALL SELECT idx, 3, 'google', '"' || u || '"' || CASE WHEN s <> '' THEN ' ' || s ELSE '' END FROM c WHERE web)"""
PLAN = f"WITH {REFS}, {_Q}"
KEY = """sha256('{' || CASE engine WHEN 'google' THEN '"engine":"google","gl":"in","hl":"en","q":' ELSE '"engine":"google_scholar","hl":"en","num":"10","q":' END || '"' || replace(replace(query, '\\', '\\\\'), '"', '\\"') || '"}')"""


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("idx") % 4 == 0, "book").otherwise("article")
    return search.planned(refs(spark, sf_dir).withColumn("entry_type", kinds))


@query(PLAN + " SELECT idx, CAST(ordinal AS BIGINT) AS ordinal, engine, query FROM plan")
def plan_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).select("idx", long("ordinal"), "engine", "query")


@query(PLAN + f" SELECT idx, CAST(ordinal AS BIGINT) AS ordinal, {KEY} AS cache_key FROM plan")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).select("idx", long("ordinal"), "cache_key")


@query(PLAN + f", k AS (SELECT idx, ordinal, {KEY} AS key FROM plan), s AS (SELECT key, min(idx) AS body FROM k WHERE ordinal = 1 GROUP BY key HAVING min(idx) % 3 > 0) SELECT k.idx, CAST(k.ordinal AS BIGINT) AS ordinal, CASE WHEN s.key IS NULL THEN 'miss' ELSE 'cache' END AS source, CAST(s.body AS VARCHAR) AS body FROM k LEFT JOIN s ON s.key = k.key")
def response_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned queries against a store of two thirds of the first ones."""
    planned = plan(spark, sf_dir)
    store = planned.where("ordinal = 1").groupBy(F.col("cache_key").alias("key")).agg(F.min("idx").alias("body")).where("body % 3 > 0").withColumn("body", F.col("body").cast("string"))
    return control.looked_up(planned, store).select("idx", long("ordinal"), "source", "body")


@query(PLAN + f", k AS (SELECT idx, {KEY} AS key FROM plan WHERE ordinal = 1), s AS (SELECT key FROM k GROUP BY key HAVING min(idx) % 3 > 0) SELECT idx FROM k WHERE key NOT IN (SELECT key FROM s)")
def uncached_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = plan(spark, sf_dir).where("ordinal = 1")
    store = first.groupBy(F.col("cache_key").alias("key")).agg(F.min("idx").alias("least")).where("least % 3 > 0")
    return control.uncached(first, store).select("idx")


@query(PLAN + f", k AS (SELECT {KEY} AS cache_key FROM plan) SELECT cache_key, CAST(count(*) AS BIGINT) AS requests FROM k GROUP BY cache_key")
def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.single_flight(plan(spark, sf_dir))


@query("SELECT event_id, event_type <> 'click' OR live <= 20 AS granted FROM (SELECT event_id, event_type, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS live FROM events)")
def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are live searches with a budget of 20 for each user; the rest is free."""
    return control.granted(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 20, F.col("event_type") == "click").select("event_id", "granted")


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 5 AS g FROM events), b AS (SELECT *, g AND count(*) FILTER (g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 12 AS h FROM a) SELECT event_id, h AS granted FROM b")
def combined_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap for each user's jobs within a cap for the user."""
    return control.granted_by_all(table(spark, sf_dir, "events"), [(["user_id", "event_type"], 5), (["user_id"], 12)], ["ts", "event_id"]).select("event_id", "granted")


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 b AS (SELECT user_id, event_id, n, t, CAST(1.0 AS DOUBLE) AS tokens FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.event_id, r.n, r.t, least(CAST(2.0 AS DOUBLE), b.tokens + (CAST(r.t AS DOUBLE) - CAST(b.t AS DOUBLE)) * (CAST(2.0 AS DOUBLE) / 3600)) - 1.0 FROM b JOIN r ON r.user_id = b.user_id AND r.n = b.n + 1)
 SELECT event_id, round(greatest(0.0, -tokens / (CAST(2.0 AS DOUBLE) / 3600)), 3) AS wait_s FROM b""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests an hour for each user."""
    out = control.token_bucket(table(spark, sf_dir, "events"), "user_id", ["event_id"], F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0, 2.0)
    return out.select("event_id", F.round("wait_s", 3).alias("wait_s"))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), "props").alias("key"), F.col("event_type").alias("engine"), F.col("props").alias("query"), F.col("ts").alias("created"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("body"))


STORE = "store AS (SELECT user_id || '-' || props AS key, event_type AS engine, props AS query, ts AS created, 'b' || event_id AS body FROM events)"
AS_OF = "2024-01-20 00:00:00"


@query(f"WITH {STORE} SELECT key, body FROM store WHERE created >= TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.fresh(_store(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), 5).select("key", "body")


@query(f"WITH {STORE} SELECT key, arg_max(body, (created, body)) AS body, arg_max(engine, (created, body)) AS engine FROM store GROUP BY key")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.latest(_store(spark, sf_dir)).select("key", "body", "engine")


@query(f"WITH {STORE} SELECT key, arg_max(body, (created, body)) AS body FROM (SELECT key, body, created FROM store UNION ALL SELECT key, 'new', TIMESTAMP '2030-01-01' FROM store WHERE engine = 'view') GROUP BY key")
def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _store(spark, sf_dir)
    new = old.where("engine = 'view'").withColumn("created", F.lit("2030-01-01").cast("timestamp")).withColumn("body", F.lit("new"))
    return files.put_responses(old, new).select("key", "body")


@query(f"WITH {STORE} SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (created < TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY) AS BIGINT) AS expired, CAST(sum(strlen(body)) AS BIGINT) AS size_bytes FROM store")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.cache_stats(_store(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), 5)


@query("""WITH a AS (SELECT l_orderkey AS request_id, l_linenumber AS attempt, CASE l_returnflag WHEN 'A' THEN 'timeout' WHEN 'N' THEN 'retryable' ELSE 'ok' END AS result, l_linestatus = 'F' AS early, l_suppkey, l_partkey, l_quantity FROM lineitem),
 n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt, l_partkey, l_suppkey, l_quantity) AS k FROM a),
 s AS (SELECT *, coalesce(max(CAST(result = 'ok' OR k > 3 AS INTEGER)) OVER w, 0) AS settled, coalesce(max(CAST(result = 'timeout' AS INTEGER)) OVER w, 0) AS late FROM n WINDOW w AS (PARTITION BY request_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT request_id, CAST(count(*) AS BIGINT) AS attempts, CAST(sum(CASE WHEN result = 'timeout' THEN 1 WHEN result = 'ok' AND NOT (late = 1 AND early) THEN 1 ELSE 0 END) AS BIGINT) AS credits, CASE WHEN arg_max(result, k) = 'ok' THEN 'answered' ELSE 'failed' END AS outcome FROM s WHERE settled = 0 GROUP BY request_id""")
def retry_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as attempts of a request."""
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    sent = F.col("l_shipdate")
    made = F.when(F.col("l_linestatus") == "F", sent - F.expr("INTERVAL 1 MINUTE")).otherwise(sent)
    result = F.when(F.col("l_returnflag") == "A", control.TIMEOUT).when(F.col("l_returnflag") == "N", control.REFUSED).otherwise(control.ANSWERED)
    attempts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), k.alias("attempt"), result.alias("result"), sent.alias("sent_at"), made.alias("created_at"))
    return control.billed(attempts)


@query("SELECT event_id, 'GET /?q=1&api_key=[REDACTED]&x=' || event_id || ' key [REDACTED] not ' || sha1(CAST(event_id AS VARCHAR)) || ' secret [REDACTED]' AS line FROM events")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id").cast("string")
    line = F.concat(F.lit("GET /?q=1&api_key="), F.md5(k), F.lit("&x="), k, F.lit(" key "), F.sha2(k, 256), F.lit(" not "), F.sha1(k), F.lit(" secret hunter2hunter2"))
    return table(spark, sf_dir, "events").select("event_id", control.redacted(line, ["hunter2hunter2", "short"]).alias("line"))


@query("SELECT c_custkey, CAST(least(50, ceil(c_nationkey * 1.5)) AS BIGINT) AS searches, CASE WHEN c_custkey % 200 > 0 THEN greatest(1.0, (c_custkey % 200) * CAST(0.8 AS DOUBLE)) END AS per_hour, least(20.0, pow(2.0, c_nationkey % 8)) AS ceiling FROM customer")
def quota_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", control.estimated_searches(n, SEARCH.max_searches).cast("long").alias("searches"), control.pacing_rate(F.col("c_custkey") % 200).alias("per_hour"), control.backoff_ceiling(n % 8).alias("ceiling"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS done, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM events")
def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w.orderBy("ts", "event_id")).cast("long").alias("done"), F.count("*").over(w).alias("total"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("progress")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", kind.alias("kind"), F.col("event_id").alias("idx"), F.lit("VERIFIED").alias("verdict"))


_STATE = "j AS (SELECT user_id AS job_id, CASE arg_max(event_type, ts) WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS state, max(ts) AS last_at FROM events GROUP BY user_id)"


@query(f"WITH {_STATE} SELECT job_id, state FROM j")
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_state(_jobs(spark, sf_dir)).select("job_id", "state")


@query(f"WITH {_STATE} SELECT job_id FROM j WHERE state IN ('done', 'failed') AND last_at < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def job_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))  # one row
    state = jobs.latest_state(_jobs(spark, sf_dir)).crossJoin(F.broadcast(now))
    return jobs.expired(state, F.col("now"), 6 * 3600).select("job_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.tumbling_counts(table(spark, sf_dir, "events")).select("start", "event_type", "n")


@query(PAIRS + " SELECT idx, work_id, CAST(versions AS BIGINT) AS versions FROM pairs")
def catalogue_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations looked up in a catalogue by their folded title."""
    return pairs(spark, sf_dir).select("idx", "work_id", "versions")
