"""What stands in for a search client: cache keys, lookups in stored responses, budgets, retries and quotas, as relational operators.

Order in time is an explicit column everywhere, so that results don't depend on which task runs first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from refloom.config import SEARCH, Search
from refloom.errors import HIDDEN, KEY_LIKE, KEY_VALUE, worth_hiding
from refloom.operators.numbering import RUN, in_runs, running_min, running_sum

ANSWERED, TIMEOUT, REFUSED, FAILED = "ok", "timeout", "retryable", "fatal"


def json_string(text: Column) -> Column:
    """A JSON string literal with characters beyond ASCII as they are."""
    for char, by in (("\\\\", r"\\\\"), ('"', r'\\"'), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"), ("\b", r"\\b"), ("\f", r"\\f")):
        text = F.regexp_replace(text, char if char != "\b" else r"\x08", by)
    return F.concat(F.lit('"'), text, F.lit('"'))


def cache_key(params: Column) -> Column:
    """SHA-256 of a map of parameters as JSON, keys in order, without the secret one. to_json promises no order, so the text is put together here."""
    entries = F.array_sort(F.filter(F.map_entries(params), lambda e: e["key"] != "api_key"))
    pairs = F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_string(e["value"])))
    return F.sha2(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).cast("binary"), 256)


def latest(responses: DataFrame) -> DataFrame:
    """One row for each key, the latest; of equal times the greatest body. An aggregate, so a key with many rows is combined before the shuffle."""
    value = F.struct("created", "body", "engine", "query")
    return responses.groupBy("key").agg(F.max(value).alias("v")).select("key", "v.engine", "v.query", "v.created", "v.body")


def fresh(responses: DataFrame, as_of: Column, ttl_days: int = SEARCH.cache_ttl_days) -> DataFrame:
    """Rows that have not outlived their time; a plain bound on `created`, which reaches the scan."""
    return responses.where(F.col("created") >= as_of - F.make_dt_interval(F.lit(ttl_days)))


def cache_stats(responses: DataFrame, as_of: Column, ttl_days: int = SEARCH.cache_ttl_days) -> DataFrame:
    cutoff = as_of - F.make_dt_interval(F.lit(ttl_days))
    return responses.agg(F.count("*").alias("entries"), F.count_if(F.col("created") < cutoff).alias("expired"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("size_bytes"))


def looked_up(planned: DataFrame, responses: DataFrame, key: str = "cache_key") -> DataFrame:
    """The planned queries with `body` and `source` (cache or miss); no query is lost. Spark broadcasts the store if it is small and merges if not."""
    store = responses.select(F.col("key").alias(key), "body")
    return planned.join(store, key, "left").withColumn("source", F.when(F.col("body").isNotNull(), "cache").otherwise("miss"))


def uncached(planned: DataFrame, responses: DataFrame, key: str = "cache_key") -> DataFrame:
    return planned.join(responses.select(F.col("key").alias(key)), key, "left_anti")


def single_flight(requests: DataFrame, key: str = "cache_key") -> DataFrame:
    """Equal requests once, with how many there were."""
    return requests.groupBy(key).agg(F.count("*").alias("requests"))


def _refused(limit: int | float | Column, what: str, least: float) -> None:
    if not isinstance(limit, Column) and not limit >= least:
        raise ValueError(f"{what} may not be under {least:g}")


def granted(requests: DataFrame, by: list[str], order: list[str], limit: int | Column, live: Column | None = None) -> DataFrame:
    """Adds `granted`: whether the budget of its account still had a credit for a request. Requests that are not live cost nothing."""
    _refused(limit, "a budget", 0)
    live = F.coalesce(F.lit(True) if live is None else live, F.lit(False))
    rows = running_sum(in_runs(requests.withColumn("n_live", live.cast("int")), order), by, order, "n_spent", F.col("n_live"))
    return rows.withColumn("granted", (F.col("n_live") == 0) | (F.col("n_spent") <= limit)).drop("n_live", "n_spent", RUN)


def granted_by_all(requests: DataFrame, budgets: list[tuple[list[str], int]], order: list[str]) -> DataFrame:
    """Adds `granted` for several budgets that have to agree, all or none; a budget without an account is one for all requests.

    A request that one budget refuses spends nothing of the others. With nested accounts, the innermost first, its refusals are known before
    the next one counts.
    """
    if not budgets:
        raise ValueError("at least one budget is needed")
    out = in_runs(requests.withColumn("granted", F.lit(True)), order)
    for by, limit in budgets:
        _refused(limit, "a budget", 0)
        out = running_sum(out, by, order, "n_spent", F.col("granted").cast("int"))
        out = out.withColumn("granted", F.col("granted") & (F.col("n_spent") <= limit)).drop("n_spent")
    return out.drop(RUN)


def token_bucket(requests: DataFrame, by: str, order: list[str], seconds: Column, per_hour: float) -> DataFrame:
    """by, waits: for each request of an account, in order of time, the seconds to wait.

    After its i-th request an account has the least, over all j up to i, of what a bucket that was full at request j holds now: capacity + rate (t_i - t_j) - (i - j + 1).
    So a running count and a running least say all, and an account of any size is spread over tasks.
    """
    if not per_hour > 0:
        raise ValueError("a rate has to be over 0")
    capacity, rate = float(max(1.0, per_hour)), per_hour / 3600.0
    time = ["n_time", *order]
    # Seconds from a whole number of them near the first request, so that small differences keep their digits.
    start = requests.agg(F.floor(F.min(seconds))).first()[0] or 0
    rows = in_runs(requests.withColumn("n_time", seconds.cast("double") - F.lit(float(start))), time)
    rows = running_sum(rows, [by], time, "n_th", F.lit(1))
    rows = running_min(rows, [by], time, "n_least", F.col("n_th") - F.lit(rate) * F.col("n_time"))
    tokens = F.lit(capacity - 1.0) + F.lit(rate) * F.col("n_time") - F.col("n_th") + F.col("n_least")
    return rows.select(by, *order, F.greatest(F.lit(0.0), -tokens / F.lit(rate)).alias("wait_s"))


def billed(attempts: DataFrame, cfg: Search = SEARCH) -> DataFrame:
    """request_id, attempts, credits, outcome of requests whose attempts (request_id, attempt, result, sent_at, created_at) are tried until one settles.

    An answer costs a credit, and so does a timeout, since the service may have finished. An answer after a timeout that the service had
    made well before it was asked came from its own cache and costs nothing.
    """
    w = Window.partitionBy("request_id").orderBy("attempt")
    settles = F.col("result").isin(ANSWERED, FAILED) | (F.col("attempt") > cfg.max_retries)
    before = F.coalesce(F.max(settles.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    timed_out = F.coalesce(F.max((F.col("result") == TIMEOUT).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    margin = F.make_dt_interval(secs=F.lit(float(cfg.upstream_cache_margin_s)))
    free = timed_out & F.coalesce(F.col("created_at") < F.col("sent_at") - margin, F.lit(False))
    cost = F.when(F.col("result") == TIMEOUT, 1).when((F.col("result") == ANSWERED) & ~free, 1).otherwise(0)
    tried = attempts.withColumn("cost", cost).withColumn("settled_before", before).where("settled_before = 0")
    return tried.groupBy("request_id").agg(
        F.count("*").alias("attempts"), F.sum("cost").alias("credits"), F.when(F.max_by("result", "attempt") == ANSWERED, "answered").otherwise("failed").alias("outcome")
    )


def backoff_ceiling(attempt: Column, cfg: Search = SEARCH) -> Column:
    return F.least(F.lit(cfg.backoff_cap_s), F.lit(cfg.backoff_base_s) * F.pow(F.lit(2.0), attempt))


def estimated_searches(uncached_references: Column, max_searches: int = SEARCH.max_searches, cfg: Search = SEARCH) -> Column:
    return F.least(F.lit(max_searches), F.ceil(uncached_references * F.lit(cfg.searches_per_reference)).cast("int"))


def pacing_rate(hourly_limit: Column, cfg: Search = SEARCH) -> Column:
    """Searches an hour; null without a limit."""
    return F.when(hourly_limit > 0, F.greatest(F.lit(1.0), hourly_limit * F.lit(cfg.rate_limit_share)))


def quota(account: DataFrame, keep: list[str] = ()) -> DataFrame:
    """keep, searches_left, hourly_limit of account rows (total_searches_left, plan_searches_left, account_rate_limit_per_hour)."""
    left = F.greatest(F.lit(0), F.coalesce("total_searches_left", "plan_searches_left", F.lit(0)))
    return account.select(*keep, left.alias("searches_left"), F.col("account_rate_limit_per_hour").alias("hourly_limit"))


def redacted(text: Column, secrets: list[str] = ()) -> Column:
    """Known secrets, values of api_key and strings like keys as [REDACTED]; the longest secrets first, and none of under eight characters."""
    for secret in worth_hiding(secrets):
        text = F.replace(text, F.lit(secret), F.lit(HIDDEN))
    return F.regexp_replace(F.regexp_replace(text, KEY_VALUE, f"$1{HIDDEN}"), KEY_LIKE, HIDDEN)


def preflight(uncached_queries: DataFrame, account: DataFrame, max_searches: int = SEARCH.max_searches, cfg: Search = SEARCH) -> DataFrame:
    """One row: estimate, worst_case, searches_left, allowed, limit, per_hour.

    uncached_queries: doc_id, idx, ordinal and cache_key of planned queries that are not stored. The estimate goes by references whose first query is among them, the worst case
    by distinct queries. account: one row.
    """
    _refused(max_searches, "a budget", 0)
    n = uncached_queries.agg(F.count_if(F.col("ordinal") == 1).alias("n"), F.count_distinct("cache_key").alias("worst_case"))
    row = quota(account).withColumn("one", F.lit(1)).join(n.withColumn("one", F.lit(1)), "one")
    estimate = estimated_searches(F.col("n"), max_searches, cfg)
    return row.select(
        estimate.alias("estimate"), F.least(F.lit(max_searches).cast("long"), F.col("worst_case")).alias("worst_case"), "searches_left", (F.col("searches_left") >= estimate).alias("allowed"),
        F.least(F.lit(max_searches), F.col("searches_left")).alias("limit"), pacing_rate(F.col("hourly_limit"), cfg).alias("per_hour"),
    )


def exported(responses: DataFrame, keys: DataFrame) -> DataFrame:
    """The newest stored response of each of the chosen keys (key); keys that are not stored are left out."""
    return latest(responses.join(keys.select("key").distinct(), "key", "left_semi"))


def admitted(jobs: DataFrame, most: int = 2) -> DataFrame:
    """Adds `admitted` to jobs (job_id, started, ended; null while running): whether fewer than `most` admitted jobs ran when it started. A refused job is not queued.

    Whether a job is let in depends on all before it, so the jobs of one service are gone through in order, in one task that holds the ends of `most` of them.
    """
    _refused(most, "the number of jobs", 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: list[pd.Timestamp] = []
        for rows in batches:
            taken = []
            for started, ended in zip(rows["started"], rows["ended"], strict=True):
                ends = [e for e in ends if pd.isna(e) or e > started]
                taken.append(len(ends) < most)
                if taken[-1]:
                    ends.append(ended)
            yield rows.assign(admitted=taken)

    kind = StructType([*jobs.schema.fields]).add("admitted", "boolean")
    return jobs.coalesce(1).sortWithinPartitions("started", "job_id").mapInPandas(run, kind)
