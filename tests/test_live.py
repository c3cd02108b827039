"""Live lookups over a scripted transport, settings, and the evaluation report."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from refloom.functions.jsontext import sanitized
from refloom.operators import control, live, reports
from refloom.plans import check
from refloom.queries import base
from refloom.errors import InputError, Redacting, RefloomError, redact
from refloom.settings import load_settings
from refloom.sources import files


def scripted(params):
    q = params["q"]
    if "broken" in q:
        raise live.TransportError("refused", retryable=False)
    if "tea leaves" in q and q.startswith('"'):
        return {"organic_results": [{"title": "Reading the tea leaves of data", "publication_info": {"summary": "J Doe - Leaf Studies Today, 2017 - x.org"}}], "api_key": "x" * 9}
    return {"error": "The service hasn't returned any results", "organic_results": []}


LIST = """[1] J. Doe, "Reading the tea leaves of data," Leaf Studies Today, 2017.
[2] A. Nobody, "A paper that was never written at all," Nature, 2019.
[3] B. Nobody, "Another paper that is broken for sure," Nature, 2019.
[4] C. Nobody, "One more paper that was never written," Nature, 2019."""
EMPTY = "key string, engine string, query string, created timestamp, body string"


@pytest.fixture(scope="module")
def refs(spark):
    return files.references(spark.createDataFrame([(1, LIST, "text")], "doc_id long, text string, format string"))


def test_live_check(spark, refs):
    results, store, asked = check.check_live(refs, spark.createDataFrame([], EMPTY), scripted, 50)
    assert [r.verdict for r in results.orderBy("idx").collect()] == ["VERIFIED", "NOT_FOUND", "SKIPPED_BUDGET", "NOT_FOUND"]
    assert asked.count() == 7 and store.count() == 5  # a sure match asks once, the others twice; two requests failed
    assert "api_key" not in "".join(r.body for r in store.collect())
    again, _, none = check.check_live(refs.where("idx <> 3"), store, scripted, 0)
    assert none.count() == 0 and [r.verdict for r in again.orderBy("idx").collect()] == ["VERIFIED", "NOT_FOUND", "NOT_FOUND"]


def test_budget_runs_out(spark, refs):
    results, _, asked = check.check_live(refs.where("idx <> 3"), spark.createDataFrame([], EMPTY), scripted, 2)
    rows = results.orderBy("idx").collect()
    assert [r.verdict for r in rows] == ["VERIFIED", "SKIPPED_BUDGET", "SKIPPED_BUDGET"] and asked.count() == 2
    assert rows[1].reason.startswith("Not fully checked") and [len(r.queries) for r in rows] == [1, 1, 0]


def test_retries_and_billing():
    calls = []

    def flaky(params):
        calls.append(params)
        if len(calls) < 3:
            raise live.TransportError("timed out", retryable=True, maybe_charged=len(calls) == 1)
        return {"search_metadata": {"created_at": "2020-01-01 00:00:00 UTC"}, "organic_results": []}

    out = live.request({"q": "x"}, flaky, sleep=lambda s: None, jitter=lambda a, b: b)
    assert (out["attempts"], out["credits"], out["waited"]) == (3, 1, 17.0)
    out = live.request({"q": "x"}, lambda p: {"error": "We couldn't get valid results"}, sleep=lambda s: None)
    assert out["attempts"] == 4 and out["body"] is None and out["credits"] == 0


def test_classification(spark):
    rows = [(200, None, "ok"), (200, "It hasn't returned any results for this query.", "empty"), (200, "We couldn't get valid results", "retryable"), (401, "x", "fatal"), (429, "slow down", "retryable"), (429, "You have run out of searches.", "fatal"), (503, None, "retryable"), (404, None, "fatal")]
    got = spark.createDataFrame(rows, "s int, e string, w string").select("w", live.classified(F.col("s"), F.col("e")).alias("c")).collect()
    assert all(r.w == r.c for r in got)


def test_sanitized():
    value = {"json_endpoint": "x", "a_endpoint": 1, "t": "https://s.example/searches/1.json", "keep": [{"api_key": "k", "text": "api_key=abc secretsecret"}], "n": 1}
    assert sanitized(value, ("secretsecret",)) == {"keep": [{"text": "api_key=[REDACTED] [REDACTED]"}], "n": 1}


def test_preflight(spark):
    account = spark.createDataFrame([(None, 40, 100)], "total_searches_left int, plan_searches_left int, account_rate_limit_per_hour int")
    lacking = spark.createDataFrame([(1, i, o, f"{i % 20}-{o}") for i in range(30) for o in (1, 2)], "doc_id int, idx int, ordinal int, cache_key string")
    r = control.preflight(lacking, account).first()
    assert (r.estimate, r.worst_case, r.searches_left, r.allowed, r.limit, r.per_hour) == (45, 40, 40, False, 40, 80.0)


def test_wrong_limits(spark):
    rows = spark.createDataFrame([(1, 1, 0.0)], "a int, i int, t double")
    for wrong in (lambda: control.granted(rows, ["a"], ["i"], -1), lambda: control.granted_by_all(rows, [], ["i"]), lambda: control.granted_by_all(rows, [(["a"], -1)], ["i"]), lambda: control.token_bucket(rows, "a", ["i"], F.col("t"), 0.0), lambda: control.admitted(rows, 0)):
        with pytest.raises(ValueError):
            wrong()


def test_errors_and_logs_hold_no_secrets():
    import logging

    said = "failed: api_key=abc and " + "0" * 64 + " and topsecretvalue"
    assert redact(said, ["topsecretvalue"]) == "failed: api_key=[REDACTED] and [REDACTED] and [REDACTED]"
    assert "topsecretvalue" not in str(RefloomError(said, ["topsecretvalue"])) and InputError("x").exit_code == 2 and live.TransportError("x", retryable=False).exit_code == 3
    try:
        raise RuntimeError(said)
    except RuntimeError:
        import sys

        record = logging.LogRecord("refloom", logging.ERROR, "x", 1, "it %s", ("topsecretvalue",), sys.exc_info())
    out = Redacting(["topsecretvalue"]).format(record)
    assert "topsecretvalue" not in out and "abc" not in out and "0" * 64 not in out and "Traceback" in out


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("REFLOOM_API_KEY='from file'\n# REFLOOM_STORE=no\nREFLOOM_DEMO_ONLY=yes\n")
    s = load_settings({"REFLOOM_STORE": "/s"}, str(tmp_path / ".env"))
    assert (s.api_key, s.store, s.demo_only) == ("from file", "/s", True) and "from file" not in repr(s)
    assert load_settings({}) == load_settings({"REFLOOM_API_KEY": " "})
    with pytest.raises(InputError):
        load_settings({"REFLOOM_DEMO_ONLY": "maybe"})


def test_usage_log(spark, tmp_path):
    for left in (None, 7):
        files.append_usage(spark, str(tmp_path / "log"), "cli", 3, 11, left)
    lines = sorted(r.value.split(" | ", 1)[1] for r in spark.read.text(str(tmp_path / "log")).collect())
    assert lines == ["live run (cli) | searches=3 | references=11 | account_left_before=7", "live run (cli) | searches=3 | references=11 | account_left_before=not checked (all cached)"]


def test_evaluation_report(spark, sf):
    text = reports.evaluation_markdown(base.outcomes(spark, sf))
    assert text.count("\n| ") >= 12 and "| reworded title |" in text and "% [" in text
