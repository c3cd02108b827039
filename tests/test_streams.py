from __future__ import annotations

import datetime

from refloom.streaming import jobs

START = datetime.datetime(2024, 1, 1)


def drain(spark, rows, schema, build, mode, tmp_path):
    """Write the rows as files in order, run the stream over them and return what came out."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(folder / f"{i:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(folder))
    name = f"out_{abs(hash(str(tmp_path)))}"
    query = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def at(s):
    return START + datetime.timedelta(seconds=s)


EVENTS = "job_id long, ts timestamp, kind string, idx long, verdict string"


def test_progress(spark, tmp_path):
    parts = [[(1, at(0), "started", 0, None), (1, at(1), "progress", 1, "VERIFIED"), (1, at(1), "progress", 1, "VERIFIED")], [(1, at(2), "progress", 2, "NOT_FOUND"), (2, at(3), "progress", 1, "VERIFIED")]]
    rows = drain(spark, parts, EVENTS, jobs.progress, "update", tmp_path)
    done = {}
    for r in rows:
        done[r.job_id] = max(done.get(r.job_id, (0, 0, 0)), (r.done, r.verified, r.not_found))
    assert done == {1: (2, 1, 1), 2: (1, 1, 0)}


def test_quiet_periods(spark, tmp_path):
    parts = [[(1, at(0), "progress", 1, None), (1, at(10), "progress", 2, None)], [(1, at(60), "progress", 3, None)], [(1, at(1000), "progress", 4, None)], [(2, at(1001), "progress", 4, None)]]
    rows = drain(spark, parts, EVENTS, jobs.quiet_periods, "append", tmp_path)
    assert sorted((r.start, r.n) for r in rows) == [(at(0), 2), (at(60), 1)]


def test_paced_requests_equal_the_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from refloom.operators import control

    schema = "account long, request_id long, ts timestamp"
    parts = [[(1, 1, at(0)), (1, 2, at(1)), (2, 3, at(1))], [(1, 4, at(2)), (1, 5, at(3000))]]
    got = {r.request_id: round(r.wait_s, 6) for r in drain(spark, parts, schema, lambda s: jobs.paced(s, 2.0), "append", tmp_path)}
    batch = spark.createDataFrame([r for p in parts for r in p], schema)
    wanted = control.token_bucket(batch, "account", ["request_id"], F.unix_micros("ts") / 1000000.0, 2.0)
    assert got == {r.request_id: round(r.wait_s, 6) for r in wanted.collect()}


def test_newest_and_state(spark, tmp_path):
    rows = [[("k", at(0), "a"), ("k", at(5), "b")], [("k", at(3), "c"), ("j", at(1), "d")]]
    out = drain(spark, rows, "key string, created timestamp, body string", jobs.newest_responses, "update", tmp_path)
    assert {r.key: r.body for r in out if r.key == "j" or r.body == "b"} == {"k": "b", "j": "d"}
    events = spark.createDataFrame([(1, at(0), "started", 0, None), (1, at(9), "done", 0, None), (2, at(1), "progress", 1, None)], EVENTS)
    state = jobs.latest_state(events)
    assert {r.job_id: r.state for r in state.collect()} == {1: "done", 2: "running"}
    from pyspark.sql import functions as F

    assert [r.job_id for r in jobs.expired(state, F.lit(at(2000)), 900).collect()] == [1]
    assert jobs.event_log(events).columns == ["job_id", "line"]
