"""The whole check over stored answers, its reports, and the command line."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from refloom.__main__ import run
from refloom.operators import control, reports, search
from refloom.plans import check
from refloom.sources import files

TEXT = """Intro
References
[1] J. Doe and R. Roe, "Reading the tea leaves of data," Journal of Leaf Studies, 2017.
[2] J. Doe, "Growing the greenest tea in moun-
tains," Journal of Leaf Studies, 2010.
[3] A. Nobody, "A paper that was never written at all," Nature, 2019.
[4] J. Doe and R. Roe, "Reading the tea leaves of data," Journal of Leaf Studies, 2017.
[5] ??
[6] P. Poe, "Reading all of the tea leaves in data carefully," Nature, 2018.
[7] Q. Quux, "Not looked up by anyone so far," Nature, 2018.
Appendix A
"""


def answer(title, summary, **links):
    return {"organic_results": [{"position": 1, "title": title, "link": "https://x.org/1", "publication_info": {"summary": summary}, "inline_links": {k: {"total": v} for k, v in links.items()}}]}


def key(query):
    import hashlib

    params = {"engine": "google_scholar", "q": query, "hl": "en", "num": "10"}
    return hashlib.sha256(json.dumps(dict(sorted(params.items())), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


ANSWERS = {
    '"Reading the tea leaves of data"': answer("Reading the tea leaves of data", "J Doe, R Roe - Journal of Leaf …, 2017 - x.org", cited_by=1234, versions=3),
    '"Growing the greenest tea in mountains"': answer("Growing the Greenest Tea in Mountains", "J Doe - Journal of Leaf Studies, 2001 - x.org", versions=4),
    'Growing the greenest tea in mountains author:"Doe"': {"organic_results": []},
    '"A paper that was never written at all"': {"error": "nothing", "organic_results": []},
    'A paper that was never written at all author:"Nobody"': answer("Something of another kind", "B Body - Foo, 2001 - x.org"),
    '"Reading all of the tea leaves in data carefully"': {"organic_results": []},
    'Reading all of the tea leaves in data carefully author:"Poe"': answer("Reading the tea leaves in data", "P Poe - Nature, 2018 - x.org"),
}


@pytest.fixture(scope="module")
def store(spark):
    rows = [(key(q), "google_scholar", q, datetime.datetime(2026, 1, 1), json.dumps(b)) for q, b in ANSWERS.items()]
    old = (key('"Reading the tea leaves of data"'), "google_scholar", "q", datetime.datetime(2020, 1, 1), "{}")
    return spark.createDataFrame([*rows, old], "key string, engine string, query string, created timestamp, body string")


@pytest.fixture(scope="module")
def results(spark, store):
    docs = spark.createDataFrame([(1, TEXT, "text")], "doc_id long, text string, format string")
    return check.check_references(files.references(docs), store).cache()


def test_verdicts(results):
    rows = {r.idx: r for r in results.collect()}
    assert [rows[i].verdict for i in range(1, 8)] == ["VERIFIED", "METADATA_MISMATCH", "NOT_FOUND", "VERIFIED", "UNPARSEABLE", "METADATA_MISMATCH", "SKIPPED_BUDGET"]
    assert rows[1].reason == "Title, authors, year and venue match a Google Scholar record (cited by 1,234)." and rows[1].confidence == 1.0 and len(rows[1].queries) == 1
    assert rows[2].reason.startswith("Title matches, but year is 2001, not 2010.") and "4 versions" in rows[2].reason and rows[2].mismatched == ["year"]
    assert rows[3].reason.startswith("No Google Scholar record matches this title; the closest result was “Something of another kind”")
    assert rows[4].duplicate_of == 1 and rows[4].reason.startswith("Duplicate of reference 1. Title")
    assert rows[6].mismatched == ["title"] and rows[6].reason == "Title differs from the closest real paper: 'Reading the tea leaves in data' (2018)."
    assert rows[7].best is None and rows[7].confidence == 0.0
    assert [rows[i].line for i in (1, 2, 3)] == [3, 4, 6]


def test_summary(results):
    r = check.summary(results).first()
    assert (r.verified, r.metadata_mismatch, r.not_found, r.unparseable, r.skipped_budget, r.total, r.checked, r.integrity_score) == (2, 2, 1, 1, 1, 7, 5, 60.0)


def test_reports(results):
    summary = check.summary(results)
    text = reports.markdown(results, summary).first().markdown
    assert "**Integrity score: 60 / 100**. 5 of 7 references checked." in text and "| 5 | Unparseable | 1.00 | ?? |" in text
    log = json.loads(reports.sarif(results, summary).first().sarif)
    found = log["runs"][0]["results"]
    assert [r["ruleId"] for r in found] == ["RL002", "RL001", "RL003", "RL002", "RL004"] and found[0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 4
    again = json.loads(reports.json_report(results, summary).first().report)
    assert again["summary"]["integrity_score"] == 60.0 and [r["idx"] for r in again["results"]] == list(range(1, 8))
    page = reports.html(results, summary).first().html
    assert "Integrity score: 60 / 100" in page and "Metadata mismatch: 2</li>" in page
    assert page.index("never written") < page.index("Growing") < page.index("??") and 'href="https://x.org/1"' in page


def test_command_line(spark, store, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/list.txt").write_text(TEXT)
    (tmp_path / "in/bad.bin").write_bytes(b"\0\1")
    store.write.parquet(str(tmp_path / "store"))
    args = ["check", str(tmp_path / "in/list.txt"), "--responses", str(tmp_path / "store")]
    assert run(args, spark) == 0
    assert run([*args, "--fail-on", "3"], spark) == 1
    assert run([*args, "-f", "sarif"], spark) == 0
    assert '"version":"2.1.0"' in capsys.readouterr().out
    assert run(["check", str(tmp_path / "in"), "-f", "json", "-o", str(tmp_path / "out")], spark) == 2
    assert run(["cache", "stats", str(tmp_path / "store")], spark) == 0
    shown = capsys.readouterr()
    assert "bad.bin: The file is not text." in shown.err
    (tmp_path / "keys.txt").write_text(key('"Reading the tea leaves of data"') + "\n")
    assert run(["cache", "export", str(tmp_path / "store"), "--keys", str(tmp_path / "keys.txt"), "-o", str(tmp_path / "some")], spark) == 0
    assert files.read_responses(spark, str(tmp_path / "some")).count() == 1
    assert run(["cache", "export", str(tmp_path / "store")], spark) == 2
    assert run(["cache", "clear", str(tmp_path / "store")], spark) == 0
    assert files.read_responses(spark, str(tmp_path / "store")).count() == 0


def test_command_line_refuses(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "none.txt").write_text("\n\n")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "many.txt").write_text("\n".join(f'[{i}] J. Doe, "Reading the tea leaves again and again {i}," Nature, 2001.' for i in range(1, 1003)))
    for name, said in (("none.txt", "The input is empty."), ("a.pdf", files.NO_FRAGMENTS), ("many.txt", "Found 1002 references"), ("absent.txt", "")):
        assert run(["check", str(tmp_path / name)], spark) == 2
        assert said in capsys.readouterr().err
    (tmp_path / "few.txt").write_text("???")
    assert run(["check"], spark) == 2 and run(["check", str(tmp_path / "few.txt"), "--max-searches", "-1"], spark) == 2
    assert run(["check", str(tmp_path / "few.txt"), "--transport", "no.such:thing"], spark) == 2
    monkeypatch.setattr(check, "check_references", lambda *a, **b: 1 / 0)
    assert run(["check", str(tmp_path / "few.txt")], spark) == 3 and "ZeroDivisionError" in capsys.readouterr().err


def test_command_line_demo_and_formats(spark, tmp_path, capsys):
    assert run(["check", "--demo"], spark) == 0
    out = capsys.readouterr().out
    assert [line.split("\t")[2] for line in out.splitlines()[1:4]] == ["VERIFIED", "METADATA_MISMATCH", "NOT_FOUND"]
    assert run(["check", "--demo", "-q"], spark) == 0 and capsys.readouterr().out == ""
    assert run(["check", "--demo", "-f", "sarif", "--sarif-uri", "refs/list.txt"], spark) == 0
    log = json.loads(capsys.readouterr().out)
    assert log["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "refs/list.txt"
    assert run(["check", "--demo", "-o", str(tmp_path / "out.html")], spark) == 0
    assert "Integrity score" in spark.read.json(str(tmp_path / "out.html")).first().html


def test_command_line_reads_pdf_fragments_and_a_transport(spark, tmp_path, capsys):
    path = tmp_path / "a.pdf"
    path.write_bytes(b"%PDF-1.4 x")
    name = spark.read.format("binaryFile").load(str(path)).first().path
    lines = ["References", "[1] A. Nobody, “A paper that was never written at all,” Nature, 2019.", "[2] J. Doe, “Reading the tea leaves of data,” Leaf Studies, 2017."]
    spark.createDataFrame([(name, 1, 10.0, 700.0 - 20 * i, 500.0, t, 600.0) for i, t in enumerate(lines)], "path string, page int, x double, y double, width double, text string, page_width double").write.parquet(str(tmp_path / "fragments"))
    args = ["check", str(path), "--fragments", str(tmp_path / "fragments"), "--responses", str(tmp_path / "store"), "--transport", "tests.test_live:scripted"]
    spark.createDataFrame([], "key string, engine string, query string, created timestamp, body string").write.parquet(str(tmp_path / "store"))
    assert run([*args, "--max-searches", "3"], spark) == 0
    out = capsys.readouterr().out
    assert [line.split("\t")[2] for line in out.splitlines()[1:3]] == ["NOT_FOUND", "VERIFIED"]
    assert files.read_responses(spark, str(tmp_path / "store")).count() == 3
    assert run([*args, "--offline"], spark) == 0


def test_frozen(spark, tmp_path):
    import hashlib

    from refloom.errors import InputError

    (tmp_path / "rows.jsonl").write_text("{}")
    files.frozen(spark, str(tmp_path / "rows.jsonl"), hashlib.sha256(b"{}").hexdigest())
    with pytest.raises(InputError):
        files.frozen(spark, str(tmp_path / "rows.jsonl"), hashlib.sha256(b"{} ").hexdigest())


def test_pasted(spark):
    r = files.pasted(spark, "Doe, J. (2001). Some things to say. Nature.").first()
    assert (r.name, r.format, r.error) == ("pasted-text", "text", None)


def test_shared_folder(spark, monkeypatch):
    from refloom.sources import shared

    made = shared.stored(spark.range(3), "x")
    path = shared.written(spark)[-1]
    assert made.count() == 3
    shared.remove(spark, [path])
    assert path not in shared.written(spark)
    setting = spark.conf.get(shared.SETTING)

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"getConf": staticmethod(lambda: {}), "master": "yarn"})

    with pytest.raises(ValueError):
        shared.shared_folder(Cluster)
    assert shared.shared_folder(spark) == setting.rstrip("/")


def test_long_references_are_joined_in_little_time(spark):
    import time

    from refloom.operators import lines

    n = 4000
    rows = spark.createDataFrame([(1, "\n".join(f"line {i} of a refer-" if i % 3 == 0 else f"ence that goes on {i}" for i in range(n)))], "doc_id long, text string")
    began = time.time()
    out = lines.split_references(lines.text_lines(rows)).collect()
    assert time.time() - began < 30 and len(out) == 1 and "a reference that goes on 1 ence" in out[0].raw


def test_bundles(spark, store, tmp_path):
    planned = search.planned(spark.createDataFrame([("Reading the tea leaves of data", "Doe", None)], "title string, surname string, entry_type string"))
    out = files.bundle(store, planned).collect()
    assert len(out) == 1
    made = {"format": 1, "generated": "2026-01-01 00:00:00", "entries": [r.entry.asDict(recursive=True) for r in out]}
    (tmp_path / "b.json").write_text(json.dumps(made))
    again = files.read_bundle(spark, str(tmp_path / "b.json")).first()
    assert again.key == key('"Reading the tea leaves of data"') and "tea leaves" in again.body


def test_files(spark, tmp_path):
    made = {"a.txt": "Doe, J. (2001). Some things to say. Nature.".encode("cp1252"), "b.bib": b"@misc{x, title={y}}", "c.pdf": b"no pdf", "d.pdf": b" %PDF-1.4", "e.docx": b"PK\x03\x04zip", "f.txt": b"a\0b", "g.txt": "﻿Müller".encode(), "h.txt": "Müller".encode("cp1252")}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.name: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert {n: r.format for n, r in rows.items()} == {"a.txt": "text", "b.bib": "bibtex", "c.pdf": None, "d.pdf": "pdf", "e.docx": None, "f.txt": None, "g.txt": "text", "h.txt": "text"}
    assert rows["g.txt"].text == "Müller" == rows["h.txt"].text and rows["c.pdf"].error and rows["e.docx"].error and rows["f.txt"].error


def test_redaction(spark):
    line = F.lit('x api_key=abc&y {"api_key": "zz"} ' + "a" * 64 + " " + "b" * 65 + " topsecretvalue short")
    got = spark.range(1).select(control.redacted(line, ["topsecretvalue", "short"])).first()[0]
    assert got == 'x api_key=[REDACTED]&y {"api_key": "[REDACTED]"} [REDACTED] ' + "b" * 65 + " [REDACTED] short"


def test_pages(spark):
    from refloom.operators import pages

    rows = [(1, 1, 10.0 if i % 2 == 0 else 320.0, 700.0 - 20 * (i // 2) + (1.0 if i == 2 else 0), 200.0, f"t{i}", 600.0) for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, x double, y double, width double, text string, page_width double")
    got = [r.text for r in pages.page_lines(frame).orderBy("page", "line").collect()]
    assert got == ["t0", "t2", "t4", "t6", "t1", "t3", "t5", "t7"]
    one = frame.withColumn("width", F.lit(500.0))
    assert [r.text for r in pages.page_lines(one).orderBy("line").collect()] == ["t0 t1", "t2 t3", "t4 t5", "t6 t7"]
