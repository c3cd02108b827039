"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns of clashing names, for every operator and stage."""

from __future__ import annotations

import gzip
import hashlib
import time
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from refloom.llm import bpe, decontamination, licenses, line_dedup, quality_rules, rule_ensemble, sharding, simhash, toxicity, warc
from tests.llm.test_brute_force import least_capacity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k_id string, body string, hash string, words int, label string, n_words string, key string, part string, line string, k_gone string, k_removed string, k_text string, spans string, `row` string, `a.b` string"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and then some more words follow here"),
    (1, "the quick brown fox jumps over the lazy dog and then some more words follow here"),
    (2, None),
    (3, ""),
    (None, "no id but a text of a few words"),
    (None, None),
    (4, LONG),
    (5, "the quick brown fox jumps over the lazy dog and then some more words follow here"),
    (6, f"one line\n{PASSAGE}\nanother line"),
    (7, f"a start of its own\n{PASSAGE}\nand an end"),
    (8, "Released under the MIT License. Apache License, Version 2.0, cc by nc cc by nc"),
    (9, "퟿ é ß 漢字 😀 " * 3),
    (10, " \n\t\n "),
    (6, f"one line\n{PASSAGE}\nanother line"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "x", "x", 1, *["x"] * 11) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Quick brown fox jumps over the lazy dog and then some more"), (1, "Quick brown fox jumps over the lazy dog and then some more"), (2, None), (3, ""), (4, "few words"), (None, "漢字")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, 0, 0), (4, None, None), (99, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


def pairs(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_decontamination(docs, none, benchmark):
    out = decontamination.contamination(docs, benchmark)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    hits = sorted(((r.k_id, r.n_hit, r.n_items) for r in rows if r.contaminated), key=str)
    assert hits == [(1, 12, 1), (1, 12, 1), (5, 12, 1), (9, 3, 0), (None, 2, 1)]
    shuffled = decontamination.contamination(docs, benchmark, broadcast_bytes=0)
    assert pairs(out, "k_id", "n_words", "n_hit", "items_sha256") == pairs(shuffled, "k_id", "n_words", "n_hit", "items_sha256")
    assert decontamination.contamination(none, benchmark).count() == 0
    assert decontamination.contamination(docs, benchmark.where("false")).where("contaminated").count() == 0
    assert {r.items_sha256 for r in decontamination.contamination(docs, benchmark.where("false")).collect()} == {hashlib.sha256(b"").hexdigest()}
    assert decontamination.clean(docs, benchmark).columns == docs.columns
    assert decontamination.clean(docs, benchmark).where("doc_id = 1").count() == 0


def test_short_items_are_windows(spark, benchmark):
    docs = spark.createDataFrame([(1, "a Few words here, few WORDS there"), (2, "few other words")], "doc_id long, text string")
    rows = {r.k_id: r for r in decontamination.contamination(docs, benchmark).collect()}
    assert (rows[1].n_hit, rows[1].n_items) == (4, 1) and rows[2].n_hit == 0


def test_licenses(docs, none):
    rows = licenses.license_scan(docs).collect()
    assert len(rows) == len(ROWS)
    r = next(r for r in rows if r.k_id == 8)
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (4, 1, 13, "apache-2,cc-by-nc,mit")
    assert all(r.n_base == 0 and r.labels == "" and r.score == 0 for r in rows if r.k_id != 8)
    assert licenses.license_scan(none).count() == 0
    with pytest.raises(ValueError):
        licenses.template_grams(docs.sparkSession, [("x", True, "two words")])


def test_licenses_gather_votes_over_gaps(spark):
    text = "permission is hereby granted and free of charge to any person obtaining a copy of this software"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = licenses.license_scan(docs).first()
    assert r.labels == "mit-grant" and r.n_base == 0 and 0.6 <= r.score < 1


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in rows if r.text_crc32 == 0}) == 1  # empty and null texts are one group
    assert sharding.shard_documents(none).count() == 0
    slots = lambda rows: sorted(((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(rows, 4).collect()), key=str)
    assert slots(docs.repartition(7)) == slots(docs.coalesce(1))  # whatever the splits


def test_sharding_equals_the_plain_search(spark):
    import random

    rnd = random.Random(5)
    for n in (1, 3, 40, 300):
        texts = [("x" * rnd.choice((1, 5, 50, 400))) + str(rnd.randrange(n)) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        groups = {}
        for t in texts:
            k = hashlib.sha256(t.encode()).hexdigest()
            groups[k] = groups.get(k, 0) + len(t) + 8
        best = least_capacity([groups[k] for k in sorted(groups)], 5)
        sizes = {}
        for r in sharding.shard_documents(docs, 5, outline=16).collect():
            sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        assert max(sizes.values()) == best


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    first = {(r.k_id, r.k_text): r.first.k_id for r in rows}
    assert {v for (i, _), v in first.items() if i in (1, 5)} == {1}
    assert {v for (i, _), v in first.items() if i in (2, 3, 10)} == {2}  # without words
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids.count("1") == 1 and "5" not in ids and "3" not in ids and "10" not in ids and ids.count("6") == 1
    assert simhash.keep_one(none).count() == 0


def test_line_dedup(docs, none):
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == len(ROWS)
    text = {}
    for r in rows:
        text.setdefault(r.doc_id, set()).add(r.text)
    assert text[6] == {f"one line\n{PASSAGE}\nanother line"}  # the first one stays, and rows that repeat it too
    assert text[7] == {"a start of its own\nand an end"}
    assert text[2] == {None} and text[3] == {""} and text[10] == {" \n\t\n "}
    assert next(r.n_chars for r in rows if r.doc_id == 7) == len("a start of its own\nand an end")
    assert text[1] == text[5]  # a short line is no passage
    assert line_dedup.dedup_lines(none).count() == 0
    out = line_dedup.dedup_lines(docs, "lines_gone")
    assert out.columns == [*docs.columns, "lines_gone"] and {r.k_gone for r in out.collect()} == {r.k_removed for r in out.collect()} == {"x"}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs, "k_gone")


def test_toxicity(docs, none, labels):
    assert toxicity.rate(docs, labels).count() == len(ROWS)
    assert toxicity.rate(none, labels).count() == 0
    assert toxicity.rate(docs, labels.where("false")).where("rejected").count() == 0
    out = toxicity.accepted(docs, labels.where("toxic = 0"))
    assert out.columns == docs.columns and out.count() == len(ROWS)


def test_quality(docs, none, labels):
    for some in (labels, labels.where("false"), labels.where("quality = 1")):
        rows = rule_ensemble.classify(docs, rule_ensemble.fit(docs, some)).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        rows = quality_rules.judge(docs, quality_rules.fit(docs, some)).collect()
        assert len(rows) == len(ROWS)
        assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
    assert rule_ensemble.classify(none, rule_ensemble.fit(docs, labels)).count() == 0
    assert quality_rules.judge(none, quality_rules.fit(none, labels)).count() == 0


def test_bpe(docs, none):
    args = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.encode_documents(docs, *args, with_ids=True).collect()
    assert len(rows) == len(ROWS)
    tok = bpe.Tokenizer(bpe.read_ranks(Path(args[0]).read_bytes()), args[1])
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in ROWS}
    assert all(tok.decode_bytes(r.ids).decode() == texts[r.decoded_sha256] and r.n_tokens == len(r.ids) for r in rows)
    assert all(r.n_tokens == 0 for r in rows if r.doc_id in (2, 3))
    assert bpe.encode_documents(none, *args).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<html lang='en'><head><title>A &amp; B</title></head><body><p>Hi<br>you</p><script>no</script><a href='/y'>y</a>"), (2, None, None), (None, "", ""), (1, "http://a.org/x", "<")], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages).withColumn("block", F.lit("clash"))).collect()
    assert len(rows) == 8
    text = next(r for r in rows if r.record_type == "conversion" and r.block)
    assert text.block == "Hi\nyou\ny" and text.refers_to == warc.record_id("1", "http://a.org/x", "response")
    about = next(r for r in rows if r.record_type == "metadata" and r.target_uri)
    assert "title: A & B\r\nlanguage: en\r\n" in about.block and "outlink: /y\r\n" in about.block
    assert warc.derivatives(warc.responses(pages.where("false"))).count() == 0
    made = warc.derivatives(warc.responses(pages))
    warc.write_warc(made.coalesce(1), str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    again = list(warc.parse_warc(data))
    assert sorted(f["warc-record-id"] for f, _ in again) == sorted(r.record_id for r in rows)
    assert all(f["warc-block-digest"] == warc.digest(block) for f, block in again)


def record(number, body, more="", kind="response"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{number}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: http://x.org/{number}\r\n{more}Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_warc_reads_crawls(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\nContent-Type: text/html%s\r\n%s\r\n"
    latin = "<p>café</p>".encode("latin-1")
    bodies = {
        1: http % (b"", b"") + "<p>café</p>".encode(),
        2: http % (b"; charset=ISO-8859-1", b"") + latin,
        3: http % (b"", b"") + b"<meta charset='iso-8859-1'>" + latin,
        4: http % (b"", b"") + latin,  # neither said nor UTF-8
        5: http % (b"", b"Content-Encoding: gzip\r\n") + gzip.compress("<p>café</p>".encode()),
        6: http % (b"", b"Transfer-Encoding: chunked\r\n") + b"5\r\n<p>ca\r\n6;x=y\r\nf\xc3\xa9</p\r\n1\r\n>\r\n0\r\n\r\n",
        7: http % (b"", b"Content-Encoding: gzip\r\n") + "<p>café</p>".encode(),  # undone by the crawler
        8: http % (b"", b"") + "<p>café</p>\r\n\r\nWARC/1.0\r\nno record".encode(),
    }
    data = record(0, b"hi", kind="warcinfo") + b"".join(record(i, b, "WARC-Payload-Digest: sha1:SAID\r\nWARC-Block-Digest: sha1:BLOCK\r\n" if i == 1 else "") for i, b in bodies.items())
    data += record(9, http % (b"", b"") + b"<p>cut" + b"x" * 50)[:-40]
    (tmp_path / "a.warc").write_bytes(data)
    members = [record(i, b) for i, b in bodies.items()]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    for name in ("a.warc", "b.warc.gz"):
        read = warc.read_warc(spark, str(tmp_path / name)).coalesce(1)
        rows = {(r.refers_to, r.record_type): r for r in warc.derivatives(read).collect()}
        for i in bodies:
            r = rows[f"<urn:uuid:{i}>", "conversion"]
            assert r.block == ("café" if i != 8 else "café\nWARC/1.0\nno record"), (name, i)
            payload = bodies[i].partition(b"\r\n\r\n")[2]
            assert r.source_digest == ("sha1:SAID" if (name, i) == ("a.warc", 1) else warc.digest(payload))
            assert f"WARC-Refers-To-Payload-Digest: {r.source_digest}\r\n" in r.headers and "WARC-Source-Server: x\r\n" in r.headers and r.date == "2024-01-01T00:00:00Z"
        assert ("WARC-Source-Block-Digest: sha1:BLOCK\r\n" in rows["<urn:uuid:1>", "metadata"].headers) == (name == "a.warc")
    cut = warc.derivatives(warc.read_warc(spark, str(tmp_path / "a.warc"))).where("refers_to = '<urn:uuid:9>'").collect()
    assert len(cut) == 2 and any("source-truncated: true" in r.block for r in cut)


@pytest.mark.parametrize("page", ["<a ", "<title>", "<!--", "<script>", '<a href="', "<", "<a href=x>", "<head>", "&#", "<p", "</", "<title></title", "a\n "])
def test_warc_hostile_pages(page):
    began = time.time()
    warc.read_page(page * (1_000_000 // len(page)))
    assert time.time() - began < 3


def test_stages(spark, sf, docs, none):
    for rows in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == rows.columns, name
            assert out.count() <= rows.count()
