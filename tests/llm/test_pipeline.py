"""The pipeline, stage by stage, against plain versions over a small table with planted cases."""

from __future__ import annotations

import base64
import hashlib
import random
import struct

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline
from refloom.llm import queries, toxicity
from tests.conftest import SF
from tests.llm.test_brute_force import words
from tests.llm.test_near_copies import brute_firsts, edited
from tests.llm.test_parts import brute_lines_removed, without


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """The smallest tables, with near copies, exact ones, passages of several lines and of one, and benchmark passages put in; and what was planted."""
    rnd = random.Random(21)
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = [x["text"] for x in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    number = max(r["doc_id"] for r in rows) + 1
    plain = lambda n: [f"v{rnd.randrange(10**7)}" for _ in range(n)]
    texts, near, leaks = [], [], []
    for n in (60, 200, 900):
        base = plain(n)
        near.append((number + len(texts), number + len(texts) + 1))
        texts += [" ".join(base), " ".join(edited(rnd, base, max(1, n // 100)))]
    texts += [texts[0], texts[0]]
    for shape in ([60], [30, 30], [12] * 5):
        passage = [" ".join(plain(k)) for k in shape]
        texts += ["\n".join([" ".join(plain(25)), *passage, " ".join(plain(25))]) for _ in range(2)]
    for item in items[:3]:
        leaks.append(number + len(texts))
        texts.append(" ".join([*plain(40), *item.split()[:12], *plain(40)]))
    rows += [{"doc_id": number + i, "text": t, "lang": "en", "source": "made", "n_chars": len(t)} for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("made")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder), near, leaks


def test_each_stage(spark, made):
    folder, near, leaks = made
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    columns = docs.columns

    def run(name, docs):
        out = stages[name](spark, docs, folder)
        assert out.columns == columns
        return out, sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    left, got = run("toxicity", docs)
    rated = {r.doc_id: r.rejected for r in toxicity.rate(docs, marks).collect()}
    assert any(rated.values()) and got == sorted(((r.doc_id, r.text) for r in docs.collect() if not rated[r.doc_id]), key=str)

    ordered = sorted(got, key=lambda r: r[0])
    texts = [t or "" for _, t in ordered]
    left, got = run("line dedup", left)
    wanted = [(i, t if t is None else w) for (i, t), w in zip(ordered, without(texts, brute_lines_removed(texts)), strict=True)]
    assert got == sorted(wanted, key=str) and wanted != ordered
    assert all(r.n_chars == len(r.text or "") for r in left.collect())

    ordered = sorted(got, key=lambda r: r[0])
    left, got = run("SimHash near-dedup", left)
    firsts = brute_firsts([t for _, t in ordered])
    assert got == sorted((ordered[i] for i in firsts), key=str) and len(got) < len(ordered)
    kept = {i for i, _ in got}
    assert all(a in kept and b not in kept for a, b in near)

    left, got_clean = run("benchmark decontamination", left)
    windows = {tuple(w[i : i + 10]) for x in pq.read_table(f"{SF}/benchmark.parquet").to_pylist() if (w := words(x["text"])) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert got_clean == [r for r in got if not hit(words(r[1]))] and not {i for i, _ in got_clean} & set(leaks)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.RANKS), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r.doc_id: r for r in stages["byte-level BPE"](spark, left, folder).collect()}
    assert set(out) == {i for i, _ in got_clean}
    for i, text in got_clean:
        ids = theirs.encode_ordinary(text or "")
        assert list(out[i].ids) == ids and out[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()) == sorted(out)
