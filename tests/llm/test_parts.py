"""The parts of the training-data operators on their own."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from refloom.llm import bpe, decontamination, licenses, line_dedup, quality_rules, queries, rule_ensemble, simhash, toxicity, trees
from tests.conftest import SF


def brute_components(group, fps, most):
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most) & (group[:, None] == group[None, :])
    labels = np.arange(len(fps))
    while True:
        new = np.array([labels[row].min() for row in near]) if len(fps) else labels
        if (new == labels).all():
            return labels
        labels = new


def clustered(rng, n):
    base = rng.integers(0, 2**63, size=max(1, n // 9), dtype=np.uint64)
    fps = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        fps = np.where(rng.random(n) < 0.6, fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), fps)
    return fps


def test_gray_index():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 200))
        rows = np.unique(np.stack([rng.integers(0, 4, n).astype(np.uint64), clustered(rng, n)], 1), axis=0)
        group, fps = rows[:, 0].astype(np.int64), rows[:, 1].copy()
        order = np.lexsort((simhash.gray_rank(fps), group))
        group, fps = group[order], fps[order]
        most = int(rng.integers(0, 6))
        labels = simhash.GrayIndex(group, fps, fanout=int(rng.integers(2, 17))).components(most)
        assert (labels == brute_components(group, fps, most)).all()


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ n >> np.uint64(1)) == n).all()


def test_large_groups_are_dealt_again(spark):
    rng = np.random.default_rng(2)
    fps = np.unique(clustered(rng, 400))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(frame, 3, group_rows=8)).collect()}
    labels = brute_components(np.zeros(len(fps), np.int64), fps, 3)
    ours = {}
    for f, label in zip(fps.view(np.int64).tolist(), labels.tolist(), strict=True):
        ours.setdefault(label, set()).add(root.get(f, f))
    assert all(len(s) == 1 for s in ours.values()) and len(set.union(*ours.values())) == len(ours)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    assert root == {i: 0 for i in range(1, 61)} | {101: 100}


@pytest.fixture(scope="module")
def tok():
    return bpe.Tokenizer(bpe.read_ranks(Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()), public_tokenizers.PATTERN)


def test_transducer_equals_the_merge_rule(tok):
    rnd = random.Random(3)
    machine = tok.machine
    for _ in range(3000):
        data = b"".join(rnd.choice(machine.tokens[:5000]) for _ in range(rnd.randint(1, 8)))
        assert machine.encode(data) == machine.merged(data)


def test_transducer_is_bounded(tok, monkeypatch):
    machine = bpe.Transducer({bytes((i,)): i for i in range(256)} | {b"aa": 256, b"aaaa": 257, b"ab": 258})
    assert machine.encode(b"a" * 9) == [257, 257, 97]
    assert machine.encode(b"aab") == machine.merged(b"aab")
    monkeypatch.setattr(bpe, "MAX_STATES", 3)
    text = b"the quick brown fox" * 3
    assert [tok.machine.encode(text) for _ in range(3)] == [tok.machine.merged(text)] * 3
    assert tok.machine.encode(b"a" * 5000) == tok.machine.merged(b"a" * 5000)


def test_streaming_decode(tok):
    text = "naïve 漢字 😀 ß" * 20
    ids = tok.encode(text)
    for size in (1, 2, 7):
        pieces = list(tok.stream(ids[i : i + size] for i in range(0, len(ids), size)))
        assert "".join(pieces) == text and all("�" not in p for p in pieces)
    machine = bpe.Utf8Stream()
    assert [machine.feed(bytes((b,))) for b in "é€😀".encode()] == ["", "é", "", "", "€", "", "", "", "😀"]
    machine.feed("€".encode()[:2])
    assert machine.end() == "�"


def plain_chunks(text):
    """(first line, line after the last) of each chunk, by the definition: one run of lines after the other."""
    lines = text.split("\n")
    n = [len(line.encode().split()) for line in lines]
    hashes = np.array([xxhash.xxh64_intdigest(line.encode(), 7) for line in lines], np.uint64)
    rolled = lambda a, b: int(line_dedup.window_hashes(hashes[a:b], np.array([0]), np.array([b - a]))[0])
    runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1)]
    holds = lambda a, b, least: sum(n[a:b]) >= least
    windows = [(a, b) for a, b in runs if holds(a, b, line_dedup.CHUNK_WORDS) and not holds(a + 1, b, line_dedup.CHUNK_WORDS) and not holds(a, b - 1, line_dedup.CHUNK_WORDS)]
    chosen = set()
    for a, b in runs:
        if holds(a, b, line_dedup.RUN_WORDS) and not holds(a, b - 1, line_dedup.RUN_WORDS):
            inside = [w for w in windows if a <= w[0] and w[1] <= b]
            chosen.add(min(inside, key=lambda w: (rolled(*w), -w[0])))
    return sorted(chosen)


def brute_lines_removed(texts):
    """For each text the places of lines that an earlier place holds, followed from each chunk that stands there."""
    first, out = {}, []
    lines = [t.split("\n") for t in texts]
    found = [plain_chunks(t) for t in texts]
    for i, of in enumerate(found):
        for a, b in of:
            first.setdefault(tuple(lines[i][a:b]), (i, a))
    for i, of in enumerate(found):
        gone = set()
        for a, b in of:
            j, at = first[tuple(lines[i][a:b])]
            if (j, at) == (i, a):
                continue
            by, own, other = at - a, lines[i], lines[j]
            same = lambda k: 0 <= k < len(own) and 0 <= k + by < len(other) and own[k] == other[k + by]  # noqa: B023, E731
            for way in (1, -1):
                k = a
                while same(k):
                    gone.add(k)
                    k += way
        out.append(gone)
    return out


def without(texts, gone):
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in g) for t, g in zip(texts, gone, strict=True)]


def test_chunks_shift():
    rnd = random.Random(4)
    lines = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(rnd.randrange(1, 12))) + str(i) for i in range(200)]
    of = lambda lines: {tuple(lines[a:b]) for a, b in plain_chunks("\n".join(lines))}
    whole, moved = of(lines), of(["put in before", *lines[:100], "and here", *lines[100:]])
    assert len(whole & moved) >= 0.9 * len(whole)


def test_chunks_of_many_texts_equal_the_definition():
    rnd = random.Random(9)
    texts = ["", "a", "\n\n"] + ["\n".join(" ".join(rnd.choice("abc") for _ in range(rnd.choice((0, 1, 3, 9, 19, 20, 31, 70)))) for _ in range(rnd.randrange(12))) for _ in range(150)]
    hashes, words, sizes = line_dedup._read_lines(texts)
    upto = np.cumsum(sizes)
    of = np.repeat(np.arange(len(texts)), sizes)
    a, b, _ = line_dedup.chunks(hashes, words, upto[of])
    got = {i: [] for i in range(len(texts))}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        got[int(of[x])].append((x - int(upto[of[x]] - sizes[of[x]]), y - int(upto[of[x]] - sizes[of[x]])))
    assert got == {i: plain_chunks(t) for i, t in enumerate(texts)}


def test_repeated_passages(spark, monkeypatch):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    texts, planted = [], []
    for shape in ([30, 30], [15] * 4, [6] * 9, [39, 1, 0, 12], [3] * 18, [18, 0, 0, 33, 2], [52], [1] * 55):
        for _ in range(6):
            passage = [line(n) for n in shape]
            for _ in range(2):
                before, after = ([line(rnd.randrange(1, 12)) for _ in range(rnd.randrange(1, 5))] for _ in range(2))
                planted.append((len(before), len(passage)))
                texts.append("\n".join([*before, *passage, *after]))
    few = [line(n) for n in (2, 9, 14, 21, 30, 45)]  # texts of few lines, in which runs overlap and repeat one another
    texts += ["\n".join(rnd.choice(few) for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = brute_lines_removed(texts)
    for small in (32 << 20, -1):  # by broadcasts, and by shuffles
        monkeypatch.setattr(line_dedup, "broadcast_if_small", lambda table, small=small: F.broadcast(table) if small > 0 else table)
        got = {r.doc_id: (r.text, r.gone) for r in line_dedup.dedup_lines(docs, "gone").collect()}
        assert got == {i: (t, len(g)) for i, (t, g) in enumerate(zip(without(texts, gone), gone, strict=True))}
    for i, (at, n) in enumerate(planted):
        assert gone[i] == (set(range(at, at + n)) if i % 2 else set())
    left = {x for t, _ in got.values() for x in t.split("\n")}
    assert left - {""} == {x for t in texts for x in t.split("\n")} - {""}  # no line is lost altogether


def test_whole_table_of_lines(spark):
    rows = sorted(((d["doc_id"], d["text"]) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()), key=lambda d: d[0])
    wanted = without([t or "" for _, t in rows], brute_lines_removed([t or "" for _, t in rows]))
    got = {r.doc_id: r.text for r in queries.QUERIES["op7_line_dedup"](spark, SF).collect()}
    assert got == {i: t if t is None else w for (i, t), w in zip(rows, wanted, strict=True)}


def test_monotone_trees():
    rng = np.random.default_rng(5)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * rng.standard_normal(2000) > 0.5).astype(float)
    grown = trees.boost(x, y, trees=30, depth=3, monotone={0: 1, 1: -1})
    line = np.linspace(0, 1, 50)
    for other in (0.1, 0.5, 0.9):
        up = grown.margin(np.c_[line, np.full(50, other), np.full(50, other)])
        down = grown.margin(np.c_[np.full(50, other), line, np.full(50, other)])
        assert (np.diff(up) >= -1e-12).all() and (np.diff(down) <= 1e-12).all()
    assert np.mean((grown.margin(x) > 0) == y) > 0.74


def test_lasso_leaves_few():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2, (1500, 40)).astype(float)
    y = (rng.random(1500) < trees.sigmoid(3 * x[:, 0] - 3 * x[:, 1])).astype(float)
    bias, w = rule_ensemble.lasso_logistic(x, y, 0.02)
    assert w[0] > 0.5 and w[1] < -0.5 and np.sum(w != 0) < 12


def test_rules_are_the_columns(spark):
    rng = np.random.default_rng(7)
    x = rng.random((400, len(rule_ensemble.STATS)))
    model = rule_ensemble.fit_sample(x, (x[:, 3] + x[:, 7] > 1).astype(float))
    assert model.rules
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in rule_ensemble.STATS))
    margin = np.full(len(x), model.bias)
    for r in model.rules:
        held = np.ones(len(x), bool)
        for s, at_most, t in r.bounds:
            column = x[:, rule_ensemble.STATS.index(s)]
            held &= column <= t if at_most else column > t
        margin += r.weight * held
    got = [r.s for r in frame.select(model.score().alias("s")).collect()]
    assert np.allclose(got, trees.sigmoid(margin))


def test_ordinal_thresholds_are_in_order():
    rng = np.random.default_rng(8)
    rows = [{int(c): 1.0 for c in rng.choice(20, 5, replace=False)} for _ in range(800)]
    level = np.array([sum(c < 4 for c in r) for r in rows])
    at_row, at_col = np.repeat(np.arange(800), 5), np.array([c for r in rows for c in r])
    w, t = toxicity.fit_ordinal(at_row, at_col, np.ones(len(at_col)), np.minimum(level, 3), 20)
    assert (np.diff(t) > 0).all() and w[:4].min() > w[4:].max()


def test_repeated_words():
    words = "a b c d e a b c d e x".encode().split()
    assert quality_rules.repeated(words) == 10
    assert quality_rules.repeated(b"a b c".split()) == 0
    assert quality_rules.repeated([b"z"] * 7) == 7



def test_winnowing_finds_every_span_of_a_window(spark):
    """Every span of ten words of an item, wherever it stands in a text and whatever its grams are, repeated ones too."""
    rnd = random.Random(12)
    items = [(i, " ".join(rnd.choice("abcd") if i % 2 else f"w{rnd.randrange(50)}" for _ in range(rnd.choice((1, 2, 4, 5, 6, 9, 10, 11, 40))))) for i in range(30)]
    docs = []
    for n, (_, text) in enumerate(items):
        w = text.split()
        for at in range(max(1, len(w) - 9)):
            around = [[f"x{n}y{at}z{k}" for k in range(rnd.randrange(8))] for _ in range(2)]
            docs.append((len(docs), " ".join([*around[0], *w[at : at + 10], *around[1]])))
    documents, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, text in items:
        w = text.split()
        for at in range(len(w) - min(10, len(w)) + 1):
            windows.setdefault(tuple(w[at : at + 10]), set()).add(str(i))
    for limit in (decontamination.BROADCAST_BYTES, 0):
        got = {r.k_id: r for r in decontamination.contamination(documents, benchmark, broadcast_bytes=limit).collect()}
        for i, text in docs:
            w, hit, found = text.split(), set(), set()
            for n in {len(k) for k in windows}:
                for at in range(len(w) - n + 1):
                    if s := windows.get(tuple(w[at : at + n])):
                        hit |= set(range(at, at + n))
                        found |= s
            assert hit and (got[i].n_hit, got[i].n_items) == (len(hit), len(found))


def test_one_scan_for_ten_lengths(spark):
    benchmark = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in range(1, 12)], "item_id long, text string")
    hits = decontamination.hit_spans(decontamination.keyed(spark.read.parquet(f"{SF}/documents.parquet")), benchmark)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def test_edited_license_texts(spark):
    """A license with words put in, left out and replaced is found; its words in another order, or a mixture of others, are not."""
    rnd = random.Random(3)
    texts = {label: phrase.split() for label, base, phrase in licenses.TEMPLATES if not base and len(phrase.split()) > 40}
    docs, wanted = [], []
    for label, words in texts.items():
        edited = list(words)
        for _ in range(len(words) // 25):
            at = rnd.randrange(len(edited))
            edited[at : at + 1] = rnd.choice([[], ["put", "in"], ["other"]])
        mixed = rnd.sample(words, len(words))
        for body, found in ((edited, True), (mixed, False), (words[: len(words) // 2], False)):
            docs.append((len(docs), "some words before " + " ".join(body) + " and some after"))
            wanted.append((label, found))
    rows = {r.k_id: r.labels.split(",") for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(label, label in rows[i]) for i, (label, _) in enumerate(wanted)] == wanted


def test_batches_of_marks_equal_single_texts():
    texts = ["Bad BAD word", "", "a é É bad-word 12 x", "bad " * 50]
    known = {m: i for i, m in enumerate(sorted({"bad", "word", "^word", "é", "12"}))}
    row, column, n = toxicity.Marks(known).counted(pa.array(texts))
    got = {}
    for r, c, k in zip(row.tolist(), column.tolist(), n.tolist(), strict=True):
        got.setdefault(r, {})[c] = k
    names = {i: m for m, i in known.items()}
    assert {r: {names[c]: k for c, k in of.items()} for r, of in got.items()} == {0: {"bad": 2, "word": 1, "^word": 1}, 2: {"é": 2, "bad": 1, "word": 1, "^word": 1, "12": 1}, 3: {"bad": 50}}
