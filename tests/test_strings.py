from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from refloom.functions import strings as S
from refloom.functions import compare, text, udfs


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_equals_dynamic_programming():
    rnd = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 40))) for _ in "ab")
        assert S.lcs(a, b) == slow_lcs(a, b) == S.lcs(b, a)
        assert 0 <= S.ratio(a, b) <= 100 and 0 <= S.partial_ratio(a, b) <= 100
        assert not a or S.partial_ratio(a, f"{b}{a}{b}") == 100


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Über die Bedeutung", "uber die bedeutung"), (r"{\"U}ber die Bedeutung", "uber die bedeutung"), ("Straße & Weg", "strasse and weg"), ("β-carotene", "beta carotene"), (r"\alpha-helix", "alpha helix"),
        ("Ørsted ørsted", "ørsted orsted"), ("ﬁne-tuning", "fine tuning"), ("a_b", "a b"), ("", ""), (r"\emph{Bold} $x$", "bold x"),
    ],
)
def test_fold(given, wanted):
    assert S.fold(given) == wanted


SAME = [
    ("Two-stream networks", "2-stream networks"), ("Colour and behaviour", "Color and behavior"), ("Pre-training of models", "Pretraining of models"), ("ΔΔC T method", "delta delta CT method"),
    ("The theatre centre", "The theater center"), ("BERT: Pre-training of deep things", "BERT"), ("Deep learning: an overview of it", "Deep learning"), ("A very long title that goes on", "A very long title that g…"),
    ("Recognitoin of handwritten digits", "Recognition of handwritten digits"), ("The first optimisation", "The 1st optimization"),
]
OTHER = [("Attention is all you need", "Attention is all we need"), ("2-stream networks for video", "3-stream networks for video"), ("Deep learning", "Deep learning for images"), ("On birds", "On bards and their many songs")]
CLOSE = ("Attention is all we need for sequence transduction", "Attention is all you need")
UNLIKE = ("Completely unrelated words here", "Attention is all you need")


def test_title_status(spark):
    pairs = [*SAME, *((b, a) for a, b in SAME), *OTHER, CLOSE, UNLIKE, ("", ""), ("x y z", "")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", compare.title_status(F.col("a"), F.col("b")).alias("s")).collect()
    got = {pairs[r.i]: r.s for r in rows}
    assert all(got[a, b] == got[b, a] == "match" for a, b in SAME)
    assert all(got[p] != "match" for p in OTHER)
    assert (got[CLOSE], got[UNLIKE], got["", ""], got["x y z", ""]) == ("partial", "mismatch", "mismatch", "mismatch")


def test_authors(spark):
    cases = [(["Müller", "de la Cruz"], ["H Mueller", "M Cruz"], False, 1.0), (["Smith", "Jones", "Doe"], ["A Smith"], True, 1.0), (["Smith", "Jones"], ["A Smith"], False, 0.5), ([], ["A Smith"], False, None), (["Smith"], None, None, None), (["Nguyễn"], ["T Nguyen"], False, 1.0)]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, a array<string>, b array<string>, c boolean").select("i", compare.author_share(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()
    assert {r.i: r.s for r in rows} == {i: c[3] for i, c in enumerate(cases)}


def test_venues(spark):
    cases = [("Adv. Neural Inf. Process. Syst.", "Advances in Neural Information Processing Systems"), ("Handbook of finance", "The Journal of Finance"), ("Journal", "Nature"), ("Nature", None)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string").select("i", compare.venue_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    got = {r.i: r.s for r in rows}
    assert got[0] == 1.0 and got[1] < 0.7 and got[2] == 0.0 and got[3] is None


def test_exact_fold_and_surnames(spark):
    texts = ["Nguyễn", "e\u0301tude", "Ｆｕｌｌ　ｗｉｄｔｈ", "ﬁne", "Ёлка", "Straße & Weg", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", udfs.exact_fold(F.col("t")).alias("f")).collect()
    assert {r.i: r.f for r in rows} == {i: None if t is None else S.fold(t) for i, t in enumerate(texts)}
    names = spark.createDataFrame([(["T. Nguyễn", "A. Müller"],), (["A. Müller"],), ([],)], "n array<string>").select(udfs.exact_surname_keys(F.col("n")).alias("k")).collect()
    assert [r.k for r in names] == [["nguyen", "muller"], ["muller"], []]


def test_native_fold_is_exact_for_latin(spark):
    rows = [("a" + chr(c) + "b " + chr(c) + "X",) for c in range(1, 0x250)] + [(r"\Alpha-helix {\"U}ber \'e \c{c} $x^2$ \textbf{Foo} \beta2",)]
    got = spark.createDataFrame(rows, "t string").select("t", text.fold(F.col("t")).alias("f")).collect()
    assert [r.t for r in got if r.f != S.fold(r.t)] == []


def test_native_words_equal_the_kernel(spark):
    words = sorted({w for t in ("optimisation behaviours centre theatre haemoglobin analyse modelled hour oestrogen labelling four twentieth seventh colour our",) for w in t.split()})
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.canonical_word(F.col("w")).alias("c")).collect()
    assert {r.w: r.c for r in got} == {w: S.canonical_word(w) for w in words}
