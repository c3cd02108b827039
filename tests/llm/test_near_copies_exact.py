"""What the Gray index leaves out is found all the same."""

from __future__ import annotations

import random

import corpus_pipeline
from refloom.llm import near_copies
from tests.llm.test_near_copies import brute_firsts, edited, planted, shingle_set


def kept(spark, sf, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, sf).collect())


def test_no_pair_close_to_the_limit_is_lost(spark, sf):
    rnd = random.Random(31)
    texts = []
    while len(texts) < 800:
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(60, 400))]
        pair = [" ".join(base), " ".join(edited(rnd, base, max(1, len(base) // 44)))]
        a, b = map(shingle_set, pair)
        if 80 <= 100 * len(a & b) / len(a | b) < 81:
            texts += pair
    rnd.shuffle(texts)
    assert kept(spark, sf, texts) == sorted(brute_firsts(texts))


def test_the_exact_join_alone(spark, sf, monkeypatch):
    monkeypatch.setattr(near_copies, "_proposed", lambda groups: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(near_copies, "LIST_ROWS", 4)  # lists are dealt to cells
    rnd = random.Random(32)
    # Phrases that many texts share, and one group in which pairs lie on both sides of the limit.
    phrases = [" ".join(f"p{rnd.randrange(50)}" for _ in range(12)) for _ in range(5)]
    texts = [" ".join([rnd.choice(phrases), *(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(40))), rnd.choice(phrases)]) for _ in range(120)]
    base = [f"w{rnd.randrange(10**6)}" for _ in range(90)]
    texts += planted() + [" ".join(edited(rnd, base, rnd.randrange(1, 4))) for _ in range(80)]
    firsts = sorted(brute_firsts(texts))
    assert 0 < len(texts) - len(firsts) and kept(spark, sf, texts) == firsts


def test_rows_that_fall_into_two_parts_of_a_group(spark, sf, monkeypatch):
    monkeypatch.setattr(near_copies, "GROUP_ROWS", 8)
    monkeypatch.setattr(near_copies, "SHARED_ROWS", 1)
    texts = planted()
    assert kept(spark, sf, texts) == sorted(brute_firsts(texts))
