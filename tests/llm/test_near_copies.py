"""The pipeline's near-dedup stage against all pairs, over planted near copies."""

from __future__ import annotations

import random

import corpus_pipeline


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_firsts(texts):
    """The least place of each component of texts with a similarity of 0.8 or more."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(x) for x in range(len(texts))}


def edited(rnd, words, edits):
    out = list(words)
    for at in rnd.sample(range(len(out)), edits):
        out[at] = f"new{rnd.randrange(10**9)}"
    return out


def planted():
    rnd = random.Random(11)
    texts = [None, "", " \n ", "few words", "Few  words", "few other words"]
    for n in (20, 60, 200, 700):
        for edits in range(1, 9):  # on both sides of 0.8
            base = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(base), " ".join(edited(rnd, base, max(1, n * edits // 240)))]
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    texts += [" ".join(edited(rnd, base, rnd.randrange(1, 6))) for _ in range(60)]  # one group, in which some pairs are near
    chain = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    for _ in range(20):
        texts.append(" ".join(chain))
        chain = edited(rnd, chain, 2)
    rnd.shuffle(texts)
    return texts


def test_near_dedup_keeps_the_first_of_each_component(spark, sf):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, sf).collect())
    assert got == sorted(brute_firsts(texts))
