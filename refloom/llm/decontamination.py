"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is `window` consecutive words of a benchmark item, or the whole item if it is shorter. Both sides hash the `k`-grams of their words
and keep, of each window's grams, the least (the last of equal ones); windows side by side mostly keep the same gram, which is one fingerprint.
A window that occurs in a document has the same grams there and so keeps the same one: every shared span of at least `window` words meets in a
fingerprint. Items of fewer words are one window of their own length, and those of fewer than `k` words are one gram. All lengths are
fingerprinted in one pass over the documents. What the fingerprint join finds is compared word by word and extended to both sides as far as
windows with this gram reach; if a whole window agrees, the extended span is hit.

Null texts have no words, and so no hits. Items without words are left out; items with a null id mark words as hit but
are not listed. Rows that agree in id and text get the same answer, each its own row. An empty benchmark hits nothing.
Extra columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import keyed, n_plain_words, plain_words, same_key

WINDOW, K = 10, 5
#: Benchmark fingerprints are broadcast up to this many bytes of text, and joined by a shuffle beyond.
BROADCAST_BYTES = 64 << 20


def _least(values: list[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def _kept(hashes: Column, grams: Column, length: int, k: int) -> Column:
    """struct(length, mark, place) for each fingerprint of windows of `length` words: mark is the gram's hash, place where it starts, from 0."""
    made = lambda mark, place: F.struct(F.lit(length).alias("length"), (mark + F.lit(length)).alias("mark"), place.cast("int").alias("place"))  # noqa: E731  marks of unlike lengths are unlike
    starts = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    if length <= k:
        return F.transform(starts(F.size(hashes) - length), lambda s: made(F.xxhash64(*(F.get(hashes, s + i) for i in range(length))), s))
    n = length - k + 1
    at = lambda s, j: F.get(grams, s + j)

    def other(s: Column) -> Column:
        # The window keeps another gram than the one before if what comes is as low as the rest, or what left was lower.
        rest = _least([at(s, j) for j in range(n - 1)])
        return (s == 0) | (at(s, n - 1) <= rest) | (at(s, -1) < rest)

    def kept(s: Column) -> Column:
        mark = _least([at(s, j) for j in range(n)])
        return made(mark, reduce(lambda e, j: F.when(at(s, j) == mark, s + j).otherwise(e), range(n), s))

    return F.transform(F.filter(starts(F.size(grams) - n), other), kept)


def _fingerprints(texts: DataFrame, lengths: list[int], k: int) -> DataFrame:
    """One row for each fingerprint: the columns of texts but body, then words, length, mark, place. All that a text has is worked out in arrays of hashes, each gram's once."""
    keep = [c for c in texts.columns if c != "body"]
    words = texts.select(*keep, plain_words(F.col("body")).alias("words")).where(F.size("words") >= min(lengths))
    hashed = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    last = F.size("hashes") - k
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("hashes", i + j) for j in range(k))))
    hashed = hashed.withColumn("grams", F.when(last >= 0, grams).otherwise(F.array().cast("array<bigint>")) if max(lengths) > k else F.array().cast("array<bigint>"))
    found = [_kept(F.col("hashes"), F.col("grams"), n, k) for n in lengths]
    return hashed.select(*keep, "words", F.inline(F.concat(*found) if len(found) > 1 else found[0]))


def benchmark_fingerprints(benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame | None:
    """(b_length, b_mark, lead, near, items): the words about each distinct fingerprint, as far as its windows reach; its gram is after `lead` of them. None if there is none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("body"))
    n = F.least(n_plain_words(F.col("body")), F.lit(window)).cast("int")
    lengths = sorted(r.n for r in items.select(n.alias("n")).where("n > 0").distinct().collect())  # at most `window` numbers
    if not lengths:
        return None
    rows = _fingerprints(items, lengths, k).where(F.col("length") == F.least(F.size("words"), F.lit(window)))
    reach = F.greatest(F.col("length") - k, F.lit(0))
    lead = F.least(F.col("place"), reach)
    near = F.slice("words", F.col("place") - lead + 1, lead + F.least(F.col("length"), F.lit(k)) + reach)
    rows = rows.select("item", F.col("length").alias("b_length"), F.col("mark").alias("b_mark"), lead.alias("lead"), near.alias("near"))
    return rows.groupBy("b_length", "b_mark", "lead", "near").agg(F.collect_set("item").alias("items"))


def _extended(words: Column, place: Column, length: Column, lead: Column, near: Column, lengths: list[int], k: int) -> tuple[Column, Column, Column]:
    """(whether a whole window agrees, words to the left of the gram that agree, and from its start on)."""
    same = lambda i: F.coalesce(F.get(words, place + i) == F.get(near, lead + i), F.lit(False))

    def run(places: list[int]) -> Column:
        return reduce(lambda n, i: F.when(same(i), n + 1).otherwise(F.lit(0)), reversed(places), F.lit(0))

    reach = max(0, max(lengths) - k)
    gram = reduce(and_, (same(i) | (F.lit(i) >= length) for i in range(min(k, max(lengths)))))
    left = F.least(run([-1 - i for i in range(reach)]), F.greatest(length - k, F.lit(0)))
    right = F.least(length, F.lit(k)) + F.least(run([k + i for i in range(reach)]), F.greatest(length - k, F.lit(0)))
    return gram & (left + right >= length), left, right


def hit_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """(k_id, k_text, at, length, items): the spans of a document, from word 1, that agree with items, each a window or more."""
    wanted = benchmark_fingerprints(benchmark, window, k)
    if wanted is None:
        return None
    about = wanted.agg(F.collect_set("b_length").alias("lengths"), F.sum(F.length(F.array_join("near", " ")) + F.size("items") * 16 + 64).alias("bytes")).first()
    lengths = sorted(about.lengths)
    meets = (F.col("mark") == F.col("b_mark")) & (F.col("length") == F.col("b_length"))
    prints = _fingerprints(docs, lengths, k)

    def spans(whole: Column, left: Column, right: Column, place: Column) -> list[Column]:
        return [(place - left + 1).cast("int").alias("at"), (left + right).cast("int").alias("length")]

    if about.bytes <= broadcast_bytes:
        # The words of a text are at hand where its fingerprints are made, and are compared there.
        whole, left, right = _extended(F.col("words"), F.col("place"), F.col("b_length"), F.col("lead"), F.col("near"), lengths, k)
        found = prints.join(F.broadcast(wanted), meets & whole)
        return found.select("k_id", "k_text", *spans(whole, left, right, F.col("place")), "items")
    # Otherwise only places and fingerprints are shuffled; each text that meets any comes once more, to be compared with all it met.
    met = prints.drop("words").join(wanted, meets).groupBy(F.col("k_id").alias("m_id"), F.col("k_text").alias("m_text")).agg(F.collect_set(F.struct("place", "length", "lead", "near", "items")).alias("met"))
    rows = docs.join(met, docs["k_id"].eqNullSafe(met["m_id"]) & (docs["k_text"] == met["m_text"])).select("k_id", "k_text", plain_words(F.col("body")).alias("words"), "met")

    def compared(m: Column) -> Column:
        whole, left, right = _extended(F.col("words"), m["place"], m["length"], m["lead"], m["near"], lengths, k)
        return F.struct(whole.alias("whole"), *spans(whole, left, right, m["place"]), m["items"].alias("items"))

    return rows.select("k_id", "k_text", F.inline(F.filter(F.transform("met", compared), lambda m: m["whole"]))).select("k_id", "k_text", "at", "length", "items")


def _covered(spans: Column) -> Column:
    """Words in the union of (at, length) spans, sorted by place."""
    def step(a: Column, s: Column) -> Column:
        end = s["at"] + s["length"] - 1
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["at"] - 1))).alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row for each document: k_id, k_text, n_words, n_hit, n_items, items_sha256, contaminated, spans (place, length)."""
    texts = keyed(docs)
    rows = texts.select("k_id", "k_text", n_plain_words(F.col("body")).alias("n_words"))
    hits = hit_spans(texts, benchmark, window, k, broadcast_bytes)
    no_spans = F.array().cast("array<struct<at:int,length:int>>")
    if hits is None:
        out = rows.select("*", no_spans.alias("spans"), F.array().cast("array<string>").alias("items"))
    else:
        found = hits.groupBy("k_id", "k_text").agg(
            F.array_sort(F.collect_set(F.struct("at", "length"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        out = rows.join(found, same_key(rows, found), "left").select(
            rows["k_id"], rows["k_text"], "n_words", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
        )
    return out.select(
        "k_id", "k_text", "n_words", _covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns."""
    hits = hit_spans(keyed(docs), benchmark, window, k)
    if hits is None:
        return docs
    bad = hits.select("k_id", F.col("k_text").alias("k_bad")).distinct()
    body = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["k_id"]) & (body == bad["k_bad"]), "left_anti")
