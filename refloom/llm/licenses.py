"""License scan by diagonal voting, with DataFrame functions only.

Every rolling k-gram of words of a text is joined, word by word, to its places in the templates: the texts of licenses and notices, and phrases. A match of the
gram at word w with template place t votes for the diagonal w - t, and a diagonal's votes are gathered. A base phrase has to have a vote from every
place on one diagonal: it stands whole, word for word, starting at that word. For other templates neighbouring diagonals, at most `gap` apart, are merged into
a span, so that a template with words put in or left out still gathers its votes; a span takes diagonals up to `width` from its first, and further
ones open another. A span is verified by its words in order: going through it from left to right, a vote counts if its place in the template comes after those of
all votes before it, and the span stands if `coverage` of the template's grams count.

Null texts are empty. Rows that agree in id and text get the same answer, each its own row. Extra columns are not
looked at. Templates shorter than k words are refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refloom.llm.common import keyed, n_plain_words, plain_words, same_key
from refloom.llm.license_texts import TEXTS

K = 3
#: Diagonals at most this far apart are neighbours, and a span's diagonals are at most so far from its first.
GAP, WIDTH = 2, 12
#: A span counts with at least this share of its template's grams, in order.
COVERAGE = 0.6

# Label, whether it is a base phrase (which has to stand whole), words of the template.
TEMPLATES = [
    ("mit", True, "under the mit license"),
    ("apache-2", True, "apache license version 2"),
    ("cc-by-nc", True, "cc by nc"),
    *((label, False, " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))) for label, text in TEXTS.items()),
]


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(template, label, base, place, grams, g0..): a row for each k-gram of each template; as many rows as the list has words at most."""
    rows = []
    for number, (label, base, phrase) in enumerate(templates):
        words = phrase.split()
        if len(words) < k:
            raise ValueError(f"template {label!r} has fewer than {k} words")
        rows += [(number, label, base, at, len(words) - k + 1, *words[at : at + k]) for at in range(len(words) - k + 1)]
    grams = ", ".join(f"g{i} string" for i in range(k))
    out = spark.createDataFrame(rows, f"template int, label string, base boolean, place int, grams int, {grams}")
    return out.withColumn("t_hash", F.xxhash64(*(f"g{i}" for i in range(k))))


def votes(texts: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(k_id, k_text, template, label, base, grams, diagonal, places): the template places that voted for each diagonal."""
    words = texts.select("k_id", "k_text", plain_words(F.col("body")).alias("words")).where(F.size("words") >= k)
    rolled = words.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - k)))
    gram = [F.get("words", F.col("at") + i) for i in range(k)]
    rolled = rolled.select("k_id", "k_text", "at", *(g.alias(f"w{i}") for i, g in enumerate(gram))).withColumn("w_hash", F.xxhash64(*(f"w{i}" for i in range(k))))
    grams = template_grams(texts.sparkSession, templates, k)
    same = rolled["w_hash"] == grams["t_hash"]
    for i in range(k):
        same &= rolled[f"w{i}"] == grams[f"g{i}"]
    met = rolled.join(F.broadcast(grams), same).select("k_id", "k_text", "template", "label", "base", "grams", (F.col("at") - F.col("place")).alias("diagonal"), "place")
    return met.groupBy("k_id", "k_text", "template", "label", "base", "grams", "diagonal").agg(F.collect_set("place").alias("places"))


def _in_order(votes: Column) -> Column:
    """How many votes, in the order of their words, have a place after the places of all before them; votes: (at, place)."""
    state = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))
    step = lambda a, v: F.when(v["place"] > a["last"], F.struct(v["place"].alias("last"), (a["n"] + 1).alias("n"))).otherwise(a)
    return F.aggregate(F.array_sort(votes), state, step, lambda a: a["n"])


def spans(texts: DataFrame, templates=TEMPLATES, k: int = K, gap: int = GAP, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """(k_id, k_text, label, base, start, share): verified spans; `start` is the word, from 0, where the first diagonal starts."""
    each = ["k_id", "k_text", "template", "label", "base", "grams"]
    line = Window.partitionBy(*each).orderBy("diagonal")
    d = F.col("diagonal")
    # A base phrase has to stand whole on one diagonal, so its diagonals are not merged.
    opens = F.col("base") | F.lag(d).over(line).isNull() | (d - F.lag(d).over(line) > gap)
    merged = (
        votes(texts, templates, k)
        .withColumn("opens", opens.cast("int"))
        .withColumn("island", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("part", F.floor((d - F.min(d).over(Window.partitionBy(*each, "island"))) / (width + 1)))
        .withColumn("votes", F.transform("places", lambda p: F.struct((d + p).alias("at"), p.alias("place"))))
        .groupBy(*each, "island", "part")
        .agg(F.min(d).alias("start"), _in_order(F.flatten(F.collect_list("votes"))).alias("voted"))
    )
    share = F.col("voted") / F.col("grams")
    kept = F.when(F.col("base"), F.col("voted") == F.col("grams")).otherwise(share >= coverage)
    return merged.withColumn("share", share).where(kept).select("k_id", "k_text", "label", "base", "start", "share")


def license_scan(docs: DataFrame, templates=TEMPLATES, k: int = K, gap: int = GAP, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document: k_id, k_text, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    texts = keyed(docs)
    rows = texts.select("k_id", "k_text", n_plain_words(F.col("body")).alias("n_words"))
    joined = lambda only: F.array_join(F.array_sort(F.collect_set(F.when(only, F.col("label")))), ",")
    found = spans(texts, templates, k, gap, width, coverage).groupBy("k_id", "k_text").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"), joined(F.col("base")).alias("base_labels"),
        joined(F.lit(True)).alias("labels"), F.max("share").alias("score"),
    )
    return rows.join(found, same_key(rows, found), "left").select(
        rows["k_id"], rows["k_text"], "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
