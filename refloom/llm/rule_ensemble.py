"""Quality classifier: a sparse ensemble of rules, compiled to Spark columns.

Trees are grown over statistics of labelled documents; every way from a root to a node is a rule, a conjunction of bounds on
statistics. A logistic regression with a lasso penalty over the rules leaves few with a weight, and these become one column
expression, so the whole corpus is scored without Python. Fitting takes a sample of labelled documents of at most
`sample_rows` rows, the first by hash of the id, which bounds the driver's work at every size of corpus.

Null texts are empty; an empty text has statistics (zeros) and a score like any other. Labels with a null id, or of no
document, are not used; of contradictory labels of one id the least counts. Without labels the score is one half, with labels of one kind it is theirs.
Repeated rows are rows of their own; an empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm import trees
from refloom.llm.quality_rules import labelled

SAMPLE_ROWS = 12_000
LEAST_SCORE = 0.7
PENALTY = 0.002
STATS = ["words", "word_length", "line_words", "symbol_share", "mark_share", "upper_share", "digit_share", "distinct_share", "dup_share", "variety"]
_SPACE = r"[\x20\x09-\x0D]+"


def statistics(texts: DataFrame) -> DataFrame:
    """STATS in place of the column body; the other columns stay."""
    keep = [c for c in texts.columns if c != "body"]
    body = F.col("body")
    parts = texts.select(
        *keep, F.length(body).alias("s_chars"), F.array_remove(F.split(body, _SPACE), "").alias("s_words"), F.split(body, "\n").alias("s_lines"),
        # What is neither lower-case nor a space nor a stop is a small part of prose; the counts below are over it alone.
        F.regexp_replace(body, r"[a-z\x20\n.,]+|[^\x00-\x7F]+", "").alias("s_rest"),
    )
    parts = parts.select(
        *keep, "s_chars", "s_rest", F.size("s_words").alias("s_n"), F.size(F.array_distinct("s_words")).alias("s_d"), F.size("s_lines").alias("s_l"),
        F.size(F.array_distinct("s_lines")).alias("s_dl"), F.length(F.regexp_replace("s_rest", "[^#*$%&|<>]+", "")).alias("s_symbols"),
        F.length(F.regexp_replace("s_rest", "[^A-Z]+", "")).alias("s_upper"), F.length(F.regexp_replace("s_rest", "[^0-9]+", "")).alias("s_digits"),
    )
    over = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return parts.select(
        *keep, F.col("s_n").cast("double").alias("words"), over("s_chars", "s_n").alias("word_length"), over("s_n", "s_l").alias("line_words"),
        over("s_symbols", "s_chars").alias("symbol_share"), ((F.length("s_rest") - F.col("s_symbols") - F.col("s_upper") - F.col("s_digits")) / F.greatest(F.lit(1), F.col("s_chars"))).alias("mark_share"),
        over("s_upper", "s_chars").alias("upper_share"), over("s_digits", "s_chars").alias("digit_share"), over("s_d", "s_n").alias("distinct_share"),
        ((F.col("s_l") - F.col("s_dl")) / F.col("s_l")).alias("dup_share"), (F.col("s_d") / F.sqrt(F.greatest(F.lit(1), F.col("s_n")))).alias("variety"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether at most, threshold), and its weight."""

    bounds: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self) -> Column:
        tests = [F.col(s) <= F.lit(t) if at_most else F.col(s) > F.lit(t) for s, at_most, t in self.bounds]
        return F.when(reduce(Column.__and__, tests), F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The chance of label 1, over a frame with STATS."""
        margin = reduce(Column.__add__, [r.column() for r in self.rules], F.lit(self.bias))
        return 1 / (1 + F.exp(-margin))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient steps; the bias has no penalty."""
    n = len(y)
    x = np.c_[np.ones(n), x]
    # The largest eigenvalue bounds the curvature; power iteration finds it.
    v = np.ones(x.shape[1])
    for _ in range(30):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1
    rate = 4 * n / max(1e-9, float(np.linalg.norm(x @ v) ** 2))
    w = z = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        step = z - rate * (x.T @ (trees.sigmoid(x @ z) - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[0] = step[0]
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def extract(grown: trees.Trees) -> list[tuple[tuple[str, bool, float], ...]]:
    """The distinct rules of the trees; of several bounds of one kind on a statistic the tightest stays."""
    found = {}
    for path in grown.paths():
        tight: dict[tuple[str, bool], float] = {}
        for f, at_most, t in path:
            key = (STATS[f], at_most)
            tight[key] = t if key not in tight else min(tight[key], t) if at_most else max(tight[key], t)
        found[tuple(sorted((s, a, t) for (s, a), t in tight.items()))] = None
    return list(found)


def fit_sample(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Ensemble:
    if not len(y):
        return Ensemble(0.0, ())
    grown = trees.boost(x, y, trees=40, depth=3, rate=0.3, share=0.6, seed=7)
    rules = extract(grown)
    held = np.ones((len(y), len(rules)))
    for i, bounds in enumerate(rules):
        for s, at_most, t in bounds:
            column = x[:, STATS.index(s)]
            held[:, i] *= column <= t if at_most else column > t
    if not rules:
        return Ensemble(grown.bias, ())
    bias, weights = lasso_logistic(held, y, penalty)
    return Ensemble(bias, tuple(Rule(r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """The ensemble for the label `quality`, learnt from rows that are not held out; equal texts count once, with the least of their labels."""
    sample = labelled(docs, labels, "quality", sample_rows, lambda i: ~is_held_out(i)).groupBy("body").agg(F.min("k_id").alias("k_id"), F.min("label").alias("label")).select("k_id", "label", "body")
    rows = statistics(sample).orderBy("k_id").toPandas()
    return fit_sample(rows[STATS].to_numpy(float).reshape(-1, len(STATS)), rows["label"].to_numpy(float))


def classify(docs: DataFrame, model: Ensemble, least_score: float = LEAST_SCORE) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    held = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    stats = statistics(docs.select("doc_id", held, F.coalesce("text", F.lit("")).alias("body")))
    return stats.select("doc_id", "held_out", model.score().alias("score")).withColumn("predicted", (F.col("score") >= least_score).cast("int"))
