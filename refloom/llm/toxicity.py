"""Toxicity by cumulative-link ordinal regression over sparse text features.

A document's features are the marks of a bounded vocabulary and how often they stand in it; the marks of a word are itself and its
beginnings, so that forms of one stem share weight. One weight vector w is shared by all
grades: P(grade > k) = sigmoid(w x - t_k), with thresholds t_0 < t_1 < ... The expected severity is the sum of these over k, and
a document is rejected if P(grade > 0) passes `least`.

Labels that hold numbers over 1 are the grades as they are. Labels that only say toxic or not know two grades. Finer ones are estimates then: the toxic texts of one
half of the sample are ranked by a model with one threshold that saw the other half only, and parted into `grades` equal shares. They order the severity
of toxic texts, which nothing here can be held against; what is tested is the line between toxic and clean.

The model is fitted on a sample of at most `sample_rows` labelled documents of each kind, the first by hash of the id, and a
vocabulary of at most `vocabulary` marks, those whose shares of toxic and clean texts are furthest apart, each in `LEAST_TEXTS` texts of a kind or more;
scoring reads every whole text. Null texts are empty, and empty texts have the severity
of the bias alone. Labels with a null id, or of no document, are not used; of contradictory labels of one id the
greatest counts. Without labels of both kinds nothing is rejected. Repeated rows are rows of their own; an empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from refloom.llm.common import WORD_BREAK, lean
from refloom.llm.trees import sigmoid
from refloom.sources.shared import stored

SAMPLE_ROWS = 6_000
VOCABULARY = 4_000
GRADES = 3
LEAST = 0.3
#: Letters of a word's beginnings, and words whose marks are kept.
STEMS = (4, 5)
MAX_WORDS = 50_000
#: A mark of the vocabulary stands in so many different training texts of one kind at least.
LEAST_TEXTS = 3
#: Characters of text that are worked on at once.
PART_CHARS = 1 << 19


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of all texts, in order: the row and the place in the distinct words of each, and the distinct words."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string())), WORD_BREAK)
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = flat.dictionary_encode()
    words = coded.dictionary
    at = coded.indices.to_numpy(zero_copy_only=False)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[at] if len(words) else np.zeros(0, bool)
    return rows[real], words, at[real]


def parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts): runs of about PART_CHARS characters, one text at the least."""
    upto = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + PART_CHARS, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def marks_of(word: str) -> set[str]:
    """The word, and its first letters with a sign before them."""
    return {word, *("^" + word[:n] for n in STEMS if len(word) >= n)}


class Marks(dict):
    """The places in the vocabulary of each word's marks; words met are kept up to a bound."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        known = self.vocabulary
        found = tuple(sorted(known[m] for m in marks_of(word) if m in known))
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = found
        return found

    def counted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, count) of a sparse matrix: how often each mark stands in each text, by row and column."""
        rows, words, at = words_of(texts)
        found = [self[w] for w in words.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((m for f in found for m in f), np.int64)
        some = sizes[at] > 0
        rows, at = rows[some], at[some]
        n = sizes[at]
        first = np.r_[0, np.cumsum(sizes)][at]
        place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, count = np.unique(np.repeat(rows, n) * (len(self.vocabulary) + 1) + flat[place], return_counts=True)
        return key // (len(self.vocabulary) + 1), key % (len(self.vocabulary) + 1), count


@dataclass(frozen=True)
class Severity:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def margins(self, texts: pa.Array, marks: Marks | None = None) -> np.ndarray:
        """The sparse matrix of a part of the texts times the weights, part by part."""
        marks, out = marks or Marks(self.vocabulary), np.zeros(len(texts))
        for at, part in parts(texts) if self.vocabulary else ():
            row, column, n = marks.counted(part)
            out[at : at + len(part)] = np.bincount(row, self.weights[column] * np.log1p(n), len(part))
        return out

    def over(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and each k."""
        return sigmoid(margins[:, None] - self.thresholds[None, :])


def fit_ordinal(at_row: np.ndarray, at_col: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, l2: float = 3e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds that maximise the likelihood of the grades, by Adam on the exact gradient.

    The features are entries (row, column, value). The thresholds are a first one and positive gaps, so that they stay in order.
    """
    top = int(grade.max())
    share = [np.clip((grade > k).mean(), 1e-3, 1 - 1e-3) for k in range(top)]
    logits = np.array([np.log((1 - s) / s) for s in share])
    gaps = np.log(np.maximum(np.diff(logits), 0.05))
    theta = np.r_[np.zeros(width), logits[:1], gaps]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = len(grade)
    for step in range(1, steps + 1):
        w = theta[:width]
        t = np.cumsum(np.r_[theta[width], np.exp(theta[width + 1 :])])
        margin = np.bincount(at_row, w[at_col] * value, n)
        # The chance of a grade is the difference of two neighbouring curves; below the first is 1, above the last 0.
        s = np.c_[np.ones(n), sigmoid(margin[:, None] - t[None, :]), np.zeros(n)]
        rows_at = np.arange(n)
        high, low = s[rows_at, grade], s[rows_at, grade + 1]
        chance = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
        g_margin = -(d_high - d_low)
        g_t = np.zeros(top)
        np.add.at(g_t, grade[grade > 0] - 1, d_high[grade > 0])
        np.add.at(g_t, grade[grade < top], -d_low[grade < top])
        tail = np.cumsum(g_t[::-1])[::-1]
        g = np.r_[np.bincount(at_col, g_margin[at_row] * value, width), tail[0], tail[1:] * np.exp(theta[width + 1 :])] / n
        g[:width] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:width], np.cumsum(np.r_[theta[width], np.exp(theta[width + 1 :])])


def sample(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, body): at most `rows` labelled texts of each kind, equal ones once."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    kinds = [known.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in ("label > 0", "label <= 0")]
    some = kinds[0].union(kinds[1]).select(F.col("doc_id").alias("k_id"), "label")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).join(F.broadcast(some), F.col("doc_id") == F.col("k_id"))
    return texts.groupBy("body").agg(F.max("label").alias("label")).select("label", "body")


def _by_row(keys: np.ndarray, width: int) -> Iterator[tuple[int, list[int]]]:
    """(row, columns) of sorted row * width + column."""
    rows, columns = keys // width, keys % width
    heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
    for a, b in zip(heads, [*heads[1:], len(rows)], strict=True):
        yield int(rows[a]), columns[a:b].tolist()


def cross_graded(at_row: np.ndarray, at_col: np.ndarray, value: np.ndarray, label: np.ndarray, fold: np.ndarray, width: int, grades: int) -> np.ndarray:
    """Grades 1 to `grades` for rows of label 1, 0 for others: the rank of each by a model of one threshold that saw the other fold only."""
    grade = np.zeros(len(label), int)
    for side in (0, 1):
        seen = np.flatnonzero(fold != side)
        if not 0 < (label[seen] > 0).sum() < len(seen):
            return (label > 0).astype(int)
        of = np.full(len(label), -1)
        of[seen] = np.arange(len(seen))
        here = of[at_row] >= 0
        weights, _ = fit_ordinal(of[at_row[here]], at_col[here], value[here], (label[seen] > 0).astype(int), width, steps=150)
        margin = np.bincount(at_row, weights[at_col] * value, len(label))
        ranked = (fold == side) & (label > 0)
        cuts = np.quantile(margin[ranked], np.arange(1, grades) / grades) if ranked.any() else []
        grade[ranked] = 1 + np.searchsorted(cuts, margin[ranked], "left")
    return grade


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY, grades: int = GRADES) -> Severity:
    texts = stored(sample(docs, labels, column, sample_rows), "toxicity-sample")
    kinds = {bool(r.toxic): r.n for r in texts.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    nothing = Severity({}, np.zeros(0), np.array([20.0]))
    if len(kinds) < 2:
        return nothing

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for b in batches:
            labels = b.column(0).to_numpy()
            for start, part in parts(b.column(1)):
                rows, words, at = words_of(part)
                names = words.to_pylist()
                once = np.unique(rows * (len(names) + 1) + at)
                for row, of in _by_row(once, len(names) + 1):
                    (toxic if labels[start + row] > 0 else clean).update(set().union(*(marks_of(names[i]) for i in of)))
        words = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], names=["word", "toxic", "clean"])

    seen = texts.mapInArrow(counted, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # How far a word's share of toxic texts is from its share of clean ones, in units of its scatter.
    p, q = F.col("toxic") / kinds[True], F.col("clean") / kinds[False]
    both = (F.col("toxic") + F.col("clean")) / sum(kinds.values())
    far = F.abs(p - q) / F.sqrt(both * (1 - both) * (1 / kinds[True] + 1 / kinds[False]) + 1e-12)
    least = LEAST_TEXTS if kinds[True] >= 30 else 2
    picked = seen.where(F.greatest("toxic", "clean") >= least).withColumn("far", far).orderBy(F.desc("far"), "word").limit(vocabulary).collect()
    known = {r.word: i for i, r in enumerate(picked)}
    if not known:
        return nothing

    @lean
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(known)
        for b in batches:
            hashes = pa.array([xxhash.xxh64_intdigest(body) - (1 << 63) for body in b.column(1).to_pylist()], pa.int64())
            for start, part in parts(b.column(1)):
                row, column, n = marks.counted(part)
                ends = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                at, n = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (column, n))
                yield pa.RecordBatch.from_arrays([hashes.slice(start, len(part)), b.column(0).slice(start, len(part)), at, n], names=["hash", "label", "at", "n"])

    rows = texts.mapInArrow(placed, "hash long, label int, at array<int>, n array<int>").toArrow().combine_chunks()  # at most 2 * sample_rows
    order = np.argsort(rows["hash"].to_numpy(), kind="stable")  # sums in one order, so that fits agree to the last bits
    rows = rows.take(pa.array(order)).combine_chunks()
    label = rows["label"].to_numpy()
    size = pc.list_value_length(rows["at"]).to_numpy()
    at_row, at_col, n = np.repeat(np.arange(len(label)), size), pc.list_flatten(rows["at"]).to_numpy(), pc.list_flatten(rows["n"]).to_numpy()
    value = np.log1p(n)
    fold = np.arange(len(label)) % 2  # rows are in the order of a hash
    grade = label.astype(int) if label.max() > 1 else cross_graded(at_row, at_col, value, label, fold, len(known), grades)
    grade = np.unique(grade, return_inverse=True)[1]
    weights, thresholds = fit_ordinal(at_row, at_col, value, grade, len(known))
    return Severity(known, weights, thresholds)


def score(docs: DataFrame, model: Severity, least: float = LEAST) -> DataFrame:
    """All columns of the documents, then `severity` (expected grade), `toxicity` (chance of a grade over 0) and `rejected`, in a struct `toxic_verdict`."""
    name = "toxic_verdict"
    while name in docs.columns:
        name += "_"
    columns = [f"c{i}" for i in range(len(docs.columns))]  # a name of theirs may hold a dot
    rows, text_at = docs.toDF(*columns), docs.columns.index("text")
    verdict_type = StructType().add("severity", "double").add("toxicity", "double").add("rejected", "boolean")
    schema = StructType([*rows.schema.fields]).add("verdict", verdict_type)

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(model.vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                over = model.over(model.margins(part.column(text_at).fill_null(""), marks))
                verdict = pa.StructArray.from_arrays([pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array(over[:, 0] >= least)], names=["severity", "toxicity", "rejected"])
                yield pa.RecordBatch.from_arrays([*part.columns, verdict], names=[*columns, "verdict"])

    return rows.mapInArrow(task, schema).toDF(*docs.columns, name)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: doc_id, severity, toxicity, rejected."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", "toxic_verdict.severity", "toxic_verdict.toxicity", "toxic_verdict.rejected")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    out = score(docs, fit(docs, labels))
    verdict = out.columns[-1]
    return out.where(~F.col(f"`{verdict}`.rejected")).select(*(F.col(f"`{c}`") for c in docs.columns))
