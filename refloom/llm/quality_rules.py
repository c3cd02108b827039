"""Quality rules: boosted trees over document statistics, scored from flat node arrays.

The statistics are worked out from whole texts on the executors, an Arrow batch at a time. Trees are grown on the driver from
a sample of labelled documents of at most `sample_rows` rows, the first by hash of the id, so the bound holds at every
size of corpus. The score may only fall as the shares of symbols, repeated words and equal lines rise.

Null texts have no words. Documents of fewer than 10 words, or with over 20 % of their words in repeated 5-word windows,
fail the base rules and are not kept. A label whose id is null, or that no document has, is not used; of contradictory labels
of one id the least counts. Without labels of both kinds the trees say nothing, and what the base rules pass is kept. Repeated rows are rows of
their own; an empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm import trees

SAMPLE_ROWS = 12_000
LEAST_SCORE = 0.5
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "line_words", "mark_share"]
#: Column of FEATURES, and which way the score may go as it rises.
MONOTONE = {FEATURES.index("symbol_share"): -1, FEATURES.index("dup_share"): -1, FEATURES.index("repeat_share"): -1}
_UPPER, _DIGITS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?;:=_/\\^~@[]{}()"


def repeated(words: list[bytes], width: int = 5) -> int:
    """Words in `width`-word windows that are found at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for i in range(width):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
        windows ^= windows >> np.uint64(29)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, windows), len(twice) - 1)] == windows)
    edges = np.bincount(at, minlength=len(words) + 1)[: len(words) + 1] - np.bincount(at + width, minlength=len(words) + 1)[: len(words) + 1]
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    rep = repeated(words)
    without = lambda drop: (len(data) - len(data.translate(None, drop))) / max(1, len(data))
    some = max(1, n)
    return [n, word_chars, n_symbols, dup, rep], [
        np.log1p(n), word_chars / some, n_symbols / max(1, word_chars), dup / max(1, len(lines)), rep / some, len(set(words)) / some,
        without(_UPPER), without(_DIGITS), n / max(1, len(lines)), without(_MARKS),
    ]


def measured(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    both = [measure(t) for t in texts]
    return np.array([b[0] for b in both], np.int64).reshape(-1, len(COUNTS)), np.array([b[1] for b in both], float).reshape(-1, len(FEATURES))


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int, training=None) -> DataFrame:
    """(k_id, label, body) of at most `rows` labelled documents. The sample of labels is bounded, so it is broadcast to the one scan of the texts."""
    some = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    if training is not None:
        some = some.where(training(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("k_id"), "label")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).join(F.broadcast(some), F.col("doc_id") == F.col("k_id")).select("k_id", "label", "body")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> trees.Trees:
    """Trees for the label `quality`; equal texts count once, with the least of their labels."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = measured(b.column(2).to_pylist())[1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c) for c in x.T)], names=["k_id", "label", *FEATURES])

    sample = labelled(docs, labels, "quality", sample_rows).groupBy("body").agg(F.min("k_id").alias("k_id"), F.min("label").alias("label")).select("k_id", "label", "body")
    rows = sample.mapInArrow(task, "k_id long, label int, " + ", ".join(f"{f} double" for f in FEATURES)).orderBy("k_id").toPandas()
    return trees.boost(rows[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), rows["label"].to_numpy(float), trees=80, depth=3, monotone=MONOTONE)


def judge(docs: DataFrame, model: trees.Trees, least_score: float = LEAST_SCORE) -> DataFrame:
    """A row for each document: doc_id, COUNTS, base_failed, kept, score."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    schema = texts.select("doc_id").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("score", "double")
    certain = len(model.roots) == 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, x = measured(part.column(1).to_pylist())
                failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
                score = trees.sigmoid(model.margin(x))
                kept = ~failed & (certain | (score >= least_score))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(kept), pa.array(score)], names=schema.names)

    return texts.mapInArrow(task, schema)
