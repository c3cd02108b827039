"""The corpus pipeline: each stage applies one operator to what the stage before it kept.

Every stage reads whole texts, returns the columns of the documents (the last one returns tokens) and is written to the shared
folder before the next begins, so a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from refloom.llm import bpe, decontamination, line_dedup, near_copies, toxicity
from refloom.llm.common import table
from refloom.llm.queries import RANKS
from refloom.sources.shared import remove, stored, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: the documents that the ordinal model of `labels` doesn't reject."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: every document, without the chunks of lines that an earlier one holds."""
    return line_dedup.dedup_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the first document of each component of those that share 0.8 of their five-word shingles, found by wide fingerprints in the Gray index."""
    return near_copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: the documents in which no window of the benchmark stands."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the ids of each document, their digest, and that of the text they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", not_toxic),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokens),
]
#: The stages hold trained models, hashes and byte-pair merges, which SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each one's rows written to the shared folder and read again. What else a stage wrote there is removed after it, and
    so are the rows that it read; those that the last stage reads stay, as its result is not worked out yet."""
    docs = table(spark, sf_dir, "documents")
    before = written(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        remove(spark, [path for path in written(spark)[:-1] if path not in before])
    return STAGES[-1][1](spark, docs, sf_dir)
