"""What the operators of this subpackage share: tables, words and row keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Whatever is not a digit, an ASCII letter or a character beyond ASCII separates words.
WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; `lower` would fold other letters too."""
    return F.translate(text, UPPER, LOWER)


def plain_words(text: Column) -> Column:
    """Array of the words of a text, with A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text), WORD_BREAK), "")


def n_plain_words(text: Column) -> Column:
    """size(plain_words(text)), without folding case."""
    return F.size(F.array_remove(F.split(text, WORD_BREAK), "")).cast("long")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k_id, k_text, body): rows that agree in id and text are one document to every operator here."""
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("k_id"), F.xxhash64(body).alias("k_text"), body.alias("body"))


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["k_id"].eqNullSafe(b["k_id"]) & (a["k_text"] == b["k_text"])


#: Tables of up to this many bytes are sent to all executors; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def _bytes(column: Column, kind: DataType) -> Column:
    """About what a value takes up in memory."""
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        return F.coalesce(F.size(column), F.lit(0)) * F.lit(8 * (len(inner.fields) + 2 if isinstance(inner, StructType) else 1)) + F.lit(16)
    if isinstance(kind, StructType):
        return reduce(Column.__add__, (_bytes(column[f.name], f.dataType) for f in kind), F.lit(16))
    return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16) if kind.typeName() in ("string", "binary") else F.lit(8)


def broadcast_if_small(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if it is proven to be small: the sizes of all its rows are added up."""
    row = reduce(Column.__add__, (_bytes(F.col(f"`{f.name}`"), f.dataType) for f in table.schema), F.lit(32))
    total = table.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(table) if total <= limit else table


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(task: Task) -> Task:
    """The task, after which its worker gives back what it has freed: workers are used again, and what Arrow and the C library hold would add up over the stages."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return run
