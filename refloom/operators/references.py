"""Reference rows: one citation once, and its copies after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.udfs import exact_fold as fold
from refloom.functions.udfs import exact_surname_keys


def dedupe_key(fields: Column, raw: Column) -> Column:
    """References with one key are one citation: all their fields agree after folding. Without a title the raw text decides."""
    names = F.array_join(exact_surname_keys(F.transform(fields["authors"], lambda a: a["surname"])), ",")
    parts = [fold(fields["title"]), names, F.coalesce(fields["year"].cast("string"), F.lit("")), fold(F.coalesce(fields["venue"], F.lit(""))), F.coalesce(fields["doi"], F.lit("")), F.coalesce(fields["entry_type"], F.lit(""))]
    whole = F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))
    return F.when(F.coalesce(fields["title"], F.lit("")) == "", F.concat(F.lit("raw:"), fold(F.coalesce(raw, F.lit(""))))).otherwise(whole)


def with_original(refs: DataFrame, by: list[str], key: str = "dedupe_key", order: str = "idx") -> DataFrame:
    """Adds `original`, the least `order` of the rows with the same key. An aggregate and a join: a citation that a third of all rows
    repeat is combined before the shuffle, and a join may be split, which a window may not."""
    # Two names for the key, since both sides come from one frame.
    first = refs.groupBy(*(F.col(c).alias(f"o_{c}") for c in by), F.col(key).alias("o_key")).agg(F.min(order).alias("original"))
    same = F.col(key).eqNullSafe(F.col("o_key"))
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"o_{c}"))
    return refs.join(first, same).drop("o_key", *(f"o_{c}" for c in by))


def originals(refs: DataFrame, order: str = "idx") -> DataFrame:
    return refs.where(F.col("original") == F.col(order))


def fanned_out(refs: DataFrame, results: DataFrame, by: list[str], order: str = "idx") -> DataFrame:
    """Every reference with its original's result; a copy says so and costs no search."""
    found = results.select(*(F.col(c).alias(f"r_{c}") for c in by), F.col(order).alias("r_order"), *(c for c in results.columns if c not in (*by, order) and c not in refs.columns))
    same = F.col("original") == F.col("r_order")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"r_{c}"))
    rows = refs.join(found, same, "left").drop("r_order", *(f"r_{c}" for c in by))
    copy = F.col("original") != F.col(order)
    rows = rows.withColumn("duplicate_of", F.when(copy, F.col("original")))
    if "reason" in rows.columns:
        rows = rows.withColumn("reason", F.when(copy, F.concat(F.lit("Duplicate of reference "), F.col("original").cast("string"), F.lit(". "), F.col("reason"))).otherwise(F.col("reason")))
    if "searches_used" in rows.columns:
        rows = rows.withColumn("searches_used", F.when(copy, 0).otherwise(F.col("searches_used")))
    return rows
