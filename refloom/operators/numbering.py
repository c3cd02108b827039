"""Running numbers over whole tables and large groups, without ordering them in one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.sources.shared import stored


def numbered(rows: DataFrame, order: str, name: str = "number", width: int = 65_536) -> DataFrame:
    """Adds `name`, from 1, in the order of a whole-number column: runs of `width` values are numbered apart and moved on by the rows before them.

    The one window without partitions orders the runs, of which there are as many as the column's range over `width`. Equal values are numbered in any order.
    """
    rows = rows.withColumn("n_run", F.floor(F.col(order) / width))
    runs = rows.groupBy("n_run").agg(F.count("*").alias("n"))
    before = runs.select(F.col("n_run").alias("b_run"), (F.sum("n").over(Window.orderBy("n_run")) - F.col("n")).alias("n_before"))
    inside = F.row_number().over(Window.partitionBy("n_run").orderBy(order))
    return rows.withColumn(name, inside).join(before, F.col("n_run") == F.col("b_run")).withColumn(name, F.col(name) + F.col("n_before")).drop("n_run", "b_run", "n_before")


RUN = "n_run"


def in_runs(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows, written, with `n_run`: numbers that rise with the order. A run is a task's share of all rows, whatever groups they are of."""
    return stored(rows.repartitionByRange(*order).withColumn(RUN, F.spark_partition_id()), "runs")


def running(rows: DataFrame, by: list[str], order: list[str], name: str, total: Callable[[Column], Column], value: Column, both: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds `name`: `total` of the values up to each row, in order, within a group. rows: from `in_runs`; both(a, b) is the total of two totals.

    Each run of a group is totalled apart and carried on from the runs before it, so a group of any size is spread over tasks. The window
    over totals has a row for each run of a group.
    """
    inside = Window.partitionBy(*by, RUN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*(F.col(c).alias(f"b_{c}") for c in by), F.col(RUN).alias("b_run")).agg(total(value).alias("b_total"))
    earlier = Window.partitionBy(*(f"b_{c}" for c in by)).orderBy("b_run").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("b_before", total(F.col("b_total")).over(earlier)).drop("b_total")
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"b_{c}")), by, F.col(RUN) == F.col("b_run"))
    out = rows.withColumn(name, total(value).over(inside)).join(before, same)
    return out.withColumn(name, F.when(F.col("b_before").isNull(), F.col(name)).otherwise(both(F.col("b_before"), F.col(name)))).drop("b_run", "b_before", *(f"b_{c}" for c in by))


def running_sum(rows: DataFrame, by: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    return running(rows, by, order, name, F.sum, value, lambda a, b: a + b)


def running_min(rows: DataFrame, by: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    return running(rows, by, order, name, F.min, value, F.least)
