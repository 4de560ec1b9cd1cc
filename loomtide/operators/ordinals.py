"""Row numbers and running sums over a whole table without one task for all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtide.operators.checkpoints import checkpointed


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, length: str | None = None, before: str | None = None) -> DataFrame:
    """df with name, its row's place from 0 in the order, and before, the sum of length over the rows before.

    Rows are dealt by ranges of the order, numbered within each range, and shifted by the totals of
    the ranges before: the only window over everything has one row for each partition.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = [F.count("*").alias("__rows"), *([F.sum(length).alias("__sum")] if length else [])]
    totals = ranged.groupBy("__range").agg(*sums)
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long").alias(f"{c}_before")
    starts = totals.select("__range", *(total(c) for c in totals.columns if c != "__range"))
    here = Window.partitionBy("__range").orderBy(*order)
    out = ranged.withColumn(name, F.row_number().over(here) - 1)
    if length:
        out = out.withColumn(before, F.coalesce(F.sum(length).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(starts, "__range").withColumn(name, F.col(name) + F.col("__rows_before"))
    if length:
        out = out.withColumn(before, (F.col(before) + F.col("__sum_before")).cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), name, *([before] if length else []))
