"""Payloads kept beside their topic: numbering, lookup and image shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtide.functions.naming import camera_info_topic


def indexed(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "index", unique: bool = False) -> DataFrame:
    """df with each row's number in its topic, from 0.

    Where by and order together are unique and never null, numbers are found on those columns alone
    and joined to the rows, so that a topic's payloads are not sorted in one task.
    """
    number = (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long")
    if not unique:
        return df.withColumn(name, number)
    keys = [*by, *order]
    return df.join(df.select(*keys).withColumn(name, number), keys).select(*(F.col(f"`{c}`") for c in df.columns), name)


def externalized(df: DataFrame, data: str, by: Sequence[str], order: Sequence[str], unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """(table, payloads): the table has index in place of its bytes, the payloads by, index and bytes."""
    both = indexed(df, by, order, unique=unique)
    return both.drop(data), both.select(*by, "index", F.col(data).alias("bytes"))


def lookup(table: DataFrame, payloads: DataFrame, by: Sequence[str], index: str = "index") -> DataFrame:
    """The table's rows with their payload's columns."""
    right = payloads if index == "index" else payloads.withColumnRenamed("index", index)
    return table.join(right, [*by, index], "left")


def image_shapes(images: DataFrame, camera_infos: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, topic, height, width): from the payload, else from the topic's camera_info.

    images has topic, height, width (null where unknown); camera_infos the same of info topics.
    """
    first = images.groupBy(*by, "topic").agg(F.max("height").alias("h"), F.max("width").alias("w"))
    info = camera_infos.groupBy(*by, F.col("topic").alias("info")).agg(F.max("height").alias("ih"), F.max("width").alias("iw"))
    joined = first.withColumn("info", camera_info_topic(F.col("topic"))).join(info, [*by, "info"], "left")
    return joined.select(*by, "topic", F.coalesce("h", "ih").alias("height"), F.coalesce("w", "iw").alias("width"))
