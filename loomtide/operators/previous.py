"""The row before, by time buckets: no task sorts a whole topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtide.operators.asof import BUCKET_NS, bucket_of


def with_previous(df: DataFrame, by: Sequence[str], time: str, value: Column, name: str, bucket_ns: int = BUCKET_NS) -> DataFrame:
    """df with name, the value of the row before in its group; null in the first row, and where time is null.

    A bucket's first row needs the last row of the nearest earlier bucket. Those rows, one for each
    bucket, are unioned in as rows that stand before all others of their bucket.
    """
    held = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row")
    rows = df.select(*by, F.col(time).cast("long").alias("__t"), held, value.alias("__value")).withColumn("__bucket", bucket_of(F.col("__t"), bucket_ns))
    last = rows.where("__t is not null").groupBy(*by, "__bucket").agg(F.max_by(F.struct("__t", "__value"), "__t").alias("__last"))
    carried = last.select(*by, "__bucket", F.lag("__last").over(Window.partitionBy(*by).orderBy("__bucket")).alias("__last")).where("__last is not null")
    carried = carried.select(*by, "__bucket", "__last.*", F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.lit(0).alias("__own"))
    both = rows.withColumn("__own", F.lit(1)).unionByName(carried)
    before = F.lag("__value").over(Window.partitionBy(*by, "__bucket").orderBy("__t", "__own"))
    found = both.withColumn("__before", F.when(F.col("__t").isNotNull(), before)).where("__own = 1")
    return found.select("__row.*", F.col("__before").alias(name))
