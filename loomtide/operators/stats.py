"""Column statistics of episodes: scalars, lists by position, structs as lists, image channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATS = ("min", "max", "mean", "std", "count")


def _population_std(x: Column) -> Column:
    """sqrt of E[x^2] - E[x]^2, clipped at 0."""
    mean = F.avg(x)
    return F.sqrt(F.greatest(F.avg(x * x) - mean * mean, F.lit(0.0)))


def scalar_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """min, max, mean, population std and count of a number or boolean column; nulls are left out.

    Booleans count as 0 and 1, but their min and max stay booleans.
    """
    kind = df.schema[column].dataType
    x = F.col(column).cast("int").cast("double") if isinstance(kind, T.BooleanType) else F.col(column).cast("double")
    return df.groupBy(*by).agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(column).alias("count"))


def list_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Arrays min, max, mean, std and count by position in a list column.

    Null and empty lists are left out. Lists of several lengths in a group, or a null element,
    leave the group without a row. Rows are summed by position before anything is gathered; a
    group's result is as long as its lists.
    """
    items = df.select(*by, F.col(column).alias("__l")).where(F.size("__l") > 0)
    at = items.select(*by, F.size("__l").alias("__n"), F.posexplode("__l").alias("__pos", "__x")).withColumn("__x", F.col("__x").cast("double"))
    one = at.groupBy(*by, "__pos").agg(F.min("__x").alias("min"), F.max("__x").alias("max"), F.avg("__x").alias("mean"), F.stddev_pop("__x").alias("std"), F.count("__x").alias("count"), F.min("__n").alias("__lo"), F.max("__n").alias("__hi"), F.bool_and(F.col("__x").isNotNull()).alias("__full"))
    rows = F.sort_array(F.collect_list(F.struct("__pos", *STATS)))
    whole = one.groupBy(*by).agg(rows.alias("__r"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.bool_and("__full").alias("__full"))
    whole = whole.where("__lo = __hi and __full")
    values = lambda name: F.transform("__r", lambda r: r[name]).alias(name)
    return whole.select(*by, *map(values, STATS))


def numeric_paths(kind: T.DataType) -> list[tuple[tuple[str, ...], T.DataType]]:
    """Primitive leaves of a struct, depth first."""
    if isinstance(kind, T.StructType):
        return [((f.name, *p), t) for f in kind.fields for p, t in numeric_paths(f.dataType)]
    return [((), kind)]


def struct_to_list(df: DataFrame, column: str) -> Column:
    """A struct as the list of its leaves that have the first leaf's type; nulls are left out."""
    leaves = numeric_paths(df.schema[column].dataType)
    primitive = [(p, t) for p, t in leaves if isinstance(t, (T.NumericType, T.BooleanType))]
    if not primitive:
        return F.lit(None)
    kind = primitive[0][1]

    def leaf(path: tuple[str, ...]) -> Column:
        c = F.col(f"`{column}`")
        for name in path:
            c = c.getField(name)
        return c

    return F.array_compact(F.array(*(leaf(p) for p, t in primitive if t == kind)))


def structs_to_lists(df: DataFrame) -> DataFrame:
    """Every struct column as a list of numbers."""
    return df.select(*(struct_to_list(df, f.name).alias(f.name) if isinstance(f.dataType, T.StructType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def channel_stats(df: DataFrame, pixels: str = "pixels", by: Sequence[str] = (), channels: int = 3) -> DataFrame:
    """Arrays min, max, mean, std by channel over interleaved 8-bit pixels, on values / 255; count is frames.

    Per-frame sums are formed in the scan and added up by channel.
    """

    def own(c: int) -> Column:
        return F.filter(F.transform(F.col(pixels), lambda x, i: F.when(i % channels == c, x.cast("double") / 255.0)), lambda x: x.isNotNull())

    def sums(values: Column) -> Column:
        s, q = F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
        return F.struct(F.array_min(values).alias("lo"), F.array_max(values).alias("hi"), s.alias("s"), q.alias("q"), F.size(values).alias("n"))

    frame = df.select(*by, *(own(c).alias(f"__v{c}") for c in range(channels))).select(*by, F.array(*(sums(F.col(f"__v{c}")) for c in range(channels))).alias("__c"))
    mean = [F.sum(F.col("__c")[c]["s"]) / F.sum(F.col("__c")[c]["n"]) for c in range(channels)]
    var = [F.greatest(F.sum(F.col("__c")[c]["q"]) / F.sum(F.col("__c")[c]["n"]) - m * m, F.lit(0.0)) for c, m in enumerate(mean)]
    return frame.groupBy(*by).agg(
        F.array(*(F.min(F.col("__c")[c]["lo"]) for c in range(channels))).alias("min"),
        F.array(*(F.max(F.col("__c")[c]["hi"]) for c in range(channels))).alias("max"),
        F.array(*mean).alias("mean"),
        F.array(*map(F.sqrt, var)).alias("std"),
        F.count("*").alias("count"),
    )


def reshaped(values: dict, channels: int = 3) -> dict:
    """Scalar stats of a video's freshness, repeated as [channels, 1, 1] lists; count stays a list of one."""
    return {k: [v] if k == "count" else [[[v]] for _ in range(channels)] for k, v in values.items()}
