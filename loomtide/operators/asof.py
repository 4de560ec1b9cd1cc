"""As-of joins as one exchange and sorted windows.

Targets and source rows are unioned, dealt by key and time bucket, and sorted; a window picks the
last (or first) source row as one struct, so that nulls inside a matched row stay null. What a
bucket's targets may need from other buckets is one row: the last source row of the nearest
earlier non-empty bucket (or the first of the nearest later one). Those rows come from a small
aggregate over buckets and are unioned in as further source rows, so there is no join, and no
task ever holds a whole key: a topic with a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Length of a time bucket: with a 1 kHz topic, 3.6 million rows.
BUCKET_NS = 3_600_000_000_000

_T, _SIDE, _SEQ, _ROW, _BUCKET = "__t", "__side", "__seq", "__row", "__bucket"


def bucket_of(t: Column, bucket_ns: int = BUCKET_NS) -> Column:
    return F.call_function("div", t - F.pmod(t, F.lit(bucket_ns)), F.lit(bucket_ns))


def _edges(left: DataFrame, right: DataFrame, keys: Sequence[str], back: bool) -> DataFrame:
    """For each bucket with targets, the source row that other buckets bring to it, with that bucket's number."""
    order = F.struct(_T, _SEQ)
    held = F.struct(_T, _SEQ, _ROW)
    own = right.groupBy(*keys, _BUCKET).agg((F.max_by(held, order) if back else F.min_by(held, order)).alias("__edge")).withColumn("__source", F.lit(1))
    asked = left.select(*keys, _BUCKET).distinct().withColumn("__edge", F.lit(None).cast(own.schema["__edge"].dataType)).withColumn("__source", F.lit(0))
    # A bucket's own edge comes after its targets' row, so only other buckets' edges lie before it.
    w = Window.partitionBy(*keys).orderBy(F.col(_BUCKET).asc() if back else F.col(_BUCKET).desc(), "__source").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.unionByName(asked).withColumn("__carry", F.last("__edge", ignorenulls=True).over(w))
    return carried.where("__source = 0 and __carry is not null").select(*keys, _BUCKET, "__carry.*")


def asof(
    targets: DataFrame,
    source: DataFrame,
    by: Sequence[str] = (),
    target_time: str = "t",
    source_time: str = "timestamp_ns",
    seq: Sequence[str] = (),
    directions: Sequence[str] = ("backward",),
    bucket_ns: int = BUCKET_NS,
) -> DataFrame:
    """Targets with one struct column for each direction: the matched source row, or null.

    backward is the last source row at or before a target's time, forward the first one at or
    after it. Equal times are ordered by seq, then by the row itself. Rows with a null time take
    no part on the source side and match nothing as targets.
    """
    keys = [*by]
    row = F.struct(*(F.col(f"`{c}`") for c in source.columns)).alias(_ROW)
    rank = F.struct(*(F.col(c) for c in seq)) if seq else F.struct(F.lit(0).alias("n"))
    right = source.where(F.col(source_time).isNotNull()).select(*keys, F.col(source_time).cast("long").alias(_T), rank.alias(_SEQ), row).withColumn(_BUCKET, bucket_of(F.col(_T), bucket_ns))
    held = F.struct(*(F.col(f"`{c}`") for c in targets.columns)).alias("__target")
    left = targets.select(*keys, F.col(target_time).cast("long").alias(_T), held).withColumn(_BUCKET, bucket_of(F.col(_T), bucket_ns))
    target_type = left.schema["__target"].dataType
    both = right
    for direction in directions:
        both = both.unionByName(_edges(left, right, keys, direction == "backward"))
    both = both.withColumn(_SIDE, F.lit(1)).withColumn("__target", F.lit(None).cast(target_type))
    both = both.unionByName(left.withColumn(_SIDE, F.lit(0)).withColumns({c: F.lit(None).cast(right.schema[c].dataType) for c in (_SEQ, _ROW)}))
    out = both
    for direction in directions:
        # Backward, sources come before targets of the same time; forward, read from the end, too.
        back = direction == "backward"
        order = [F.col(_T).asc(), F.col(_SIDE).desc(), F.col(_SEQ).asc()] if back else [F.col(_T).desc(), F.col(_SIDE).desc(), F.col(_SEQ).desc()]
        w = Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"__{direction}", F.last(_ROW, ignorenulls=True).over(w))
    matched = [F.when(F.col(_T).isNotNull(), F.col(f"__{d}")).alias(d) for d in directions]
    return out.where(F.col(_SIDE) == 0).select("__target.*", *matched)
