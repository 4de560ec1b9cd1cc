"""Synchronisation: all topics of a recording on one clock.

A timeline starts where the last topic starts and ends where the last one ends. On a regular
grid, rows are held (zero-order hold) or taken from the nearest row; a merged timeline keeps
every timestamp of every topic. is_fresh tells whether a row differs from the grid row before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtide.model import FRESH, NS, SYNCED, TIMESTAMP, Recording, SynchronizeError, keys_of
from loomtide.operators.asof import BUCKET_NS, asof

#: Grid points that one row is expanded to at once.
CHUNK = 65_536


def step_ns(fps: float) -> int:
    """The grid's step: whole nanoseconds, rounded down."""
    if not fps or fps <= 0:
        raise SynchronizeError(f"fps must be positive, not {fps}")
    return NS // int(fps) if float(fps).is_integer() else int(NS / fps)


def topic_catalog(long: DataFrame, by: Sequence[str], topic: str = "topic", time: str = TIMESTAMP) -> DataFrame:
    """(by, topic, n, first_ns, last_ns)."""
    return long.groupBy(*by, topic).agg(F.count("*").alias("n"), F.min(time).alias("first_ns"), F.max(time).alias("last_ns"))


def topic_bounds(long: DataFrame, by: Sequence[str], topic: str = "topic", time: str = TIMESTAMP) -> DataFrame:
    """(by, topic, first_ns, last_ns)."""
    return topic_catalog(long, by, topic, time).drop("n")


def bounds(long: DataFrame, by: Sequence[str], topic: str = "topic", time: str = TIMESTAMP) -> DataFrame:
    """(by, start_ns, end_ns): the latest first and the latest last timestamp over topics."""
    return topic_bounds(long, by, topic, time).groupBy(*by).agg(F.max("first_ns").alias("start_ns"), F.max("last_ns").alias("end_ns"))


def grid(limits: DataFrame, step: int, name: str = SYNCED, keep_start: bool = False) -> DataFrame:
    """One row for each point start_ns, start_ns + step, ... up to and including end_ns; keep_start keeps start_ns.

    Long timelines are expanded by chunks, so no row holds more than CHUNK points.
    """
    rest = [c for c in limits.columns if c not in ("start_ns", "end_ns")]
    sized = limits.where("end_ns >= start_ns").withColumn("__last", F.expr(f"(end_ns - start_ns) div {step}L"))
    chunks = sized.select(*rest, "start_ns", "__last", F.explode(F.expr(f"sequence(0L, __last div {CHUNK})")).alias("__chunk"))
    points = F.expr(f"sequence(__chunk * {CHUNK}, least(__last, __chunk * {CHUNK} + {CHUNK - 1}))")
    return chunks.select(*rest, "start_ns", F.explode(points).alias("__i")).select(*rest, *(["start_ns"] if keep_start else []), (F.col("start_ns") + F.col("__i") * step).alias(name))


def topics_grid(long: DataFrame, by: Sequence[str], step: int, topic: str = "topic", time: str = TIMESTAMP, keep_start: bool = False) -> DataFrame:
    """(by, topic, synched_timestamp_ns): each topic on its recording's grid; both bounds come from one aggregate over topics."""
    whole = Window.partitionBy(*by)
    limits = topic_bounds(long, by, topic, time).select(*by, topic, F.max("first_ns").over(whole).alias("start_ns"), F.max("last_ns").over(whole).alias("end_ns"))
    return grid(limits, step, keep_start=keep_start)


def with_freshness(df: DataFrame, by: Sequence[str], matched: Column, time: str = SYNCED) -> DataFrame:
    """df with is_fresh: matched, a time, is not null and differs from that of the row before.

    The lag runs over a topic's grid, which is as long as the recording, however many messages
    the topic has.
    """
    before = F.lag("__m").over(Window.partitionBy(*by).orderBy(time))
    return df.withColumn("__m", matched).withColumn(FRESH, F.col("__m").isNotNull() & ~F.col("__m").eqNullSafe(before)).drop("__m")


def hold(targets: DataFrame, source: DataFrame, by: Sequence[str], seq: Sequence[str] = (), time: str = TIMESTAMP, step: int | None = None, bucket_ns: int = BUCKET_NS) -> DataFrame:
    """Zero-order hold: the targets (by, synched_timestamp_ns) with the struct row, and is_fresh.

    With step, targets are a regular grid with its start_ns: a held row is fresh if it came after
    the last grid time, or stands at the start, and no row needs to see another.
    """
    held = asof(targets, source, by, SYNCED, time, seq, ("backward",), bucket_ns).withColumnRenamed("backward", "row")
    matched = F.col("row")[time]
    if step is None:
        return with_freshness(held, by, matched)
    late = (matched > F.col(SYNCED) - step) | (matched.isNotNull() & (F.col(SYNCED) == F.col("start_ns")))
    return held.withColumn(FRESH, F.coalesce(late, F.lit(False))).drop("start_ns")


def nearest(targets: DataFrame, source: DataFrame, by: Sequence[str], seq: Sequence[str] = (), time: str = TIMESTAMP, bucket_ns: int = BUCKET_NS) -> DataFrame:
    """The nearer of the rows before and after, the earlier at a tie; distances are absolute differences."""
    both = asof(targets, source, by, SYNCED, time, seq, ("backward", "forward"), bucket_ns)
    back, ahead = F.col(SYNCED) - F.col("backward")[time], F.col("forward")[time] - F.col(SYNCED)
    later = F.col("forward").isNotNull() & (F.col("backward").isNull() | (ahead < back))
    chosen = both.withColumn("row", F.when(later, F.col("forward")).otherwise(F.col("backward"))).drop("backward", "forward")
    return with_freshness(chosen, by, F.col("row")[time])


def _long_times(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    if not tables:
        raise SynchronizeError("there are no topics to synchronise")
    by = keys_of(next(iter(tables.values())))
    slim = [df.select(*by, F.lit(t).alias("topic"), F.col(TIMESTAMP).cast("long").alias(TIMESTAMP)) for t, df in tables.items()]
    return reduce(DataFrame.unionByName, slim), by


def timeline_bounds(tables: Mapping[str, DataFrame], strict: bool = True) -> DataFrame:
    """(rosbag_uuid, start_ns, end_ns) over the tables. A topic without rows is an error if strict."""
    times, by = _long_times(tables)
    if strict:
        seen = {r["topic"] for r in times.select("topic").distinct().collect()}  # at most one row a topic
        if missing := sorted(set(tables) - seen):
            raise SynchronizeError(f"topics without rows: {missing}")
    return bounds(times, by)


def _spread(matched: DataFrame, source: DataFrame, by: Sequence[str], fresh: bool) -> DataFrame:
    columns = [F.col("row")[c].alias(c) for c in source.columns if c not in by]
    return matched.select(*by, SYNCED, *columns, *([FRESH] if fresh else []))


def synchronize(tables: Mapping[str, DataFrame], fps: float, method: str = "zero_order_hold", seq: Sequence[str] = (), strict: bool = True) -> dict[str, DataFrame]:
    """Each topic on the common grid: synched_timestamp_ns, the topic's columns, is_fresh."""
    if method not in ("zero_order_hold", "nearest_neighbor"):
        raise SynchronizeError(f"unknown method {method!r}")
    step, limits = step_ns(fps), timeline_bounds(tables, strict)
    holds = method == "zero_order_hold"
    points = grid(limits, step, keep_start=holds)
    out = {}
    for topic, df in tables.items():
        by = keys_of(df)
        tie = [c for c in seq if c in df.columns]
        matched = hold(points, df, by, tie, step=step) if holds else nearest(points, df, by, tie)
        out[topic] = _spread(matched, df, by, True)
    return out


def merge_timestamps(tables: Mapping[str, DataFrame], seq: Sequence[str] = (), strict: bool = True) -> dict[str, DataFrame]:
    """Each topic held onto all timestamps of all topics within the bounds; repeated ones stay, and there is no is_fresh."""
    times, by = _long_times(tables)
    limits = timeline_bounds(tables, strict)
    here = times.crossJoin(limits) if not by else times.join(limits, by)
    points = here.where(F.col(TIMESTAMP).between(F.col("start_ns"), F.col("end_ns"))).select(*by, F.col(TIMESTAMP).alias(SYNCED))
    return {t: _spread(asof(points, df, by, SYNCED, TIMESTAMP, [c for c in seq if c in df.columns]).withColumnRenamed("backward", "row"), df, by, False) for t, df in tables.items()}


def merged(long: DataFrame, by: Sequence[str], topic: str = "topic", time: str = TIMESTAMP, seq: Sequence[str] = (), bucket_ns: int = BUCKET_NS) -> DataFrame:
    """(by, topic, synched_timestamp_ns, row): merge_timestamps over one long table, as a single as-of join."""
    topics = topic_bounds(long, by, topic, time)
    limits = topics.groupBy(*by).agg(F.max("first_ns").alias("start_ns"), F.max("last_ns").alias("end_ns"))
    points = long.select(*by, F.col(time).alias(SYNCED)).join(limits, list(by)).where(F.col(SYNCED).between(F.col("start_ns"), F.col("end_ns")))
    targets = points.join(topics, list(by)).select(*by, topic, SYNCED)
    return asof(targets, long, [*by, topic], SYNCED, time, seq, bucket_ns=bucket_ns).withColumnRenamed("backward", "row")


def excluded_rows(long: DataFrame, by: Sequence[str], topic: str = "topic", time: str = TIMESTAMP) -> DataFrame:
    """Rows outside their recording's bounds."""
    limits = bounds(long, by, topic, time)
    joined = long.join(limits, list(by)) if by else long.crossJoin(limits)
    return joined.where(~F.col(time).between(F.col("start_ns"), F.col("end_ns"))).drop("start_ns", "end_ns")


def synchronize_recording(recording: Recording, fps: float, method: str = "zero_order_hold") -> Recording:
    return recording.with_tables(synchronize(recording.tables, fps, method), fps=fps)
