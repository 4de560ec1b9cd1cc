"""Timing quality of topics, segments and episodes, and tie-aware percentile ranks.

Intervals are differences to the row before within a window of time, taken by time buckets, so
that no task sorts a whole topic. A topic's figures are one partially aggregated pass over them;
its median comes from counts of distinct intervals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtide.model import NS, TIMESTAMP, TransformError, seconds_to_ns
from loomtide.operators.asof import BUCKET_NS
from loomtide.operators.previous import with_previous

MS = 1_000_000.0
TIMING = ("message_count", "first_message_timestamp_ns", "last_message_timestamp_ns", "observed_topic_span_s", "episode_coverage_ratio", "observed_hz", "median_topic_interval_ms", "topic_interval_cv", "max_topic_interval_ms", "max_interval_over_median")


def sliced(df: DataFrame, start: Column, end: Column, time: str = TIMESTAMP) -> DataFrame:
    """Rows within [start, end]; a window that ends before it starts is an error."""
    wrong = F.raise_error(F.lit("a window ends before it starts"))
    return df.where(F.when(end < start, wrong).otherwise(F.col(time).between(start, end)))


def intervals_ms(df: DataFrame, by: Sequence[str], time: str = TIMESTAMP, name: str = "interval_ms", bucket_ns: int = BUCKET_NS) -> DataFrame:
    """df with the milliseconds since the row before in its group; null in the first row, and where time is null."""
    out = with_previous(df, by, time, F.col(time).cast("long"), "__previous", bucket_ns)
    return out.withColumn(name, (F.col(time).cast("long") - F.col("__previous")) / F.lit(MS)).drop("__previous")


def _medians(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, name): each group's median of value, the mean of the middle two of an even number."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__ties"))
    w = Window.partitionBy(*keys)
    seen = counts.select(*keys, value, F.sum("__ties").over(w.orderBy(value)).alias("__upto"), F.sum("__ties").over(w).alias("__n"))
    at = lambda place: F.min(F.when(F.col("__upto") > place, F.col(value)))
    middle = (F.col("__n") - 1) / 2
    return seen.groupBy(*keys).agg(((at(F.floor(middle)) + at(F.ceil(middle))) / 2).alias(name))


def _timing(inside: DataFrame, keys: Sequence[str], time: str, bucket_ns: int) -> DataFrame:
    """(keys, *TIMING) of rows with start_ns and end_ns of their window."""
    rows = intervals_ms(inside, keys, time, bucket_ns=bucket_ns)
    first, last, n = F.min(time), F.max(time), F.count(time)
    span = last - first
    i, mean = F.col("interval_ms"), F.avg("interval_ms")
    found = rows.groupBy(*keys).agg(
        n.alias("message_count"),
        first.alias("first_message_timestamp_ns"),
        last.alias("last_message_timestamp_ns"),
        F.coalesce(span / F.lit(float(NS)), F.lit(0.0)).alias("observed_topic_span_s"),
        F.coalesce(F.least(span / (F.max("end_ns") - F.max("start_ns")), F.lit(1.0)), F.lit(0.0)).alias("episode_coverage_ratio"),
        F.when(span > 0, (n - 1) / (span / F.lit(float(NS)))).alias("observed_hz"),
        F.when(mean > 0, F.stddev_pop(i) / mean).alias("topic_interval_cv"),
        F.max(i).alias("max_topic_interval_ms"),
    )
    median = F.col("median_topic_interval_ms")
    out = found.join(_medians(rows, keys, "interval_ms", "median_topic_interval_ms"), list(keys), "left")
    return out.withColumn("max_interval_over_median", F.when(median > 0, F.col("max_topic_interval_ms") / median)).select(*keys, *TIMING)


def topic_metrics(long: DataFrame, windows: DataFrame, by: Sequence[str], required: Sequence[str] = (), topic: str = "topic", time: str = TIMESTAMP, bucket_ns: int = BUCKET_NS) -> DataFrame:
    """Timing figures of each topic within its recording's window (by, start_ns, end_ns).

    Topics that the windows don't reach, and required ones that don't exist, have a count of 0,
    coverage and span 0, and nulls otherwise.
    """
    topics = long.select(*by, topic).distinct()
    if required:
        asked = windows.select(*by).distinct().withColumn(topic, F.explode(F.array(*map(F.lit, required))))
        topics = topics.unionByName(asked).distinct()
    limits = windows.select(*by, "start_ns", "end_ns")
    bad = F.raise_error(F.lit("a window must end after it starts"))
    limits = limits.withColumn("end_ns", F.when(F.col("end_ns") <= F.col("start_ns"), bad).otherwise(F.col("end_ns")))
    slim = long.select(*by, topic, time)
    inside = (slim.join(limits, list(by)) if by else slim.crossJoin(limits)).where(F.col(time).between(F.col("start_ns"), F.col("end_ns")))
    out = topics.join(_timing(inside, [*by, topic], time, bucket_ns), [*by, topic], "left")
    out = out.fillna({"message_count": 0, "observed_topic_span_s": 0.0, "episode_coverage_ratio": 0.0})
    return out.withColumn("is_required_topic", F.col(topic).isin(*required) if required else F.lit(False))


def segment_metrics(long: DataFrame, segments: DataFrame, by: Sequence[str], required: Sequence[str], topic: str = "topic", time: str = TIMESTAMP, bucket_ns: int = BUCKET_NS) -> DataFrame:
    """Each segment's worst figures over the required topics.

    segments has by, segment_index, segment_label, segment_success, start_s, end_s. Seconds are
    rounded half away from zero to nanoseconds. Segments are few beside messages, but their
    number is not bounded: they meet messages by recording, and the join is left to the planner.
    """
    if not required:
        raise TransformError("segment metrics need required topics")
    keys = [*by, "segment_index"]
    wrong = F.raise_error(F.lit("a segment must end after it starts"))
    s = segments.withColumn("start_ns", seconds_to_ns(F.col("start_s"))).withColumn("end_ns", F.when(F.col("end_s") <= F.col("start_s"), wrong).otherwise(seconds_to_ns(F.col("end_s"))))
    asked = s.select(*keys, "start_ns", "end_ns", F.explode(F.array(*map(F.lit, required))).alias(topic))
    mine = long.where(F.col(topic).isin(*required)).select(*by, topic, time)
    inside = mine.join(asked, [*by, topic]).where(F.col(time).between(F.col("start_ns"), F.col("end_ns")))
    timing = _timing(inside, [*keys, topic], time, bucket_ns)
    each = asked.select(*keys, topic).join(timing, [*keys, topic], "left")
    worst = each.groupBy(*keys).agg(
        F.bool_and(F.coalesce(F.col("message_count"), F.lit(0)) > 0).alias("has_all_required_topics"),
        F.min(F.coalesce("episode_coverage_ratio", F.lit(0.0))).alias("minimum_required_segment_coverage_ratio"),
        F.max("max_topic_interval_ms").alias("worst_topic_max_interval_ms"),
        F.max("max_interval_over_median").alias("worst_topic_max_interval_over_median"),
    )
    about = segments.select(*keys, "segment_label", "segment_success", (F.col("end_s") - F.col("start_s")).alias("segment_duration_s"))
    return about.join(worst, keys)


def episode_metrics(topics: DataFrame, episodes: DataFrame, by: Sequence[str], n_required: int | None = None) -> DataFrame:
    """Each recording's worst figures over its required topics.

    topics is topic_metrics' result; episodes has by, episode_label, episode_success, start_s,
    end_s. Fewer required rows than n_required count as missing topics, with coverage 0; without
    any required topic the coverage is null.
    """
    need = F.col("is_required_topic")
    want = F.lit(n_required) if n_required is not None else F.count_if(need)
    agg = topics.groupBy(*by).agg(
        want.alias("__want"),
        F.count_if(need).alias("__have"),
        F.coalesce(F.bool_and(F.when(need, F.col("message_count") > 0)), F.lit(True)).alias("__all"),
        F.min(F.when(need, F.col("episode_coverage_ratio"))).alias("__cover"),
        F.max(F.when(need, F.col("max_topic_interval_ms"))).alias("worst_topic_max_interval_ms"),
        F.max(F.when(need, F.col("max_interval_over_median"))).alias("worst_topic_max_interval_over_median"),
        F.max(F.when(need, F.col("topic_interval_cv"))).alias("worst_topic_interval_cv"),
    )
    backwards = F.raise_error(F.lit("an episode must not end before it starts"))
    duration = F.when(F.col("end_s") < F.col("start_s"), backwards).otherwise(F.col("end_s") - F.col("start_s"))
    cover = F.when(F.col("__want") == 0, None).when(F.col("__have") < F.col("__want"), F.lit(0.0)).otherwise(F.col("__cover"))
    joined = episodes.join(agg, list(by)) if by else episodes.crossJoin(agg)
    return joined.select(
        *by, "episode_label", F.coalesce("episode_success", F.lit(False)).alias("episode_success"), duration.alias("episode_duration_s"),
        ((F.col("__have") >= F.col("__want")) & F.col("__all")).alias("has_all_required_topics"), cover.alias("minimum_required_episode_coverage_ratio"),
        "worst_topic_max_interval_ms", "worst_topic_max_interval_over_median", "worst_topic_interval_cv",
    )


def percentile_rank(df: DataFrame, value: str, by: Sequence[str], name: str, size: str | None = None) -> DataFrame:
    """name: the mean rank position of a value among its group, from 0 to 1; 0.5 if alone.

    Ranks come from counts per distinct value, so a hot group is aggregated before it is sorted.
    """
    keys = [*by, value]
    counts = df.groupBy(*keys).agg(F.count("*").alias("__ties"))
    w = Window.partitionBy(*by)
    below = F.coalesce(F.sum("__ties").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("__ties").over(w)
    ranked = counts.select(*(F.col(k).alias(f"__k_{k}") for k in keys), n.alias("__n"), F.when(n == 1, 0.5).otherwise((below + (F.col("__ties") - 1) / 2) / (n - 1)).alias(name))
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(ranked[f"__k_{k}"])
    out = df.join(ranked, same)
    return out.select(*df.columns, *([F.col("__n").alias(size)] if size else []), name)
