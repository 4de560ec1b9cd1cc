"""Holding the last row over a stream: an extension, as recordings themselves are batches.

Rows of a stream update the state of their key; each micro-batch emits, for every new row, the
time since the row before and whether its value changed. State is one row for each key, and ends
when the stream's watermark is a while past the key's last row; its next row then counts as a first one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, timestamp_ns long, value double, gap_ns long, is_fresh boolean"
STATE = "timestamp_ns long, value double"


def held(stream: DataFrame, key: str = "key", time: str = "timestamp_ns", value: str = "value", silence_ms: int = 86_400_000, late: str = "1 hour") -> DataFrame:
    """(key, timestamp_ns, value, gap_ns, is_fresh); late rows, older than their key's state, are dropped."""

    def update(keys: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("timestamp_ns", kind="stable")
        out = []
        for t, v in zip(rows["timestamp_ns"].tolist(), rows["value"].tolist(), strict=True):
            if last[0] is not None and t < last[0]:
                continue
            out.append((keys[0], t, v, None if last[0] is None else t - last[0], last[0] is None or v != last[1]))
            last = (t, v)
        if out:
            state.update(last)
            state.setTimeoutTimestamp(max(last[0] // 1_000_000 + silence_ms, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["key", "timestamp_ns", "value", "gap_ns", "is_fresh"])
        frame["gap_ns"] = frame["gap_ns"].astype("Int64")
        yield frame

    slim = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("long").alias("timestamp_ns"), F.col(value).cast("double").alias("value"))
    slim = slim.withColumn("event_time", F.timestamp_millis(F.call_function("div", F.col("timestamp_ns"), F.lit(1_000_000)))).withWatermark("event_time", late)
    return slim.groupBy("key").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_rates(stream: DataFrame, time: str = "ts", key: str = "topic", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, n): messages per tumbling window, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
