"""Names, errors and the data set of a recording."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Reserved column names of the on-disk formats.
TIMESTAMP = "timestamp_ns"
PUBLISHED = "publish_timestamp_ns"
SYNCED = "synched_timestamp_ns"
FRESH = "is_fresh"
UUID = "rosbag_uuid"
INDEX = "index"
TIME_COLUMNS = (TIMESTAMP, PUBLISHED, SYNCED)

NS = 1_000_000_000


class RecordingError(Exception):
    """Any failure that this library raises on purpose."""


class IngestError(RecordingError):
    """A source can't be read or decoded."""


class SynchronizeError(RecordingError):
    """Topics can't be brought onto one clock."""


class EnrichError(RecordingError):
    """A derived column can't be made."""


class EncodeError(RecordingError):
    """Media settings are invalid, or no encoder is at hand."""


class DecodeError(RecordingError):
    """Media can't be decoded."""


class TransformError(RecordingError):
    """A training data set can't be assembled."""


@dataclass(frozen=True)
class Recording:
    """One data set: a DataFrame for each topic, and what belongs to it.

    Topics may hold many recordings at once, told apart by rosbag_uuid. payloads holds
    (rosbag_uuid, topic, index, extension, ros_format, bytes) rows, registry the encoded videos.
    """

    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    payloads: DataFrame | None = None
    registry: DataFrame | None = None
    metadata: Any = None
    fps: float | None = None
    topic_types: Mapping[str, str] = field(default_factory=dict)

    def table(self, topic: str) -> DataFrame:
        if topic not in self.tables:
            raise RecordingError(f"topic {topic!r} is missing; there are {sorted(self.tables)}")
        return self.tables[topic]

    def with_tables(self, tables: Mapping[str, DataFrame], **changes: Any) -> Recording:
        return replace(self, tables={**self.tables, **tables}, **changes)

    def topics(self) -> list[str]:
        return sorted(self.tables)

    def message_type(self, topic: str) -> str | None:
        return self.topic_types.get(topic)

    def batches(self, topic: str) -> pa.Table:
        """A topic's rows as an Arrow table on the driver, for tables that are known to fit it."""
        return self.table(topic).toArrow()

    def with_batches(self, topic: str, table: pa.Table, spark: SparkSession) -> Recording:
        return self.with_tables({topic: spark.createDataFrame(table)})

    def mapped(self, change, **changes: Any) -> Recording:
        """Each topic through change(df)."""
        return replace(self, tables={t: change(df) for t, df in self.tables.items()}, **changes)


def keys_of(df: DataFrame) -> list[str]:
    """The columns that tell recordings apart: none in a table of one recording."""
    return [UUID] if UUID in df.columns else []


def seconds_to_ns(seconds: Column, rule: str = "half_up") -> Column:
    """Seconds to nanoseconds: truncate, half_up (away from zero) or half_even."""
    ns = seconds.cast("double") * F.lit(float(NS))
    if rule == "truncate":
        return ns.cast("long")
    return (F.round(ns, 0) if rule == "half_up" else F.rint(ns)).cast("long")
