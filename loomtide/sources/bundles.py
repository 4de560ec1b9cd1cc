"""Bundles: one Parquet table for each topic and the system tables, read and written by Spark."""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtide.functions.naming import file_stem, file_stem_of
from loomtide.model import UUID, IngestError, Recording
from loomtide.sources import metadata

# Names of the system tables.
METADATA, TOPIC_TYPES, REGISTRY = "_metadata", "_topic_type_map", "_video_registry"
#: Payloads as they came, by topic: an extension of the format, which has videos in their place.
PAYLOADS = "_payloads"


def _plain_integers(df: DataFrame) -> DataFrame:
    """Unsigned 64-bit columns, which Parquet gives as decimals, as longs."""
    return df.select(*(F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0 and f.dataType.precision >= 19 else F.col(f"`{f.name}`") for f in df.schema.fields))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return _plain_integers(spark.read.parquet(path))


def _optional(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def read_bundle(spark: SparkSession, root: str, uuid: str | None = None) -> Recording:
    """A bundle as a Recording. A topic that the type map has twice is an error."""
    base = f"{root.rstrip('/')}/parquet"
    types = spark.read.parquet(f"{base}/{TOPIC_TYPES}.parquet").collect()  # as many rows as topics
    names = [r["topic"] for r in types]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise IngestError(f"topics that occur twice in the type map: {twice}")
    tables = {n: read_table(spark, f"{base}/{file_stem_of(n)}.parquet") for n in names}
    if uuid:
        tables = {n: df.withColumn(UUID, F.lit(uuid)) for n, df in tables.items()}
    payloads, registry = (_optional(spark, f"{base}/{name}.parquet") for name in (PAYLOADS, REGISTRY))
    meta = metadata.from_frame(spark.read.parquet(f"{base}/{METADATA}.parquet"))
    return Recording(tables, payloads and payloads.drop("of"), registry, meta, None, {r["topic"]: r["type"] for r in types})


def write_bundle(spark: SparkSession, recording: Recording, root: str, single_file: bool = False) -> None:
    """Writes a Recording as a bundle; single_file gives each topic one part file."""
    base = f"{root.rstrip('/')}/parquet"
    for topic, df in recording.tables.items():
        out = df.coalesce(1) if single_file else df
        out.write.mode("overwrite").parquet(f"{base}/{file_stem_of(topic)}.parquet")
    rows = [(t, recording.topic_types.get(t, "")) for t in sorted(recording.tables)]
    spark.createDataFrame(rows, "topic string, type string").coalesce(1).write.mode("overwrite").parquet(f"{base}/{TOPIC_TYPES}.parquet")
    if recording.metadata is not None:
        metadata.to_frame(spark, [recording.metadata]).coalesce(1).write.mode("overwrite").parquet(f"{base}/{METADATA}.parquet")
    if recording.payloads is not None:
        by_topic = recording.payloads.withColumn("of", file_stem(F.col("topic")))
        by_topic.write.mode("overwrite").partitionBy("of").parquet(f"{base}/{PAYLOADS}.parquet")
    if recording.registry is not None:
        recording.registry.write.mode("overwrite").parquet(f"{base}/{REGISTRY}.parquet")


def load_tables(spark: SparkSession, root: str, skip_unreadable: bool = False) -> dict[str, DataFrame]:
    """Every Parquet file or directory below root, keyed by /its path without the suffix."""
    out = {}
    for at, dirs, names in os.walk(root):
        for n in sorted([d for d in dirs if d.endswith(".parquet")] + [f for f in names if f.endswith(".parquet") and not at.endswith(".parquet")]):
            path = os.path.join(at, n)
            try:
                df = read_table(spark, path)
                if skip_unreadable:
                    df.limit(1).count()
            except Exception:
                if not skip_unreadable:
                    raise
                continue
            out["/" + os.path.relpath(path, root)[: -len(".parquet")]] = df
        dirs[:] = [d for d in dirs if not d.endswith(".parquet")]
    return out


def dump_tables(recording: Recording, root: str) -> None:
    """Each topic at its own nested path below root."""
    for topic, df in recording.tables.items():
        df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{topic.lstrip('/')}.parquet")


def from_tables(spark: SparkSession, tables: Mapping[str, pa.Table], meta: Any = None) -> Recording:
    """A Recording from Arrow tables."""
    return Recording({t: _plain_integers(spark.createDataFrame(a)) for t, a in tables.items()}, metadata=meta)


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped and a missing file is empty."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ddl)
    return lines.where(F.trim("value") != "").select(F.from_json("value", ddl, {"mode": "FAILFAST"}).alias("r")).select("r.*")
