"""Recording files as DataFrames, through a Python data source with one task for each file.

spark.read.format("recording").option("paths", ...) gives raw messages; mode=topics gives each
file's topics with their definitions, which are few. ingest decodes a set of files into one table
for each topic, and payloads of images and point clouds apart from them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from loomtide.functions.naming import payload_format, route
from loomtide.model import INDEX, PUBLISHED, TIMESTAMP, UUID, IngestError, Recording
from loomtide.operators.payload import indexed
from loomtide.sources import containers, metadata
from loomtide.sources.messages import Cursor, bytes_reader, message_reader
from loomtide.sources.schema_text import Definitions, externalized, parse_definitions, topic_schema

MESSAGES = "rosbag_uuid string, path string, topic string, type string, encoding string, log_time long, publish_time long, seq long, data binary"
TOPICS = "rosbag_uuid string, path string, topic string, type string, encoding string, definition string, n_messages long"
_TEXT, _LONG = pa.string(), pa.int64()
_ARROW = {
    MESSAGES: pa.schema([("rosbag_uuid", _TEXT), ("path", _TEXT), ("topic", _TEXT), ("type", _TEXT), ("encoding", _TEXT), ("log_time", _LONG), ("publish_time", _LONG), ("seq", _LONG), ("data", pa.binary())]),
    TOPICS: pa.schema([("rosbag_uuid", _TEXT), ("path", _TEXT), ("topic", _TEXT), ("type", _TEXT), ("encoding", _TEXT), ("definition", _TEXT), ("n_messages", _LONG)]),
}
#: Messages, or bytes of them, of one Arrow batch.
ROWS, BYTES = 4096, 16 << 20


def open_input(path: str):
    """A local file, or any store that pyarrow knows by the path's scheme."""
    if "://" not in path:
        return open(path, "rb")  # noqa: SIM115
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def messages_of(path: str) -> Iterator[containers.Message]:
    with open_input(path) as f:
        yield from (containers.read_bag if path.endswith(".bag") else containers.read_mcap)(f)


def sidecar(path: str) -> dict | None:
    """meta.json beside a recording, as version 2.0; None without one."""
    try:
        with open_input(f"{os.path.dirname(path)}/meta.json") as f:
            return metadata.parse(f.read().decode())
    except FileNotFoundError:
        return None


def uuid_of(path: str) -> str:
    meta = sidecar(path)
    return (meta or {}).get("uuid") or os.path.splitext(os.path.basename(path))[0]


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.paths = json.loads(options["paths"])
        self.topics = set(json.loads(options["topics"])) if options.get("topics") else None
        self.catalog = options.get("mode") == "topics"

    def partitions(self) -> Sequence[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        uuid = uuid_of(partition.path)
        if self.catalog:
            seen: dict[str, list] = {}
            for m in messages_of(partition.path):
                seen.setdefault(m.topic, [uuid, partition.path, m.topic, m.type, m.encoding, m.definition, 0])[-1] += 1
            yield _batch(list(seen.values()), TOPICS)
            return
        rows, size = [], 0
        for k, m in enumerate(messages_of(partition.path)):
            if self.topics is not None and m.topic not in self.topics:
                continue
            rows.append((uuid, partition.path, m.topic, m.type, m.encoding, m.log_time, m.publish_time, k, m.data))
            size += len(m.data)
            if len(rows) >= ROWS or size >= BYTES:
                yield _batch(rows, MESSAGES)
                rows, size = [], 0
        if rows:
            yield _batch(rows, MESSAGES)


def _batch(rows: list, ddl: str) -> pa.RecordBatch:
    schema = _ARROW[ddl]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class RecordingSource(DataSource):
    """format("recording"): options paths (JSON list), topics (JSON list), mode (messages or topics)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return TOPICS if self.options.get("mode") == "topics" else MESSAGES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


def raw_messages(spark: SparkSession, paths: Sequence[str], topics: Sequence[str] | None = None) -> DataFrame:
    spark.dataSource.register(RecordingSource)
    reader = spark.read.format("recording").option("paths", json.dumps(list(paths)))
    return (reader.option("topics", json.dumps(list(topics))) if topics is not None else reader).load()


def topic_catalog(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    spark.dataSource.register(RecordingSource)
    return spark.read.format("recording").option("paths", json.dumps(list(paths))).option("mode", "topics").load()


def decoded(raw: DataFrame, defs: Definitions, apart: bool = False) -> DataFrame:
    """Messages of one topic as its table, with rosbag_uuid and seq; apart keeps the data bytes as __bytes."""
    shown = externalized(defs) if apart else defs
    fields = [f for f in topic_schema(shown).fields if not (apart and f.name == INDEX)]
    kind = T.StructType([T.StructField(UUID, T.StringType()), T.StructField("seq", T.LongType()), *fields, *([T.StructField("__bytes", T.BinaryType())] if apart else [])])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = bytes_reader(defs) if apart else message_reader(defs)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                got = read(Cursor(r["data"], "ros1" if r["encoding"] == "ros1" else "cdr"))
                values, extra = got if apart else (got, None)
                row = {UUID: r["rosbag_uuid"], "seq": r["seq"], TIMESTAMP: r["log_time"], PUBLISHED: r["publish_time"], **values}
                rows.append({**row, "__bytes": extra} if apart else row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return raw.mapInArrow(run, kind)


def ingest(spark: SparkSession, paths: Sequence[str], require_metadata: bool = False, staging: str | None = None) -> Recording:
    """All topics of the files as one Recording.

    A topic must have one definition over all files. With staging, a shared folder, messages are
    first written there by topic, so that each file is read once rather than once for each topic.
    """
    if require_metadata and (bare := [p for p in paths if sidecar(p) is None]):
        raise IngestError(f"recordings without meta.json: {bare}")
    about = topic_catalog(spark, paths).select("topic", "type", "definition").distinct()
    about = about.withColumn("route", route(F.col("topic"), F.col("type"))).collect()  # as many as topics
    kinds: dict[str, tuple[str, str, str]] = {}
    for r in about:
        if kinds.setdefault(r["topic"], (r["type"], r["definition"], r["route"]))[:2] != (r["type"], r["definition"]):
            raise IngestError(f"topic {r['topic']!r} has several definitions")
    if staging:
        raw_messages(spark, paths).write.mode("overwrite").partitionBy("topic").parquet(staging)
    tables, payloads = {}, []
    for topic, (type_name, text, way) in sorted(kinds.items()):
        defs = parse_definitions(type_name, text)
        raw = spark.read.parquet(staging).where(F.col("topic") == topic) if staging else raw_messages(spark, paths, [topic])
        apart = way != "plain" and externalized(defs) != defs and not (way == "image" and any(p.endswith(".bag") for p in paths))
        df = decoded(raw, defs, apart)
        if apart:
            # Messages are numbered before they are decoded, and without their bytes.
            slim = raw.select(UUID, F.col("log_time").alias(TIMESTAMP), "seq")
            df = df.join(indexed(slim, [UUID], [TIMESTAMP, "seq"]), [UUID, TIMESTAMP, "seq"])
            form = F.col("format") if "format" in df.columns else F.col("encoding") if "encoding" in df.columns else F.lit("")
            payloads.append(df.select(UUID, F.lit(topic).alias("topic"), INDEX, payload_format(form).alias("extension"), form.alias("ros_format"), F.col("__bytes").alias("bytes")))
            df = df.drop("__bytes")
        tables[topic] = df.drop("seq")
    metas = [m for p in paths if (m := sidecar(p))]
    return Recording(tables, reduce(DataFrame.unionByName, payloads) if payloads else None, None, metas[0] if len(metas) == 1 else metas or None, None, {t: k for t, (k, _, _) in kinds.items()})
