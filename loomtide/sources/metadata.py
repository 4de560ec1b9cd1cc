"""Recording metadata: version detection, both versions' schemas, upgrade and validation."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import MISSING, asdict, dataclass, fields, is_dataclass
from typing import Any, get_args, get_origin, get_type_hints

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtide.model import IngestError

# Names and types of metadata version 2.0.
V2_DDL = """`$schema` string, schema_version string, uuid string, robot struct<uri:string,type:string,id:string,checksum:string>,
files array<struct<type:string,name:string,checksum:string>>, environment struct<type:string,site:string,location:string>,
runner struct<type:string,organization:string,name:string>, devices array<struct<role:string,type:string,id:string>>,
programs array<struct<role:string,name:string,source:struct<git:struct<uri:string,hash:string,branch:string,tag:string>>>>,
episode struct<start_time:double,end_time:double,success:boolean,label:string>, labels array<string>,
segments array<struct<start_time:double,end_time:double,label_idx:int,success:boolean>>"""


@dataclass(frozen=True)
class Robot:
    type: str
    id: str
    uri: str | None = None
    checksum: str | None = None


@dataclass(frozen=True)
class File:
    type: str
    name: str
    checksum: str | None = None


@dataclass(frozen=True)
class Environment:
    type: str
    site: str
    location: str = ""


@dataclass(frozen=True)
class Runner:
    type: str
    organization: str
    name: str


@dataclass(frozen=True)
class Device:
    role: str
    type: str
    id: str = ""


@dataclass(frozen=True)
class Git:
    uri: str | None
    hash: str
    branch: str
    tag: str | None = None


@dataclass(frozen=True)
class Source:
    git: Git | None = None


@dataclass(frozen=True)
class Program:
    role: str
    name: str
    source: Source | None = None


@dataclass(frozen=True)
class Episode:
    start_time: float
    end_time: float
    success: bool
    label: str = ""


@dataclass(frozen=True)
class Segment:
    start_time: float
    end_time: float
    label_idx: int
    success: bool


@dataclass(frozen=True)
class Metadata:
    """Version 2.0 metadata as objects; typed makes it of a dict, and plain gives the dict back."""

    uuid: str
    robot: Robot
    files: tuple[File, ...]
    environment: Environment
    runner: Runner
    programs: tuple[Program, ...]
    episode: Episode
    labels: tuple[str, ...]
    devices: tuple[Device, ...] = ()
    segments: tuple[Segment, ...] = ()
    schema_version: str = "2.0"

    def plain(self) -> dict[str, Any]:
        return json.loads(json.dumps(asdict(self)))


def typed(meta: Mapping[str, Any]) -> Metadata:
    """A dict's metadata as objects, after validate; a missing field without a default, or one of another type, is an error."""

    def made(kind: Any, value: Any, at: str) -> Any:
        if get_origin(kind) is tuple:
            return tuple(made(get_args(kind)[0], v, f"{at}[{k}]") for k, v in enumerate(value or ()))
        options = [k for k in (get_args(kind) or (kind,)) if k is not type(None)]
        if value is None and type(None) in get_args(kind):
            return None
        if is_dataclass(options[0]):
            if not isinstance(value, Mapping):
                raise IngestError(f"metadata has no {at}")
            hints = get_type_hints(options[0])
            lost = [f.name for f in fields(options[0]) if f.name not in value and f.default is MISSING]
            if lost:
                raise IngestError(f"metadata lacks {at}.{lost[0]}")
            return options[0](**{f.name: made(hints[f.name], value[f.name], f"{at}.{f.name}") for f in fields(options[0]) if f.name in value})
        if options[0] is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, options[0]):
            raise IngestError(f"metadata's {at} is {value!r}, not of type {options[0].__name__}")
        return value

    return made(Metadata, validate(meta), "metadata")


def detect_version(meta: Mapping[str, Any]) -> str:
    """2 or 1: schema_version beginning with 2. wins, else version beginning with 1."""
    if str(meta.get("schema_version", "")).startswith("2."):
        return "2"
    if str(meta.get("version", "")).startswith("1."):
        return "1"
    raise IngestError("metadata has neither a schema_version 2.x nor a version 1.x")


def version_of(text: Column) -> Column:
    """detect_version over a column of JSON texts; null where there is no known version."""
    new, old = F.get_json_object(text, "$.schema_version"), F.get_json_object(text, "$.version")
    return F.when(new.startswith("2."), "2").when(old.startswith("1."), "1")


def parsed(text: Column) -> Column:
    """Version 2.0 JSON texts as nested rows; null for other texts, which upgrade takes one by one."""
    return F.when(version_of(text) == "2", F.from_json(text, V2_DDL))


def segment_label(meta: Column, index: int) -> Column:
    """The label of a parsed recording's segment; null if there is none."""
    return F.get(meta["labels"], F.get(meta["segments"], F.lit(index))["label_idx"])


def validate(meta: Mapping[str, Any]) -> dict[str, Any]:
    """The metadata as a dict, if programs, files and labels are there and label numbers fit."""
    for part in ("uuid", "programs", "files", "labels", "episode"):
        if not meta.get(part):
            raise IngestError(f"metadata lacks {part}")
    for k, s in enumerate(meta.get("segments") or []):
        if not 0 <= s["label_idx"] < len(meta["labels"]):
            raise IngestError(f"segment {k} has label {s['label_idx']} of {len(meta['labels'])}")
    return dict(meta)


# What older metadata doesn't say and newer metadata must.
ROBOT_TYPE, ENVIRONMENT_TYPE, RUNNER_TYPE = "HSR", "real_world", "operator"
DEVICE_ROLES = ("controller", "joystick", "device")


def _by_role(entities: list[dict], role: str, part: str) -> str:
    return next((e.get(part) or "" for e in entities if e["role"] == role), "")


def _shared_number(instructions: list[dict], whole: list[dict], parts: list[dict]) -> int | None:
    """The one number that two instructions may share: that of the composite segment and of the
    last part alike, where the second of the two instructions ends the list."""
    if not whole or not parts or whole[0]["instruction_idx"] != parts[-1]["instruction_idx"]:
        return None
    number, all_numbers = whole[0]["instruction_idx"], [i["idx"] for i in instructions]
    repeated = {n: all_numbers.count(n) for n in all_numbers if all_numbers.count(n) > 1}
    return number if repeated == {number: 2} and all_numbers[-1] == number else None


def upgrade(old: Mapping[str, Any]) -> dict[str, Any]:
    """Version 1.x metadata as 2.0.

    The first composite segment becomes the episode, the others stay segments. Every instruction's
    first text becomes a label, in order, and segments refer to labels by instruction number.
    """
    run, context = old["run"], old["context"]
    instructions, entities = run.get("instructions", []), context.get("entities", [])
    whole = [s for s in run.get("segments", []) if s.get("is_composite")]
    parts = [s for s in run.get("segments", []) if not s.get("is_composite")]
    shared = _shared_number(instructions, whole, parts)
    labels: list[str] = []
    first: dict[int, int] = {}
    for i in instructions:
        if i["idx"] in first and i["idx"] != shared:
            raise IngestError(f"instruction number {i['idx']} occurs twice")
        if not i["text"]:
            raise IngestError(f"instruction {i['idx']} has no text")
        first.setdefault(i["idx"], len(labels))
        labels.append(i["text"][0])

    def label_of(segment: dict) -> int:
        if segment["instruction_idx"] not in first:
            raise IngestError(f"a segment refers to instruction {segment['instruction_idx']}, which doesn't exist")
        return first[segment["instruction_idx"]]

    if whole:
        at = len(labels) - 1 if whole[0]["instruction_idx"] == shared else label_of(whole[0])
        episode = {"start_time": whole[0]["start_time"], "end_time": whole[0]["end_time"], "success": whole[0]["success"], "label": labels[at]}
    else:
        episode = {"start_time": parts[0]["start_time"] if parts else 0.0, "end_time": parts[-1]["end_time"] if parts else 0.0, "success": bool(parts) and all(s["success"] for s in parts), "label": run.get("episode_label", "")}
    git = lambda g: {"uri": g.get("uri"), "hash": g.get("hash"), "branch": g.get("branch"), "tag": None}
    return {
        "$schema": None,
        "schema_version": "2.0",
        "uuid": old["uuid"],
        "robot": {"uri": None, "type": ROBOT_TYPE, "id": _by_role(entities, "robot", "id"), "checksum": None},
        "files": [{"type": f["type"], "name": f["name"], "checksum": None} for f in old.get("files", [])],
        "environment": {"type": ENVIRONMENT_TYPE, "site": _by_role(entities, "location", "name"), "location": ""},
        "runner": {"type": RUNNER_TYPE, "organization": _by_role(entities, "organization", "name"), "name": _by_role(entities, "operator", "name")},
        "devices": [{"role": e["role"], "type": e.get("name") or e["role"], "id": e.get("id") or ""} for e in entities if e["role"] in DEVICE_ROLES],
        "programs": [{"role": c["role"], "name": c["name"], "source": {"git": git(c["source"]["git"]) if c.get("source", {}).get("git") else None}} for c in context.get("components", [])],
        "episode": episode,
        "labels": labels,
        "segments": [{"start_time": s["start_time"], "end_time": s["end_time"], "label_idx": label_of(s), "success": s["success"]} for s in parts],
    }


def parse(text: str) -> dict[str, Any]:
    """Version 2.0 metadata from either version's JSON."""
    meta = json.loads(text)
    return dict(meta) if detect_version(meta) == "2" else upgrade(meta)


def to_frame(spark: SparkSession, metas: list[Mapping[str, Any]]) -> DataFrame:
    """One nested row for each recording."""
    kind = T._parse_datatype_string(V2_DDL)
    return spark.createDataFrame([_row(kind, m) for m in metas], kind)


def _row(kind: T.DataType, value: Any) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_row(f.dataType, value.get(f.name)) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_row(kind.elementType, v) for v in value]
    return float(value) if isinstance(kind, T.DoubleType) else value


def from_frame(df: DataFrame) -> dict[str, Any]:
    """The metadata of a table that must have exactly one row."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise IngestError(f"a metadata table has one row, not {'several' if rows else 'none'}")
    return rows[0].asDict(recursive=True)


def segments_frame(spark: SparkSession, meta: Mapping[str, Any]) -> DataFrame:
    """(rosbag_uuid, segment_index, segment_label, segment_success, start_s, end_s, label_idx)."""
    rows = [(meta["uuid"], k, meta["labels"][s["label_idx"]], bool(s["success"]), float(s["start_time"]), float(s["end_time"]), int(s["label_idx"])) for k, s in enumerate(meta.get("segments") or [])]
    return spark.createDataFrame(rows, "rosbag_uuid string, segment_index int, segment_label string, segment_success boolean, start_s double, end_s double, label_idx int")
