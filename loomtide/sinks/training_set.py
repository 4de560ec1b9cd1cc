"""Training data sets: one Parquet file for each episode, and JSON beside them.

Frames are assembled, annotated and numbered as one plan. Episodes are written by one task each
under their fixed file names, as whole files that a repeated task writes again. What reaches the
driver is one row for each episode and one for each task.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomtide.model import SYNCED, UUID, Recording, TransformError
from loomtide.operators import episodes as ep
from loomtide.operators import stats
from loomtide.operators.checkpoints import checkpointed
from loomtide.operators.merge import check_compatible, global_tasks, remapped, renumbered, task_map
from loomtide.sources import metadata

# Fixed values of the format: version, chunk size, path templates and standard columns.
VERSION, CHUNK = "v2.1", 1000
DATA_PATH = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
VIDEO_PATH = "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4"
STANDARD = ("index", "frame_index", "episode_index", "timestamp", "next.done", "task_index", "short_horizon_task_index", "primitive_action_index", "success_primitive_action")
TASK_COLUMNS = ("task_index", "short_horizon_task_index", "primitive_action_index")
_NAMES = {T.FloatType: "float32", T.DoubleType: "float64", T.LongType: "int64", T.IntegerType: "int32", T.ShortType: "int16", T.ByteType: "int8", T.BooleanType: "bool", T.StringType: "string"}


def program(meta: Mapping[str, Any], *roles: str) -> dict[str, Any]:
    found = next((p for p in meta["programs"] if p["role"] in roles), None)
    if found is None or not (found.get("source") or {}).get("git"):
        raise TransformError(f"metadata names no program with a source for {' or '.join(roles)}")
    return found


def episode_record(meta: Mapping[str, Any], tasks: Sequence[str], index: int, length: int, success: bool, segment: int | None = None, label: str = "", task_type: str | None = None) -> dict[str, Any]:
    """One line of episodes.jsonl: the whole recording, or one primitive action's segment."""
    interface, collection = program(meta, "interface", "teleoperation"), program(meta, "data_collection", "data_capture")
    bag = next((f["name"] for f in meta["files"] if f["type"] in ("rosbag", "rosbag2", "mcap")), None)
    if bag is None:
        raise TransformError("metadata names no recording file")
    if segment is not None:
        actions, whole = [meta["labels"][meta["segments"][segment]["label_idx"]]], list(tasks[-1:]) if len(tasks) > 1 else []
    elif meta["episode"].get("label"):
        actions, whole = list(meta["labels"]), [meta["episode"]["label"]]
    elif len(tasks) > 1:
        actions, whole = list(tasks[:-1]), [tasks[-1]]
    elif tasks:
        actions, whole = [tasks[0]], []
    else:
        raise TransformError("an episode needs at least one task")
    git, inner = collection["source"]["git"], interface["source"]["git"]
    return {
        "episode_index": index,
        "episode_id": meta["uuid"] if segment is None else f"{meta['uuid']}:{segment}",
        "tasks": actions,
        "length": length,
        "bag_path": bag,
        "version": "1.0",
        "location_name": meta["environment"]["site"],
        "interface": interface["name"],
        "git_hash": git["hash"],
        "git_branch": git["branch"],
        "interface_git_hash": inner["hash"],
        "interface_git_branch": inner["branch"],
        "pipeline_git_hash": "",
        "pipeline_git_branch": "",
        "label": label,
        "hsr_id": meta["robot"]["id"],
        "task_type": task_type or ("SHT" if segment is None else "PA"),
        "task_success": success,
        "short_horizon_task": whole,
        "primitive_action": actions,
        "success_short_horizon_task": success,
        "uuid": meta["uuid"],
        "metadata": dict(meta),
    }


def feature_of(df: DataFrame, name: str, feature: ep.Feature | None = None) -> dict[str, Any]:
    """dtype, shape (of the first list, else 1), names and description of a column."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        first = df.where(F.col(f"`{name}`").isNotNull()).select(F.size(f"`{name}`").alias("n")).first()
        shape, kind = [first["n"] if first else 0], kind.elementType
    else:
        shape = [1]
    if type(kind) not in _NAMES:
        raise TransformError(f"feature {name!r} has the unsupported type {kind.simpleString()}")
    out: dict[str, Any] = {"dtype": _NAMES[type(kind)], "shape": shape, "names": list(feature.names) if feature and feature.names else None}
    return out | ({"description": feature.description} if feature and feature.description else {})


def _tasks(metas: Sequence[Mapping[str, Any]]) -> dict[str, int]:
    """Label -> task index by first occurrence over the recordings, each one's episode label after its labels."""
    out: dict[str, int] = {}
    for meta in metas:
        for label in ep.registered_tasks(meta["labels"], meta["episode"].get("label") or ""):
            out.setdefault(label, len(out))
    return out


def _segments(spark: SparkSession, metas: Sequence[Mapping[str, Any]], tasks: Mapping[str, int]) -> DataFrame:
    """All recordings' segments with their task's number and that of their whole recording (-1 without)."""
    labels = spark.createDataFrame(list(tasks.items()), "segment_label string, __task long")  # one row a label
    wholes = spark.createDataFrame([(m["uuid"], tasks.get(m["episode"].get("label") or "", -1)) for m in metas], f"{UUID} string, __whole long")
    rows = reduce(DataFrame.unionByName, (metadata.segments_frame(spark, m) for m in metas))
    return rows.join(labels, "segment_label").join(wholes, UUID)


def frames(spark: SparkSession, recording: Recording, metas: Sequence[Mapping[str, Any]], features: Sequence[ep.Feature], per_segment: bool, spacing_s: float) -> DataFrame:
    """All episodes' frames with features, annotations and axes; several recordings are told apart by rosbag_uuid."""
    by = [UUID] if len(metas) > 1 else []
    segments = _segments(spark, metas, _tasks(metas))
    parts = ep.projected(recording.tables, features, by)
    segments = ep.overlapping(segments if by else segments.drop(UUID), ep.synced_range(parts, by), by)
    joined = ep.assembled(parts, segments, by)
    marked = ep.annotated(joined, [*by, "segment_index"], [SYNCED], F.col("__task"), F.col("segment_success"), F.col("__whole"))
    if per_segment:
        out = ep.numbered(marked, [*by, "segment_index"], [SYNCED], [*by, "segment_index"], spacing_s)
    elif by:  # a recording is an episode: its frames in segment order
        out = ep.numbered(marked, by, ["segment_index", SYNCED], by, spacing_s)
    else:
        out = ep.axes(marked, [], ["segment_index", SYNCED], spacing_s)
    return stats.structs_to_lists(out.drop("start_s", "end_s", "label_idx", "segment_label", "segment_success", "__task", "__whole", SYNCED))


def is_hidden(column: str) -> bool:
    """Whether a column of frames has no place in the files."""
    return column in ("segment_index", UUID) or column.startswith("image_index_")


def spacing(recording: Recording, metas: Sequence[Mapping[str, Any]], features: Sequence[ep.Feature]) -> tuple[float, int]:
    """(seconds between frames, frames a second), which all recordings must share."""
    by = [UUID] if len(metas) > 1 else []
    parts = ep.projected(recording.tables, features, by)
    times = reduce(DataFrame.unionByName, (p.select(*by, SYNCED) for p in parts.values()))
    found = ep.frame_spacing(times, by).select("spacing_s", "fps").distinct().limit(2).collect()
    if not found:
        raise TransformError("fewer than two synced times: there is no frame spacing")
    if len(found) > 1:
        raise TransformError("the recordings differ in their frame spacing")
    return found[0]["spacing_s"], found[0]["fps"]


def write_episodes(df: DataFrame, out_dir: str, chunk: int = CHUNK) -> list[dict[str, int]]:
    """Writes data/chunk-CCC/episode_NNNNNN.parquet into a shared folder: (episode_index, length) of each.

    A task streams its episodes' rows in order and holds one batch at a time.
    """
    names = df.columns  # with dots, which only plain names in the plan can carry
    schema = to_arrow_schema(df.select(*(F.col(f"`{c}`") for c in names if not is_hidden(c))).schema)
    at_episode, at_frame = (f"c{names.index(c)}" for c in ("episode_index", "frame_index"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, at, rows, path = None, None, 0, ""

        def done() -> pa.RecordBatch:
            writer.close()
            os.replace(path + ".part", path)
            return pa.RecordBatch.from_pydict({"episode_index": [at], "length": [rows]})

        for plain in batches:
            batch = pa.RecordBatch.from_arrays(plain.columns, names=names)
            own = batch.column("episode_index").to_numpy(zero_copy_only=False)
            cuts = [0, *((own[1:] != own[:-1]).nonzero()[0] + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if own[a] != at:
                    if writer:
                        yield done()
                    at, rows = int(own[a]), 0
                    path = f"{out_dir}/{DATA_PATH.format(episode_chunk=at // chunk, episode_index=at)}"
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    writer = pq.ParquetWriter(path + ".part", schema)
                part = pa.Table.from_batches([batch.slice(a, b - a)]).select(schema.names)
                writer.write_table(part.cast(schema))
                rows += b - a
        if writer:
            yield done()

    dealt = df.toDF(*(f"c{k}" for k in range(len(names)))).repartition(at_episode).sortWithinPartitions(at_episode, at_frame)
    found = dealt.mapInArrow(run, "episode_index long, length long").collect()  # one row an episode
    return sorted((r.asDict() for r in found), key=lambda r: r["episode_index"])


def episode_stats(df: DataFrame) -> dict[int, dict[str, Any]]:
    """Statistics of every numeric column of every episode, by episode_index: one row each reaches the driver."""
    out: dict[int, dict[str, Any]] = {}
    for f in df.schema.fields:
        if is_hidden(f.name):
            continue
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.NumericType, T.BooleanType)):
            table = stats.list_stats(df.withColumn("__v", F.col(f"`{f.name}`")), "__v", ["episode_index"])
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            keyed = df.select(F.col("episode_index").alias("__e"), F.col(f"`{f.name}`").alias("__v"))
            table = stats.scalar_stats(keyed, "__v", ["__e"]).withColumnRenamed("__e", "episode_index")
        else:
            continue
        for r in table.collect():
            values = {s: r[s] if isinstance(r[s], list) else [r[s]] for s in stats.STATS}
            values["count"] = values["count"][:1]
            out.setdefault(r["episode_index"], {})[f.name] = values
    return out


def _lines(path: str, rows: Sequence[Mapping[str, Any]]) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


def info(n_episodes: int, n_frames: int, n_tasks: int, n_videos: int, fps: int, features: Mapping[str, Any], robot: str = "") -> dict[str, Any]:
    return {
        "codebase_version": VERSION,
        "robot_type": robot,
        "total_episodes": n_episodes,
        "total_frames": n_frames,
        "total_tasks": n_tasks,
        "total_videos": n_videos,
        "total_chunks": -(-n_episodes // CHUNK),
        "chunks_size": CHUNK,
        "fps": fps,
        "splits": {"train": f"0:{n_episodes}"},
        "data_path": DATA_PATH,
        "video_path": VIDEO_PATH,
        "features": dict(features),
    }


def write_training_set(spark: SparkSession, recording: Recording, features: Sequence[ep.Feature], out_dir: str, per_segment: bool = False) -> dict[str, Any]:
    """Episodes and metadata of one recording or, with a list of metadata, of several; gives info.json's content."""
    given = recording.metadata if isinstance(recording.metadata, list) else [recording.metadata]
    metas = sorted((metadata.validate(m) for m in given), key=lambda m: m["uuid"])
    if len({m["uuid"] for m in metas}) < len(metas):
        raise TransformError("several recordings have one uuid")
    spacing_s, fps = spacing(recording, metas, features)
    # The same rows feed several outputs, so they are written once.
    df = checkpointed(frames(spark, recording, metas, features, per_segment, spacing_s))
    if complaints := ep.length_check(df, features):
        raise TransformError("; ".join(complaints))
    written = write_episodes(df, out_dir)
    all_tasks, of = _tasks(metas), {m["uuid"]: m for m in metas}
    own = df.select("episode_index", F.col(UUID) if UUID in df.columns else F.lit(metas[0]["uuid"]).alias(UUID), F.col("segment_index") if per_segment else F.lit(None).cast("int").alias("segment_index"))
    which = {r["episode_index"]: (of[r[UUID]], r["segment_index"]) for r in own.distinct().collect()}  # one row an episode
    lines = []
    for w in written:
        meta, segment = which[w["episode_index"]]
        names = list(ep.registered_tasks(meta["labels"], meta["episode"].get("label") or ""))
        judged = meta["segments"][-1 if segment is None else segment] if meta["segments"] else {"success": False}
        lines.append(episode_record(meta, names, w["episode_index"], w["length"], bool(judged["success"]), segment))
    _lines(f"{out_dir}/meta/episodes.jsonl", lines)
    _lines(f"{out_dir}/meta/tasks.jsonl", [{"task_index": k, "task": t} for t, k in all_tasks.items()])
    figures = episode_stats(df)
    _lines(f"{out_dir}/meta/episodes_stats.jsonl", [{"episode_index": e["episode_index"], "episode_id": e["episode_id"], "stats": figures.get(e["episode_index"], {})} for e in lines])
    known = {f.name: f for f in features}
    described = {c: feature_of(df, c, known.get(c)) for c in df.columns if not is_hidden(c)}
    about = info(len(lines), sum(e["length"] for e in lines), len(all_tasks), 0, fps, described, metas[0]["robot"].get("type") or "")
    with open(f"{out_dir}/meta/info.json", "w", encoding="utf-8") as f:
        json.dump(about, f, indent=2, ensure_ascii=False)
    return about


def merge_training_sets(spark: SparkSession, roots: Sequence[str], out_dir: str) -> dict[str, Any]:
    """Several data sets as one: episodes, frames and tasks numbered anew, tasks of one label joined."""
    import shutil

    infos = [json.load(open(f"{r}/meta/info.json", encoding="utf-8")) for r in roots]
    check_compatible(infos)
    def lines(root: str, name: str) -> list[dict]:
        path = f"{root}/meta/{name}"
        return [json.loads(x) for x in open(path, encoding="utf-8") if x.strip()] if os.path.exists(path) else []

    tasks = [(k, t["task_index"], t["task"]) for k, r in enumerate(roots) for t in lines(r, "tasks.jsonl")]
    episodes = [(k, e["episode_index"], e["length"]) for k, r in enumerate(roots) for e in lines(r, "episodes.jsonl")]
    task_df = spark.createDataFrame(tasks, "source long, task_index long, task string")
    episode_df = spark.createDataFrame(episodes, "source long, episode_index long, length long")
    mapping, placed = task_map(task_df), renumbered(episode_df)
    place = {(r["source"], r["episode_index"]): r["new_episode_index"] for r in placed.collect()}  # one row an episode
    sets = [spark.read.parquet(*sorted(_data_files(r))).withColumn("source", F.lit(k).cast("long")) for k, r in enumerate(roots)]
    both = reduce(DataFrame.unionByName, sets)
    moved = both.join(placed.select("source", "episode_index", "new_episode_index", "frame_offset"), ["source", "episode_index"])
    moved = moved.withColumn("index", F.col("frame_index") + F.col("frame_offset")).withColumn("episode_index", F.col("new_episode_index")).drop("new_episode_index", "frame_offset")
    moved = remapped(moved, mapping, [c for c in TASK_COLUMNS if c in moved.columns]).drop("source")
    write_episodes(moved, out_dir)
    n_videos = 0
    for k, root in enumerate(roots):
        for at, _, names in os.walk(f"{root}/videos"):
            for n in sorted(x for x in names if x.endswith(".mp4")):
                new = place[k, int(n.removeprefix("episode_").removesuffix(".mp4"))]
                target = f"{out_dir}/{VIDEO_PATH.format(episode_chunk=new // CHUNK, video_key=os.path.basename(at), episode_index=new)}"
                os.makedirs(os.path.dirname(target), exist_ok=True)
                shutil.copyfile(f"{at}/{n}", target)
                n_videos += 1
    for name in ("episodes.jsonl", "episodes_stats.jsonl"):
        rows = [{**e, "episode_index": place[k, e["episode_index"]]} for k, r in enumerate(roots) for e in lines(r, name)]
        _lines(f"{out_dir}/meta/{name}", sorted(rows, key=lambda e: e["episode_index"]))
    labels = sorted((r.asDict() for r in global_tasks(task_df).collect()), key=lambda r: r["global_task_index"])
    _lines(f"{out_dir}/meta/tasks.jsonl", [{"task_index": r["global_task_index"], "task": r["task"]} for r in labels])
    about = info(len(episodes), sum(e[2] for e in episodes), len(labels), n_videos, infos[0]["fps"], infos[0]["features"], infos[0].get("robot_type", ""))
    with open(f"{out_dir}/meta/info.json", "w", encoding="utf-8") as f:
        json.dump(about, f, indent=2, ensure_ascii=False)
    return about


def _data_files(root: str) -> list[str]:
    return [os.path.join(at, n) for at, _, names in os.walk(f"{root}/data") for n in names if n.endswith(".parquet")]
