"""Merging data sets: task de-duplication, renumbering and compatibility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.model import TransformError
from loomtide.operators.ordinals import numbered


def global_tasks(tasks: DataFrame, source: str = "source", index: str = "task_index", task: str = "task") -> DataFrame:
    """(task, global_task_index): labels numbered by where they are first seen, by source and index.

    Labels are aggregated first, then numbered by ranges.
    """
    first = tasks.groupBy(task).agg(F.min(F.struct(source, index)).alias("__first"))
    return numbered(first, ["__first"], "global_task_index").select(task, "global_task_index")


def task_map(tasks: DataFrame, source: str = "source", index: str = "task_index", task: str = "task") -> DataFrame:
    """(source, task_index, global_task_index)."""
    return tasks.join(global_tasks(tasks, source, index, task), task).select(source, index, "global_task_index")


def remapped(df: DataFrame, mapping: DataFrame, columns: Sequence[str], source: str = "source", index: str = "task_index") -> DataFrame:
    """Task columns through the map of their source; negative and unknown numbers stay."""
    for c in columns:
        m = mapping.select(F.col(source).alias("__s"), F.col(index).alias("__i"), F.col("global_task_index").alias("__g"))
        out = df.join(m, (df[source] == m["__s"]) & (df[c] == m["__i"]) & (df[c] >= 0), "left")
        df = out.withColumn(c, F.coalesce("__g", c)).drop("__s", "__i", "__g")
    return df


def renumbered(episodes: DataFrame, order: Sequence[str] = ("source", "episode_index"), length: str = "length") -> DataFrame:
    """episodes (one row each) with new_episode_index and frame_offset, running on over the order."""
    return numbered(episodes, order, "new_episode_index", length, "frame_offset")


def totals(episodes: DataFrame, tasks: DataFrame, n_videos: int, chunk: int = 1000, length: str = "length") -> DataFrame:
    """One row: total_episodes, total_frames, total_tasks, total_videos, total_chunks."""
    e = episodes.agg(F.count("*").alias("total_episodes"), F.coalesce(F.sum(length), F.lit(0)).alias("total_frames"))
    t = tasks.agg(F.count_distinct("task").alias("total_tasks"))
    return e.crossJoin(t).withColumn("total_videos", F.col("total_episodes") * n_videos).withColumn("total_chunks", F.ceil(F.col("total_episodes") / chunk))


def feature_differences(left: DataFrame, right: DataFrame, key: str = "name", fields: Sequence[str] = ("dtype", "shape", "codec", "pix_fmt")) -> DataFrame:
    """(name, difference): features that one side lacks, or whose fields differ."""
    a, b = left.select(key, F.struct(*fields).alias("l")), right.select(key, F.struct(*fields).alias("r"))
    both = a.join(b, key, "full_outer")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields)))
    what = F.when(F.col("l").isNull(), "only right").when(F.col("r").isNull(), "only left").when(F.size(differ) > 0, F.array_join(differ, ","))
    return both.select(key, what.alias("difference")).where("difference is not null")


def check_compatible(infos: Sequence[Mapping[str, Any]]) -> None:
    """Raises unless all infos agree in fps, version, and each feature's dtype, shape, codec and pixel format."""
    if not infos:
        raise TransformError("there are no data sets to merge")
    first = infos[0]
    for k, info in enumerate(infos[1:], 1):
        for name in ("fps", "codebase_version"):
            if info.get(name) != first.get(name):
                raise TransformError(f"data set {k} has {name} {info.get(name)!r}, the first {first.get(name)!r}")
        ours, theirs = first.get("features", {}), info.get("features", {})
        if set(ours) != set(theirs):
            raise TransformError(f"data set {k} differs in features: {sorted(set(ours) ^ set(theirs))}")
        for name, f in ours.items():
            for part in ("dtype", "shape"):
                if f.get(part) != theirs[name].get(part):
                    raise TransformError(f"data set {k}: feature {name} differs in {part}")
            for part in ("video.codec", "video.pix_fmt"):
                if (f.get("info") or {}).get(part) != (theirs[name].get("info") or {}).get(part):
                    raise TransformError(f"data set {k}: feature {name} differs in {part}")
