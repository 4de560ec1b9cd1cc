"""Training episodes: segments cut from synced topics, joined into frames, annotated and numbered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtide.functions.fieldpath import field
from loomtide.model import SYNCED, TransformError, seconds_to_ns
from loomtide.operators import ordinals


@dataclass(frozen=True)
class Feature:
    """One column of an episode: a field of a topic, or the frame index of a video or image topic."""

    name: str
    topic: str
    path: str = ""
    kind: str = "parquet"  # or video, image
    names: tuple[str, ...] | None = None
    description: str = ""


def image_index(name: str) -> str:
    return f"image_index_{name}"


def projected(tables: Mapping[str, DataFrame], features: Sequence[Feature], by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """For each topic that features need: by, synched_timestamp_ns and its features, by name."""
    missing = {f.topic: sorted(g.name for g in features if g.topic == f.topic) for f in features if f.topic not in tables}
    if missing:
        raise TransformError(f"missing topics with the features that need them: {dict(sorted(missing.items()))}")
    out = {}
    for topic in sorted({f.topic for f in features}):
        own = sorted((f for f in features if f.topic == topic), key=lambda f: f.name)
        columns = [field(f.path).alias(f.name) if f.kind == "parquet" else F.col("index").alias(image_index(f.name)) for f in own]
        out[topic] = tables[topic].select(*by, SYNCED, *columns)
    return out


def in_segment(start_s: Column, end_s: Column, time: Column | None = None) -> Column:
    """Whether a frame lies in [start, end]; seconds are cut to nanoseconds."""
    t = F.col(SYNCED) if time is None else time
    return t.between(seconds_to_ns(start_s, "truncate"), seconds_to_ns(end_s, "truncate"))


def overlapping(segments: DataFrame, ranges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Segments that meet their recording's synced range (by, first_ns, last_ns); seconds are rounded."""
    both = segments.join(ranges, list(by)) if by else segments.crossJoin(ranges)
    start, end = seconds_to_ns(F.col("start_s")), seconds_to_ns(F.col("end_s"))
    return both.where((end >= F.col("first_ns")) & (start <= F.col("last_ns"))).select(*segments.columns)


def synced_range(tables: Mapping[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    times = reduce(DataFrame.unionByName, (df.select(*by, SYNCED) for df in tables.values()))
    return times.groupBy(*by).agg(F.min(SYNCED).alias("first_ns"), F.max(SYNCED).alias("last_ns"))


def assembled(parts: Mapping[str, DataFrame], segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Frames of each segment: the topics' rows at the same synced time, inner-joined.

    Topics are joined once, on keys that they are all dealt by; segments, whose rows are small,
    then meet the frames by recording and range.
    """
    keys = [*by, SYNCED]
    joined = reduce(lambda a, b: a.join(b, keys), parts.values())
    limits = segments.select(*by, *(c for c in segments.columns if c not in by))
    inside = in_segment(F.col("start_s"), F.col("end_s"))
    return joined.join(limits, list(by)).where(inside) if by else joined.join(limits, inside)


def length_check(df: DataFrame, features: Sequence[Feature]) -> list[str]:
    """Complaints about list features whose length isn't that of their names: one aggregate over all."""
    named = [f for f in features if f.names is not None and f.name in df.columns]
    if not named:
        return []
    row = df.agg(*(F.count_if(F.size(F.col(f"`{f.name}`")) != len(f.names)).alias(f"n{k}") for k, f in enumerate(named))).first()
    return [f"{f.name}: {row[f'n{k}']} rows don't have {len(f.names)} elements" for k, f in enumerate(named) if row[f"n{k}"]]


def axes(df: DataFrame, by: Sequence[str], order: Sequence[str], spacing_s: float, offset: Column | None = None, episode: Column | None = None) -> DataFrame:
    """frame_index from 0 in each episode (by), index plus the offset, episode_index and timestamp."""
    frame = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    here = df.withColumn("frame_index", frame.cast("long"))
    return here.withColumn("index", F.col("frame_index") + (F.lit(0) if offset is None else offset)).withColumn("episode_index", (F.lit(0) if episode is None else episode).cast("long")).withColumn("timestamp", F.col("frame_index") * F.lit(spacing_s))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], episode_order: Sequence[str], spacing_s: float) -> DataFrame:
    """Axes over many episodes: episode_index by episode_order, index running on across episodes."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("__length"), *(F.min(c).alias(f"__o_{c}") for c in episode_order if c not in by))
    placed = ordinals.numbered(sizes, [c if c in by else f"__o_{c}" for c in episode_order], "__episode", "__length", "__offset")
    joined = df.join(placed.select(*by, "__episode", "__offset"), list(by))
    return axes(joined, by, order, spacing_s, F.col("__offset"), F.col("__episode")).drop("__episode", "__offset")


def annotated(df: DataFrame, by: Sequence[str], order: Sequence[str], task: Column, success: Column, composite: Column | None = None) -> DataFrame:
    """next.done on each segment's last frame, and the segment's task and success on all of them."""
    w = Window.partitionBy(*by)
    last = F.row_number().over(w.orderBy(*order)) == F.count("*").over(w)
    whole = F.coalesce(composite, F.lit(-1)) if composite is not None else F.lit(-1)
    values = {"next.done": last, "short_horizon_task_index": whole.cast("long"), "primitive_action_index": task.cast("long"), "success_primitive_action": success, "task_index": task.cast("long")}
    return df.select("*", *(c.alias(n) for n, c in values.items()))


def frame_spacing(times: DataFrame, by: Sequence[str] = (), time: str = SYNCED) -> DataFrame:
    """(by, spacing_s, fps): between the first two distinct times; fps is at least 1."""
    firsts = times.groupBy(*by).agg(F.min(time).alias("__a"))
    later = times.join(firsts, list(by)) if by else times.crossJoin(firsts)
    second = later.where(F.col(time) > F.col("__a")).groupBy(*by, "__a").agg(F.min(time).alias("__b"))
    spacing = (F.col("__b") - F.col("__a")) / F.lit(1e9)
    return second.select(*by, spacing.alias("spacing_s"), F.greatest(F.round(1 / spacing), F.lit(1.0)).cast("long").alias("fps"))


def registered_tasks(labels: Sequence[str], episode_label: str = "") -> dict[str, int]:
    """Label -> task index by first occurrence, the episode's label last."""
    out: dict[str, int] = {}
    for label in [*labels, *([episode_label] if episode_label else [])]:
        out.setdefault(label, len(out))
    return out


def task_table(labels: DataFrame, by: Sequence[str] = (), column: str = "labels") -> DataFrame:
    """(by, task_index, task): distinct labels of an array column by first position."""
    first = labels.select(*by, F.posexplode(column).alias("pos", "task")).groupBy(*by, "task").agg(F.min("pos").alias("pos"))
    return first.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1).cast("long").alias("task_index"), "task")
