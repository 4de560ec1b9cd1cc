"""Transform trees: complete buffers of frames, and relative poses along chains.

buffer turns a stream of partial transform messages into rows that hold every frame's latest
transform. chain composes, for each asked pair of frames, the poses along the tree's path. Paths
are found once on the driver from the tree's edges, of which there are as many as frames; the
algebra is Column expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.functions.geometry import Pose, Quat, Vec, identity, pose
from loomtide.model import FRESH, PUBLISHED, SYNCED, TIMESTAMP, EnrichError, Recording, keys_of
from loomtide.operators.asof import BUCKET_NS, asof

Edge = tuple[str, str]  # parent, child


def exploded(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row for each transform: by, timestamp_ns, child_frame_id, header, transform. Empty lists have none."""
    return df.select(*by, F.col(TIMESTAMP).cast("long").alias(TIMESTAMP), F.explode("transforms").alias("t")).select(*by, TIMESTAMP, "t.child_frame_id", "t.header", "t.transform")


def buffer(tf: DataFrame, tf_static: DataFrame | None = None, by: Sequence[str] | None = None, bucket_ns: int = BUCKET_NS) -> DataFrame:
    """(by, timestamp_ns, transforms): at each time that any transform came, all frames' latest.

    Times before every frame is known are left out. A transform is fresh where it came at that
    very time. Other columns of tf than timestamps and transforms are taken from its first row.
    """
    by = keys_of(tf) if by is None else list(by)
    rows = exploded(tf, by)
    if tf_static is not None:
        rows = rows.unionByName(exploded(tf_static, by))
    frames = rows.select(*by, "child_frame_id").distinct()
    expected = frames.groupBy(*by).agg(F.count("*").alias("__expected"))
    times = rows.select(*by, TIMESTAMP).distinct()
    # Times meet frames within their recording; frames are as few as a robot has links.
    grid = times.join(frames, by) if by else times.crossJoin(frames)
    latest = asof(grid, rows, [*by, "child_frame_id"], TIMESTAMP, TIMESTAMP, (), ("backward",), bucket_ns)
    known = latest.where(F.col("backward.header").isNotNull())
    entry = F.struct("child_frame_id", F.col("backward.header").alias("header"), F.col("backward.transform").alias("transform"), (F.col(f"backward.{TIMESTAMP}") == F.col(TIMESTAMP)).alias(FRESH))
    grouped = known.groupBy(*by, TIMESTAMP).agg(F.sort_array(F.collect_list(entry)).alias("transforms"), F.count_distinct("child_frame_id").alias("__n"))
    complete = grouped.join(expected, by) if by else grouped.crossJoin(expected)
    out = complete.where("__n = __expected").drop("__n", "__expected")
    extra = [c for c in tf.columns if c not in (*by, TIMESTAMP, PUBLISHED, SYNCED, "transforms")]
    if extra:
        first = tf.groupBy(*by).agg(F.min_by(F.struct(*extra), TIMESTAMP).alias("__first"))
        out = (out.join(first, by) if by else out.crossJoin(first)).select(*out.columns, "__first.*")
    return out


def edges_of(df: DataFrame) -> list[Edge]:
    """Distinct (parent, child) edges of a buffer's transforms: as many as frames."""
    # Rows mostly repeat one list of frames, so lists are told apart before they are taken to pieces.
    lists = df.select(F.col("transforms.header.frame_id").alias("p"), F.col("transforms.child_frame_id").alias("c")).distinct()
    rows = lists.select(F.explode(F.arrays_zip("p", "c")).alias("e")).select("e.p", "e.c").distinct().collect()
    return sorted((r["p"], r["c"]) for r in rows)


def parents(edges: Sequence[Edge]) -> dict[str, str]:
    """child -> parent; a child of two parents, or a cycle, is an error."""
    up: dict[str, str] = {}
    for parent, child in edges:
        if up.setdefault(child, parent) != parent:
            raise EnrichError(f"frame {child!r} has several parents: {up[child]!r} and {parent!r}")
    for child in up:
        path_up(child, up)
    return up


def path_up(frame: str, up: Mapping[str, str]) -> list[str]:
    """frame and all its ancestors, nearest first."""
    path, seen = [frame], {frame}
    while path[-1] in up:
        above = up[path[-1]]
        if above in seen:
            raise EnrichError(f"the transform tree has a cycle through {above!r}")
        path.append(above)
        seen.add(above)
    return path


def chain_path(source: str, target: str, up: Mapping[str, str]) -> tuple[list[str], list[str]]:
    """Children of the edges from the common ancestor down to source, and down to target."""
    known = {*up, *up.values()}
    for frame in (source, target):
        if frame not in known:
            raise EnrichError(f"unknown frame {frame!r}")
    above_source, above_target = path_up(source, up), path_up(target, up)
    shared = next((f for f in above_source if f in set(above_target)), None)
    if shared is None:
        raise EnrichError(f"frames {source!r} and {target!r} have no common ancestor")
    down = lambda path: path[: path.index(shared)][::-1]
    return down(above_source), down(above_target)


def bound(df: DataFrame, name: str, value: Pose) -> tuple[DataFrame, Pose]:
    """df with a column for each number of a pose, and the pose over those columns.

    Numbers rather than a struct: the optimizer would replace fields of a struct by the expressions
    that it is made of, and compute them again at each use.
    """
    parts = {f"{name}_t{n}": c for n, c in zip("xyz", value.translation, strict=True)} | {f"{name}_r{n}": c for n, c in zip("xyzw", value.rotation, strict=True)}
    here = [F.col(c) for c in parts]
    return df.withColumns(parts), Pose(Vec(*here[:3]), Quat(*here[3:]))


def relative(df: DataFrame, down_source: Sequence[Pose], down_target: Sequence[Pose], name: str) -> tuple[DataFrame, Pose]:
    """df with the pose of target seen from source, from the poses below their common ancestor.

    Each product is a projection of its own, so that expressions don't grow with the chain.
    """
    sides: list[Pose] = []
    for side, parts in (("l", down_source), ("r", down_target)):
        if not parts:
            continue
        whole = parts[0]
        for k, part in enumerate(parts[1:]):
            df, whole = bound(df, f"{name}_{side}{k}", whole.times(part))
        sides.append(whole.inverse() if side == "l" else whole)
    if len(sides) == 2:
        df, back = bound(df, f"{name}_i", sides[0])
        sides = [back.times(sides[1])]
    return bound(df, name, sides[0] if sides else identity())


def chain(df: DataFrame, pairs: Sequence[tuple[str, str]], edges: Sequence[Edge] | None = None) -> DataFrame:
    """Times with, for each pair, a struct source.target of transform and is_fresh.

    A pair is fresh where one of its edges is; a frame seen from itself is the identity and never
    fresh. An edge missing from a row, or two parents of one child in a row, is an error there.
    """
    if not pairs:
        raise EnrichError("there are no frame pairs")
    up = parents(edges_of(df) if edges is None else edges)
    paths = {p: ([], []) if p[0] == p[1] else chain_path(*p, up) for p in dict.fromkeys(pairs)}
    used = sorted({c for a, b in paths.values() for c in (*a, *b)})
    by = keys_of(df)
    times = [c for c in (SYNCED, TIMESTAMP) if c in df.columns]
    out = df.select(*by, *times, F.col("transforms").alias("__t"), F.col("transforms.child_frame_id").alias("__c"))

    def edge(child: str) -> Column:
        at = F.array_position("__c", child).cast("int")
        found = F.filter("__t", lambda t: t["child_frame_id"] == child)
        parents_here = F.size(F.array_distinct(F.transform(found, lambda t: t["header"]["frame_id"])))
        lost = F.raise_error(F.lit(f"no transform of frame {child!r} in a row"))
        many = F.raise_error(F.lit(f"several parents of frame {child!r} in a row"))
        repeated = F.size("__c") - F.size(F.array_remove("__c", child)) > 1
        return F.when(F.coalesce(at, F.lit(0)) == 0, lost).when(F.when(repeated, parents_here > 1).otherwise(False), many).otherwise(F.get("__t", at - 1))

    at = {c: k for k, c in enumerate(used)}
    out = out.select(*by, *times, *(edge(c).alias(f"__e{k}") for c, k in at.items()))
    raw = {c: pose(F.col(f"__e{k}.transform"), False) for c, k in at.items()}
    out = out.withColumns({f"__q{k}": F.sqrt(raw[c].rotation.dot(raw[c].rotation)) for c, k in at.items()})
    poses: dict[str, Pose] = {}
    for c, k in at.items():
        out, poses[c] = bound(out, f"__n{k}", Pose(raw[c].translation, raw[c].rotation.normalized(F.col(f"__q{k}"))))
    for k, (a, b) in enumerate(paths.values()):
        fresh = F.lit(False)
        for c in dict.fromkeys((*a, *b)):
            fresh = fresh | F.coalesce(F.col(f"__e{at[c]}.{FRESH}"), F.lit(False))
        out, value = relative(out, [poses[c] for c in a], [poses[c] for c in b], f"__v{k}")
        out = out.withColumn(f"__p{k}", F.struct(value.struct().alias("transform"), fresh.alias(FRESH)))
    by_source: dict[str, list[Column]] = {}
    for k, (source, target) in enumerate(paths):
        by_source.setdefault(source, []).append(F.col(f"__p{k}").alias(target))
    return out.select(*by, *times, *(F.struct(*cols).alias(source) for source, cols in by_source.items()))


def find_topic(recording: Recording, exact: str, test) -> str:
    """The topic of that exact name, else the only one that passes the test."""
    if exact in recording.tables:
        return exact
    found = sorted(t for t in recording.tables if test(t))
    if len(found) != 1:
        raise EnrichError(f"need one topic like {exact!r}, found {found}")
    return found[0]


def with_buffer(recording: Recording) -> Recording:
    """Adds <tf>_buffer from the tf topic and, if it has rows, tf_static."""
    name = find_topic(recording, "/tf", lambda t: t.endswith("tf"))
    return recording.with_tables({f"{name}_buffer": buffer(recording.table(name), recording.tables.get(f"{name}_static"))})


def with_chain(recording: Recording, pairs: Sequence[tuple[str, str]]) -> Recording:
    """Adds /tf_chain from the buffer topic."""
    name = find_topic(recording, "/tf_buffer", lambda t: "tf_buffer" in t)
    return recording.with_tables({"/tf_chain": chain(recording.table(name), pairs)})
