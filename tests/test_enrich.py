"""Shifts, deltas, transform trees, commands and field paths."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from loomtide.functions.fieldpath import field, parse_path
from loomtide.model import EnrichError, Recording
from loomtide.operators import commands, shift, tf


def series(spark, values, kind="int"):
    return spark.createDataFrame(list(enumerate(values)), f"timestamp_ns long, v {kind}")


def plain_shift(values, steps, fill, kind):
    moved = [values[k + steps] if 0 <= k + steps < len(values) else None for k in range(len(values))]
    if fill == "zero" and kind != "string":
        return [0 if v is None else v for v in moved]
    first = next((v for v in moved if v is not None), None)
    out, last = [], first
    for v in moved:
        last = last if v is None else v
        out.append(last)
    return out


@pytest.mark.parametrize("fill", ["edge", "zero"])
@pytest.mark.parametrize("steps", [-30, -4, -1, 1, 3, 30])
def test_shift(spark, steps, fill):
    rng = random.Random(steps)
    numbers = [rng.choice([None, rng.randrange(100)]) for _ in range(23)]
    words = [None if v is None else f"w{v}" for v in numbers]
    df = spark.createDataFrame([(k, v, w) for k, (v, w) in enumerate(zip(numbers, words, strict=True))], "timestamp_ns long, v int, w string")
    out = shift.shifted(df, steps, fill).orderBy("timestamp_ns").collect()
    assert [r.v for r in out] == plain_shift(numbers, steps, fill, "int") and [r.w for r in out] == plain_shift(words, steps, fill, "string")
    assert [r.timestamp_ns for r in out] == list(range(23))


def test_no_shift(spark):
    df = series(spark, [4, None, 6])
    assert shift.shifted(df, 0) is df


def test_shift_of_a_long_key_takes_linear_time(spark):
    long = spark.range(1_000_000).select(F.col("id").alias("timestamp_ns"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    began = time.perf_counter()
    r = shift.shifted(long, 5, "edge").agg(F.count("v"), F.max("v"), F.min("v")).first()
    assert r[:] == (1_000_000, 999_999 // 7 * 7, 7) and time.perf_counter() - began < 60


def test_unknown_fill(spark):
    with pytest.raises(EnrichError):
        shift.shifted(series(spark, [1]), 1, "mean")


def test_delta_array(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.5, 1.0]), (2, [1.5, 4.0])], "timestamp_ns long, position array<double>")
    assert [r.delta_position for r in shift.delta_array(df).orderBy("timestamp_ns").collect()] == [[0, 0], [0.5, -1], [0, 3]]
    bad = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "timestamp_ns long, position array<double>")
    with pytest.raises(Exception, match="changes its length"):
        shift.delta_array(bad).collect()


POSE = "struct<translation:struct<x:double,y:double,z:double>,rotation:struct<x:double,y:double,z:double,w:double>>"


def pose(x=0.0, y=0.0, z=0.0, q=(0.0, 0.0, 0.0, 1.0)):
    return ((x, y, z), q)


def turned(q, v):
    """v turned by a unit quaternion, as a rotation matrix does it."""
    x, y, z, w = q
    m = ((1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)), (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)), (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)))
    return tuple(sum(a * b for a, b in zip(row, v, strict=True)) for row in m)


def random_pose(rng):
    q = [rng.gauss(0, 1) for _ in range(4)]
    n = math.sqrt(sum(c * c for c in q))
    return tuple(rng.uniform(-3, 3) for _ in range(3)), tuple(c / n for c in q)


@pytest.mark.parametrize("frame", ["previous_target_frame", "source_frame"])
def test_delta_transform(spark, frame):
    rng = random.Random(frame)
    poses = [random_pose(rng) for _ in range(12)]
    df = spark.createDataFrame([(k, ((p,),)) for k, p in enumerate(poses)], f"timestamp_ns long, a struct<b:struct<transform:{POSE}>>")
    got = [r.a.b.delta_transform for r in shift.delta_transforms(df, frame).orderBy("timestamp_ns").collect()]
    assert tuple(got[0].translation) == (0, 0, 0) and tuple(got[0].rotation) == (0, 0, 0, 1)
    for (t0, q0), (t1, q1), d in zip(poses, poses[1:], got[1:], strict=False):
        moved = tuple(b - a for a, b in zip(t0, t1, strict=True))
        back = (*(-c for c in q0[:3]), q0[3])
        assert tuple(d.translation) == pytest.approx(turned(back, moved) if frame == "previous_target_frame" else moved)
        for v in ((1, 0, 0), (0, 1, 0)):  # turning by the delta, then by the pose before, is turning by the pose
            assert turned(q0, turned(tuple(d.rotation), v)) == pytest.approx(turned(q1, v))


def test_deltas_over_many_buckets(spark):
    """Rows hours apart, which fall into buckets of their own, and null values among them."""
    rng = random.Random(7)
    hours = sorted(rng.sample(range(400), 60))
    rows = [(h * 3_600_000_000_000 + rng.randrange(10**12), None if k % 9 == 5 else [float(k * k), -float(k)]) for k, h in enumerate(hours)]
    df = spark.createDataFrame([(u, t, p) for u in ("x", "y") for t, p in rows], "rosbag_uuid string, timestamp_ns long, position array<double>")
    got = shift.delta_array(df).orderBy("rosbag_uuid", "timestamp_ns").collect()
    want = [None if p is None else [0.0, 0.0] if q is None else [p[0] - q[0], p[1] - q[1]] for (_, q), (_, p) in zip([(0, None), *rows], rows, strict=False)]
    assert [r.delta_position for r in got] == want * 2


def test_opposite_quaternions_are_one_rotation(spark):
    _, q = random_pose(random.Random(3))
    df = spark.createDataFrame([(0, pose(q=q)), (1, pose(q=tuple(-c for c in q)))], f"timestamp_ns long, transform {POSE}")
    assert tuple(shift.delta_transforms(df).orderBy("timestamp_ns").collect()[1].delta_transform.rotation) == pytest.approx((0, 0, 0, 1))


def test_delta_transform_needs_one(spark):
    with pytest.raises(EnrichError):
        shift.delta_transforms(series(spark, [1]))


TF = f"timestamp_ns long, transforms array<struct<header:struct<frame_id:string>,child_frame_id:string,transform:{POSE}>>"


def message(parent, child, x):
    return ((parent,), child, pose(x))


def test_buffer(spark):
    rows = [(10, [message("base", "a", 1.0)]), (20, [message("base", "b", 2.0)]), (30, [message("base", "a", 3.0)]), (40, [])]
    out = tf.buffer(spark.createDataFrame(rows, TF)).orderBy("timestamp_ns").collect()
    assert [r.timestamp_ns for r in out] == [20, 30]
    got = [{t.child_frame_id: (t.transform.translation.x, t.is_fresh) for t in r.transforms} for r in out]
    assert got == [{"a": (1.0, False), "b": (2.0, True)}, {"a": (3.0, True), "b": (2.0, False)}]


def test_buffer_with_static_and_extra_columns(spark):
    moving = spark.createDataFrame([(10, [message("base", "a", 1.0)])], TF).withColumn("note", F.lit("n")).withColumn("publish_timestamp_ns", F.lit(1))
    static = spark.createDataFrame([(5, [message("a", "b", 2.0)])], TF)
    out = tf.buffer(moving, static)
    rows = out.orderBy("timestamp_ns").collect()
    assert [r.timestamp_ns for r in rows] == [10] and rows[0].note == "n" and "publish_timestamp_ns" not in out.columns


BUF = f"timestamp_ns long, transforms array<struct<child_frame_id:string,header:struct<frame_id:string>,transform:{POSE},is_fresh:boolean>>"


def edge(parent, child, fresh, *xyz):
    return (child, (parent,), pose(*xyz), fresh)


def chain(spark, edges, pairs):
    return tf.chain(spark.createDataFrame([(1, edges)], BUF), pairs).first()


def test_chain(spark):
    r = chain(spark, [edge("base", "left_tip", False, 1.0), edge("base", "right_tip", True, 0.0, 2.0)], [("left_tip", "right_tip"), ("left_tip", "left_tip")])
    assert tuple(r.left_tip.right_tip.transform.translation) == (-1, 2, 0) and r.left_tip.right_tip.is_fresh
    assert tuple(r.left_tip.left_tip.transform.rotation) == (0, 0, 0, 1) and not r.left_tip.left_tip.is_fresh
    r = chain(spark, [edge("base", "arm", False, 1.0), edge("arm", "hand_link", False, 0.0, 2.0)], [("hand_link", "base")])
    assert tuple(r.hand_link.base.transform.translation) == (-1, -2, 0)


@pytest.mark.parametrize(("edges", "pair", "what"), [
    ([edge("a", "b", False), edge("c", "d", False)], ("b", "d"), "common ancestor"),
    ([edge("a", "b", False), edge("c", "b", False)], ("b", "a"), "several parents"),
    ([edge("a", "b", False), edge("b", "a", False)], ("b", "a"), "cycle"),
    ([edge("a", "b", False)], ("b", "z"), "unknown frame"),
])
def test_chain_errors(spark, edges, pair, what):
    with pytest.raises(EnrichError, match=what):
        chain(spark, edges, [pair])


def test_long_chain_against_plain_products(spark):
    rng = random.Random(8)
    poses = [random_pose(rng) for _ in range(6)]  # root - n0 - n1 - n2, and root - n3 - n4 - n5
    names = [("root", "n0"), ("n0", "n1"), ("n1", "n2"), ("root", "n3"), ("n3", "n4"), ("n4", "n5")]
    edges = [(child, (parent,), p, child == "n4") for (parent, child), p in zip(names, poses, strict=True)]
    r = chain(spark, edges, [("n2", "n5"), ("n0", "n2")])

    def from_root(point, path):
        for t, q in reversed(path):
            point = tuple(a + b for a, b in zip(t, turned(q, point), strict=True))
        return point

    for pair, down, up in ((r.n2.n5, poses[3:], poses[:3]), (r.n0.n2, poses[1:3], [])):
        found = (tuple(pair.transform.translation), tuple(pair.transform.rotation))
        for point in ((0, 0, 0), (1, 2, 3)):
            assert from_root(from_root(point, [found]), up) == pytest.approx(from_root(point, down))
    assert r.n2.n5.is_fresh and not r.n0.n2.is_fresh


def test_chain_with_repeated_frames_in_a_row(spark):
    r = chain(spark, [edge("a", "b", False, 1.0), edge("a", "b", True, 2.0)], [("a", "b")])
    assert r.a.b.transform.translation.x == 1.0
    df = spark.createDataFrame([(1, [edge("a", "b", False), edge("c", "b", False)])], BUF)
    with pytest.raises(Exception, match="several parents of frame"):
        tf.chain(df, [("a", "b")], [("a", "b")]).collect()


def test_chain_with_a_missing_edge(spark):
    df = spark.createDataFrame([(1, [edge("a", "b", False)]), (2, [])], BUF)
    with pytest.raises(Exception, match="no transform of frame"):
        tf.chain(df, [("a", "b")]).collect()


def test_commands(spark):
    point = "struct<positions:array<double>,velocities:array<double>,accelerations:array<double>,effort:array<double>,time_from_start:struct<sec:int,nanosec:bigint>>"
    arm = spark.createDataFrame([(1, ["x"], [([0.0], [], [], [], (3, 4))]), (2, ["x"], [])], f"timestamp_ns long, joint_names array<string>, points array<{point}>")
    servo = spark.createDataFrame([(9, [0.0] * 7), (1, [0.0] * 6 + [0.7])], "timestamp_ns long, present_position array<double>")
    out = commands.with_command(Recording({commands.HAND.template: arm, commands.HAND.state: servo}), commands.HAND).table(commands.HAND.output)
    rows = out.orderBy("timestamp_ns").collect()
    assert [r.points[0].positions for r in rows] == [[0.7], [0.7]] and rows[0].points[0].time_from_start.sec == 3 and rows[0].joint_names == ["hand_motor_joint"]
    with pytest.raises(EnrichError):
        commands.with_command(Recording({}), commands.HEAD)


def test_field_paths(spark):
    df = spark.createDataFrame([([0, 1, 2, 3, 4], [[0, 1], [2, 3], [4, 5]], (7,))], "data array<int>, nested array<array<int>>, s struct<`a b`:int>")
    one = lambda p: df.select(field(p).alias("x")).first().x
    assert one("/data/1:3") == [1, 2] and one("/nested/0:2/0") == [0, 2] and one("/nested/1:/0:1") == [[2], [4]]
    assert one("/data/-1") == 4 and one("/data/9") is None and one("/s/a b") == 7 and one("/data/3:1") == []
    assert one("/data/:-2") == [0, 1, 2] and one("/data/-9:2") == [0, 1] and one("/data/:") == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        parse_path("data/0")
