"""Synchronisers and as-of joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loomtide.model import SynchronizeError
from loomtide.operators import sync
from loomtide.operators.asof import asof

MS = 1_000_000


def tables(spark, data):
    return {t: spark.createDataFrame([(a * MS, v) for a, v in zip(*d, strict=True)], "timestamp_ns long, value int") for t, d in data.items()}


def made_series(seed):
    """Three topics of unlike rates with jitter, gaps and a repeated value."""
    rng = random.Random(seed)
    out = {}
    for topic, gap in (("fast", 17), ("slow", 211), ("bursts", 90)):
        at, times = rng.randrange(0, 120), []
        while at < 2600:
            times.append(at)
            at += rng.choice((gap, gap, gap + 3, 4 * gap))
        out[topic] = (times, [rng.randrange(6) for _ in times])
    return out


def bounds_of(series):
    return max(t[0] for t, _ in series.values()), max(t[-1] for t, _ in series.values())


def plain_match(times, at, method):
    """The place of the row that a grid time takes, by looking at all rows."""
    before = [k for k, t in enumerate(times) if t <= at]
    if method == "zero_order_hold":
        return before[-1] if before else None
    return min(range(len(times)), key=lambda k: (abs(times[k] - at), times[k]))


@pytest.mark.parametrize("method", ["zero_order_hold", "nearest_neighbor"])
@pytest.mark.parametrize(("seed", "fps"), [(1, 8), (2, 50), (3, 1)])
def test_grid(spark, method, seed, fps):
    series = made_series(seed)
    start, end = bounds_of(series)
    step = 1000 // fps
    out = sync.synchronize(tables(spark, series), fps, method)
    for topic, (times, values) in series.items():
        rows = out[topic].orderBy("synched_timestamp_ns").collect()
        grid = list(range(start, end + 1, step))
        places = [plain_match(times, at, method) for at in grid]
        assert [r.synched_timestamp_ns // MS for r in rows] == grid
        assert [r.value for r in rows] == [None if k is None else values[k] for k in places]
        assert [r.is_fresh for r in rows] == [k is not None and (n == 0 or k != places[n - 1]) for n, k in enumerate(places)]


@pytest.mark.parametrize("seed", [4, 5])
def test_merged_timestamps(spark, seed):
    series = made_series(seed)
    start, end = bounds_of(series)
    merged = sorted(t for times, _ in series.values() for t in times if start <= t <= end)
    out = sync.merge_timestamps(tables(spark, series))
    for topic, (times, values) in series.items():
        rows = out[topic].orderBy("synched_timestamp_ns").collect()
        places = [plain_match(times, at, "zero_order_hold") for at in merged]
        assert [r.synched_timestamp_ns // MS for r in rows] == merged
        assert [(r.timestamp_ns // MS, r.value) for r in rows] == [(times[k], values[k]) for k in places]
        assert "is_fresh" not in out[topic].columns


def test_wide_gap_takes_the_nearer_side(spark):
    out = sync.synchronize(tables(spark, {"a": ([0, 3000, 9000, 12000], [0, 1, 2, 3])}), 1, "nearest_neighbor")["a"]
    assert {r.synched_timestamp_ns // (1000 * MS): r.value for r in out.collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2, 8: 2, 9: 2, 10: 2, 11: 3, 12: 3}


def test_errors(spark):
    with pytest.raises(SynchronizeError):
        sync.step_ns(0)
    with pytest.raises(SynchronizeError):
        sync.synchronize({}, 10)
    empty = {"a": spark.createDataFrame([], "timestamp_ns long, value int"), **tables(spark, {"b": ([1], [1])})}
    with pytest.raises(SynchronizeError):
        sync.synchronize(empty, 10)


def test_step_is_cut_to_whole_nanoseconds():
    assert sync.step_ns(30) == 33_333_333


@pytest.mark.parametrize("bucket", [7, 50, 10_000])
def test_asof_against_brute_force(spark, bucket):
    rng = random.Random(bucket)
    source = [(rng.choice("xy"), rng.randrange(-100, 400), n, rng.choice([None, n])) for n in range(120)]
    targets = [(k, t) for k in "xyz" for t in range(-120, 420, 9)]
    s = spark.createDataFrame(source, "k string, timestamp_ns long, n long, v long")
    t = spark.createDataFrame(targets, "k string, t long")
    got = {(r.k, r.t): r for r in asof(t, s, ["k"], "t", "timestamp_ns", ["n"], ("backward", "forward"), bucket).collect()}
    assert len(got) == len(targets)
    for k, at in targets:
        own = sorted((a, n, v) for kk, a, n, v in source if kk == k)
        back, ahead = [r for r in own if r[0] <= at], [r for r in own if r[0] >= at]
        for side, want in (("backward", back[-1:]), ("forward", ahead[:1])):
            r = got[k, at][side]
            assert ([] if r is None else [(r.timestamp_ns, r.n, r.v)]) == want


def test_null_times(spark):
    s = spark.createDataFrame([(None, 1), (5, 2)], "timestamp_ns long, v int")
    t = spark.createDataFrame([(None,), (6,)], "t long")
    got = {r.t: r.backward for r in asof(t, s).collect()}
    assert got[None] is None and got[6].v == 2


def test_long_grid_is_chunked(spark):
    limits = spark.createDataFrame([(0, 200_000)], "start_ns long, end_ns long")
    assert sync.grid(limits, 1).agg(F.count("*"), F.min("synched_timestamp_ns"), F.max("synched_timestamp_ns"), F.count_distinct("synched_timestamp_ns")).first()[:] == (200_001, 0, 200_000, 200_001)
