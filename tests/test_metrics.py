"""Timing metrics, ranks, statistics, episodes and merging: known values."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomtide.functions import naming
from loomtide.model import TransformError
from loomtide.operators import episodes as ep
from loomtide.operators import merge, metrics, ordinals, stats

MS, S = 1_000_000, 1_000_000_000


def times(spark, topics, unit=MS):
    return spark.createDataFrame([(t, a * unit) for t, ts in topics.items() for a in ts], "topic string, timestamp_ns long")


def window(spark, start, end):
    return spark.createDataFrame([(start * MS, end * MS)], "start_ns long, end_ns long")


def plain_timing(times, start, end):
    own = sorted(t for t in times if start <= t <= end)
    if not own:
        return (0, 0.0, 0.0, None, None, None, None, None)
    gaps = [b - a for a, b in zip(own, own[1:], strict=False)]
    span = own[-1] - own[0]
    middle = statistics.median(gaps) if gaps else None
    spread = statistics.pstdev(gaps) / statistics.fmean(gaps) if gaps and sum(gaps) else None
    return (len(own), span / 1000, min(span / (end - start), 1), (len(own) - 1) / (span / 1000) if span else None, middle, spread, max(gaps, default=None), max(gaps) / middle if middle else None)


@pytest.mark.parametrize("bucket", [40 * MS, 10_000 * MS])
def test_topic_metrics(spark, bucket):
    rng = random.Random(6)
    topics = {"even": list(range(35, 900, 20)), "odd": sorted(rng.sample(range(1000), 41)), "twice": [300, 300, 410], "one": [512], "late": [990]}
    rows = metrics.topic_metrics(times(spark, topics), window(spark, 50, 870), [], ["odd", "gone"], bucket_ns=bucket).collect()
    got = {r.topic: r for r in rows}
    assert set(got) == {*topics, "gone"} and {t for t, r in got.items() if r.is_required_topic} == {"odd", "gone"}
    for topic, r in got.items():
        want = plain_timing(topics.get(topic, []), 50, 870)
        found = (r.message_count, r.observed_topic_span_s, r.episode_coverage_ratio, r.observed_hz, r.median_topic_interval_ms, r.topic_interval_cv, r.max_topic_interval_ms, r.max_interval_over_median)
        assert found == tuple(w if w is None else pytest.approx(w) for w in want), topic


@pytest.mark.parametrize("bucket", [3, 50, 10_000])
def test_intervals_over_buckets(spark, bucket):
    rng = random.Random(bucket)
    rows = [(k, rng.choice([None, *range(200)]), n) for n, k in enumerate(rng.choices("ab", k=60))]
    df = spark.createDataFrame(rows, "k string, timestamp_ns long, n int")
    got = sorted((r.k, r.timestamp_ns, r.gap) for r in metrics.intervals_ms(df, ["k"], name="gap", bucket_ns=bucket).collect() if r.timestamp_ns is not None)
    want = []
    for k in "ab":
        own = sorted(t for kk, t, _ in rows if kk == k and t is not None)
        want += [(k, t, None if i == 0 else (t - own[i - 1]) / 1e6) for i, t in enumerate(own)]
    assert [(k, t) for k, t, _ in got] == [(k, t) for k, t, _ in want] and sorted(map(str, got)) == sorted(map(str, want))
    assert metrics.intervals_ms(df, ["k"], bucket_ns=bucket).count() == 60


def test_numbers_over_ranges(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(50)) for k in rng.sample(range(1000), 300)]
    got = ordinals.numbered(spark.createDataFrame(rows, "a long, length long").repartition(7), ["a"], "n", "length", "before").orderBy("a").collect()
    rows.sort()
    assert [(r.a, r.n, r.before) for r in got] == [(a, k, sum(x for _, x in rows[:k])) for k, (a, _) in enumerate(rows)]
    assert ordinals.numbered(spark.createDataFrame([], "a long"), ["a"], "n").count() == 0


def test_segments(spark):
    long = times(spark, {"a": [1, 2, 3, 4, 6], "b": [2, 3, 6]}, S)
    seg = spark.createDataFrame([(0, "pick", True, 1.0, 4.0), (1, "place", False, 4.0, 7.0)], "segment_index int, segment_label string, segment_success boolean, start_s double, end_s double")
    pick, place = metrics.segment_metrics(long, seg, [], ["a", "b"]).orderBy("segment_index").collect()
    assert (pick.minimum_required_segment_coverage_ratio, pick.worst_topic_max_interval_ms, pick.worst_topic_max_interval_over_median) == (pytest.approx(1 / 3), 1000, 1)
    assert (place.minimum_required_segment_coverage_ratio, place.worst_topic_max_interval_ms, place.worst_topic_max_interval_over_median) == (0, 2000, 1)
    assert pick.has_all_required_topics and place.has_all_required_topics
    gone = metrics.segment_metrics(long, seg, [], ["z"]).first()
    assert (gone.has_all_required_topics, gone.minimum_required_segment_coverage_ratio, gone.worst_topic_max_interval_ms) == (False, 0.0, None)
    with pytest.raises(TransformError):
        metrics.segment_metrics(long, seg, [], [])


def test_episode(spark):
    topics = metrics.topic_metrics(times(spark, {"a": [0, 500]}), window(spark, 0, 500), [], ["a"])
    eps = spark.createDataFrame([("bake", True, 0.0, 2.5)], "episode_label string, episode_success boolean, start_s double, end_s double")
    full = metrics.episode_metrics(topics, eps, []).first()
    assert (full.has_all_required_topics, full.minimum_required_episode_coverage_ratio, full.episode_duration_s) == (True, 1.0, 2.5)
    lacking = metrics.episode_metrics(topics, eps, [], 2).first()
    assert (lacking.has_all_required_topics, lacking.minimum_required_episode_coverage_ratio) == (False, 0.0)
    free = metrics.episode_metrics(topics.withColumn("is_required_topic", F.lit(False)), eps, []).first()
    assert (free.has_all_required_topics, free.minimum_required_episode_coverage_ratio) == (True, None)


def test_percentile_rank(spark):
    df = spark.createDataFrame([("x", 2), ("x", 4), ("x", 4), ("y", 3), (None, 1)], "label string, d int")
    r = metrics.percentile_rank(df, "d", ["label"], "rank", "n").collect()
    assert sorted((x.label or "", x.d, x.n, x.rank) for x in r) == [("", 1, 1, 0.5), ("x", 2, 3, 0.0), ("x", 4, 3, 0.75), ("x", 4, 3, 0.75), ("y", 3, 1, 0.5)]


def test_statistics(spark):
    df = spark.createDataFrame([(0, 1.0, True, [1.0, 10.0], (1.0, 2, 3.0)), (0, 3.0, False, [3.0, 30.0], (None, 2, 4.0)), (0, None, None, None, None), (1, 5.0, True, [1.0], (0.0, 1, 1.0)), (1, 5.0, True, [1.0, 2.0], (0.0, 1, 1.0))], "e int, x double, b boolean, l array<double>, s struct<p:double,q:int,r:double>")
    r = stats.scalar_stats(df, "x", ["e"]).where("e = 0").first()
    assert (r["min"], r["max"], r["mean"], r["std"], r["count"]) == (1, 3, 2, 1, 2)
    r = stats.scalar_stats(df, "b", ["e"]).where("e = 0").first()
    assert (r["min"], r["max"], r["mean"], r["count"]) == (False, True, 0.5, 2)
    rows = stats.list_stats(df, "l", ["e"]).collect()
    assert [(r["e"], r["min"], r["max"], r["mean"], r["std"], r["count"]) for r in rows] == [(0, [1, 10], [3, 30], [2, 20], [1, 10], [2, 2])]
    assert [r.s for r in stats.structs_to_lists(df).where("e = 0").collect()][:2] == [[1.0, 3.0], [4.0]]
    pix = spark.createDataFrame([([0, 255, 51, 255, 255, 51],)], "pixels array<int>")
    r = stats.channel_stats(pix).first()
    assert r["min"] == [0, 1, 0.2] and r["max"] == [1, 1, 0.2] and r["mean"] == pytest.approx([0.5, 1, 0.2]) and r["std"] == pytest.approx([0.5, 0, 0]) and r["count"] == 1
    assert stats.reshaped({"min": 0, "count": 4}, 2) == {"min": [[[0]], [[0]]], "count": [4]}


def test_assembly(spark):
    a = spark.createDataFrame([(k * S, float(k), [float(k)]) for k in range(6)], "synched_timestamp_ns long, v double, l array<double>")
    b = spark.createDataFrame([(k * S, k) for k in range(1, 6)], "synched_timestamp_ns long, index int")
    features = [ep.Feature("f", "/a", "/l/0"), ep.Feature("cam", "/b", kind="video")]
    parts = ep.projected({"/a": a, "/b": b}, features)
    seg = spark.createDataFrame([(0, 0.0, 2.0), (1, 4.0, 9.0), (2, 50.0, 60.0)], "segment_index int, start_s double, end_s double")
    kept = ep.overlapping(seg, ep.synced_range(parts))
    assert sorted(r.segment_index for r in kept.collect()) == [0, 1]
    frames = ep.annotated(ep.assembled(parts, kept), ["segment_index"], ["synched_timestamp_ns"], F.lit(3), F.lit(True))
    rows = ep.numbered(frames, ["segment_index"], ["synched_timestamp_ns"], ["segment_index"], 0.5).orderBy("index").collect()
    assert [(r.segment_index, r.f, r.image_index_cam, r["next.done"], r.frame_index, r["index"], r.episode_index, r.timestamp) for r in rows] == [
        (0, 1.0, 1, False, 0, 0, 0, 0.0), (0, 2.0, 2, True, 1, 1, 0, 0.5), (1, 4.0, 4, False, 0, 2, 1, 0.0), (1, 5.0, 5, True, 1, 3, 1, 0.5)]
    with pytest.raises(TransformError, match="missing topics"):
        ep.projected({"/a": a}, features)
    assert ep.length_check(a, [ep.Feature("l", "/a", "/l", names=("x", "y"))]) == ["l: 6 rows don't have 2 elements"]
    assert ep.frame_spacing(a).first()[:] == (1.0, 1)
    assert ep.registered_tasks(["a", "b", "a"], "c") == {"a": 0, "b": 1, "c": 2}


def test_merge(spark):
    tasks = spark.createDataFrame([(0, 0, "pick"), (0, 1, "place"), (1, 0, "place"), (1, 1, "push")], "source long, task_index long, task string")
    assert {r.task: r.global_task_index for r in merge.global_tasks(tasks).collect()} == {"pick": 0, "place": 1, "push": 2}
    assert {(r.source, r.task_index): r.global_task_index for r in merge.task_map(tasks).collect()} == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    eps = spark.createDataFrame([(0, 0, 100), (0, 1, 200), (1, 0, 5)], "source long, episode_index long, length long")
    assert [r.frame_offset for r in merge.renumbered(eps).orderBy("new_episode_index").collect()] == [0, 100, 300]
    frames = spark.createDataFrame([(1, 0, 0), (1, 1, -1), (1, 2, 9)], "source long, frame_index long, task_index long")
    out = merge.remapped(frames, merge.task_map(tasks), ["task_index"]).orderBy("frame_index").collect()
    assert [r.task_index for r in out] == [1, -1, 9]
    with pytest.raises(TransformError):
        merge.check_compatible([{"fps": 30, "features": {}}, {"fps": 10, "features": {}}])
    assert merge.totals(eps, tasks, 2).first()[:] == (3, 305, 3, 6, 1)


def test_names(spark):
    df = spark.createDataFrame([("/a/b/image/compressed", "x/CompressedImage"), ("/d/compressedDepth", "x/CompressedImage"), ("/i", "sensor_msgs/Image"), ("/p", "sensor_msgs/PointCloud2"), ("/j", "sensor_msgs/JointState")], "t string, k string")
    assert [r.r for r in df.select(naming.route(F.col("t"), F.col("k")).alias("r")).collect()] == ["compressed_image", "compressed_depth", "image", "point_cloud", "plain"]
    r = df.select(naming.camera_info_topic(F.col("t")).alias("c"), naming.file_stem(F.col("t")).alias("s")).first()
    assert r.c == "/a/b/camera_info" and r.s == "a__b__image__compressed"
