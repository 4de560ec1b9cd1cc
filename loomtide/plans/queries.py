"""Queries over the sample tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.functions import depth, naming
from loomtide.functions.fieldpath import field
from loomtide.model import Recording
from loomtide.operators import asof as asof_ops
from loomtide.operators import commands, episodes, merge, metrics, payload, shift, stats, sync, tf
from loomtide.sources import metadata

HOUR = 3_600_000_000_000
DAY = 24 * HOUR
#: Time buckets of the sparse event stream, which has a row every few hours.
BUCKET = 7 * DAY
REC = ["rec"]
#: A unique order of an order's lines.
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
TOPIC = ["rec", "topic"]
# The segments that the range queries use, as (index, label, success, start, end) in seconds.
SEGMENTS = [(0, "pick", True, 1704240000.0, 1704672000.0), (1, "place", False, 1704672000.5, 1705276800.25), (2, "pick", True, 1705276800.0, 1706140800.0)]
REQUIRED = ("click", "purchase", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, topic, timestamp_ns, seq, value: the event stream as recordings with topics."""
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return read(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("rec"), F.col("event_type").alias("topic"), ns.alias("timestamp_ns"), F.col("event_id").alias("seq"), "value")


def topics_grid(ev: DataFrame, step: int = HOUR, keep_start: bool = False) -> DataFrame:
    return sync.topics_grid(ev, REC, step, keep_start=keep_start)


def r6(c: Column | str) -> Column:
    """Rounded to six digits, in doubles: F.round would go through decimal numbers."""
    return F.rint((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6


def topic_catalog(spark, sf_dir):
    return sync.topic_catalog(events(spark, sf_dir), REC)


def timeline_bounds(spark, sf_dir):
    return sync.bounds(events(spark, sf_dir), REC)


def timeline_grid(spark, sf_dir):
    return sync.grid(sync.bounds(events(spark, sf_dir), REC), HOUR)


def sync_zoh(spark, sf_dir):
    ev = events(spark, sf_dir)
    held = sync.hold(topics_grid(ev, HOUR, True), ev, TOPIC, ["seq"], step=HOUR, bucket_ns=BUCKET)
    return held.select("rec", "topic", "synched_timestamp_ns", F.col("row.timestamp_ns").alias("timestamp_ns"), F.col("row.seq").alias("seq"), F.col("row.value").alias("value"), "is_fresh")


def sync_nearest(spark, sf_dir):
    ev = events(spark, sf_dir)
    near = sync.nearest(topics_grid(ev), ev, TOPIC, ["seq"], bucket_ns=BUCKET)
    return near.select("rec", "topic", "synched_timestamp_ns", F.col("row.timestamp_ns").alias("timestamp_ns"), F.col("row.value").alias("value"), "is_fresh")


def sync_timestamp_merge(spark, sf_dir):
    held = sync.merged(events(spark, sf_dir), REC, seq=["seq"], bucket_ns=BUCKET)
    return held.select("rec", "topic", "synched_timestamp_ns", F.col("row.timestamp_ns").alias("timestamp_ns"), F.col("row.value").alias("value"))


def asof_forward(spark, sf_dir):
    ev = events(spark, sf_dir)
    found = asof_ops.asof(topics_grid(ev, DAY), ev, TOPIC, "synched_timestamp_ns", "timestamp_ns", ["seq"], ("forward",), BUCKET)
    return found.select("rec", "topic", "synched_timestamp_ns", F.col("forward.timestamp_ns").alias("timestamp_ns"), F.col("forward.value").alias("value"))


def sync_excluded_rows(spark, sf_dir):
    return sync.excluded_rows(events(spark, sf_dir), REC)


def _shift(steps: int, fill: str):
    def query(spark, sf_dir):
        ev = events(spark, sf_dir)
        return shift.shifted(ev, steps, fill, TOPIC, ["timestamp_ns", "seq"], ["value"])

    return query


def delta_array(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("position"))
    d = shift.delta_array(e, "position", "delta_position", ["label"], ["vec_id"])
    return d.select("vec_id", F.posexplode("delta_position").alias("pos", "d")).withColumn("d", r6("d") + 0.0)


def poses(spark, sf_dir) -> DataFrame:
    """A pose for each line of an order, turned about z by half an angle that its discount gives."""
    half = F.col("l_discount") * 5 + F.col("l_linenumber") * 0.7
    t = F.struct(F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), F.col("l_discount").alias("z"))
    q = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.sin(half).alias("z"), F.cos(half).alias("w"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", *LINE, F.struct(t.alias("translation"), q.alias("rotation")).alias("transform"))


def _delta_transform(frame: str):
    def query(spark, sf_dir):
        d = shift.delta_transforms(poses(spark, sf_dir), frame, ["l_orderkey"], LINE)
        dt = F.col("delta_transform")
        parts = {f"t{n}": dt["translation"][n] for n in "xyz"} | {f"r{n}": dt["rotation"][n] for n in "xyzw"}
        return d.select("l_orderkey", "l_linenumber", *((r6(c) + 0.0).alias(n) for n, c in parts.items()))

    return query


def tf_messages(spark, sf_dir) -> DataFrame:
    """The event stream as transform messages: a child frame for each event type."""
    zero = F.lit(0.0)
    t = F.struct(
        F.struct(F.lit("base").alias("frame_id")).alias("header"),
        F.col("topic").alias("child_frame_id"),
        F.struct(F.struct(F.col("value").alias("x"), zero.alias("y"), zero.alias("z")).alias("translation"), F.struct(zero.alias("x"), zero.alias("y"), zero.alias("z"), F.lit(1.0).alias("w")).alias("rotation")).alias("transform"),
    )
    return events(spark, sf_dir).where("value is not null").select("rec", "timestamp_ns", F.array(t).alias("transforms"))


def tf_buffer(spark, sf_dir):
    rows = tf.buffer(tf_messages(spark, sf_dir), None, REC, BUCKET)
    flat = rows.select("rec", "timestamp_ns", F.explode("transforms").alias("t"))
    return flat.select("rec", "timestamp_ns", "t.child_frame_id", F.col("t.transform.translation.x").alias("x"), "t.is_fresh")


def tf_chain(spark, sf_dir):
    """A tree base -> arm -> hand and base -> eye; the hand seen from the eye."""
    p = poses(spark, sf_dir).withColumn("timestamp_ns", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    pose = F.col("transform")
    still = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("w"))
    shifted = lambda x: F.struct(F.struct(F.lit(x).alias("x"), F.lit(0.5).alias("y"), F.lit(0.0).alias("z")).alias("translation"), still.alias("rotation"))
    edge = lambda parent, child, t, fresh: F.struct(F.lit(child).alias("child_frame_id"), F.struct(F.lit(parent).alias("frame_id")).alias("header"), t.alias("transform"), F.lit(fresh).alias("is_fresh"))
    rows = p.select("timestamp_ns", F.array(edge("base", "arm", pose, False), edge("arm", "hand", shifted(1.0), True), edge("base", "eye", shifted(-2.0), False)).alias("transforms"))
    out = tf.chain(rows, [("eye", "hand"), ("hand", "base")])
    parts = {"tx": "eye.hand.transform.translation.x", "ty": "eye.hand.transform.translation.y", "tz": "eye.hand.transform.translation.z", "rz": "eye.hand.transform.rotation.z", "rw": "eye.hand.transform.rotation.w", "bx": "hand.base.transform.translation.x", "by": "hand.base.transform.translation.y"}
    return out.select("timestamp_ns", *((r6(c) + 0.0).alias(n) for n, c in parts.items()), F.col("eye.hand.is_fresh").alias("fresh"))


def uuid_stamp(spark, sf_dir):
    recording = commands.stamped(Recording({"/events": events(spark, sf_dir)}), "0b6f6e0a-recording")
    return recording.table("/events").select("rosbag_uuid", "rec", "seq", "value")


def month(ev: DataFrame) -> DataFrame:
    return sync.bounds(ev, REC)


def topic_timing_metrics(spark, sf_dir):
    ev = events(spark, sf_dir)
    out = metrics.topic_metrics(ev, month(ev), REC, REQUIRED, bucket_ns=BUCKET)
    rounded = [r6(c).alias(c) if c not in ("message_count", "first_message_timestamp_ns", "last_message_timestamp_ns") else F.col(c) for c in metrics.TIMING]
    return out.select("rec", "topic", *rounded, "is_required_topic")


def segments_frame(spark: SparkSession) -> DataFrame:
    recs = spark.range(4).select(F.col("id").alias("rec"))
    s = spark.createDataFrame(SEGMENTS, "segment_index int, segment_label string, segment_success boolean, start_s double, end_s double")
    return recs.crossJoin(s)


def segment_metrics(spark, sf_dir):
    out = metrics.segment_metrics(events(spark, sf_dir), segments_frame(spark), REC, REQUIRED, bucket_ns=BUCKET)
    return out.select("rec", "segment_index", "segment_label", "segment_success", r6("segment_duration_s").alias("segment_duration_s"), "has_all_required_topics", *(r6(c).alias(c) for c in ("minimum_required_segment_coverage_ratio", "worst_topic_max_interval_ms", "worst_topic_max_interval_over_median")))


def episode_metrics(spark, sf_dir):
    ev = events(spark, sf_dir)
    eps = spark.range(4).select(F.col("id").alias("rec"), F.lit("bake").alias("episode_label"), (F.col("id") % 2 == 0).alias("episode_success"), F.lit(0.0).alias("start_s"), (F.col("id") * 10.0).alias("end_s"))
    out = metrics.episode_metrics(metrics.topic_metrics(ev, month(ev), REC, REQUIRED, bucket_ns=BUCKET), eps, REC, len(REQUIRED))
    return out.select("rec", "episode_label", "episode_success", "episode_duration_s", "has_all_required_topics", *(r6(c).alias(c) for c in ("minimum_required_episode_coverage_ratio", "worst_topic_max_interval_ms", "worst_topic_max_interval_over_median", "worst_topic_interval_cv")))


def duration_percentile_rank(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("duration"))
    out = metrics.percentile_rank(o, "duration", ["o_orderpriority"], "percentile_rank", "group_size")
    return out.withColumn("percentile_rank", r6("percentile_rank"))


def interval_ms(spark, sf_dir):
    ev = events(spark, sf_dir)
    return metrics.intervals_ms(ev, TOPIC, bucket_ns=BUCKET).select("rec", "topic", "seq", r6("interval_ms").alias("interval_ms"))


def field_path_index(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", field("/embedding/0").alias("first"), field("/embedding/-1").alias("last"), field("/embedding/1000").alias("beyond"))


def field_path_slice(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    total = lambda p: F.aggregate(field(p), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.select("vec_id", r6(total("/embedding/1:3")).alias("s1"), r6(total("/embedding/-2:")).alias("s2"), F.size(field("/embedding/:-60")).alias("n3"), F.size(field("/embedding/70:80")).alias("n4"))


def segment_assemble(spark, sf_dir):
    ev = events(spark, sf_dir)
    held = sync.hold(topics_grid(ev, HOUR, True), ev, TOPIC, ["seq"], step=HOUR, bucket_ns=BUCKET).select("rec", "topic", "synched_timestamp_ns", F.col("row.value").alias("value"), "is_fresh")
    parts = {t: held.where(F.col("topic") == t).select("rec", "synched_timestamp_ns", F.col("value").alias(t), F.col("is_fresh").alias(f"{t}_fresh")) for t in REQUIRED}
    return episodes.assembled(parts, segments_frame(spark), REC).select("rec", "segment_index", "synched_timestamp_ns", *REQUIRED, *(f"{t}_fresh" for t in REQUIRED))


def segment_overlap(spark, sf_dir):
    ev = events(spark, sf_dir)
    ranges = ev.groupBy("rec").agg(F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))
    return episodes.overlapping(segments_frame(spark), ranges, REC)


def episode_axes(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    out = episodes.numbered(l, ["l_orderkey"], ["l_linenumber"], ["l_orderkey"], 0.1)
    return out.withColumn("timestamp", r6("timestamp"))


def next_done(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", *LINE, "l_returnflag")
    out = episodes.annotated(l, ["l_orderkey"], LINE, F.col("l_suppkey") % 10, F.col("l_returnflag") == "N")
    return out.withColumnRenamed("next.done", "next_done").drop("l_suppkey", "l_returnflag", "l_extendedprice")


def frame_spacing(spark, sf_dir):
    ev = events(spark, sf_dir)
    return episodes.frame_spacing(ev, TOPIC, "timestamp_ns").withColumn("spacing_s", r6("spacing_s"))


def scalar_stats(spark, sf_dir):
    out = stats.scalar_stats(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "count")


def list_stats(spark, sf_dir):
    out = stats.list_stats(read(spark, sf_dir, "embeddings"), "embedding", ["label"])
    flat = out.select("label", F.posexplode(F.arrays_zip("min", "max", "mean", "std", "count")).alias("pos", "s"))
    return flat.select("label", "pos", r6("s.min").alias("min"), r6("s.max").alias("max"), r6("s.mean").alias("mean"), r6("s.std").alias("std"), F.col("s.count").alias("count"))


def struct_to_list(spark, sf_dir):
    p = poses(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", stats.struct_to_list(p, "transform").alias("v")).select("l_orderkey", "l_linenumber", F.size("v").alias("n"), r6(F.get("v", F.lit(0))).alias("v0"), r6(F.get("v", F.lit(6))).alias("v6"))


def _tasks(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.groupBy((F.col("p_partkey") % 5).alias("source"), F.col("p_type").alias("task")).agg(F.min("p_partkey").alias("task_index"))


def task_dedup(spark, sf_dir):
    return merge.global_tasks(_tasks(spark, sf_dir))


def task_remap(spark, sf_dir):
    frames = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("source"), F.when(F.col("p_size") < 5, F.lit(-1).cast("long")).otherwise(F.col("p_partkey")).alias("task_index"))
    return merge.remapped(frames, merge.task_map(_tasks(spark, sf_dir)), ["task_index"])


def _episodes(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("length"))
    return o.select((F.col("l_orderkey") % 3).alias("source"), F.col("l_orderkey").alias("episode_index"), "length")


def episode_renumber(spark, sf_dir):
    return merge.renumbered(_episodes(spark, sf_dir))


def dataset_totals(spark, sf_dir):
    return merge.totals(_episodes(spark, sf_dir), _tasks(spark, sf_dir), 2)


def depth_quantize(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") / 20).cast("long").alias("mm"))
    q = l.withColumn("code", depth.quantize(F.col("mm")).cast("long"))
    return q.withColumn("back", depth.dequantize(F.col("code")).cast("long"))


def payload_index(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    return payload.indexed(p, ["host"], ["page_id"])


def topic_file_stem(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1)
    return p.select("page_id", naming.file_stem(path).alias("stem"), naming.last_segment(path).alias("last"), naming.camera_info_topic(path).alias("info"))


def payload_format(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    text = F.concat(F.element_at(F.array(*map(F.lit, ("JPEG; bgr8", "png compressed", "WebP", "h264", "rgb8; jpg"))), (F.col("doc_id") % 5 + 1).cast("int")), F.lit(" "), F.col("source"))
    return d.select("doc_id", naming.payload_format(text).alias("format"), naming.episode_name(F.col("doc_id")).alias("episode"), naming.segment_id(F.col("source"), F.col("n_chars")).alias("segment_id"))


def feature_compat(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    side = lambda bit: p.where(F.col("p_partkey") % 7 != bit).select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("dtype"), F.when(F.col("p_size") % 11 == bit, F.lit(0)).otherwise(F.col("p_size")).alias("shape"), F.lit("h264").alias("codec"), F.lit("yuv").alias("pix_fmt"))
    return merge.feature_differences(side(1), side(2))


def metadata_json(spark, sf_dir):
    """A recording's metadata for each event, two thirds of them of version 2.0, as JSON texts and back."""
    e = events(spark, sf_dir)
    part = lambda first, label: F.struct((F.col("timestamp_ns") / 1e9 + first).alias("start_time"), (F.col("timestamp_ns") / 1e9 + first + 1).alias("end_time"), label.alias("label_idx"), (F.col("seq") % 2 == 0).alias("success"))
    new = F.struct(F.lit("2.0").alias("schema_version"), F.concat(F.lit("r"), F.col("seq")).alias("uuid"), F.array("topic", F.lit("rest")).alias("labels"), F.array(part(0, F.lit(1)), part(1, (F.col("seq") % 2).cast("int"))).alias("segments"))
    old = F.struct(F.lit("1.3").alias("version"), F.concat(F.lit("r"), F.col("seq")).alias("uuid"))
    text = F.when(F.col("seq") % 3 == 0, F.to_json(old)).otherwise(F.to_json(new))
    read_back = e.select("seq", metadata.version_of(text).alias("version"), metadata.parsed(text).alias("m"))
    return read_back.select("seq", "version", "m.uuid", F.size("m.segments").alias("n_segments"), metadata.segment_label(F.col("m"), 0).alias("first"), metadata.segment_label(F.col("m"), 1).alias("second"), r6(F.get("m.segments", F.lit(1))["end_time"]).alias("end_time"))


def payload_lookup(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.col("html").cast("binary").alias("data"))
    table, side = payload.externalized(p, "data", ["host"], ["page_id"], unique=True)
    return payload.lookup(table, side, ["host"]).select("page_id", "host", "index", F.octet_length("bytes").alias("n_bytes"))


def topic_routes(spark, sf_dir):
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % 5 + 1).cast("int"))
    topic = F.concat(F.lit("/cam"), F.col("page_id").cast("string"), pick("/image/compressed", "/depth/compressedDepth", "/image_raw", "/points", "/joint_states"))
    kind = pick("sensor_msgs/msg/CompressedImage", "sensor_msgs/msg/CompressedImage", "sensor_msgs/msg/Image", "sensor_msgs/msg/PointCloud2", "sensor_msgs/msg/JointState")
    return read(spark, sf_dir, "pages").select("page_id", topic.alias("topic"), naming.route(topic, kind).alias("route"))


def task_table(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]).alias("labels"))
    return episodes.task_table(turns, ["conv_id"])


def image_shapes(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    name = F.concat(F.lit("/cam"), (F.col("p_partkey") % 50).cast("string"))
    own = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size"))
    images = p.select(F.concat(name, F.lit("/image/compressed")).alias("topic"), own.alias("height"), (own * 2).alias("width"))
    infos = p.select(F.concat(name, F.lit("/camera_info")).alias("topic"), (F.col("p_size") + 100).alias("height"), F.col("p_size").alias("width"))
    return payload.image_shapes(images, infos)


def channel_stats(spark, sf_dir):
    pixels = F.transform("embedding", lambda x: F.abs(x * 255).cast("int"))
    out = stats.channel_stats(read(spark, sf_dir, "embeddings").select("label", pixels.alias("pixels")), "pixels", ["label"], 4)
    return out.select("label", *(r6(F.get(c, F.lit(k))).alias(f"{c}{k}") for c in ("min", "max", "mean", "std") for k in range(4)), "count")


def command_synthesis(spark, sf_dir):
    ev = events(spark, sf_dir).withColumnRenamed("rec", "rosbag_uuid")
    nothing = "array<struct<positions:array<double>,velocities:array<double>,accelerations:array<double>,effort:array<double>,time_from_start:struct<sec:int,nanosec:bigint>>>"
    template = ev.where("topic = 'click'").select("rosbag_uuid", "timestamp_ns", "seq", F.array().cast("array<string>").alias("joint_names"), F.array().cast(nothing).alias("points"))
    state = ev.where("topic = 'view'").select("rosbag_uuid", "timestamp_ns", F.array("value", F.col("seq").cast("double")).alias("position"))
    made = commands.constant_command(template, state, commands.CommandSpec("/c", "/s", "position", (1, 0), ("a", "b"), "/t"))
    point = F.get("points", F.lit(0))["positions"]
    return made.select(F.col("rosbag_uuid").alias("rec"), "timestamp_ns", "seq", F.get(point, F.lit(0)).alias("p0"), F.get(point, F.lit(1)).alias("p1"), F.array_join("joint_names", ",").alias("joints"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "topic_catalog": topic_catalog,
    "timeline_bounds": timeline_bounds,
    "timeline_grid": timeline_grid,
    "sync_zoh": sync_zoh,
    "sync_nearest": sync_nearest,
    "sync_timestamp_merge": sync_timestamp_merge,
    "asof_forward": asof_forward,
    "sync_excluded_rows": sync_excluded_rows,
    "shift_future_edge": _shift(2, "edge"),
    "shift_past_edge": _shift(-3, "edge"),
    "shift_zero": _shift(1, "zero"),
    "delta_array": delta_array,
    "delta_transform_source": _delta_transform("source_frame"),
    "delta_transform_target": _delta_transform("previous_target_frame"),
    "tf_buffer": tf_buffer,
    "tf_chain": tf_chain,
    "uuid_stamp": uuid_stamp,
    "interval_ms": interval_ms,
    "topic_timing_metrics": topic_timing_metrics,
    "segment_metrics": segment_metrics,
    "episode_metrics": episode_metrics,
    "duration_percentile_rank": duration_percentile_rank,
    "field_path_index": field_path_index,
    "field_path_slice": field_path_slice,
    "segment_assemble": segment_assemble,
    "segment_overlap": segment_overlap,
    "episode_axes": episode_axes,
    "next_done": next_done,
    "frame_spacing": frame_spacing,
    "scalar_stats": scalar_stats,
    "list_stats": list_stats,
    "struct_to_list": struct_to_list,
    "task_dedup": task_dedup,
    "task_remap": task_remap,
    "episode_renumber": episode_renumber,
    "dataset_totals": dataset_totals,
    "depth_quantize": depth_quantize,
    "payload_index": payload_index,
    "payload_lookup": payload_lookup,
    "topic_routes": topic_routes,
    "task_table": task_table,
    "image_shapes": image_shapes,
    "channel_stats": channel_stats,
    "command_synthesis": command_synthesis,
    "topic_file_stem": topic_file_stem,
    "payload_format": payload_format,
    "feature_compat": feature_compat,
    "metadata_json": metadata_json,
}
