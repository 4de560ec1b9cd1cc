"""Containers, decoding, bundles, metadata, depth, data sets, stages and the command line."""

import io
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtide.__main__ import main
from loomtide.functions import depth
from loomtide.model import DecodeError, EncodeError, IngestError, Recording, RecordingError
from loomtide.operators import payload
from loomtide.plans.stages import STAGES, DepthImageEncoder, ImageEncoder, Orchestrator, Pipeline, stage_of
from loomtide.sinks import media
from loomtide.sources import bundles, containers, discovery, metadata
from loomtide.sources.messages import decode, encode
from loomtide.sources.recordings import ingest
from loomtide.sources.schema_text import parse_definitions, parse_fields, struct_type

# Message definitions and metadata keys are those of the formats.
SEP = "\n" + "=" * 80 + "\n"
JOINT = "# state\nstd_msgs/Header header\nstring[] name\nfloat64[] position\nfloat64[] velocity\nfloat64[] effort" + SEP + "MSG: std_msgs/Header\nbuiltin_interfaces/Time stamp\nstring frame_id"
IMAGE = "string format\nuint8[] data"
ODD = "uint8 A=3\nbool b\nint8 c\nuint16 d\nint64 e\nfloat32[2] f\nstring<=10 s\nchar g\nInner[] inner\nduration t" + SEP + "MSG: pkg/Inner\nuint8 k\nfloat64 v"


def joint(i):
    return {"header": {"stamp": {"sec": i, "nanosec": 5}, "frame_id": "f"}, "name": ["j1", "j2"], "position": [3.0 + i, 0.5 * i * i], "velocity": [0.0, 0.0], "effort": []}


def recording_messages(n=10, encoding="cdr"):
    j, c = parse_definitions("sensor_msgs/msg/JointState", JOINT), parse_definitions("sensor_msgs/CompressedImage", IMAGE)
    step, out = 40_000_000, []
    for i in range(n):
        out.append(containers.Message("/joint_states", "sensor_msgs/msg/JointState", JOINT, encoding, 1_000_000_000 + i * step, None if encoding == "ros1" else 7 + i, encode(j, joint(i), encoding)))
        out.append(containers.Message("/cam/compressed", "sensor_msgs/CompressedImage", IMAGE, encoding, 1_000_000_001 + i * step, None, encode(c, {"format": "jpeg", "data": list(bytes([i] * 3))}, encoding)))
    return out


META = {"schema_version": "2.0", "uuid": "u1", "robot": {"type": "arm", "id": "r1"}, "files": [{"type": "mcap", "name": "a.mcap"}], "environment": {"type": "real_world", "site": "lab", "location": ""}, "runner": {"type": "operator", "organization": "", "name": "n"}, "devices": [], "programs": [{"role": r, "name": r, "source": {"git": {"uri": "u", "hash": "h", "branch": "b", "tag": None}}} for r in ("interface", "data_collection")], "episode": {"start_time": 1.0, "end_time": 1.3, "success": True, "label": "all"}, "labels": ["pick", "place"], "segments": [{"start_time": 1.0, "end_time": 1.11, "label_idx": 0, "success": True}, {"start_time": 1.12, "end_time": 1.3, "label_idx": 1, "success": False}]}


@pytest.fixture
def mcap(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    with open(d / "a.mcap", "wb") as f:
        containers.write_mcap(f, recording_messages(), "zstd")
    (d / "meta.json").write_text(json.dumps(META))
    return str(d / "a.mcap")


@pytest.mark.parametrize("encoding", ["cdr", "ros1"])
def test_decode_round_trip(encoding):
    defs = parse_definitions("pkg/Odd", ODD)
    value = {"b": True, "c": -3, "d": 65535, "e": -(2**60), "f": [1.5, -2.0], "s": "hé", "g": 200, "inner": [{"k": 1, "v": 2.5}, {"k": 2, "v": -1.0}], "t": {"sec": -1, "nanosec": 5}}
    assert decode(defs, encode(defs, value, encoding), encoding) == value
    with pytest.raises(IngestError):
        decode(defs, encode(defs, value, encoding)[:-9], encoding)
    names = dict((f.name, f.dataType.simpleString()) for f in struct_type(defs).fields)
    assert names["d"] == "bigint" and names["g"] == "smallint" and names["inner"] == "array<struct<k:smallint,v:double>>"


def test_big_endian():
    defs = parse_definitions("p/M", "uint8 a\nint32 b")
    assert decode(defs, b"\0\0\0\0" + b"\1\0\0\0" + struct.pack(">i", -5), "cdr") == {"a": 1, "b": -5}


def test_field_lines():
    assert [(f.name, f.type, f.array) for f in parse_fields("int32 X=1\n\n# c\nfloat64[<=3] a # x\nstring[4] b\nstring S = \"a # b\"")] == [("a", "float64", -1), ("b", "string", 4)]
    with pytest.raises(IngestError):
        parse_fields("nonsense")
    with pytest.raises(IngestError):
        parse_definitions("a/B", "int32 x" + SEP + "oops")


@pytest.mark.parametrize(("write", "read", "kinds"), [(containers.write_mcap, containers.read_mcap, ["", "zstd"]), (containers.write_bag, containers.read_bag, ["none", "bz2"])])
def test_containers(write, read, kinds):
    want = recording_messages(4, "ros1" if "bz2" in kinds else "cdr")
    for kind in kinds:
        f = io.BytesIO()
        write(f, want, kind)
        f.seek(0)
        got = list(read(f))
        assert [(m.topic, m.log_time, m.data) for m in got] == [(m.topic, m.log_time, m.data) for m in want]
    with pytest.raises(IngestError):
        list(read(io.BytesIO(b"x" * 40)))


def test_ingest(spark, mcap, tmp_path):
    for staging in (None, str(tmp_path / "staging")):
        r = ingest(spark, [mcap], True, staging)
        rows = r.table("/joint_states").orderBy("timestamp_ns").collect()
        assert len(rows) == 10 and rows[3].position == [6.0, 4.5] and rows[3].publish_timestamp_ns == 10 and rows[3].rosbag_uuid == "u1" and rows[3].header.stamp.sec == 3
        cam = r.table("/cam/compressed")
        assert "data" not in cam.columns and [x["index"] for x in cam.orderBy("timestamp_ns").collect()] == list(range(10))
        p = r.payloads.orderBy("index").collect()
        assert bytes(p[4]["bytes"]) == b"\4\4\4" and p[4].extension == "jpg" and r.metadata["uuid"] == "u1"
    with pytest.raises(IngestError):
        bare = tmp_path / "b.mcap"
        bare.write_bytes(open(mcap, "rb").read())
        ingest(spark, [str(bare)], True)


def test_bag_ingest(spark, tmp_path):
    with open(tmp_path / "a.bag", "wb") as f:
        containers.write_bag(f, recording_messages(3, "ros1"), "bz2")
    r = ingest(spark, [str(tmp_path / "a.bag")])
    assert [x.publish_timestamp_ns for x in r.table("/joint_states").collect()] == [None] * 3 and r.payloads.count() == 3


def test_bundle_round_trip(spark, mcap, tmp_path):
    r = ingest(spark, [mcap])
    bundles.write_bundle(spark, r, str(tmp_path / "out/u1"), True)
    back = bundles.read_bundle(spark, str(tmp_path / "out/u1"))
    assert set(back.tables) == set(r.tables) and back.metadata["labels"] == ["pick", "place"] and back.metadata["episode"]["end_time"] == 1.3
    assert sorted(map(str, back.table("/joint_states").collect())) == sorted(map(str, r.table("/joint_states").select(*back.table("/joint_states").columns).collect()))
    assert discovery.bundles([tmp_path]) == [str(tmp_path / "out/u1")]
    images = lambda x: sorted((p.rosbag_uuid, p.topic, p["index"], p.extension, bytes(p["bytes"])) for p in x.payloads.collect())
    assert images(back) == images(r) and len(images(r)) == 10 and images(r)[7][4] == b"\7\7\7"
    shown = payload.lookup(back.table("/cam/compressed"), back.payloads.drop("topic", "extension", "ros_format"), ["rosbag_uuid"])
    assert shown.where("bytes is null").count() == 0 and shown.count() == 10
    bundles.dump_tables(r, str(tmp_path / "dump"))
    assert set(bundles.load_tables(spark, str(tmp_path / "dump"))) == set(r.tables)
    (tmp_path / "dump/bad.parquet").write_bytes(b"no")
    assert set(bundles.load_tables(spark, str(tmp_path / "dump"), True)) == set(r.tables)


def test_arrow_tables_and_unsigned_longs(spark, tmp_path):
    import pyarrow.parquet as pq

    t = pa.table({"timestamp_ns": pa.array([1, 2], pa.uint64()), "v": [1.0, 2.0]})
    pq.write_table(t, tmp_path / "t.parquet")
    assert dict(bundles.read_table(spark, str(tmp_path / "t.parquet")).dtypes)["timestamp_ns"] == "bigint"
    assert bundles.from_tables(spark, {"/t": pa.table({"v": [1]})}).table("/t").count() == 1
    assert bundles.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert [r.a for r in bundles.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == [1, 2]


def old_metadata(numbers, composite):
    return {"uuid": "u", "version": "1.3", "files": [{"type": "rosbag", "name": "d"}], "context": {"entities": [{"role": "robot", "id": "r2"}, {"role": "location", "name": "site"}, {"role": "controller", "name": "pad"}], "components": [{"role": "interface", "name": "i", "source": {"git": {"uri": "u", "hash": "h", "branch": "b"}}}]}, "run": {"episode_label": "e", "instructions": [{"idx": n, "text": [f"t{k}"]} for k, n in enumerate(numbers)], "segments": [{"start_time": 0.0, "end_time": 1.0, "instruction_idx": numbers[0], "success": True}, {"start_time": 1.0, "end_time": 2.0, "instruction_idx": numbers[1], "success": False}, *([{"start_time": 0.0, "end_time": 2.0, "instruction_idx": composite, "success": True, "is_composite": True}] if composite is not None else [])]}}


def test_metadata_upgrade(spark):
    new = metadata.parse(json.dumps(old_metadata([3, 5, 7], 7)))
    assert new["episode"] == {"start_time": 0.0, "end_time": 2.0, "success": True, "label": "t2"} and new["labels"] == ["t0", "t1", "t2"]
    assert [s["label_idx"] for s in new["segments"]] == [0, 1] and new["robot"]["id"] == "r2" and new["environment"]["site"] == "site" and new["devices"] == [{"role": "controller", "type": "pad", "id": ""}]
    plain = metadata.upgrade(old_metadata([0, 1], None))
    assert plain["episode"] == {"start_time": 0.0, "end_time": 2.0, "success": False, "label": "e"}
    shared = metadata.upgrade(old_metadata([0, 1, 1], 1))
    assert shared["episode"]["label"] == "t2" and [s["label_idx"] for s in shared["segments"]] == [0, 1]
    with pytest.raises(IngestError):
        metadata.upgrade(old_metadata([0, 0, 1], 1))
    with pytest.raises(IngestError):
        metadata.detect_version({"version": "3"})
    df = metadata.to_frame(spark, [new])
    assert metadata.from_frame(df)["segments"] == new["segments"]
    with pytest.raises(IngestError):
        metadata.from_frame(df.union(df))
    with pytest.raises(IngestError):
        metadata.validate({**new, "labels": []})


def test_typed_metadata():
    m = metadata.typed(META)
    assert m.programs[0].source.git.hash == "h" and m.segments[1].label_idx == 1 and m.robot.uri is None
    assert metadata.typed(m.plain()) == m and metadata.typed(metadata.parse(json.dumps(old_metadata([3, 5, 7], 7)))).episode.label == "t2"
    for bad in ({"robot": None}, {"robot": {"id": "x"}}, {"episode": {**META["episode"], "success": "yes"}}, {"segments": [{"start_time": 0.0}]}):
        with pytest.raises((IngestError, KeyError)):
            metadata.typed({**META, **bad})


def png16(a, kind):
    h, w = a.shape
    raw, above = b"", np.zeros(2 * w, dtype=int)
    for y in range(h):
        line = np.frombuffer(a[y].astype(">u2").tobytes(), dtype=np.uint8).astype(int)
        left = np.concatenate([[0, 0], line[:-2]])
        corner = np.concatenate([[0, 0], above[:-2]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        raw, above = raw + bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes(), line
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_depth(spark):
    rng = np.random.default_rng(0)
    frame = (rng.integers(0, 5000, (6, 7)) * (rng.random((6, 7)) > 0.4)).astype(np.uint16)
    assert (depth.rvl_decode(depth.rvl_encode(frame), 42) == frame.reshape(-1)).all()
    for kind in range(5):
        assert (depth.png16_decode(png16(frame, kind)) == frame).all()
    rvl = b"\0" * 12 + struct.pack("<II", 7, 6) + depth.rvl_encode(frame)
    rows = [(rvl, "16UC1; compressedDepth RVL"), (b"\0" * 12 + png16(frame, 4), "16UC1; compressedDepth png"), (None, None)]
    df = spark.createDataFrame(rows, "b binary, f string")
    out = [r.d for r in df.select(depth.decode_depth("b", "f").alias("d")).collect()]
    assert out[0] == out[1] == frame.reshape(-1).tolist() and out[2] is None
    with pytest.raises(DecodeError):
        depth.compressed_depth(rvl, "32FC1; compressedDepth")
    with pytest.raises(DecodeError):
        depth.rvl_decode(b"\0\0\0\0", 500)
    q = spark.createDataFrame([(v,) for v in (0, 1, 4092, 4093, None)], "mm int").select(depth.quantize(F.col("mm")).alias("q"))
    assert [r.q for r in q.collect()] == [0, 1, 1023, 0, None]
    d = spark.createDataFrame([(0,), (1,), (1023,)], "q int").select(depth.dequantize(F.col("q")).alias("d"))
    assert [r.d for r in d.collect()] == [0, 4, 4092]
    p = spark.createDataFrame([([1, 1023],)], "q array<int>").select(depth.p010le("q").alias("p")).first().p
    assert bytes(p) == struct.pack("<HHH", 64, 1023 << 6, 0x8000)


def test_payloads(spark):
    df = spark.createDataFrame([("a", 2, b"y"), ("a", 1, b"x"), ("b", 1, b"z")], "topic string, timestamp_ns long, data binary")
    table, side = payload.externalized(df, "data", ["topic"], ["timestamp_ns"])
    assert sorted((r.topic, r["index"], bytes(r["bytes"])) for r in payload.lookup(table, side, ["topic"]).collect()) == [("a", 0, b"x"), ("a", 1, b"y"), ("b", 0, b"z")]
    images = spark.createDataFrame([("/c/image/compressed", None, None), ("/d/image/raw", 4, 5)], "topic string, height int, width int")
    infos = spark.createDataFrame([("/c/camera_info", 10, 20), ("/d/camera_info", 9, 9)], "topic string, height int, width int")
    assert {r.topic[1]: (r.height, r.width) for r in payload.image_shapes(images, infos).collect()} == {"c": (10, 20), "d": (4, 5)}


def test_images_of_two_recordings(spark, mcap, tmp_path):
    with open(tmp_path / "b.mcap", "wb") as f:
        containers.write_mcap(f, [m for m in recording_messages(4) if m.topic == "/cam/compressed"], "")
    both = ingest(spark, [mcap, str(tmp_path / "b.mcap")])
    out = ImageEncoder(str(tmp_path / "img")).run(both).registry.collect()
    assert len(out) == len({r.path for r in out}) == 14 and all(open(r.path, "rb").read() == bytes([r["index"]] * 3) for r in out)
    assert not list((tmp_path / "img").rglob("*.part"))


def test_depth_files(spark, tmp_path):
    frames = [np.arange(12, dtype=np.uint16).reshape(3, 4) * k for k in (1, 300)]
    rows = [(u, "/d/compressedDepth", k, "16UC1; compressedDepth png", b"\0" * 12 + png16(f, 1)) for u in ("u1", "u2") for k, f in enumerate(frames)]
    p = spark.createDataFrame([*rows, ("u1", "/c", 0, "jpeg", b"x")], "rosbag_uuid string, topic string, index long, ros_format string, bytes binary")
    out = DepthImageEncoder(str(tmp_path / "depth")).run(Recording(payloads=p)).registry.collect()
    assert sorted((r.rosbag_uuid, r["index"], r.width, r.height) for r in out) == [(u, k, 4, 3) for u in ("u1", "u2") for k in (0, 1)]
    assert all((np.fromfile(r.path, dtype="<u2").reshape(3, 4) == frames[r["index"]]).all() for r in out)
    assert json.loads((tmp_path / "depth/u2/d__compressedDepth/meta.json").read_text()) == {"width": 4, "height": 3}
    assert DepthImageEncoder().run(Recording()).registry is None


def test_settings_without_effect_are_refused():
    for name in ("ParquetVideoExporterConfig", "LeRobotV21TransformerConfig"):
        with pytest.raises((EncodeError, RecordingError)):
            Pipeline([stage_of({name: {"video_config": {"fps": 30}, **({"outdir": "x", "robot_model": []} if name[0] == "L" else {"output_dir": "x"})}})]).build()
    with pytest.raises(RecordingError, match="no settings"):
        Orchestrator.from_config({"stage_configs": [], "workdir": "x"})


def test_inputs_at_once(spark, mcap, tmp_path):
    bad = str(tmp_path / "bad.mcap")
    open(bad, "wb").write(b"no")
    job = [{"Rosbag2IngestorConfig": {"require_metadata": False}}]
    results = Orchestrator(job, jobs=3).run([bad, mcap, bad + "x"], spark)
    assert list(results) == [bad, mcap, bad + "x"] and [e is None for e in results.values()] == [False, True, False]


def test_accessors(spark):
    r = bundles.from_tables(spark, {"/t": pa.table({"v": [1]})}).with_batches("/u", pa.table({"w": [2.0]}), spark)
    assert r.topics() == ["/t", "/u"] and r.batches("/u").to_pydict() == {"w": [2.0]} and r.message_type("/t") is None


def test_media_settings(tmp_path, spark):
    assert media.VideoConfig(codec_config={"codec": "H264_VAAPI"}, crf="21", resize=(64, 48)).arguments()[:2] == ["-vf", "scale=64:48:flags=bicubic"]
    for bad in ({"crf": "99"}, {"gop": 0}, {"resize": (3, 4)}, {"scaling": "x"}, {"codec_config": {"codec": "VP8"}}, {"codec_config": {"codec": "H264", "bframes": 20}}):
        with pytest.raises(EncodeError):
            media.VideoConfig(**bad).check()
    with pytest.raises(EncodeError):
        media.DepthConfig(depth_max_mm=0).check()
    assert media.decodes_raw_depth("ffv1", "") and media.decodes_raw_depth("x", "gray16le") and not media.decodes_raw_depth("AV1", "yuv420p10le")
    p = spark.createDataFrame([("/c", 0, "jpg", b"x")], "topic string, index long, extension string, bytes binary")
    assert [open(r.path, "rb").read() for r in media.write_images(p, str(tmp_path / "img")).collect()] == [b"x"]


MODEL = [{"Parquet": {"feature": "state", "topic": "/joint_states", "field_path": "/position", "names": ["j1", "j2"]}}, {"Parquet": {"feature": "action", "topic": "/joint_states/action", "field_path": "/position"}}]


def stages(out, per_segment=True):
    return ["Rosbag2IngestorConfig", {"ZeroOrderHoldTimeSynchronizerConfig": {"fps": 20}}, {"ShiftEnricherConfig": {"source_topic": "/joint_states", "output_topic": "/joint_states/action", "shift_steps": 1}}, {"LeRobotV21TransformerConfig": {"outdir": out, "robot_model": MODEL, "separate_per_primitive": per_segment}}]


def test_pipeline_and_merge(spark, mcap, tmp_path):
    for name, per in (("a", True), ("b", False)):
        result = Orchestrator(stages(str(tmp_path / "sets" / name), per), str(tmp_path / "work"), save_contexts=name == "a").run([mcap], spark)
        assert result == {mcap: None}
    a = tmp_path / "sets/a"
    about = json.loads((a / "meta/info.json").read_text())
    lines = [json.loads(x) for x in (a / "meta/episodes.jsonl").read_text().splitlines()]
    assert about["total_episodes"] == 2 and about["total_frames"] == 6 and about["fps"] == 20 and about["features"]["state"] == {"dtype": "float64", "shape": [2], "names": ["j1", "j2"]}
    assert [e["episode_id"] for e in lines] == ["u1:0", "u1:1"] and [e["length"] for e in lines] == [3, 3] and lines[0]["short_horizon_task"] == ["all"]
    first = spark.read.parquet(str(a / "data/chunk-000/episode_000000.parquet")).orderBy("index").collect()
    assert [r.state[0] for r in first] == [3.0, 4.0, 5.0] and [r.action[0] for r in first] == [4.0, 5.0, 6.0] and [r["next.done"] for r in first] == [False, False, True]
    figures = [json.loads(x) for x in (a / "meta/episodes_stats.jsonl").read_text().splitlines()]
    assert figures[0]["stats"]["state"]["max"] == [5.0, 2.0] and figures[0]["stats"]["state"]["count"] == [3]
    assert (tmp_path / "work/a/01_ZeroOrderHoldTimeSynchronizerConfig/joint_states.parquet").exists()
    assert main(["merge", "--output-dir", str(tmp_path / "all"), str(tmp_path / "sets")]) == 0
    merged = [json.loads(x) for x in (tmp_path / "all/meta/episodes.jsonl").read_text().splitlines()]
    assert [e["episode_index"] for e in merged] == [0, 1, 2]
    rows = spark.read.parquet(*[str(p) for p in (tmp_path / "all/data").rglob("*.parquet")])
    assert sorted(r["index"] for r in rows.collect()) == list(range(rows.count())) and (tmp_path / "all/data/chunk-000/episode_000002.parquet").exists()


@pytest.mark.parametrize("per_segment", [True, False])
def test_training_set_of_two_recordings(spark, mcap, tmp_path, per_segment):
    (tmp_path / "in2").mkdir()
    with open(tmp_path / "in2/z.mcap", "wb") as f:
        containers.write_mcap(f, recording_messages(12), "zstd")
    other = {**META, "uuid": "u2", "labels": ["place", "wipe"], "episode": {**META["episode"], "label": "clean"}}
    (tmp_path / "in2/meta.json").write_text(json.dumps(other))
    out = tmp_path / "set"
    Pipeline([stage_of(c) for c in stages(str(out), per_segment)[1:]]).run(ingest(spark, [mcap, str(tmp_path / "in2/z.mcap")]), spark)
    alone = []
    for name, path in (("one", mcap), ("two", str(tmp_path / "in2/z.mcap"))):
        Pipeline([stage_of(c) for c in stages(str(tmp_path / name), per_segment)[1:]]).run(ingest(spark, [path]), spark)
        alone += [json.loads(x) for x in (tmp_path / name / "meta/episodes.jsonl").read_text().splitlines()]
    lines = [json.loads(x) for x in (out / "meta/episodes.jsonl").read_text().splitlines()]
    tasks = {json.loads(x)["task"]: json.loads(x)["task_index"] for x in (out / "meta/tasks.jsonl").read_text().splitlines()}
    assert [e["episode_index"] for e in lines] == list(range(4 if per_segment else 2)) and tasks == {"pick": 0, "place": 1, "all": 2, "wipe": 3, "clean": 4}
    assert [{**e, "episode_index": 0} for e in lines] == [{**e, "episode_index": 0} for e in alone]
    rows = spark.read.parquet(*[str(p) for p in (out / "data").rglob("*.parquet")]).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(sum(e["length"] for e in alone))) and "rosbag_uuid" not in rows[0].asDict()
    assert {(r.episode_index, r.task_index, r.short_horizon_task_index) for r in rows} == ({(0, 0, 2), (1, 1, 2), (2, 1, 4), (3, 3, 4)} if per_segment else {(0, 0, 2), (0, 1, 2), (1, 1, 4), (1, 3, 4)})


def test_orchestrator_failures(spark, mcap, tmp_path):
    bad = str(tmp_path / "bad.mcap")
    open(bad, "wb").write(b"no")
    job = [{"Rosbag2IngestorConfig": {"require_metadata": False}}]
    both = Orchestrator(job).run([bad, mcap], spark)
    assert both[bad] is not None and both[mcap] is None
    assert list(Orchestrator(job, stop_on_error=True).run([bad, mcap], spark)) == [bad]


def test_stage_names():
    assert len(STAGES) == 21
    with pytest.raises(RecordingError):
        stage_of("NoSuchConfig")
    with pytest.raises(RecordingError):
        stage_of({"UuidEnricherConfig": {"x": 1}})
    with pytest.raises(RecordingError):
        Pipeline.from_json('{"stage_configs": [{"TfChainEnricherConfig": {}}]}').build()


def test_export_command(spark, mcap, tmp_path):
    assert main(["export", "--output-dir", str(tmp_path / "out"), mcap]) == 0
    out = Pipeline.from_json(json.dumps([{"ParquetVideoIngestorConfig": {"input_dir": str(tmp_path / "out/u1")}}, "UuidEnricherConfig", {"DeltaJointPositionEnricherConfig": {"topic_names": ["/joint_states"]}}])).build().run(Recording(), spark)
    assert [r.rosbag_uuid for r in out.table("/joint_states").select("rosbag_uuid").distinct().collect()] == ["u1"]
    assert "delta_position" in out.table("/joint_states").columns


def test_discovery(tmp_path):
    for n in ("b.mcap", "a.bag", "c.orig.bag", "d.txt"):
        (tmp_path / n).write_text("")
    assert [p[-6:] for p in discovery.recordings([tmp_path, tmp_path / "a.bag"])] == ["/a.bag", "b.mcap"]
    (tmp_path / "s2/meta").mkdir(parents=True)
    (tmp_path / "s2/meta/info.json").write_text("{}")
    assert discovery.datasets(tmp_path) == [str(tmp_path / "s2")]


def test_streams(spark, tmp_path):
    from loomtide.streaming.hold import held

    day = 86_400 * 10**9  # rows of the epoch itself are before any watermark

    spark.createDataFrame([("a", day + 1, 1.0), ("a", day + 5, 1.0), ("b", day + 2, 3.0), ("a", day + 9, 2.0)], "key string, timestamp_ns long, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, timestamp_ns long, value double").parquet(str(tmp_path / "in"))
    q = held(stream).writeStream.format("memory").queryName("held_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = sorted((r.key, r.timestamp_ns - day, r.gap_ns, r.is_fresh) for r in spark.table("held_out").collect())
    assert [(k, t, f) for k, t, _, f in got] == [("a", 1, True), ("a", 5, False), ("a", 9, True), ("b", 2, True)] and [g for _, _, g, _ in got][1:3] == [4, 4]
