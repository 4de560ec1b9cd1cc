"""Stages that are configured by name, as in pipeline files, and pipelines of them.

A stage is a dataclass with run(recording) -> recording. Its registered name is the one that
pipeline files use.
"""

from __future__ import annotations

import json
import uuid as uuids
from collections.abc import Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomtide.model import EncodeError, EnrichError, IngestError, Recording, RecordingError, TransformError
from loomtide.operators import commands, shift, sync, tf
from loomtide.operators.episodes import Feature
from loomtide.sinks import media, training_set
from loomtide.sources import bundles, recordings

STAGES: dict[str, type] = {}


def stage(name: str):
    """Registers a stage class under a name of pipeline files."""

    def put(cls):
        STAGES[name] = cls
        cls.stage_name = name
        return cls

    return put


@dataclass
class Stage:
    """Base of all stages; build() is there for code that builds configurations before it runs them."""

    def build(self) -> Stage:
        self.check()
        return self

    def check(self) -> None:
        """Raises on settings that can't work."""

    def run(self, recording: Recording, spark: SparkSession | None = None, source: str | None = None) -> Recording:
        raise NotImplementedError


def _session(spark: SparkSession | None) -> SparkSession:
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RecordingError("there is no active Spark session")
    return spark


@dataclass
class _Ingest(Stage):
    require_metadata: bool = True
    staging_dir: str | None = None

    def ingest(self, path: str | Sequence[str], spark: SparkSession | None = None) -> Recording:
        paths = [path] if isinstance(path, str) else list(path)
        return recordings.ingest(_session(spark), paths, self.require_metadata, self.staging_dir)

    def run(self, recording, spark=None, source=None):
        if source is None:
            raise IngestError("an ingest stage needs an input")
        return self.ingest(source, spark)


@stage("Rosbag2IngestorConfig")
@dataclass
class McapIngest(_Ingest):
    """MCAP recordings."""


@stage("Rosbag1IngestorConfig")
@dataclass
class BagIngest(_Ingest):
    """Version 2.0 bags."""


@stage("ParquetVideoIngestorConfig")
@dataclass
class BundleIngest(Stage):
    """A bundle, at input_dir or at the pipeline's input."""

    input_dir: str | None = None

    def run(self, recording, spark=None, source=None):
        path = self.input_dir or source
        if path is None:
            raise IngestError("a bundle stage needs an input")
        return bundles.read_bundle(_session(spark), path)


@dataclass
class _GridSync(Stage):
    fps: float = 30
    method = "zero_order_hold"

    def check(self):
        sync.step_ns(self.fps)

    def synchronize(self, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        return sync.synchronize(tables, self.fps, self.method)

    def run(self, recording, spark=None, source=None):
        return recording.with_tables(self.synchronize(recording.tables), fps=self.fps)


@stage("ZeroOrderHoldTimeSynchronizerConfig")
@dataclass
class HoldSync(_GridSync):
    """The last row at each grid time."""


@stage("NearestNeighborTimeSynchronizerConfig")
@dataclass
class NearestSync(_GridSync):
    """The nearest row at each grid time."""

    method = "nearest_neighbor"


@stage("TimestampMergeTimeSynchronizerConfig")
@dataclass
class MergeSync(Stage):
    """Every timestamp of every topic."""

    def synchronize(self, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        return sync.merge_timestamps(tables)

    def run(self, recording, spark=None, source=None):
        return recording.with_tables(self.synchronize(recording.tables))


@stage("TfBufferEnricherConfig")
@dataclass
class TfBuffer(Stage):
    """Complete transform rows."""

    def run(self, recording, spark=None, source=None):
        return tf.with_buffer(recording)


@stage("TfChainEnricherConfig")
@dataclass
class TfChain(Stage):
    """Relative poses of frame pairs, given as {source, target}."""

    frame_pairs: list[Mapping[str, str]] = field(default_factory=list)

    def check(self):
        if not self.frame_pairs:
            raise EnrichError("frame_pairs is empty")

    def run(self, recording, spark=None, source=None):
        return tf.with_chain(recording, [(p["source"], p["target"]) for p in self.frame_pairs])


@stage("DeltaJointPositionEnricherConfig")
@dataclass
class DeltaJoint(Stage):
    """delta_position beside position, in the named topics or all that have it."""

    topic_names: list[str] | None = None

    def enrich(self, df: DataFrame) -> DataFrame:
        return shift.delta_array(df, "position", "delta_position")

    def run(self, recording, spark=None, source=None):
        names = self.topic_names or [t for t, df in recording.tables.items() if dict(df.dtypes).get("position") == "array<double>"]
        return recording.with_tables({t: self.enrich(recording.table(t)) for t in names})


@stage("DeltaTransformEnricherConfig")
@dataclass
class DeltaTransform(Stage):
    """delta_transform beside each transform of the named topics."""

    topic_names: list[str] = field(default_factory=list)
    delta_reference_frame: str = "previous_target_frame"

    def check(self):
        if not self.topic_names:
            raise EnrichError("topic_names is empty")

    def enrich(self, df: DataFrame) -> DataFrame:
        return shift.delta_transforms(df, self.delta_reference_frame)

    def run(self, recording, spark=None, source=None):
        return recording.with_tables({t: self.enrich(recording.table(t)) for t in self.topic_names})


@stage("ShiftEnricherConfig")
@dataclass
class Shift(Stage):
    """A shifted copy of a topic; nothing happens at 0 steps or without the topic."""

    source_topic: str = ""
    output_topic: str = ""
    shift_steps: int = 0
    fill_strategy: str = "edge"

    def enrich(self, df: DataFrame) -> DataFrame:
        return shift.shifted(df, self.shift_steps, self.fill_strategy.lower())

    def run(self, recording, spark=None, source=None):
        if not self.shift_steps or self.source_topic not in recording.tables:
            return recording
        return recording.with_tables({self.output_topic: self.enrich(recording.table(self.source_topic))})


@stage("UuidEnricherConfig")
@dataclass
class Uuid(Stage):
    """rosbag_uuid on every topic: the metadata's, or a new one."""

    uuid: str | None = None

    def run(self, recording, spark=None, source=None):
        meta = recording.metadata if isinstance(recording.metadata, Mapping) else {}
        return commands.stamped(recording, self.uuid or meta.get("uuid") or str(uuids.uuid4()))


@stage("HandCommandEnricherConfig")
@dataclass
class HandCommand(Stage):
    """The gripper's command topic, if it is missing."""

    def run(self, recording, spark=None, source=None):
        return commands.with_command(recording, commands.HAND)


@stage("HeadCommandEnricherConfig")
@dataclass
class HeadCommand(Stage):
    """The head's command topic, if it is missing."""

    def run(self, recording, spark=None, source=None):
        return commands.with_command(recording, commands.HEAD)


def video_config(settings: Mapping[str, Any] | None) -> media.VideoConfig:
    given = dict(settings or {})
    if given.get("resize"):
        given["resize"] = tuple(given["resize"])
    return media.VideoConfig(**{f.name: given[f.name] for f in fields(media.VideoConfig) if f.name in given}).check()


@stage("VideoEncoderConfig")
@dataclass
class VideoEncoder(Stage):
    """Videos of image payloads; needs an encoder on every executor."""

    output_dir: str = "videos"
    video_config: Mapping[str, Any] | None = None

    def check(self):
        video_config(self.video_config)

    def run(self, recording, spark=None, source=None):
        if recording.payloads is None:
            raise EncodeError("there are no payloads to encode")
        media.encoder()
        return recording.with_tables({}, registry=media.encode_videos(recording.payloads, video_config(self.video_config), self.output_dir))


@stage("DepthVideoConfig")
@dataclass
class DepthVideo(Stage):
    """Depth video settings; needs an encoder on every executor."""

    depth_max_mm: int = 4092
    fps: int = 30
    codec_config: Mapping[str, Any] = field(default_factory=lambda: {"codec": "FFV1"})

    def check(self):
        media.DepthConfig(self.depth_max_mm, self.fps, dict(self.codec_config)).check()

    def run(self, recording, spark=None, source=None):
        self.check()
        media.encoder()
        raise EncodeError("depth videos can't be encoded without a media stack")


@stage("ImageEncoderConfig")
@dataclass
class ImageEncoder(Stage):
    """Image payloads as files."""

    output_dir: str = "images"

    def run(self, recording, spark=None, source=None):
        if recording.payloads is None:
            raise EncodeError("there are no payloads to write")
        return recording.with_tables({}, registry=media.write_images(recording.payloads, self.output_dir))


@stage("DepthImageEncoderConfig")
@dataclass
class DepthImageEncoder(Stage):
    """Compressed depth payloads as raw millimetres with their sizes; nothing happens without payloads."""

    output_dir: str = "depth"

    def run(self, recording, spark=None, source=None):
        if recording.payloads is None:
            return recording
        return recording.with_tables({}, registry=media.write_depth(recording.payloads, self.output_dir))


@stage("VideoDecoderConfig")
@dataclass
class VideoDecoder(Stage):
    """Frames of registered videos; needs a media stack."""

    def run(self, recording, spark=None, source=None):
        from loomtide.model import DecodeError

        raise DecodeError("videos can't be decoded without a media stack")


def feature_map(model: Any) -> list[Feature]:
    """Features of a robot model: a list of tagged entries, or a path of a JSON or YAML file."""
    if isinstance(model, str):
        model = load_config(model)
    entries = model.get("features", model.get("map", [])) if isinstance(model, Mapping) else model
    out = []
    for entry in entries:
        kind = next((k for k in ("Parquet", "Video", "Image") if k in entry), entry.get("type", "Parquet"))
        e = entry.get(kind, entry)
        out.append(Feature(e["feature"], e["topic"], e.get("field_path", e.get("field", "")), kind.lower(), tuple(e["names"]) if e.get("names") else None, e.get("description") or ""))
    return out


@stage("LeRobotV21TransformerConfig")
@dataclass
class TrainingSet(Stage):
    """Episodes and metadata below outdir; one for each segment if separate_per_primitive."""

    outdir: str = ""
    robot_model: Any = None
    video_config: Mapping[str, Any] | None = None
    separate_per_primitive: bool = False

    def check(self):
        if not self.outdir or self.robot_model is None:
            raise TransformError("outdir and robot_model are needed")
        if self.video_config is not None:
            raise EncodeError("training sets are written without videos: leave video_config out")

    def run(self, recording, spark=None, source=None):
        self.check()
        training_set.write_training_set(_session(spark), recording, feature_map(self.robot_model), self.outdir, self.separate_per_primitive)
        return recording


@stage("ParquetVideoExporterConfig")
@dataclass
class BundleExport(Stage):
    """A bundle below output_dir/uuid, with payloads as they came."""

    output_dir: str = ""
    video_config: Mapping[str, Any] | None = None
    depth_config: Mapping[str, Any] | None = None
    single_file: bool = True

    def check(self):
        if self.video_config is not None or self.depth_config is not None:
            raise EncodeError("bundles keep payloads as they came: leave video_config and depth_config out")

    def run(self, recording, spark=None, source=None):
        self.check()
        meta = recording.metadata if isinstance(recording.metadata, Mapping) else {}
        name = meta.get("uuid") or (Path(source).stem if source else "recording")
        bundles.write_bundle(_session(spark), recording, f"{self.output_dir.rstrip('/')}/{name}", self.single_file)
        return recording


def load_config(path: str) -> Any:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RecordingError("YAML files need the yaml package; JSON works without") from e
    return yaml.safe_load(text)


def stage_of(entry: Mapping[str, Any] | str) -> Stage:
    """A stage from {name: settings} or a bare name; unknown names and settings are errors."""
    (name, settings), = ({entry: {}} if isinstance(entry, str) else entry).items()
    if name not in STAGES:
        raise RecordingError(f"unknown stage {name!r}; there are {sorted(STAGES)}")
    known = {f.name for f in fields(STAGES[name])}
    if extra := sorted(set(settings or {}) - known):
        raise RecordingError(f"{name} has no settings {extra}")
    return STAGES[name](**(settings or {}))


@dataclass
class Pipeline:
    """Stages in order. User code may add functions of a Recording as stages, too."""

    stages: list[Any] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        config = json.loads(text)
        return cls([stage_of(s) for s in (config["stage_configs"] if isinstance(config, Mapping) else config)])

    def build(self) -> Pipeline:
        for s in self.stages:
            if isinstance(s, Stage):
                s.check()
        return self

    def run(self, recording: Recording | None = None, spark: SparkSession | None = None, source: str | None = None, after=None) -> Recording:
        recording = recording or Recording()
        for k, s in enumerate(self.stages):
            recording = s.run(recording, spark, source) if isinstance(s, Stage) else s(recording)
            if after:
                after(k, s, recording)
        return recording


@dataclass
class Orchestrator:
    """A pipeline over many inputs, jobs of them at once; each is itself a distributed job."""

    stage_configs: list[Any]
    work_dir: str = "./work"
    save_contexts: bool = False
    stop_on_error: bool = False
    jobs: int = 1

    @classmethod
    def from_config(cls, config: Mapping[str, Any]) -> Orchestrator:
        if extra := sorted(set(config) - {f.name for f in fields(cls)}):
            raise RecordingError(f"there are no settings {extra}")
        return cls(**config)

    def _run_one(self, path: str, spark: SparkSession | None) -> Exception | None:
        def keep(k: int, s: Any, recording: Recording) -> None:
            if self.save_contexts:
                bundles.dump_tables(recording, f"{self.work_dir}/{Path(path).stem}/{k:02d}_{getattr(s, 'stage_name', 'function')}")

        try:
            Pipeline([stage_of(c) for c in self.stage_configs]).build().run(None, spark, path, keep)
        except Exception as e:  # reported for each input
            return e
        return None

    def run(self, inputs: Sequence[str], spark: SparkSession | None = None) -> dict[str, Exception | None]:
        """Each input's failure, or None. With stop_on_error no further input starts after a failure."""
        spark = _session(spark)
        results: dict[str, Exception | None] = {}
        waiting = list(inputs)
        with ThreadPoolExecutor(max(1, self.jobs)) as pool:
            running: dict[Future, str] = {}
            while waiting or running:
                while waiting and len(running) < max(1, self.jobs):
                    path = waiting.pop(0)
                    running[pool.submit(self._run_one, path, spark)] = path
                for future in wait(running, return_when=FIRST_COMPLETED).done:
                    results[running.pop(future)] = error = future.result()
                    if error is not None and self.stop_on_error:
                        waiting = []
        return {path: results[path] for path in inputs if path in results}
