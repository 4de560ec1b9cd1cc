"""Media settings and image files.

Settings of the video encoders are checked and turned into encoder arguments; running them needs
an external encoder, which is looked for when it is used.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.functions.depth import compressed_depth
from loomtide.functions.naming import file_stem_of
from loomtide.model import UUID, EncodeError

# Encoder names by codec, pixel formats and ranges of the quality settings.
RGB_CODECS = {
    "AV1": ("libsvtav1", "yuv420p", 63),
    "H264": ("libx264", "yuv420p", 51),
    "H265": ("libx265", "yuv420p", 51),
    "AV1_VAAPI": ("av1_vaapi", "nv12", 255),
    "H264_VAAPI": ("h264_vaapi", "nv12", 51),
    "H265_VAAPI": ("hevc_vaapi", "nv12", 51),
    "AV1_NVENC": ("av1_nvenc", "yuv420p", 255),
    "H264_NVENC": ("h264_nvenc", "yuv420p", 51),
    "H265_NVENC": ("hevc_nvenc", "yuv420p", 51),
}
DEPTH_CODECS = {"FFV1": ("ffv1", "gray16le"), "AV1": ("libsvtav1", "yuv420p10le"), "AV1_VAAPI": ("av1_vaapi", "p010le"), "AV1_NVENC": ("av1_nvenc", "p010le")}
SCALINGS = ("FastBilinear", "Bilinear", "Bicubic", "Lanczos", "Area", "Spline")


@dataclass(frozen=True)
class VideoConfig:
    """Settings of an RGB video."""

    fps: int = 100
    gop: int = 20
    crf: str = "34"
    scaling: str = "Bicubic"
    resize: tuple[int, int] | None = None
    codec_config: dict[str, Any] = field(default_factory=lambda: {"codec": "AV1"})

    @property
    def codec(self) -> str:
        return self.codec_config.get("codec", "AV1")

    def check(self) -> VideoConfig:
        if self.codec not in RGB_CODECS:
            raise EncodeError(f"unknown codec {self.codec!r}; there are {sorted(RGB_CODECS)}")
        if self.fps <= 0 or self.gop <= 0:
            raise EncodeError("fps and gop must be positive")
        if self.scaling not in SCALINGS:
            raise EncodeError(f"unknown scaling {self.scaling!r}")
        top = RGB_CODECS[self.codec][2]
        if not self.crf.isdigit() or not 0 <= int(self.crf) <= top:
            raise EncodeError(f"crf must be a number from 0 to {top}")
        if self.resize and (min(self.resize) <= 0 or self.resize[0] % 2 or self.resize[1] % 2):
            raise EncodeError("a resized frame has positive, even sides")
        if int(self.codec_config.get("bframes", 0)) >= self.gop:
            raise EncodeError("there must be fewer B frames than the gop has frames")
        return self

    def arguments(self) -> list[str]:
        """Encoder arguments after the input."""
        self.check()
        name, pixels, _ = RGB_CODECS[self.codec]
        quality = "-qp" if self.codec.endswith("VAAPI") else "-cq" if self.codec.endswith("NVENC") else "-crf"
        scale = ["-vf", f"scale={self.resize[0]}:{self.resize[1]}:flags={self.scaling.lower()}"] if self.resize else []
        return [*scale, "-c:v", name, "-pix_fmt", pixels, "-g", str(self.gop), quality, self.crf, "-r", str(self.fps)]


@dataclass(frozen=True)
class DepthConfig:
    """Settings of a depth video."""

    depth_max_mm: int = 4092
    fps: int = 30
    codec_config: dict[str, Any] = field(default_factory=lambda: {"codec": "FFV1"})

    def check(self) -> DepthConfig:
        codec = self.codec_config.get("codec", "FFV1")
        if codec not in DEPTH_CODECS:
            raise EncodeError(f"unknown depth codec {codec!r}; there are {sorted(DEPTH_CODECS)}")
        if self.fps <= 0 or not 0 < self.depth_max_mm <= 65535:
            raise EncodeError("fps must be positive and depth_max_mm between 1 and 65535")
        return self


def decodes_raw_depth(codec: str, pixel_format: str) -> bool:
    """Whether a depth video holds millimetres as they are, rather than ten-bit codes."""
    return codec.upper() == "FFV1" or pixel_format.startswith("gray16")


def encoder() -> str:
    found = shutil.which("ffmpeg")
    if not found:
        raise EncodeError("video encoding needs ffmpeg on the path of every executor")
    return found


REGISTRY = "rosbag_uuid string, topic string, video_path string, codec string, frame_count long, encoding_config_json string"


def folder_of(out_dir: str, uuid: str | None, topic: str) -> str:
    """Where a recording's topic has its files; payloads without a recording's uuid belong to one alone."""
    return "/".join([out_dir, *([uuid] if uuid else []), file_stem_of(topic)])


def _with_uuid(payloads: DataFrame) -> DataFrame:
    return payloads if UUID in payloads.columns else payloads.withColumn(UUID, F.lit(None).cast("string"))


def _write(path: str, data: bytes) -> None:
    """A whole file or none, under a name of its attempt until then: repeated and speculative tasks may write it, too."""
    part = f"{path}.{TaskContext.get().taskAttemptId()}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def encode_videos(payloads: DataFrame, config: VideoConfig, out_dir: str) -> DataFrame:
    """One video for each topic of each recording from its compressed frames in index order: the registry's rows.

    Frames go to the encoder as they are, one after another, so a task holds one frame at a time.
    """
    import json

    arguments = config.check().arguments()
    text = json.dumps({"fps": config.fps, "gop": config.gop, "crf": config.crf, **config.codec_config})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((n, pa.string()) for n in (UUID, "topic", "video_path", "codec")), ("frame_count", pa.int64()), ("encoding_config_json", pa.string())])
        process, at, path, part, frames = None, None, "", "", 0

        def done() -> pa.RecordBatch:
            process.stdin.close()
            if process.wait():
                raise EncodeError(f"the encoder failed on {at}")
            os.replace(part, path)
            return pa.RecordBatch.from_arrays([[c] for c in (*at, path, config.codec, frames, text)], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if (r[UUID], r["topic"]) != at:
                    if process:
                        yield done()
                    at, frames, path = (r[UUID], r["topic"]), 0, folder_of(out_dir, r[UUID], r["topic"]) + ".mp4"
                    part = f"{path}.{TaskContext.get().taskAttemptId()}.mp4"
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    process = subprocess.Popen([encoder(), "-y", "-loglevel", "error", "-f", "image2pipe", "-framerate", str(config.fps), "-i", "-", *arguments, part], stdin=subprocess.PIPE)
                process.stdin.write(r["bytes"])
                frames += 1
        if process:
            yield done()

    slim = _with_uuid(payloads).select(UUID, "topic", "index", "bytes").repartition(UUID, "topic").sortWithinPartitions(UUID, "topic", "index")
    return slim.mapInArrow(run, REGISTRY)


def write_images(payloads: DataFrame, out_dir: str) -> DataFrame:
    """Each payload as a file <out_dir>/<uuid>/<topic>/<index>.<extension> in a shared folder: (rosbag_uuid, topic, index, path)."""
    schema = pa.schema([(UUID, pa.string()), ("topic", pa.string()), ("index", pa.int64()), ("path", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                at = folder_of(out_dir, r[UUID], r["topic"])
                os.makedirs(at, exist_ok=True)
                path = f"{at}/{r['index']:06d}.{r['extension']}"
                _write(path, r["bytes"])
                rows.append({UUID: r[UUID], "topic": r["topic"], "index": r["index"], "path": path})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    slim = _with_uuid(payloads).select(UUID, "topic", F.col("index").cast("long").alias("index"), "extension", "bytes")
    return slim.mapInArrow(run, f"{UUID} string, topic string, index long, path string")


def write_depth(payloads: DataFrame, out_dir: str) -> DataFrame:
    """Each compressed depth payload as raw little-endian 16-bit millimetres, <index>.bin, in its topic's
    folder, and the topic's width and height in meta.json there: (rosbag_uuid, topic, index, path, width, height)."""
    import json

    schema = pa.schema([(UUID, pa.string()), ("topic", pa.string()), ("index", pa.int64()), ("path", pa.string()), ("width", pa.int64()), ("height", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[str, tuple[int, int]] = {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                at = folder_of(out_dir, r[UUID], r["topic"])
                os.makedirs(at, exist_ok=True)
                frame = compressed_depth(r["bytes"], r["ros_format"] or "")
                height, width = frame.shape
                _write(path := f"{at}/{r['index']}.bin", frame.astype("<u2").tobytes())
                if told.setdefault(at, (0, 0)) != (width, height):
                    told[at] = width, height
                    _write(f"{at}/meta.json", json.dumps({"width": width, "height": height}).encode())
                rows.append({UUID: r[UUID], "topic": r["topic"], "index": r["index"], "path": path, "width": width, "height": height})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    deep = _with_uuid(payloads).where(F.lower("ros_format").contains("compresseddepth"))
    slim = deep.select(UUID, "topic", F.col("index").cast("long").alias("index"), "ros_format", "bytes")
    return slim.mapInArrow(run, f"{UUID} string, topic string, index long, path string, width long, height long")
