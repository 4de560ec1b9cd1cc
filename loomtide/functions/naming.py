"""Topic names, file names, formats and routing as Column and plain functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_stem(topic: Column) -> Column:
    """/camera/image -> camera__image."""
    return F.regexp_replace(F.ltrim(topic, F.lit("/")), "/", "__")


def file_stem_of(topic: str) -> str:
    return topic.lstrip("/").replace("/", "__")


def last_segment(topic: Column) -> Column:
    return F.element_at(F.split(topic, "/"), -1)


def payload_format(format_text: Column) -> Column:
    """The file extension of a compressed payload's format text: jpg, png, webp or bin."""
    low = F.lower(format_text)
    return F.when(low.contains("jpeg") | low.contains("jpg"), "jpg").when(low.contains("png"), "png").when(low.contains("webp"), "webp").otherwise("bin")


def route(topic: Column, type_name: Column) -> Column:
    """How a topic's messages are decoded: compressed_image, compressed_depth, image, point_cloud or plain."""
    last = last_segment(topic)
    return (
        F.when(last == "compressedDepth", "compressed_depth")
        .when(last == "compressed", "compressed_image")
        .when(type_name.endswith("Image") & ~type_name.endswith("CompressedImage"), "image")
        .when(type_name.endswith("PointCloud2"), "point_cloud")
        .otherwise("plain")
    )


def camera_info_topic(topic: Column) -> Column:
    """The topic without its last two segments, and /camera_info."""
    parts = F.split(topic, "/")
    return F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "/"), F.lit("/camera_info"))


def episode_name(index: Column, width: int = 6) -> Column:
    """episode_000042; longer numbers keep all their digits."""
    text = index.cast("string")
    return F.concat(F.lit("episode_"), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def segment_id(uuid: Column, segment: Column) -> Column:
    return F.concat_ws(":", uuid, segment.cast("string"))


def base_feature(name: Column) -> Column:
    """A freshness feature's name without its suffix."""
    return F.regexp_replace(name, r"\.is_fresh$", "")
