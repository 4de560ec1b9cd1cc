"""A session with the settings that results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, and Arrow; further settings by keyword with _ for dots.

    The JVM never compiles methods of over 8000 bytes: generated code beyond that would be
    interpreted, so such stages run as their operators' smaller methods instead.
    """
    builder = SparkSession.builder.appName("loomtide")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
