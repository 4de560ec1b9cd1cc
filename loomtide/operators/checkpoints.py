"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark import SparkContext
from pyspark.sql import DataFrame


def collect_garbage(sc: SparkContext) -> bool:
    """Collects the driver's garbage if its heap has grown beyond half of its maximum; whether it did.

    Steps leave behind what Spark knew of their tasks and shuffles. The JVM may grow its heap to the
    maximum rather than collect that; a full collection gives most of it back, and lets Spark drop
    shuffles that nothing refers to any more.
    """
    runtime = sc._jvm.java.lang.Runtime.getRuntime()
    grown = 2 * runtime.totalMemory() > runtime.maxMemory()
    if grown:
        runtime.gc()
    return grown


def checkpointed(df: DataFrame) -> DataFrame:
    """df read back from the folder in spark.checkpoint.dir, which the driver and all executors share.

    Where it is unset, a session whose executors are threads of the driver (as in tests) gets a
    temporary folder; on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    out = df.checkpoint()
    if sc.master.partition("[")[0] != "local":  # there the heap is that of the executors too
        collect_garbage(sc)
    return out
