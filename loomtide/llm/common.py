"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.operators.checkpoints import checkpointed as checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id (long) and text (string, null as empty): other columns can't clash with ours."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_hash(column: Column, buckets: int, rest: Column | None = None) -> Column:
    """crc32 of the id written as decimal text, modulo buckets."""
    return F.crc32(column.cast("string").cast("binary")) % buckets


def per_text(df: DataFrame, make: Callable[[], Callable[[list[str]], list]], fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """doc_id plus the fields that a worker function derives from whole texts, batch by batch.

    make runs once per task and gives a function from texts to a list of columns.
    """
    schema = pa.schema([("doc_id", pa.int64()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                columns = work(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], schema=schema)

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id long, {ddl}")


def slices(batch: pa.RecordBatch, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most about max_bytes of Arrow data (one row at least)."""
    rows = batch.num_rows
    step = max(1, int(rows * max_bytes / max(batch.nbytes, 1)))
    if step >= rows:
        yield batch
        return
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def text_hash(text: Column) -> Column:
    """Tells rows of one id with different texts apart (null: empty)."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def one_of_each(df: DataFrame, classes: DataFrame) -> DataFrame:
    """df (doc_id, text and others) with one row of each class: that of least doc_id, one without an
    id only if all are. classes has doc_id, text_hash and class for each row of df."""
    first = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("row"))
    keys = {"__row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__row_unnamed": F.col("doc_id").isNull(), "__row_hash": text_hash(F.col("text"))}
    chosen = first.select(F.coalesce("row.doc_id", F.lit(0)).alias("__row_id"), F.col("row.unnamed").alias("__row_unnamed"), F.col("row.text_hash").alias("__row_hash"))
    # Plain keys without nulls: rows are dealt by them once, for the join and for repeated rows.
    return df.withColumns(keys).join(chosen, list(keys), "left_semi").dropDuplicates(list(keys)).drop(*keys)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys (numbers without nulls) as tables, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
        cuts = np.nonzero((values[:, 1:] != values[:, :-1]).any(axis=0))[0] + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            now = tuple(values[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def least_reachable(n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the links (rows, cols), by repeated minima."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, rows, root[cols])
        np.minimum.at(new, cols, root[rows])
        new = new[new]
        if (new == root).all():
            return root
        root = new
