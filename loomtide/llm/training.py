"""What the two text classifiers share: a bounded labelled sample, and term codes of texts."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.llm.common import checkpointed, id_hash
from loomtide.llm.tokenization import BoundedCache

#: At most so many training rows of each class; their texts alone come to the driver.
MAX_ROWS_PER_CLASS = 3000
#: And at most so many bytes of them, as whole texts; half for each class, and what one leaves for both.
MAX_BYTES = 64 << 20
CACHE = 200_000


def held_out(folds: int, fold: int):
    """Whether doc_id is in the fold that learning never sees; a null id is."""
    return F.coalesce(id_hash(F.col("doc_id"), folds) == fold, F.lit(True))


def fitting(sizes: list[tuple[int, int]], room: int) -> Iterator[int]:
    """Ids in order, without those whose size exceeds the room that is left."""
    for k, size in sizes:
        if size <= room:
            room -= size
            yield k


def sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, fold: int, per_class: int = MAX_ROWS_PER_CLASS) -> tuple[list[str], np.ndarray, float]:
    """(texts, labels, share of class 1 among all rows that may be learnt from).

    Rows of each class are taken by a hash of their id, so the sample is the same on every run;
    its size doesn't grow with the input. Sample and share are of the labels of ids in docs. A text
    that doesn't fit what is left of the bytes is passed over; one of over MAX_BYTES is never learnt from.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(folds, fold))
    rows = checkpointed(rows.join(docs.select(F.col("doc_id").alias("there")).distinct(), F.col("doc_id") == F.col("there"), "left_semi"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    own: dict[int, dict[int, int]] = {}
    for y in sorted(counts):
        own[y] = {r["doc_id"]: y for r in rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()}
    turns = [k for pair in itertools.zip_longest(*own.values()) for k in pair if k is not None]
    chosen = {k: y for ids in own.values() for k, y in ids.items()}
    if not chosen:
        return [], np.zeros(0), 0.5
    wanted = docs.sparkSession.createDataFrame([(k,) for k in chosen], "wanted long")  # at most 2 * per_class rows
    kept = checkpointed(docs.join(F.broadcast(wanted), F.col("doc_id") == F.col("wanted"), "left_semi").select("doc_id", "text", F.octet_length("text").alias("size")))
    place = {k: i for i, k in enumerate(turns)}  # the classes take turns
    sizes = [(r["doc_id"], r["size"]) for r in sorted(kept.groupBy("doc_id").agg(F.sum("size").alias("size")).collect(), key=lambda r: place[r["doc_id"]])]
    inside = set(fitting([x for x in sizes if chosen[x[0]] == 0], MAX_BYTES // 2)) | set(fitting([x for x in sizes if chosen[x[0]] == 1], MAX_BYTES // 2))
    used = sum(n for k, n in sizes if k in inside)
    inside |= set(fitting([x for x in sizes if x[0] not in inside], MAX_BYTES - used))
    texts = sorted({(r["doc_id"], r["text"]) for r in kept.where(F.col("doc_id").isin(list(inside))).select("doc_id", "text").collect()})
    return [t for _, t in texts], np.array([chosen[k] for k, _ in texts], dtype=float), counts.get(1, 0) / sum(counts.values())


def bucket(term: str, size: int) -> int:
    return zlib.crc32(term.encode()) % size


class Coder:
    """Texts to arrays of term codes; a chunk between spaces has its codes from terms_of."""

    def __init__(self, terms_of: Callable[[str], list[int]], cache: int = CACHE):
        self._chunks = BoundedCache(lambda part: np.array(terms_of(part), dtype="<u4").tobytes(), cache)

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._chunks.__getitem__, text.split())), dtype="<u4")


def text_column(make: Callable[[], Callable[[list[str]], list]], text: Column) -> Column:
    """The first of the columns that make()'s function derives from texts, as a column (null: empty)."""

    @F.pandas_udf("double")
    def derived(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        work = make()
        for texts in batches:
            yield pd.Series(work(texts.tolist())[0], dtype="float64")

    return derived(F.coalesce(text, F.lit("")))


PIECES = re.compile(r"[^\W_]+|[\W_]+")


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    """Adam steps over a list of arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
