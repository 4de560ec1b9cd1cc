"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint is a majority vote over the 64-bit hashes of its word shingles. Two
fingerprints link at two or fewer differing bits. Fingerprints are split into two segments of
32 bits: if at most two bits differ, either the first segment differs in at most one bit or the
second not at all. So each distinct fingerprint looks up the Hamming ball of radius 1 around its
first segment (33 keys) and its second segment itself in the segment tables; what comes back is
verified over all 64 bits inside the join. Copies share a fingerprint and are one node; only
links between different fingerprints exist as rows, at most 2080 for each.

Edge cases: a null, empty or blank text has fingerprint zero, which links like any other; a text
of fewer words than a shingle is one shingle; repeated rows fall into one class; a null id gets
its class like any row, and a class of null ids alone has a null id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.common import checkpointed, documents, one_of_each, text_hash
from loomtide.llm.common import slices as parts_of
from loomtide.llm.components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of a whole text (bytes.lower and bytes.split know ASCII only)."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), runs), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """Each bit that most of the 64-bit hashes have; 0 of none."""
    votes, total = np.zeros(64, dtype=np.int64), 0
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        total += len(bits)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (of the text) and fp (the fingerprint as a signed long) for each row of df (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                fps = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fps)], schema=schema)

    return documents(df).withColumn("text_hash", text_hash(F.col("text"))).mapInArrow(run, "doc_id long, text_hash long, fp long")


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) pairs of fingerprints, a < b, that differ in at most max_bits (0 to 3) bits. nodes has distinct fp (long)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius 1 cover 0 to 3 bits")
    first = F.shiftrightunsigned("fp", 32)
    second = F.col("fp").bitwiseAND(0xFFFFFFFF) + F.lit(1 << 32)
    ball = lambda seg: F.concat(F.array(seg), *(F.array(seg.bitwiseXOR(F.lit(1 << b))) for b in range(32)))
    probes = F.concat(ball(first) if max_bits >= 2 else F.array(first), ball(second) if max_bits == 3 else F.array(second))
    table = nodes.select(F.explode(F.array(first, second)).alias("key"), F.col("fp").alias("b"))
    asked = nodes.select(F.explode(probes).alias("key"), F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return asked.join(table, (asked["key"] == table["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b")


def _classes(df: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """doc_id, text_hash, fp, class (a fingerprint) and component_id for each row of df."""
    marked = checkpointed(fingerprints(df, shingle))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes, max_bits))
    named = checkpointed(nodes.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "fp").alias("class"), "least"))
    first = named.groupBy(F.col("class").alias("c")).agg(F.min("least").alias("component_id"))
    named = checkpointed(named.join(first, F.col("class") == F.col("c")).select("class_fp", "class", "component_id"))
    return marked.join(named, F.col("fp") == F.col("class_fp")).drop("class_fp")


def classes(df: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable over links) for each row of df."""
    return _classes(df, shingle, max_bits).select("doc_id", "fp", "component_id")


def deduplicated(df: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """df (doc_id, text and others) with one row of each class."""
    return one_of_each(df, _classes(df, shingle, max_bits))
