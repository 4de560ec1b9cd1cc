"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised. A table's hash is the tuple of K quantised random projections
floor((a . v + b) / W) with Gaussian a, so vectors at cosine 0.98 (distance 0.2) share a table's
bucket with probability 0.22, and at least one of the 32 tables with probability 0.9997; nearer
vectors with more. Vectors of different labels or lengths never share a bucket.

Exact copies, found by a 128-bit hash of label and vector, are one node from the start, and nodes
are numbers: vectors are moved once, and then only for buckets that hold several. Buckets of one
vector, nearly all of them, are dropped on their keys alone. A larger bucket is processed in blocks
of about BLOCK vectors: pairs of blocks are separate groups, so a hot bucket is spread over
tasks. Of buckets with the same members, as a tight group has them in many tables, one is processed. A group checks labels, and cosines in double precision, counts each pair in the first table
that joins it, and emits for each vector its number of new links and the least node of its local
component, never the pairs themselves.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label, link with nothing and are components of their own; a row with a null id links with
nothing either and has a null component; repeated rows are vectors of their own, and so are rows of
one id with different vectors, which link by their cosine alone; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.common import checkpointed, least_reachable, sorted_groups
from loomtide.llm.components import components

THRESHOLD = 0.98
TABLES, K, W, SEED = 32, 18, 2.0, 20240601
#: Vectors of a bucket that are compared at once.
BLOCK = 512


def projections(dim: int, tables: int = TABLES, k: int = K, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * k)), rng.random(tables * k)


def signatures(unit: np.ndarray, tables: int = TABLES, k: int = K, w: float = W, seed: int = SEED) -> np.ndarray:
    """One 64-bit bucket number for each vector and table."""
    a, b = projections(unit.shape[1], tables, k, seed)
    cells = np.floor(unit @ a / w + b).astype(np.int64).view(np.uint64).reshape(len(unit), tables, k)
    out = np.full((len(unit), tables), unit.shape[1], dtype=np.uint64)
    for j in range(k):  # a multiplicative hash of the cells in turn
        out = (out ^ cells[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _units(column: pa.ListArray) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps huge components from overflowing
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_SIGNED = pa.schema([("node", pa.int64()), ("label", pa.string()), ("copies", pa.int64()), ("vector", pa.list_(pa.float64())), ("sigs", pa.list_(pa.int64()))])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            part = batch.filter(pa.array(sizes == dim))
            unit = _units(part.column("vector"))
            sig = signatures(unit)
            lists = [pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.reshape(-1)) for m in (unit, sig)]
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("label"), part.column("copies"), *lists], schema=_SIGNED)


_LINKED = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _linked(threshold: float):
    """Sorted groups (bucket, block pair) to links; a group has at most about two blocks of rows."""

    def alike(part: pa.Table) -> pa.RecordBatch | None:
        """Links between vectors of one length."""
        part = part.sort_by("node")
        n = part.num_rows
        node, side, copies = (part.column(c).to_numpy() for c in ("node", "side", "copies"))
        label = part.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        x = part.column("vector").combine_chunks().flatten().to_numpy().reshape(n, -1)
        sig = part.column("sigs").combine_chunks().flatten().to_numpy().reshape(n, -1)
        table = int(part.column("t")[0].as_py())
        if part.column("lo")[0].as_py() == part.column("hi")[0].as_py():
            i, j = np.nonzero(x @ x.T >= threshold)
            keep = i < j
            i, j = i[keep], j[keep]
        else:
            left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
            a, b = np.nonzero(x[left] @ x[right].T >= threshold)
            i, j = left[a], right[b]
        same = label[i] == label[j]
        i, j = i[same], j[same]
        if table and len(i):
            seen = np.concatenate([(sig[i[s : s + 65536], :table] == sig[j[s : s + 65536], :table]).any(axis=1) for s in range(0, len(i), 65536)])
            i, j = i[~seen], j[~seen]
        if not len(i):
            return None
        links = np.zeros(n, dtype=np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = node[least_reachable(n, i, j)]
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(root[hit])], schema=_LINKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches, ("key", "lo", "hi")):
            sizes = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in part.column("vector").chunks])
            for dim in np.unique(sizes):  # one length, but for colliding keys
                if (done := alike(part.filter(pa.array(sizes == dim)))) is not None:
                    yield done

    return run


def linked(nodes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(node, links, root) over nodes (node, label, vector, copies): new links by table, and local roots."""
    signed = checkpointed(nodes.select("node", "label", "copies", "vector").mapInArrow(_signed, "node long, label string, copies long, vector array<double>, sigs array<long>"))
    keyed = signed.select("node", "label", F.size("vector").alias("dim"), F.posexplode("sigs").alias("t", "sig")).select("node", "t", F.xxhash64("label", "dim", "t", "sig").alias("key"))
    # A bucket with the very members of an earlier table's has no pair that isn't counted there.
    members = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in range(2)]
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("t").alias("t"), *members).where("n > 1")
    first = buckets.groupBy("n", "x0", "x1").agg(F.min_by("key", "t").alias("shared_key"))
    shared = checkpointed(first.select("shared_key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = keyed.join(shared, F.col("key") == F.col("shared_key")).select("node", "t", "key", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select(F.col("node").alias("of"), "t", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    full = met.join(signed, F.col("of") == F.col("node")).drop("of")
    return full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_linked(threshold), "node long, links long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of df."""
    zero = F.lit(0).cast(df.schema[vector_col].dataType.elementType)  # a zero of either sign is one number
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.when(x == 0, zero).otherwise(x)).alias("vector"), F.col(label_col).cast("string").alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False))
    hashes = [F.when(F.col("good"), F.xxhash64(F.lit(k), "label", "vector")).alias(f"h{k}") for k in range(2)]
    rows = rows.select("*", good.alias("good")).select("vec_id", F.when(F.col("good"), F.col("label")).alias("label"), F.when(F.col("good"), F.col("vector")).alias("vector"), *hashes, F.monotonically_increasing_id().alias("row"))
    rows = checkpointed(rows)
    sets = checkpointed(rows.where("h0 is not null").groupBy("h0", "h1").agg(F.min("vec_id").alias("least"), F.min("row").alias("node"), F.count("*").alias("copies")))
    vectors = rows.select("row", "label", "vector").join(sets.select("node", "copies"), F.col("row") == F.col("node"))
    found = checkpointed(linked(vectors, threshold).groupBy("node", "root").agg(F.sum("links").alias("links")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found, "node", "root").select(F.col("node").alias("joined"), "component")
    named = sets.join(counts, "node", "left").join(roots, F.col("node") == F.col("joined"), "left").withColumn("component", F.coalesce("component", "node"))
    named = checkpointed(named.select("h0", "h1", "least", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    first = named.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    named = checkpointed(named.join(first, F.col("component") == F.col("c")).select(F.col("h0").alias("g0"), F.col("h1").alias("g1"), "n_links", "component_id"))
    out = rows.select("vec_id", "h0", "h1").join(named, (F.col("h0") == F.col("g0")) & (F.col("h1") == F.col("g1")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
