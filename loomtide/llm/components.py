"""Connected components over a distributed edge list, by alternating star contractions.

Large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014) run as grouped minima joined back to the edges. No neighbourhood is gathered
into one row or task: the minimum is a partially aggregated value, and for the join back the
edges of a node are dealt to SALTS tasks, each with a copy of the node's minimum. Each round is
cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomtide.llm.common import checkpointed

#: Tasks that share the edges of one node in a join.
SALTS = 16


def _minimum(directed: DataFrame, value: Column) -> DataFrame:
    """(m_a, m, m_salt): each node's value over its edges, once for each salt."""
    least = directed.groupBy(F.col("a").alias("m_a")).agg(value.alias("m"))
    return least.withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_minimum(edges: DataFrame, least: DataFrame) -> DataFrame:
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return salted.join(least, (F.col("a") == F.col("m_a")) & (F.col("salt") == F.col("m_salt")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour v of u is linked to the least of u's closed neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _minimum(both, F.min(F.least("a", "b")))
    return _with_minimum(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour v of u, and u itself, is linked to the least of them. Edges have a > b."""
    moved = _with_minimum(edges, _minimum(edges, F.min("b"))).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(edges.groupBy("a").agg(F.min("b").alias("b")))


def _counted(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges behind a checkpoint, and their number as it was written (only to see whether it is still changing)."""
    seen = Observation()
    now = checkpointed(edges.observe(seen, F.count(F.lit(1)).alias("n")))
    return now, seen.get["n"]


def _within(some: DataFrame, others: DataFrame) -> bool:
    return some.join(others, ["a", "b"], "left_anti").isEmpty()


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for each node that some edge touches.

    Nodes are longs. Loops, repeated edges and edges with a null end are allowed and add nothing.
    An empty edge list gives an empty result. Raises if max_rounds rounds don't suffice, which a
    path would need to be longer than 2**max_rounds for.
    """
    clean = edges.select(F.greatest(left, right).cast("long").alias("a"), F.least(left, right).cast("long").alias("b")).where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("a") > F.col("b"))).distinct()
    now, size = _counted(clean)
    for _ in range(max_rounds):
        if not size:
            break
        before, size_before = now, size
        now, size = _counted(_small_star(_large_star(now)).distinct())
        if size == size_before and _within(now, before) and _within(before, now):
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
