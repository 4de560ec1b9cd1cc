"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers. A segment of up to SEGMENT rows stores, for each attribute
and bit, one bitmap over its rows. A query's score is a weighted sum of attributes; it is formed
for all rows at once by adding the slices, shifted by the set bits of the query's components,
with full adders on bitmaps (negative components add complemented slices, which shifts all
scores of a segment alike). The sum is itself bit-sliced: from its most significant slice
downward, rows that must be among the first k are separated from those that tie so far. Ties at
the boundary go to smaller ids, and the rows chosen get their exact scores from their own bits.

Segments are built where the rows lie, without a shuffle. Segments and blocks of queries are dealt
by spread keys, so no side is broadcast or gathered; a task holds the blocks of a key, passes each
segment over them once and yields at most k rows for each query. Pairs of segment and block exist
only there, not as rows. Segments are dealt to at most GROUPS groups, each of which gets a copy
of the queries, so that copies don't multiply with the shuffle's partitions.

Every finite vector takes part. Components of WIDE or more in size don't fit a long after
quantising; their rows form segments of plain doubles, and they, and products that could pass a
long, are scored in Python's integers. A score beyond a long is given as the nearest long.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, nor
do rows with a null id; vectors of other lengths than the query's aren't compared; rows that share
the query's id are its own and left out; repeated candidate rows count each; of several vectors
under a query's id the least is asked; fewer than k candidates give fewer rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE, TOP = 256, 5
#: Components below this in size quantise to less than 2**62.
WIDE = 2.0**54
SEGMENT, QUERY_BLOCK = 32768, 256
#: Each segment is sent to so many tasks, which share the query blocks.
SPREAD = 4
#: Each query block is sent to every group of segments: to so many at most.
GROUPS = 128

_SEGMENTS = pa.schema([("seg", pa.int64()), ("dim", pa.int32()), ("low", pa.int64()), ("bits", pa.int32()), ("ids", pa.binary()), ("slices", pa.binary())])
_BLOCKS = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("size", pa.int32()), ("values", pa.binary())])
_TOP = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def slice_bits(values: np.ndarray, low: int, bits: int) -> np.ndarray:
    """Bitmaps [bit, attribute, word] over rows of values (rows, attributes) minus low."""
    rows, dim = values.shape
    words = -(-rows // 64)
    padded = np.zeros((words * 64, dim), dtype=np.int64)
    padded[:rows] = values - low
    out = np.empty((bits, dim, words), dtype=np.uint64)
    for b in range(bits):
        out[b] = np.packbits(np.ascontiguousarray((padded.T >> b & 1).astype(np.uint8)), axis=1, bitorder="little").view(np.uint64)
    return out


def row_values(slices: np.ndarray, low: int, rows: np.ndarray) -> np.ndarray:
    """The quantised vectors of some rows, read back from their bits."""
    picked = (slices[:, :, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
    return (picked.astype(np.int64) << np.arange(len(slices))[:, None, None]).sum(axis=0).T + low


def _added(column: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """One bitmap for this weight from all its addends (m, words), and carries for the next weight."""
    carries = []
    while len(column) > 2:
        n = len(column) // 3
        a, b, c, rest = column[:n], column[n : 2 * n], column[2 * n : 3 * n], column[3 * n :]
        half = a ^ b
        carries.append((a & b) | (half & c))
        column = np.concatenate([half ^ c, rest]) if len(rest) else half ^ c
    if len(column) == 2:
        carries.append((column[0] & column[1])[None])
        column = column[:1] ^ column[1:]
    return column[0], carries


def score_slices(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Bit slices, least significant first, of a score that orders rows as query . row does."""
    flip = np.where(query < 0, ~np.uint64(0), np.uint64(0)).astype(np.uint64)
    signed = slices ^ flip[None, :, None]
    weight = np.abs(query)
    columns: list[list[np.ndarray]] = [[] for _ in range(len(slices) + int(weight.max()).bit_length())]
    for c in range(int(weight.max()).bit_length()):
        own = np.nonzero(weight >> c & 1)[0]
        for b in range(len(slices) if len(own) else 0):
            columns[b + c].append(signed[b, own])
    out, s = [], 0
    while s < len(columns):
        if columns[s]:
            total, carries = _added(np.concatenate(columns[s]))
            if carries:
                if s + 1 == len(columns):
                    columns.append([])
                columns[s + 1] += carries
        else:
            total = np.zeros(slices.shape[2], dtype=np.uint64)
        out.append(total)
        s += 1
    return out


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.nonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))[0]


def select_top(score: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores; among equals at the boundary the first rows."""
    sure, tied = np.zeros_like(among), among
    for s in reversed(score):
        with_bit = tied & s
        n = int(np.bitwise_count(sure | with_bit).sum())
        if n > k:
            tied = with_bit
        else:
            sure, tied = sure | with_bit, tied & ~s
            if n == k:
                return _rows(sure)
    first = _rows(sure)
    return np.concatenate([first, _rows(tied)[: k - len(first)]])


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as longs, for components below WIDE."""
    return np.floor(SCALE * x).astype(np.int64)


def exact(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as Python integers, for any finite doubles (large ones are whole numbers)."""
    flat = [int(np.floor(SCALE * v)) if abs(v) < WIDE else int(v) * SCALE for v in x.reshape(-1).tolist()]
    out = np.empty(len(flat), dtype=object)
    out[:] = flat
    return out.reshape(x.shape)


def plain_top(ids: np.ndarray, values: np.ndarray, query: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """(ids, scores) of the k best rows of Python integers, scores cut to longs."""
    scores = [max(-(1 << 63), min((1 << 63) - 1, s)) for s in (values @ query).tolist()]
    best = sorted(zip((-s for s in scores), ids.tolist()))[:k]
    return [i for _, i in best], [-s for s, _ in best]


def _by_length(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(wide, ids, vectors) in runs of up to most rows of one length, those with wide components apart."""
    held: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == dim))
            all_ids, x = part.column("vec_id").to_numpy(), part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            large = (np.abs(x) >= WIDE).any(axis=1)
            for wide in (False, True):
                ids, values = all_ids[large == wide], x[large == wide]
                if (dim, wide) in held:
                    before = held[dim, wide]
                    ids, values = np.concatenate([before[0], ids]), np.concatenate([before[1], values])
                while len(ids) >= most:
                    yield wide, ids[:most], values[:most]
                    ids, values = ids[most:], values[most:]
                held[dim, wide] = (ids, values)
    for (_, wide), (ids, values) in held.items():
        if len(ids):
            yield wide, ids, values


def _number(k: int) -> int:
    return (TaskContext.get().partitionId() << 32) + k


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for k, (wide, ids, x) in enumerate(_by_length(batches, SEGMENT)):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        if wide:  # no bits: the rows themselves
            low, bits, slices = 0, 0, x.astype("<f8").tobytes()
        else:
            values = quantised(x)
            low = int(values.min())
            bits = max(1, (int(values.max()) - low).bit_length())
            slices = slice_bits(values, low, bits).tobytes()
        row = [_number(k), x.shape[1], low, bits, ids.astype("<i8").tobytes(), slices]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SEGMENTS, strict=True)], schema=_SEGMENTS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for k, (wide, ids, x) in enumerate(_by_length(batches, QUERY_BLOCK)):
        values = x if wide else quantised(x)
        size = 0 if wide else next(n for n in (2, 4, 8) if n == 8 or np.abs(values).max() < 1 << 8 * n - 1)
        row = [_number(k), x.shape[1], ids.astype("<i8").tobytes(), size, values.astype(f"<i{size}" if size else "<f8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)


class _Segment:
    """A segment read from its row; best answers one query."""

    def __init__(self, dim: int, low: int, bits: int, ids: np.ndarray, stored: pa.Buffer):
        self.low, self.bits, self.ids, self._plain = low, bits, ids, None
        if bits:
            self.slices = np.frombuffer(stored, dtype=np.uint64).reshape(bits, dim, -1)
            self.largest = max(abs(low), abs(low + (1 << bits) - 1))
            self.present = np.packbits(np.arange(self.slices.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
        else:
            self.rows = np.frombuffer(stored, dtype="<f8").reshape(-1, dim)

    def plain(self) -> np.ndarray:
        if self._plain is None:
            self._plain = row_values(self.slices, self.low, np.arange(len(self.ids))).astype(object) if self.bits else exact(self.rows)
        return self._plain

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """query: quantised, or plain doubles if it is wide."""
        first, last = np.searchsorted(self.ids, [query_id, query_id + 1])  # the query's own rows
        wide = query.dtype.kind == "f"
        if not self.bits or wide or len(query) * int(np.abs(query).max()) * self.largest >= 1 << 63:
            others = np.r_[:first, last : len(self.ids)]
            return plain_top(self.ids[others], self.plain()[others], exact(query) if wide else query.astype(object), k)
        among = self.present
        if last > first:
            among = among.copy()
            for own in range(first, last):
                among[own >> 6] &= ~np.uint64(1 << (own & 63))
        rows = select_top(score_slices(self.slices, query) if query.any() else [], among, k)
        return self.ids[rows].tolist(), (row_values(self.slices, self.low, rows) @ query).tolist()


def _searched(k: int):
    """Rows of blocks and segments, sorted by dim, g, h and kind (blocks first), to the best rows of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks = None, []
        for batch in batches:
            names = ("dim", "g", "h", "kind", "low", "bits")
            for at, (dim, g, h, kind, low, bits) in enumerate(zip(*(batch.column(name).to_pylist() for name in names), strict=True)):
                if (dim, g, h) != key:
                    key, blocks = (dim, g, h), []
                ids, data = (batch.column(name)[at].as_buffer() for name in ("ids", "data"))
                if kind == 0:  # copied, for the batch would stay with it
                    blocks.append((bits, bytes(ids), bytes(data)))
                    continue
                segment = _Segment(dim, low, bits, np.frombuffer(ids, dtype="<i8"), data)
                for size, own, stored in blocks:
                    asked = np.frombuffer(own, dtype="<i8")
                    values = np.frombuffer(stored, dtype=f"<i{size}" if size else "<f8").reshape(len(asked), -1)
                    values = values.astype(np.int64) if size else values
                    out: list[list] = [[], [], []]
                    for query_id, query in zip(asked.tolist(), values, strict=True):
                        found, scores = segment.best(query_id, query, k)
                        out[0] += [query_id] * len(found)
                        out[1] += found
                        out[2] += scores
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_TOP)

    return run


def top_k(df: DataFrame, is_query: Column, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows. is_query is over the column vec_id."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = min(partitions, GROUPS)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    columns = ("dim", "g", "h", "kind", "low", "bits", "ids", "data")
    segments = rows.mapInArrow(_segments, "seg long, dim int, low long, bits int, ids binary, slices binary")
    segments = segments.withColumnsRenamed({"slices": "data"}).withColumn("kind", F.lit(1)).withColumn("g", dealt("seg", groups)).withColumn("h", spread(SPREAD))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = asked.mapInArrow(_blocks, "block long, dim int, ids binary, size int, values binary").withColumnsRenamed({"values": "data", "size": "bits"})
    blocks = blocks.withColumn("low", F.lit(0).cast("long")).withColumn("kind", F.lit(0)).withColumn("h", dealt("block", SPREAD)).withColumn("g", spread(groups))
    met = blocks.select(*columns).unionByName(segments.select(*columns)).repartition(partitions, "dim", "g", "h").sortWithinPartitions("dim", "g", "h", "kind")
    found = met.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
