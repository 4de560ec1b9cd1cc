"""Ten-bit depth quantisation as integer expressions, and decoding of compressed depth images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtide.model import DecodeError

# Fixed values of the quantised format: the largest depth in mm, the largest code, the header's size.
DEPTH_MAX_MM, CODE_MAX, HEADER = 4092, 1023, 12


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def quantize(mm: Column, depth_max: int = DEPTH_MAX_MM) -> Column:
    """Millimetres to codes 1..1023; 0 and depths beyond the maximum become 0."""
    mm = mm.cast("long")
    code = _div(mm * CODE_MAX + depth_max // 2, F.lit(depth_max))
    return F.when((mm <= 0) | (mm > depth_max), F.lit(0)).when(mm.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(CODE_MAX), code))).cast("int")


def dequantize(code: Column, depth_max: int = DEPTH_MAX_MM) -> Column:
    """Codes to millimetres; 0 stays 0."""
    code = code.cast("long")
    return _div(code * depth_max + CODE_MAX // 2, F.lit(CODE_MAX)).cast("int")


def quantize_frame(frame: Column, depth_max: int = DEPTH_MAX_MM) -> Column:
    return F.transform(frame, lambda mm: quantize(mm, depth_max))


@F.pandas_udf(T.BinaryType())
def p010le(codes: pd.Series) -> pd.Series:
    """Codes of a frame (array<int>, even in size) as P010 bytes: luma code << 6, neutral chroma."""
    def one(c):
        luma = (np.asarray(c, dtype=np.uint16) << 6).astype("<u2")
        return luma.tobytes() + np.full(len(luma) // 2, 0x8000, dtype="<u2").tobytes()

    return codes.map(lambda c: None if c is None else one(c))


def rvl_decode(data: bytes, count: int) -> np.ndarray:
    """Run lengths and zigzag deltas in 4-bit groups of 3 bits, packed into little-endian 32-bit words, high nibble first."""
    words = np.frombuffer(data[: len(data) // 4 * 4], dtype="<u4")
    nibbles = ((words[:, None] >> np.arange(28, -1, -4, dtype=np.uint32)) & 15).reshape(-1).tolist()
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(nibbles):
                raise DecodeError("a run-length depth image ends early")
            n = nibbles[at]
            at += 1
            value |= (n & 7) << shift
            if not n & 8:
                return value
            shift += 3

    out, filled, last = np.zeros(count, dtype=np.uint16), 0, 0
    while filled < count:
        filled += number()
        some = number()
        if filled + some > count:
            raise DecodeError("a run-length depth image is longer than its size")
        for k in range(filled, filled + some):
            z = number()
            last += (z >> 1) ^ -(z & 1)
            out[k] = last & 0xFFFF
        filled += some
    return out


def rvl_encode(depth: np.ndarray) -> bytes:
    """The inverse of rvl_decode."""
    nibbles: list[int] = []

    def number(value: int) -> None:
        while True:
            low, value = value & 7, value >> 3
            nibbles.append(low | (8 if value else 0))
            if not value:
                return

    flat, k, last = depth.reshape(-1).astype(int).tolist(), 0, 0
    while k < len(flat):
        start = k
        while k < len(flat) and flat[k] == 0:
            k += 1
        number(k - start)
        start = k
        while k < len(flat) and flat[k] != 0:
            k += 1
        number(k - start)
        for v in flat[start:k]:
            delta, last = v - last, v
            number((delta << 1) ^ (delta >> 31))
    nibbles += [0] * (-len(nibbles) % 8)
    groups = np.array(nibbles, dtype=np.uint32).reshape(-1, 8)
    return (groups << np.arange(28, -1, -4, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4").tobytes()


def png16_decode(data: bytes) -> np.ndarray:
    """A 16-bit grey, non-interlaced PNG as a (height, width) array."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise DecodeError("not a PNG")
    at, body, shape = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
            if (depth, colour, interlace) != (16, 0, 0):
                raise DecodeError("only 16-bit grey PNGs without interlacing are depth images")
            shape = height, width
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
    if shape is None:
        raise DecodeError("a PNG without a header")
    height, width = shape
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, 1 + 2 * width)
    out, above = np.zeros((height, 2 * width), dtype=np.uint8), np.zeros(2 * width, dtype=np.int64)
    for y in range(height):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, 2), axis=0).reshape(-1) & 255
        elif kind in (3, 4):
            for x in range(2 * width):
                left = line[x - 2] if x > 1 else 0
                corner = above[x - 2] if x > 1 else 0
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((left, above[x], corner), key=lambda v, p=p: abs(p - v))
                line[x] = (line[x] + guess) & 255
        elif kind:
            raise DecodeError(f"unknown PNG filter {kind}")
        out[y], above = line, line
    return out.view(">u2").astype(np.uint16)


def compressed_depth(data: bytes, format_text: str) -> np.ndarray:
    """Depth in millimetres, (height, width), of a compressed depth message: a header, then PNG or run lengths."""
    if "32FC1" in format_text:
        raise DecodeError("compressed float depth (32FC1) is not supported")
    if len(data) < HEADER:
        raise DecodeError("a compressed depth message is shorter than its header")
    body = data[HEADER:]
    if "rvl" in format_text.lower():
        if len(body) < 8:
            raise DecodeError("a run-length depth image without its size")
        width, height = struct.unpack("<II", body[:8])
        return rvl_decode(body[8:], width * height).reshape(height, width)
    return png16_decode(body)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def decode_depth(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(bytes, format) of compressed depth messages to millimetres, row by row."""
    for data, formats in batches:
        yield pd.Series([None if d is None else compressed_depth(bytes(d), f or "").reshape(-1).astype(np.int32) for d, f in zip(data, formats, strict=True)])
