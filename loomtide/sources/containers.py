"""Recording containers: MCAP and version 2.0 bags, read message by message from any bytes.

Both readers give (topic, type, definition text, encoding, log time, publish time, bytes). They
work on a seekable binary file and hold one chunk at a time.
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

from loomtide.model import IngestError

# Fixed values of the two formats: magic numbers and record codes.
MCAP_MAGIC = b"\x89MCAP0\r\n"
BAG_MAGIC = b"#ROSBAG V2.0\n"
MCAP_SCHEMA, MCAP_CHANNEL, MCAP_MESSAGE, MCAP_CHUNK, MCAP_DATA_END, MCAP_FOOTER = 0x03, 0x04, 0x05, 0x06, 0x0F, 0x02
BAG_MESSAGE, BAG_CHUNK, BAG_CONNECTION = 0x02, 0x05, 0x07


class Message(NamedTuple):
    topic: str
    type: str
    definition: str
    encoding: str
    log_time: int
    publish_time: int | None
    data: bytes


def _inflated(kind: str, data: bytes, size: int) -> bytes:
    if kind in ("", "none"):
        return data
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=max(size, 1))
    if kind == "bz2":
        return bz2.decompress(data)
    if kind == "lz4":
        try:
            import lz4.frame
        except ImportError as e:
            raise IngestError("lz4 chunks need the lz4 package") from e
        return lz4.frame.decompress(data)
    raise IngestError(f"unknown compression {kind!r}")


class _Fields:
    """Little-endian fields of a record."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, code: str):
        values = struct.unpack_from("<" + code, self.data, self.at)
        self.at += struct.calcsize("<" + code)
        return values[0] if len(values) == 1 else values

    def raw(self, size: int) -> bytes:
        self.at += size
        return self.data[self.at - size : self.at]

    def text(self) -> str:
        return self.raw(self.take("I")).decode()


def read_mcap(f: BinaryIO) -> Iterator[Message]:
    """Messages in file order. Channels without a schema, or with an empty one, are skipped."""
    if f.read(8) != MCAP_MAGIC:
        raise IngestError("not an MCAP file")
    schemas: dict[int, tuple[str, str]] = {}
    channels: dict[int, tuple[int, str, str]] = {}

    def record(op: int, body: bytes) -> Iterator[Message]:
        r = _Fields(body)
        if op == MCAP_SCHEMA:
            number, name, _ = r.take("H"), r.text(), r.text()
            schemas[number] = (name, r.raw(r.take("I")).decode("utf-8", "replace"))
        elif op == MCAP_CHANNEL:
            number, schema = r.take("HH")
            channels[number] = (schema, r.text(), r.text())
        elif op == MCAP_MESSAGE:
            channel, _, log, publish = r.take("HIQQ")
            if channel not in channels:
                raise IngestError(f"a message of the unknown channel {channel}")
            schema, topic, encoding = channels[channel]
            name, text = schemas.get(schema, ("", ""))
            if text.strip():
                yield Message(topic, name, text, encoding or "cdr", log, publish, body[r.at :])
        elif op == MCAP_CHUNK:
            _, _, size, _ = r.take("QQQI")
            kind, packed = r.text(), r.raw(r.take("Q"))
            inner, at = _inflated(kind, packed, size), 0
            while at < len(inner):
                code, length = struct.unpack_from("<BQ", inner, at)
                yield from record(code, inner[at + 9 : at + 9 + length])
                at += 9 + length

    while len(head := f.read(9)) == 9:
        op, size = struct.unpack("<BQ", head)
        if op in (MCAP_DATA_END, MCAP_FOOTER):
            return
        body = f.read(size)
        if len(body) < size:
            raise IngestError("an MCAP file ends early")
        yield from record(op, body)


def _bag_header(data: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at < len(data):
        (size,) = struct.unpack_from("<I", data, at)
        name, _, value = data[at + 4 : at + 4 + size].partition(b"=")
        out[name.decode()] = value
        at += 4 + size
    return out


def _bag_records(f: BinaryIO) -> Iterator[tuple[dict[str, bytes], bytes]]:
    while len(size := f.read(4)) == 4:
        header = _bag_header(f.read(struct.unpack("<I", size)[0]))
        data = f.read(struct.unpack("<I", f.read(4))[0])
        yield header, data


def read_bag(f: BinaryIO) -> Iterator[Message]:
    """Messages in file order; a message of an unknown connection is an error. There is no publish time."""
    import io

    if f.read(len(BAG_MAGIC)) != BAG_MAGIC:
        raise IngestError("not a version 2.0 bag")
    connections: dict[int, tuple[str, str, str]] = {}

    def record(header: dict[str, bytes], data: bytes) -> Iterator[Message]:
        op = header["op"][0]
        if op == BAG_CONNECTION:
            about = _bag_header(data)
            connections[struct.unpack("<I", header["conn"])[0]] = (header["topic"].decode(), about["type"].decode(), about["message_definition"].decode("utf-8", "replace"))
        elif op == BAG_MESSAGE:
            (number,) = struct.unpack("<I", header["conn"])
            if number not in connections:
                raise IngestError(f"a message of the unknown connection {number}")
            sec, nsec = struct.unpack("<II", header["time"])
            yield Message(*connections[number], "ros1", sec * 1_000_000_000 + nsec, None, data)
        elif op == BAG_CHUNK:
            size = struct.unpack("<I", header["size"])[0] if "size" in header else 0
            for h, d in _bag_records(io.BytesIO(_inflated(header["compression"].decode(), data, size))):
                yield from record(h, d)

    for header, data in _bag_records(f):
        yield from record(header, data)


def _text(s: str) -> bytes:
    return struct.pack("<I", len(s.encode())) + s.encode()


def write_mcap(f: BinaryIO, messages: list[Message], compression: str = "") -> None:
    """A small MCAP file of one chunk, for tests and made-up recordings."""
    body, schemas, channels = bytearray(), {}, {}

    def put(out, op: int, data: bytes) -> None:
        out += struct.pack("<BQ", op, len(data)) + data

    for k, m in enumerate(messages):
        if (m.type, m.definition) not in schemas:
            schemas[m.type, m.definition] = len(schemas) + 1
            text = m.definition.encode()
            put(body, MCAP_SCHEMA, struct.pack("<H", len(schemas)) + _text(m.type) + _text("ros2msg") + struct.pack("<I", len(text)) + text)
        if m.topic not in channels:
            channels[m.topic] = len(channels) + 1
            put(body, MCAP_CHANNEL, struct.pack("<HH", channels[m.topic], schemas[m.type, m.definition]) + _text(m.topic) + _text(m.encoding) + struct.pack("<I", 0))
        put(body, MCAP_MESSAGE, struct.pack("<HIQQ", channels[m.topic], k, m.log_time, m.publish_time or m.log_time) + m.data)
    packed = bytes(body)
    if compression == "zstd":
        import zstandard

        packed = zstandard.ZstdCompressor().compress(packed)
    times = [m.log_time for m in messages] or [0]
    chunk = struct.pack("<QQQI", min(times), max(times), len(body), 0) + _text(compression) + struct.pack("<Q", len(packed)) + packed
    out = bytearray(MCAP_MAGIC)
    put(out, 0x01, _text("ros2") + _text(""))
    put(out, MCAP_CHUNK, chunk)
    put(out, MCAP_DATA_END, struct.pack("<I", 0))
    put(out, MCAP_FOOTER, struct.pack("<QQI", 0, 0, 0))
    f.write(out + MCAP_MAGIC)


def write_bag(f: BinaryIO, messages: list[Message], compression: str = "none") -> None:
    """A small version 2.0 bag of one chunk."""
    def header(**fields: bytes) -> bytes:
        raw = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in fields.items())
        return struct.pack("<I", len(raw)) + raw

    body, seen = bytearray(), {}
    for m in messages:
        if m.topic not in seen:
            seen[m.topic] = len(seen)
            about = header(topic=m.topic.encode(), type=m.type.encode(), message_definition=m.definition.encode())
            body += header(op=bytes([BAG_CONNECTION]), conn=struct.pack("<I", seen[m.topic]), topic=m.topic.encode()) + about
        time = struct.pack("<II", *divmod(m.log_time, 1_000_000_000))
        body += header(op=bytes([BAG_MESSAGE]), conn=struct.pack("<I", seen[m.topic]), time=time) + struct.pack("<I", len(m.data)) + m.data
    packed = bz2.compress(bytes(body)) if compression == "bz2" else bytes(body)
    f.write(BAG_MAGIC)
    f.write(header(op=b"\x03", index_pos=struct.pack("<Q", 0), conn_count=struct.pack("<I", len(seen)), chunk_count=struct.pack("<I", 1)) + struct.pack("<I", 0))
    f.write(header(op=bytes([BAG_CHUNK]), compression=compression.encode(), size=struct.pack("<I", len(body))) + struct.pack("<I", len(packed)) + packed)
