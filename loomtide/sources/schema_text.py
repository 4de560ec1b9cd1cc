"""Message definitions: the text that recordings carry, parsed into types and Spark schemas.

A text holds a first definition and, after lines of 80 equal signs, one section for each type it
uses, headed MSG: package/Type. Constants, comments and blank lines are skipped. Types are
resolved within their own text only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from loomtide.model import PUBLISHED, TIMESTAMP, IngestError

# Fixed values of the format: the line between sections, and the primitive types.
SECTION = "=" * 80
PRIMITIVES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "byte": T.ShortType(),
    "char": T.ShortType(),
    "uint8": T.ShortType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "uint16": T.LongType(),
    "int32": T.IntegerType(),
    "uint32": T.LongType(),
    "int64": T.LongType(),
    "uint64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "wstring": T.StringType(),
    "time": T.StructType([T.StructField("sec", T.IntegerType()), T.StructField("nanosec", T.LongType())]),
    "duration": T.StructType([T.StructField("sec", T.IntegerType()), T.StructField("nanosec", T.LongType())]),
}
TIME_TYPES = {"builtin_interfaces/Time": "time", "builtin_interfaces/Duration": "duration"}
_FIELD = re.compile(r"(?P<type>[A-Za-z][\w/]*)(?:<=(?P<bound>\d+))?(?P<array>\[(?P<limit><=)?(?P<size>\d*)\])?\s+(?P<name>[A-Za-z]\w*)(?P<rest>.*)")


@dataclass(frozen=True)
class Field:
    """A field: its type name, and array as None, -1 (any length) or a fixed length."""

    name: str
    type: str
    array: int | None = None


@dataclass(frozen=True)
class Definitions:
    """All types of one text, by full name; root is the message's own."""

    root: str
    fields: dict[str, tuple[Field, ...]]

    def resolve(self, name: str, inside: str) -> str:
        """The full name of a type as written inside another."""
        package = inside.rpartition("/")[0].split("/")[0]
        for full in (name, _short(name), f"{package}/{name}", "std_msgs/Header" if name == "Header" else ""):
            if full in self.fields:
                return full
        hits = [f for f in self.fields if f.rpartition("/")[2] == name.rpartition("/")[2]]
        if len(hits) == 1:
            return hits[0]
        raise IngestError(f"unknown type {name!r} in {inside!r}")


def _short(name: str) -> str:
    """package/msg/Type -> package/Type."""
    parts = name.split("/")
    return f"{parts[0]}/{parts[-1]}" if len(parts) == 3 else name


def sections(name: str, text: str) -> dict[str, str]:
    """Definition texts by type name."""
    first, *rest = re.split(rf"^{SECTION}\s*$", text.replace("\r\n", "\n"), flags=re.MULTILINE)
    out = {_short(name): first}
    for part in rest:
        head, _, body = part.strip("\n").partition("\n")
        if not head.startswith("MSG:"):
            raise IngestError(f"a section of {name!r} begins with {head!r} rather than MSG:")
        out[_short(head[4:].strip())] = body
    return out


def parse_fields(text: str) -> tuple[Field, ...]:
    """Fields of one definition, in order. NAME=value after a type is a constant; bounds aren't."""
    out = []
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        m = _FIELD.fullmatch(line)
        if m is None:
            raise IngestError(f"can't read the field line {raw!r}")
        if m["rest"].lstrip().startswith("="):
            continue
        array = None if m["array"] is None else -1 if m["limit"] or not m["size"] else int(m["size"])
        out.append(Field(m["name"], m["type"], array))
    return tuple(out)


def parse_definitions(name: str, text: str) -> Definitions:
    parts = sections(name, text)
    return Definitions(_short(name), {n: parse_fields(t) for n, t in parts.items()})


def data_type(defs: Definitions, field: Field, inside: str) -> T.DataType:
    kind = PRIMITIVES.get(TIME_TYPES.get(_short(field.type), field.type))
    if kind is None:
        full = defs.resolve(field.type, inside)
        kind = struct_type(defs, full)
    return kind if field.array is None else T.ArrayType(kind)


def struct_type(defs: Definitions, name: str | None = None) -> T.StructType:
    name = name or defs.root
    return T.StructType([T.StructField(f.name, data_type(defs, f, name)) for f in defs.fields[name]])


def topic_schema(defs: Definitions) -> T.StructType:
    """The topic table's schema: both timestamps, then the message's fields, all nullable."""
    times = [T.StructField(TIMESTAMP, T.LongType()), T.StructField(PUBLISHED, T.LongType())]
    return T.StructType(times + struct_type(defs).fields)


def externalized(defs: Definitions, data: str = "data") -> Definitions:
    """The definitions with the root's bytes field replaced by a number, index."""
    own = tuple(Field("index", "uint32") if f.name == data and f.type in ("uint8", "byte", "char") and f.array == -1 else f for f in defs.fields[defs.root])
    return Definitions(defs.root, {**defs.fields, defs.root: own})
