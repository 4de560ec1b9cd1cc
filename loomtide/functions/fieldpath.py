"""Field paths such as /position/0, /points/-1/x or /data/1:3 as Column expressions.

A path's first part names a column. Further parts are struct fields, signed element numbers, or
slices start:end with either end open. After a slice, the parts that follow apply to each of its
elements.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_INDEX = re.compile(r"-?\d+")
_SLICE = re.compile(r"(-?\d*):(-?\d*)")


def parse_path(path: str) -> list[str | int | slice]:
    parts = path.strip("/").split("/")
    if not path.startswith("/") or not parts[0]:
        raise ValueError(f"a field path starts with / and a column: {path!r}")
    out: list[str | int | slice] = [parts[0]]
    for part in parts[1:]:
        if _INDEX.fullmatch(part):
            out.append(int(part))
        elif (m := _SLICE.fullmatch(part)) is not None:
            out.append(slice(*(int(g) if g else None for g in m.groups())))
        else:
            out.append(part)
    return out


def _sliced(c: Column, s: slice) -> Column:
    """Elements of c, with ends clamped to it as Python clamps them."""
    n = F.size(c)

    def place(at: int | None, default: Column) -> Column:
        if at is None:
            return default
        return F.least(F.lit(at), n) if at >= 0 else F.greatest(n + at, F.lit(0))

    start, end = place(s.start, F.lit(0)), place(s.stop, n)
    return F.when(c.isNotNull(), F.slice(c, start + 1, F.greatest(end - start, F.lit(0))))


def _applied(c: Column, parts: list[str | int | slice]) -> Column:
    for k, part in enumerate(parts):
        if isinstance(part, slice):
            chosen, rest = _sliced(c, part), parts[k + 1 :]
            return F.transform(chosen, lambda e: _applied(e, rest)) if rest else chosen  # noqa: B023  used at once
        c = c.getField(part) if isinstance(part, str) else F.try_element_at(c, F.lit(part + 1 if part >= 0 else part))
    return c


def field(path: str) -> Column:
    """The Column of a path; elements that aren't there are null."""
    first, *rest = parse_path(path)
    return _applied(F.col(f"`{first}`"), rest)
