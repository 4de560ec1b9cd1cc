"""Shifted, filled and differenced columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomtide.functions.geometry import aligned, quat, vec
from loomtide.model import TIME_COLUMNS, EnrichError, keys_of
from loomtide.operators.previous import with_previous


def order_of(df: DataFrame) -> str:
    """The time column that orders a table's rows."""
    for name in ("synched_timestamp_ns", "timestamp_ns"):
        if name in df.columns:
            return name
    raise EnrichError(f"no time column among {df.columns}")


def shifted(df: DataFrame, steps: int, fill: str = "edge", by: Sequence[str] | None = None, order: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns moved by steps rows, positive towards the future; time columns stay.

    edge fills gaps from the rows before, then after, and so fills nulls that were there before,
    too. zero does so with 0 for numbers and falls back to edge for other types.
    """
    if fill not in ("edge", "zero"):
        raise EnrichError(f"unknown fill {fill!r}")
    if steps == 0:
        return df
    by = keys_of(df) if by is None else list(by)
    order = [order_of(df)] if order is None else list(order)
    moved = [c for c in (columns or df.columns) if c not in TIME_COLUMNS and c not in by and c not in order]
    w = Window.partitionBy(*by).orderBy(*order)
    ahead = lambda c: F.lead(c, steps).over(w) if steps > 0 else F.lag(c, -steps).over(w)
    out = df.withColumns({f"__s_{c}": ahead(F.col(f"`{c}`")) for c in moved})
    back, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def filled(c: str) -> Column:
        s = F.col(f"`__s_{c}`")
        if fill == "zero" and isinstance(df.schema[c].dataType, T.NumericType):
            return F.coalesce(s, F.lit(0).cast(df.schema[c].dataType))
        # Without a value at or before a row, the first one after it is the first of all.
        return F.coalesce(F.last(s, ignorenulls=True).over(back), F.first(s, ignorenulls=True).over(whole))

    return out.select(*(filled(c).alias(c) if c in moved else F.col(f"`{c}`") for c in df.columns))


def _before(df: DataFrame, by: Sequence[str] | None, order: Sequence[str] | None, value: Column, name: str) -> DataFrame:
    """df with the value of the row before: by the table's time, in buckets of it, or by a given order over small groups."""
    by = keys_of(df) if by is None else list(by)
    if order is None:
        return with_previous(df, by, order_of(df), value, name)
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def delta_array(df: DataFrame, column: str = "position", name: str = "delta_position", by: Sequence[str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """name = column - column of the row before, element by element; zeros in the first row."""
    minus = F.zip_with(column, "__before", lambda a, b: a - b)
    uneven = F.raise_error(F.concat(F.lit(f"{column} changes its length from "), F.size("__before").cast("string"), F.lit(" to "), F.size(column).cast("string")))
    delta = F.when(F.col("__before").isNull(), F.transform(column, lambda a: a - a)).when(F.size(column) != F.size("__before"), uneven).otherwise(minus)
    return _before(df, by, order, F.col(column), "__before").withColumn(name, delta).drop("__before")


_XYZ, _XYZW = ("x", "y", "z"), ("x", "y", "z", "w")


def _is_transform(kind: T.DataType) -> bool:
    if not isinstance(kind, T.StructType) or not {"translation", "rotation"} <= set(kind.names):
        return False
    parts = ((kind["translation"].dataType, _XYZ), (kind["rotation"].dataType, _XYZW))
    return all(isinstance(p, T.StructType) and set(names) <= set(p.names) and all(isinstance(p[n].dataType, (T.FloatType, T.DoubleType)) for n in names) for p, names in parts)


def transform_paths(schema: T.StructType) -> list[tuple[str, ...]]:
    """Paths of all structs named transform of translation and rotation; lists aren't entered."""
    found: list[tuple[str, ...]] = []

    def walk(kind: T.DataType, at: tuple[str, ...]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                if f.name == "transform" and _is_transform(f.dataType):
                    found.append((*at, f.name))
                else:
                    walk(f.dataType, (*at, f.name))

    walk(schema, ())
    return found


def delta_pose(current: Column, previous: Column, frame: str = "previous_target_frame") -> Column:
    """The struct translation, rotation by which current differs from previous.

    source_frame leaves the translation's difference in the parent's axes; previous_target_frame
    turns it into the previous pose's own. Without a previous pose: zero, and no rotation.
    """
    if frame not in ("source_frame", "previous_target_frame"):
        raise EnrichError(f"unknown translation frame {frame!r}")
    now, before = quat(current["rotation"]), quat(previous["rotation"])
    moved = vec(current["translation"]) - vec(previous["translation"])
    if frame == "previous_target_frame":
        moved = before.conjugate().rotate(moved)
    turn = before.conjugate().times(aligned(now, before))
    or_zero = lambda c, d=0.0: F.coalesce(c + 0.0, F.lit(d))
    return F.struct(
        F.struct(*(or_zero(c).alias(n) for n, c in zip(_XYZ, moved, strict=True))).alias("translation"),
        F.struct(*(or_zero(c, 1.0 if n == "w" else 0.0).alias(n) for n, c in zip(_XYZW, turn, strict=True))).alias("rotation"),
    )


def delta_transforms(df: DataFrame, frame: str = "previous_target_frame", by: Sequence[str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """df with delta_transform beside each transform struct, at any depth of structs."""
    paths = transform_paths(df.schema)
    if not paths:
        raise EnrichError("there is no transform to difference")

    def at(path: tuple[str, ...]) -> Column:
        c = F.col(f"`{path[0]}`")
        for name in path[1:]:
            c = c.getField(name)
        return c

    out = _before(df, by, order, F.struct(*(at(p).alias(f"p{k}") for k, p in enumerate(paths))), "__p")
    out = out.withColumns({f"__d{k}": delta_pose(at(p), F.col(f"__p.p{k}"), frame) for k, p in enumerate(paths)})
    for k, p in enumerate(paths):
        if len(p) == 1:
            out = out.withColumn("delta_transform", F.col(f"__d{k}"))
        else:
            inner = ".".join(f"`{n}`" for n in (*p[1:-1], "delta_transform"))
            out = out.withColumn(p[0], F.col(f"`{p[0]}`").withField(inner, F.col(f"__d{k}")))
    return out.drop("__p", *(f"__d{k}" for k in range(len(paths))))
