"""Rigid transforms as Column expressions, so that they stay inside generated code.

A vector is three Columns x, y, z; a quaternion four, x, y, z, w; a pose is a struct of
translation<x,y,z> and rotation<x,y,z,w> doubles.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    def __sub__(self, other: Vec) -> Vec:
        return Vec(*(a - b for a, b in zip(self, other, strict=True)))

    def plus(self, other: Vec) -> Vec:
        return Vec(*(a + b for a, b in zip(self, other, strict=True)))

    def struct(self) -> Column:
        # Adding zero turns a negative zero into a plain one.
        return F.struct(*((c + 0.0).alias(n) for n, c in zip("xyz", self, strict=True)))


class Quat(NamedTuple):
    x: Column
    y: Column
    z: Column
    w: Column

    def conjugate(self) -> Quat:
        return Quat(-self.x, -self.y, -self.z, self.w)

    def dot(self, other: Quat) -> Column:
        return self.x * other.x + self.y * other.y + self.z * other.z + self.w * other.w

    def times(self, o: Quat) -> Quat:
        """Hamilton product."""
        a = self
        return Quat(
            a.w * o.x + a.x * o.w + a.y * o.z - a.z * o.y,
            a.w * o.y - a.x * o.z + a.y * o.w + a.z * o.x,
            a.w * o.z + a.x * o.y - a.y * o.x + a.z * o.w,
            a.w * o.w - a.x * o.x - a.y * o.y - a.z * o.z,
        )

    def scaled(self, factor: Column) -> Quat:
        return Quat(*(c * factor for c in self))

    def normalized(self, norm: Column | None = None) -> Quat:
        """Of length one (norm is its length, if known); a zero quaternion becomes the identity."""
        norm = F.sqrt(self.dot(self)) if norm is None else norm
        return Quat(*(F.when(norm > 0, c / norm).otherwise(F.lit(1.0 if n == "w" else 0.0)) for n, c in zip("xyzw", self, strict=True)))

    def rotate(self, v: Vec) -> Vec:
        """v turned by this unit quaternion: v + 2 r x (r x v + w v)."""
        tx, ty, tz = (
            2 * (self.y * v.z - self.z * v.y),
            2 * (self.z * v.x - self.x * v.z),
            2 * (self.x * v.y - self.y * v.x),
        )
        return Vec(
            v.x + self.w * tx + self.y * tz - self.z * ty,
            v.y + self.w * ty + self.z * tx - self.x * tz,
            v.z + self.w * tz + self.x * ty - self.y * tx,
        )

    def struct(self) -> Column:
        return F.struct(*((c + 0.0).alias(n) for n, c in zip("xyzw", self, strict=True)))


class Pose(NamedTuple):
    translation: Vec
    rotation: Quat

    def times(self, other: Pose) -> Pose:
        """First other, then self."""
        return Pose(self.translation.plus(self.rotation.rotate(other.translation)), self.rotation.times(other.rotation))

    def inverse(self) -> Pose:
        back = self.rotation.conjugate()
        return Pose(back.rotate(Vec(*(-c for c in self.translation))), back)

    def struct(self) -> Column:
        return F.struct(self.translation.struct().alias("translation"), self.rotation.struct().alias("rotation"))


def vec(c: Column) -> Vec:
    return Vec(*(c[n].cast("double") for n in "xyz"))


def quat(c: Column) -> Quat:
    return Quat(*(c[n].cast("double") for n in "xyzw"))


def pose(c: Column, normalize: bool = True) -> Pose:
    rotation = quat(c["rotation"])
    return Pose(vec(c["translation"]), rotation.normalized() if normalize else rotation)


def identity() -> Pose:
    zero, one = F.lit(0.0), F.lit(1.0)
    return Pose(Vec(zero, zero, zero), Quat(zero, zero, zero, one))


def aligned(current: Quat, previous: Quat) -> Quat:
    """current or its negative (the same rotation), whichever lies nearer to previous."""
    return current.scaled(F.when(current.dot(previous) < 0, -1.0).otherwise(1.0))
