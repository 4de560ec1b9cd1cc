"""Command topics made up from states, for robots that never sent them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.model import TIMESTAMP, EnrichError, Recording, keys_of


@dataclass(frozen=True)
class CommandSpec:
    """A constant command: which state elements of the first row, under which joint names."""

    output: str
    state: str
    field: str
    elements: tuple[int, ...]
    joints: tuple[str, ...]
    template: str


# Topics and state elements of the two commands that are made up.
HAND = CommandSpec("/hsrb/gripper_controller/command", "/hsrb/servo_states", "present_position", (6,), ("hand_motor_joint",), "/hsrb/arm_trajectory_controller/command")
HEAD = CommandSpec("/hsrb/head_trajectory_controller/command", "/hsrb/joint_states", "position", (9, 10), ("head_pan_joint", "head_tilt_joint"), "/hsrb/arm_trajectory_controller/command")


def empty_doubles() -> Column:
    return F.array().cast("array<double>")


def joint_names(names: Sequence[str]) -> Column:
    return F.array(*map(F.lit, names))


def trajectory_point(positions: Column, time_from_start: Column) -> Column:
    return F.struct(positions.alias("positions"), empty_doubles().alias("velocities"), empty_doubles().alias("accelerations"), empty_doubles().alias("effort"), time_from_start.alias("time_from_start"))


def constant_command(template: DataFrame, state: DataFrame, spec: CommandSpec) -> DataFrame:
    """The template's rows with one trajectory point each, at the state's values in its first row."""
    by = keys_of(template)
    first = state.groupBy(*by).agg(F.min_by(spec.field, TIMESTAMP).alias("__first"))
    joined = template.join(first, by) if by else template.crossJoin(first)
    lost = F.raise_error(F.lit(f"{spec.state} has too few values in {spec.field}"))
    value = lambda k: F.coalesce(F.try_element_at("__first", F.lit(k + 1)), lost)
    zero = F.struct(F.lit(0).alias("sec"), F.lit(0).cast("long").alias("nanosec"))
    time = F.coalesce(F.get("points", F.lit(0))["time_from_start"], zero)
    return joined.withColumn("joint_names", joint_names(spec.joints)).withColumn("points", F.array(trajectory_point(F.array(*map(value, spec.elements)), time))).drop("__first")


def with_command(recording: Recording, spec: CommandSpec) -> Recording:
    """Adds the command topic unless it is there already."""
    if spec.output in recording.tables:
        return recording
    for need in (spec.template, spec.state):
        if need not in recording.tables:
            raise EnrichError(f"topic {need!r} is missing")
    return recording.with_tables({spec.output: constant_command(recording.table(spec.template), recording.table(spec.state), spec)})


def stamped(recording: Recording, uuid: str) -> Recording:
    """Every topic with the recording's uuid."""
    return recording.mapped(lambda df: df.withColumn("rosbag_uuid", F.lit(uuid)))
