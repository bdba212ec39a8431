"""Resampling of voxel grids, one axis after the other.

``shapes(case_id, old_shape, new_shape)``. Order 0 is an expression: each source
voxel is sent to the output positions it becomes, so nothing is joined. Orders 1 and 3
take whole lines (at most one axis long), many at a time, in Arrow batches: they are
sorted in the partition of their line, interpolated between neighbours or filtered recursively.

Voxels carry the sizes of the axes that are still to come, an axis's two in one number: a column is eight
bytes of every row that is shuffled and sorted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.columns import AXES
from voxmill.operators import lines
from voxmill.operators.spread import attach

ANISO_THRESHOLD = 3.0  # fixed value: spacing ratio from which the first axis is treated apart


def needs_separate_z(spacing: Column, threshold: float = ANISO_THRESHOLD) -> Column:
    """Three axes, and the largest spacing more than ``threshold`` times the smallest."""
    low = F.array_min(spacing)
    return (F.size(spacing) >= 3) & (low != 0) & (F.array_max(spacing) / F.nullif(low, F.lit(0.0)) > threshold)


def _position(o: Column, old: Column, new: Column) -> Column:
    """Source coordinate of output ``o``."""
    return (o + 0.5) * old / new - 0.5


def _spread_out(df: DataFrame, axis: str, reach: float, old: Column, new: Column) -> DataFrame:
    """Candidate outputs ``_o`` of each source voxel; a superset, filtered by the caller."""
    s = F.col(axis)
    first = F.greatest(F.lit(0), F.floor((s - reach + 0.5) * new / old - 0.5).cast("int") - 1)
    last = F.least(new - 1, F.ceil((s + reach + 0.5) * new / old - 0.5).cast("int") + 1)
    return df.withColumn("_o", F.explode(F.sequence(F.least(first, last), last)))


def packed_sizes(old: Column, new: Column) -> Column:
    """Both sizes of an axis as one number, column ``_size<axis>`` of a voxel."""
    return F.shiftleft(old.cast("bigint"), 32) + new.cast("bigint")


def _old(a: int) -> Column:
    return F.shiftright(F.col(f"_size{a}"), 32).cast("int")


def _new(a: int) -> Column:
    return F.col(f"_size{a}").bitwiseAND(F.lit(0xffffffff)).cast("int")


def _old_new(table: pa.Table, a: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = lines.numbers(table, f"_size{a}", np.int64)[rows]
    return sizes >> 32, sizes.astype(np.int32).astype(np.int64)


def _nearest_axis(df: DataFrame, axis: str, a: int) -> DataFrame:
    old, new = _old(a), _new(a)
    source = F.least(F.floor(_position(F.col("_o"), old, new) + 0.5), old - 1)
    return _spread_out(df, axis, 0.5, old, new).filter(source == F.col(axis)) \
        .withColumn(axis, F.col("_o")).drop("_o", f"_size{a}")


def _sizes(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_size")]


def _line_keys(df: DataFrame, axis: str, value: str) -> list[str]:
    return [c for c in df.columns if c not in (axis, value, *_sizes(df))]


def _kept(df: DataFrame, axis: str, a: int, value: str) -> list[str]:
    """Columns that a line's outputs have from it: its keys, and the sizes of the other axes."""
    return [*_line_keys(df, axis, value), *(c for c in _sizes(df) if c != f"_size{a}")]


def _linear_axis(df: DataFrame, axis: str, a: int, value: str) -> DataFrame:
    rest = _kept(df, axis, a, value)

    def work(table: pa.Table, first: np.ndarray) -> pa.Table:
        old, new = _old_new(table, a, first[:-1])
        known = table.column(value).is_valid().to_numpy()
        line, place, values, sure = lines.interpolate_lines(
            first, lines.numbers(table, axis, np.int64), lines.numbers(table, value), known, old, new)
        return lines.carried(table, rest, first[:-1][line], **{axis: place.astype(np.int32), value: np.ma.array(values, mask=~sure)})

    return _line_pass(df, axis, a, value, work)


def _cubic_axis(df: DataFrame, axis: str, a: int, value: str) -> DataFrame:
    rest = _kept(df, axis, a, value)

    def work(table: pa.Table, first: np.ndarray) -> pa.Table:
        _, new = _old_new(table, a, first[:-1])
        values, starts = lines.resample_lines(first, lines.numbers(table, value), new)
        line = np.repeat(np.arange(len(new)), new)
        return lines.carried(table, rest, first[:-1][line], **{axis: (np.arange(len(line)) - starts[:-1][line]).astype(np.int32), value: values})

    return _line_pass(df, axis, a, value, work)


def _line_pass(df: DataFrame, axis: str, a: int, value: str, work: Callable[[pa.Table, np.ndarray], pa.Table]) -> DataFrame:
    keys = _line_keys(df, axis, value)
    # slabs of constant i hold the lines of both other axes: the pass along k follows the one along j in place
    exchange = [keys, [c for c in keys if c != "k"], None][a]
    return lines.over_lines(df, keys, [axis], work, lines.ddl(df, _kept(df, axis, a, value), **{axis: "int", value: "double"}), exchange,
                            lambda table, first: _old_new(table, a, first[:-1])[1])


def _axis_pass(df: DataFrame, a: int, order: int, value: str) -> DataFrame:
    if order == 0:
        return _nearest_axis(df, AXES[a], a)
    return _linear_axis(df, AXES[a], a, value) if order == 1 else _cubic_axis(df, AXES[a], a, value)


def _clipped(df: DataFrame, source: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Limit the result to the range of what went in (splines overshoot)."""
    limits = source.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return attach(df, limits, keys).withColumn(value, F.least(F.greatest(value, "_lo"), "_hi")).drop("_lo", "_hi")


def _with_sizes(table: DataFrame, shapes: DataFrame) -> DataFrame:
    flat = shapes.select("case_id", *[packed_sizes(F.get("old_shape", F.lit(a)), F.get("new_shape", F.lit(a))).alias(f"_size{a}") for a in range(3)])
    return attach(table, flat, ["case_id"])


def _layers(table: DataFrame) -> list[str]:
    return ["case_id"] + [c for c in ("channel",) if c in table.columns]


def resample(table: DataFrame, shapes: DataFrame, order: int, value: str = "value") -> DataFrame:
    """Same order on all axes. Cases whose shape stays are passed through."""
    sized = _with_sizes(table, shapes)
    same = F.lit(True)
    for a in range(3):
        same = same & (_old(a) == _new(a))
    moved = sized.filter(~same)
    out = moved
    for a in range(3):
        out = _axis_pass(out, a, order, value)
    if order > 1:
        out = _clipped(out, moved, _layers(table), value)
    return sized.filter(same).select(*table.columns).unionByName(out.select(*table.columns))


def resample_separate_z(table: DataFrame, shapes: DataFrame, order: int, order_z: int = 0,
                        value: str = "value") -> DataFrame:
    """In-plane with ``order``, then the first axis with ``order_z``."""
    sized = _with_sizes(table, shapes)
    flat_same = (_old(1) == _new(1)) & (_old(2) == _new(2))
    z_same = _old(0) == _new(0)
    still = sized.filter(flat_same)
    moved = sized.filter(~flat_same)
    plane = _axis_pass(_axis_pass(moved, 1, order, value), 2, order, value)
    if order > 1:
        plane = _clipped(plane, moved, [*_layers(table), "i"], value)
    plane = still.select(*plane.columns).unionByName(plane)
    if order_z == 0:
        return _axis_pass(plane, 0, 0, value).select(*table.columns)
    deep = plane.filter(~z_same)
    out = _axis_pass(deep, 0, order_z, value)
    if order_z > 1:
        out = _clipped(out, deep, [*_layers(table), "j", "k"], value)
    return plane.filter(z_same).select(*table.columns).unionByName(out.select(*table.columns))


def resample_labels(segs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Labels are nearest-neighbour on every axis, with or without a separate first axis."""
    return resample(segs, shapes, 0, "label")


def resample_auto(table: DataFrame, shapes: DataFrame, order: int = 3, order_z: int = 0,
                  value: str = "value", force_separate_z: bool | None = None) -> DataFrame:
    """Cases with thick slices (before or after) take the two-step way.

    shapes also has ``spacing`` and ``target``."""
    if force_separate_z is not None:
        return resample_separate_z(table, shapes, order, order_z, value) if force_separate_z \
            else resample(table, shapes, order, value)
    thick = needs_separate_z(F.col("spacing")) | needs_separate_z(F.col("target"))
    return resample(table, shapes.filter(~thick), order, value).unionByName(
        resample_separate_z(table, shapes.filter(thick), order, order_z, value))
