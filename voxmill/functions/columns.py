"""Column helpers shared by the operators; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("i", "j", "k")
VOXEL = ("case_id", *AXES)
CHANNEL_VOXEL = ("case_id", "channel", *AXES)


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def token(*parts) -> Column:
    """Hex digest of the parts: the same in every engine that has md5."""
    return F.md5(F.concat_ws("|", *[as_col(p).cast("string") for p in parts]))


def draw(*parts) -> Column:
    """Uniform number in [0, 1) that depends on nothing but the parts."""
    head = F.conv(F.substring(token(*parts), 1, 13), 16, 10).cast("bigint")
    return head / F.lit(4503599627370496.0)


def draw_between(lo, hi, *parts) -> Column:
    return as_col(lo) + draw(*parts) * (as_col(hi) - as_col(lo))


def draw_index(size, *parts) -> Column:
    """Uniform index in [0, size)."""
    return F.floor(draw(*parts) * size).cast("bigint")


def draw_normal(*parts) -> Column:
    """Standard normal number (Box-Muller over two draws; 1-u avoids log 0)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - draw(*parts, "a")))
    return radius * F.cos(F.lit(6.283185307179586) * draw(*parts, "b"))


def half_even(value: Column) -> Column:
    """Round half to even, as an integer."""
    return F.rint(value).cast("int")


def half_floor(value: Column) -> Column:
    """floor(x / 2): ``div`` would truncate negative numbers towards zero."""
    return F.floor(value / F.lit(2)).cast("int")


def per_axis(fn, n: int = 3) -> Column:
    """Array of ``fn(axis)`` over the spatial axes."""
    return F.array(*[fn(a) for a in range(n)])


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda acc, x: acc * x.cast("double"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row: in a lambda it would be for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2.0


def permute(values: Column, order: Column) -> Column:
    """values[order[0]], values[order[1]], ..."""
    return F.transform(order, lambda a: F.get(values, a))


def inside_box(lo: Column, hi: Column) -> Column:
    """The voxel lies in [lo, hi) on every axis."""
    test = F.lit(True)
    for a, axis in enumerate(AXES):
        test = test & (F.col(axis) >= lo[a]) & (F.col(axis) < hi[a])
    return test
