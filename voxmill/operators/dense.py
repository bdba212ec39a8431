"""Work on whole patches: the rows of a patch and channel pass by as one array, with what was drawn for it.

One exchange brings the rows of a patch together. A row with the patch's parameters comes first,
then the displacements of its cells, if any, then its voxels by channel or class. Only one channel of one patch is
held at a time besides a run of rows; all patches have one size, which bounds it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.columns import AXES
from voxmill.operators.lines import ROWS_AT_ONCE, whole_lines
from voxmill.operators.patches import PATCH

#: parameters, values of the patch, displacements by cell -> values of the result
Work = Callable[[np.ndarray, np.ndarray, np.ndarray | None], np.ndarray]


def axes_of(table: DataFrame) -> list[str]:
    """The axes of a table of patches: those of 2-D patches are j and k."""
    return [a for a in AXES if a in table.columns]


def over_patches(table: DataFrame, params: DataFrame, size: Sequence[int], out: Sequence[int], value: str, work: Work,
                 offsets: DataFrame | None = None, shifts: Sequence[str] = ()) -> DataFrame:
    """``work`` on every patch and channel (or class) that ``params(batch, slot, p)`` has a row for.

    ``p`` is an array of numbers. ``offsets`` has the columns ``shifts`` for cells of the result. Cells that
    a patch lacks are 0; rows beyond ``size`` and patches without parameters give nothing.
    """
    names, axes = table.columns, axes_of(table)
    layers = [c for c in names if c not in (*PATCH, *axes, value)]
    kind = table.schema[value].dataType
    none = F.lit(None).cast("array<double>")
    rows = table.withColumns({"_kind": F.lit(2), "_p": none})
    rows = rows.unionByName(params.select(*PATCH, F.lit(0).alias("_kind"), F.col("p").cast("array<double>").alias("_p")), allowMissingColumns=True)
    if offsets is not None:
        moved = offsets.select(*PATCH, F.lit(1).alias("_kind"), *[F.col(a).cast(table.schema[a].dataType).alias(a) for a in axes],
                               F.array(*shifts).cast("array<double>").alias("_p"))
        rows = rows.unionByName(moved, allowMissingColumns=True)
    size, out, n_out, n_shifts = tuple(size), tuple(out), math.prod(out), len(shifts)

    def cells_of(part: pa.Table, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, place): rows within the shape and their places in it."""
        place = [part.column(a).to_numpy() for a in axes]
        inside = np.flatnonzero(np.logical_and.reduce([(x >= 0) & (x < n) for x, n in zip(place, shape)]))
        return inside, np.ravel_multi_index([x[inside].astype(np.int64) for x in place], shape)

    def results(part: pa.Table, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, n_out, ROWS_AT_ONCE):
            hi = min(lo + ROWS_AT_ONCE, n_out)
            cells = dict(zip(axes, np.unravel_index(np.arange(lo, hi), out)))
            columns = []
            for name in names:
                of = part.schema.field(name).type
                if name == value:
                    columns.append(pa.array(values[lo:hi]))
                elif name in cells:
                    columns.append(pa.array(cells[name]).cast(of))
                else:
                    columns.append(pa.repeat(part.column(name)[0], hi - lo))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, drawn, shift = None, None, None
        for run, first in whole_lines(batches, [*PATCH, "_kind", *layers]):
            kinds = run.column("_kind").to_numpy()[first[:-1]]
            for lo, hi, what in zip(first[:-1], first[1:], kinds):
                part = run.slice(lo, hi - lo).combine_chunks()
                patch = tuple(part.column(c)[0].as_py() for c in PATCH)
                if what == 0:
                    owner, drawn, shift = patch, np.array(part.column("_p")[0].as_py(), dtype=float), None
                elif owner != patch:
                    continue
                elif what == 1:
                    inside, place = cells_of(part, out)
                    numbers = part.column("_p").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                    shift = np.zeros((n_shifts, n_out))
                    shift[:, place] = numbers[inside].T
                else:
                    inside, place = cells_of(part, size)
                    given = part.column(value).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
                    dense = np.zeros(math.prod(size), dtype=given.dtype)
                    dense[place] = given[inside]
                    yield from results(part, work(drawn, dense.reshape(size), shift).reshape(-1).astype(given.dtype))

    schema = ", ".join(f"`{c}` {kind.simpleString() if c == value else table.schema[c].dataType.simpleString()}" for c in table.columns)
    return rows.repartition(*PATCH).sortWithinPartitions(*PATCH, "_kind", *layers).mapInArrow(passed, schema)


def sampler(size: Sequence[int], out: Sequence[int], axes: Sequence[int], nearest: bool) -> Work:
    """Values at matrix * (cell - centre) + centre along the given axes, zero outside; other axes stay."""
    size, out, n = tuple(size), tuple(out), len(axes)

    def work(drawn: np.ndarray, dense: np.ndarray, shift: np.ndarray | None) -> np.ndarray:
        matrix = drawn.reshape(n, n)
        values = np.zeros(math.prod(out), dtype=dense.dtype if nearest else float)
        for lo in range(0, len(values), ROWS_AT_ONCE):
            here = slice(lo, min(lo + ROWS_AT_ONCE, len(values)))
            index = list(np.unravel_index(np.arange(here.start, here.stop), out))
            centred = [index[a] - (out[a] - 1) / 2 for a in axes]
            source = []
            for r, a in enumerate(axes):
                at = sum((matrix[r, t] * centred[t] for t in range(n)), np.zeros(len(index[a])))
                if shift is not None:
                    at = at + shift[r, here]
                source.append(at + (size[a] - 1) / 2 if size[a] > 1 else np.zeros(len(at)))
            # the cell that holds the place, or its nearest; with weights, all its corners
            low = [np.rint(p) if nearest else np.floor(p) for p in source]
            for pick in product((0,) if nearest else (0, 1), repeat=n):
                weight = np.ones(here.stop - here.start)
                for r, (a, high) in enumerate(zip(axes, pick)):
                    tap, share = low[r] + high, source[r] - np.floor(source[r])
                    weight *= ((tap >= 0) & (tap <= size[a] - 1)) * (1.0 if nearest else share if high else 1 - share)
                    index[a] = np.clip(tap, 0, size[a] - 1).astype(np.int64)
                found = dense[tuple(index)]
                values[here] += np.where(weight > 0, found, 0).astype(dense.dtype) if nearest else weight * found
        return values

    return work


def coarsener(size: Sequence[int], axes: Sequence[int]) -> Work:
    """Nearest samples on a grid that is ``drawn[0]`` times as fine, and linearly back, axis by axis."""
    def work(drawn: np.ndarray, dense: np.ndarray, _: np.ndarray | None) -> np.ndarray:
        for a in axes:
            n, m = size[a], max(1, int(np.rint(size[a] * drawn[0])))
            coarse = dense.take(np.floor(np.arange(m) * n / m).astype(np.int64), axis=a)
            x = np.maximum(0.0, (np.arange(n) + 0.5) * m / n - 0.5)
            low = np.minimum(np.floor(x), m - 1).astype(np.int64)
            share = (x - np.floor(x)).reshape([-1 if b == a else 1 for b in range(dense.ndim)])
            dense = (1 - share) * coarse.take(low, axis=a) + share * coarse.take(np.minimum(low + 1, m - 1), axis=a)
        return dense

    return work
