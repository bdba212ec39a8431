"""Work on whole lines of voxels: rows are sorted by line in their partition and pass through as arrays.

A line is at most one axis long. Lines of a partition are worked on many at a time, so the loops are
over the places of a line, never over lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows that are gathered before their lines are worked on, and that lines worked on together become; a line that is longer counts whole.
ROWS_AT_ONCE = 1 << 16


def line_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First row of each line and the end: rows where a key differs from the row before."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        a, b = column.slice(1), column.slice(0, max(n - 1, 0))
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), n)


def whole_lines(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole lines with their starts; the last line of what has come waits for its rest."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= ROWS_AT_ONCE:
            table = pa.Table.from_batches(held)
            first = line_starts(table, keys)
            if len(first) > 2:
                yield table.slice(0, int(first[-2])).combine_chunks(), first[:-1]
                table = table.slice(int(first[-2]))
            held, rows = table.to_batches(), table.num_rows
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, line_starts(table, keys)


def pieces(table: pa.Table, first: np.ndarray, becomes: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The table in runs of whole lines, given how many rows each line becomes: few seeds may fill long lines."""
    run = (np.cumsum(becomes) - 1) // ROWS_AT_ONCE
    cuts = np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(run))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield table.slice(int(first[a]), int(first[b] - first[a])).combine_chunks(), first[a:b + 1] - first[a]


def over_lines(df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[pa.Table, np.ndarray], pa.Table],
               schema: str, exchange: Sequence[str] | None = None,
               becomes: Callable[[pa.Table, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``work`` on tables of whole lines: rows of equal ``keys`` in the given order. ``becomes`` says how many
    rows each line becomes, where that may be more than it has.

    ``exchange`` names the keys that rows are dealt by; without it they must be together already, as
    after a pass along another axis of the same slabs.
    """
    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_lines(batches, keys):
            for part, own in pieces(table, first, becomes(table, first)) if becomes else [(table, first)]:
                yield from work(part, own).to_batches(max_chunksize=ROWS_AT_ONCE)

    dealt = df.repartition(*exchange) if exchange else df
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(passed, schema)


def ddl(df: DataFrame, names: Sequence[str], **other: str) -> str:
    """Schema text of these columns as they are, and of others by name and type."""
    own = [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]
    return ", ".join([*own, *(f"`{n}` {kind}" for n, kind in other.items())])


def carried(table: pa.Table, names: Sequence[str], rows: np.ndarray, **more: np.ndarray) -> pa.Table:
    """These columns of the rows named, with further columns."""
    out = table.select(list(names)).take(pa.array(rows))
    for name, values in more.items():
        out = out.append_column(name, pa.array(values))
    return out


def numbers(table: pa.Table, name: str, kind=float) -> np.ndarray:
    """A column as an array; nulls are NaN."""
    return np.asarray(table.column(name).to_numpy(), dtype=kind)


# --- lower envelopes -------------------------------------------------------------------

def lower_envelope(first: np.ndarray, pos: np.ndarray, height: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, ...]:
    """(line, seed, begin, end) of the parts of each line's lower envelope, by line and place.

    Line l has the parabolas height[p] + ((x - pos[p]) * step[l])^2 for p from first[l] to first[l + 1], by rising
    place. A parabola joins where it falls below the one on top of the line's stack, and takes those off
    the stack that it undercuts from their beginning on, so each joins and leaves once: the cost of a
    line is linear in its seeds. All lines of the table take their next seed together.
    """
    counts = np.diff(first)
    by_count = np.argsort(-counts, kind="stable")
    starts, ordered, square = first[:-1][by_count], counts[by_count], (step * step)[by_count]
    owner = np.repeat(np.arange(len(counts)), counts)
    origin = height + pos * pos * (step * step)[owner]
    stack, begin, depth = np.zeros(len(pos), dtype=np.int64), np.full(len(pos), -np.inf), np.zeros(len(counts), dtype=np.int64)
    for nth in range(int(ordered[0]) if len(ordered) else 0):
        active = int(np.searchsorted(-ordered, -nth, side="left"))
        at = starts[:active]
        joins = at + nth
        cut, todo = np.full(active, -np.inf), np.arange(active) if nth else np.zeros(0, dtype=np.int64)
        while len(todo):
            top = at[todo] + depth[todo] - 1
            under, over = stack[top], joins[todo]
            cut[todo] = (origin[over] - origin[under]) / (2 * square[todo] * (pos[over] - pos[under]))
            todo = todo[cut[todo] <= begin[top]]
            depth[todo] -= 1
        place = at + depth[:active]
        stack[place], begin[place] = joins, cut
        depth[:active] += 1
    # back to the lines' own order
    kept = np.zeros(len(counts), dtype=np.int64)
    kept[by_count] = depth
    line = np.repeat(np.arange(len(counts)), kept)
    inside = np.arange(len(line)) - np.repeat(np.cumsum(kept) - kept, kept)
    place = first[:-1][line] + inside
    end = np.append(begin[place][1:], np.inf)
    end[np.cumsum(kept) - 1] = np.inf
    return line, stack[place], begin[place], end


def fill_lines(first: np.ndarray, pos: np.ndarray, height: np.ndarray, step: np.ndarray, low: np.ndarray, high: np.ndarray,
               limit: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, value): the lower envelope at all whole places from ``low`` to ``high`` of each line, or at
    those of them where it is at most limit^2."""
    line, seed, begin, end = lower_envelope(first, pos, height, step)
    here = pos[seed]
    start, stop = np.maximum(np.ceil(begin), low[line]), np.minimum(np.ceil(end) - 1, high[line])
    if limit is not None:
        left = limit * limit - height[seed]
        reach = np.where(left >= 0, np.floor(np.sqrt(np.maximum(left, 0)) / step[line]), -1)
        start, stop = np.maximum(start, here - reach), np.minimum(stop, here + reach)
    n = np.maximum(stop - start + 1, 0).astype(np.int64)
    line, seed, step_ = np.repeat(line, n), np.repeat(seed, n), np.repeat(step[line], n)
    place = np.repeat(start, n) + np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    off = (place - pos[seed]) * step_
    return line, place.astype(np.int64), height[seed] + off * off


def envelope_at(first: np.ndarray, pos: np.ndarray, height: np.ndarray, step: np.ndarray, line: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The lower envelope of line ``line`` at ``place``, for each of these; infinite on lines without seeds."""
    owner, seed, begin, _ = lower_envelope(first, pos, height, step)
    out = np.full(len(place), np.inf)
    if not len(place) or not len(owner):
        return out
    low, high = place.min(), place.max()
    width = int(high - low) + 2
    starts = owner * width + (np.clip(np.ceil(begin), low, high + 1) - low).astype(np.int64)
    part = np.searchsorted(starts, line * width + (place - low).astype(np.int64), side="right") - 1
    there = (part >= 0) & (owner[np.maximum(part, 0)] == line)
    seed = seed[part[there]]
    off = (place[there] - pos[seed]) * step[line[there]]
    out[there] = height[seed] + off * off
    return out


# --- cubic splines ---------------------------------------------------------------------

POLE = 3 ** 0.5 - 2


def spline_coefficients(values: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic B-splines through ``values`` (places by lines), mirrored at the end values.

    One recursive filter runs forward and one backward; both begin with the exact sum over the mirrored line.
    """
    n = len(values)
    if n == 1:
        return values.astype(float)
    c = 6.0 * values
    k = np.arange(1, n - 1)
    weights = POLE ** k + POLE ** (2 * n - 2 - k)
    c[0] = (c[0] + POLE ** (n - 1) * c[-1] + weights @ c[1:-1]) / (1 - POLE ** (2 * n - 2))
    for i in range(1, n):
        c[i] += POLE * c[i - 1]
    c[-1] = POLE / (POLE * POLE - 1) * (c[-1] + POLE * c[-2])
    for i in range(n - 2, -1, -1):
        c[i] = POLE * (c[i + 1] - c[i])
    return c


def spline_taps(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights), each new by 4: what each of ``new`` even samples of ``old`` coefficients adds up."""
    x = (np.arange(new) + 0.5) * old / new - 0.5
    taps = np.floor(x)[:, None] + np.arange(-1, 3)
    d = np.abs(x[:, None] - taps)
    weights = np.where(d < 1, (4 - 6 * d * d + 3 * d ** 3) / 6, np.where(d < 2, (2 - d) ** 3 / 6, 0.0))
    if old == 1:
        return np.zeros((new, 4), dtype=np.int64), weights
    around = np.abs(taps.astype(np.int64)) % (2 * (old - 1))
    return (old - 1) - np.abs((old - 1) - around), weights


def resample_lines(first: np.ndarray, values: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, first) of all lines at their new numbers of samples."""
    old = np.diff(first)
    out_first = np.concatenate([[0], np.cumsum(new)]).astype(np.int64)
    out = np.zeros(int(out_first[-1]))
    for n in np.unique(old):
        same = np.flatnonzero(old == n)
        c = spline_coefficients(values[first[:-1][same] + np.arange(n)[:, None]])
        for m in np.unique(new[same]):
            own = new[same] == m
            places, weights = spline_taps(int(n), int(m))
            got = sum(weights[:, t, None] * c[:, own][places[:, t]] for t in range(4))
            out[out_first[:-1][same[own]] + np.arange(m)[:, None]] = got
    return out, out_first


# --- linear interpolation --------------------------------------------------------------

def interpolate_lines(first: np.ndarray, pos: np.ndarray, values: np.ndarray, known: np.ndarray, old: np.ndarray,
                      new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, value, known): lines of ``old`` places at ``new`` places, each between its two neighbours, mirrored at the ends.

    Rows are places ``pos`` of their line; places without a row add nothing, and outputs to which none adds are left
    out. Rows that are not known count as rows but add nothing; an output of only these is not known.
    """
    start = np.cumsum(old) - old
    owner = np.repeat(np.arange(len(old)), np.diff(first))
    inside = (pos >= 0) & (pos < old[owner])
    at, size = (start[owner] + pos)[inside], int(old.sum())
    rows = np.bincount(at, minlength=size)
    valued = np.bincount(at[known[inside]], minlength=size)
    total = np.bincount(at, weights=np.where(known, values, 0.0)[inside], minlength=size)
    new = np.where(old > 0, new, 0)
    line = np.repeat(np.arange(len(new)), new)
    place = np.arange(len(line)) - np.repeat(np.cumsum(new) - new, new)
    n = old[line]
    x = (place + 0.5) * n / new[line] - 0.5
    low = np.floor(x).astype(np.int64)
    out, seen, sure = np.zeros(len(line)), np.zeros(len(line), dtype=bool), np.zeros(len(line), dtype=bool)
    for tap, weight in ((low, 1 - (x - low)), (low + 1, x - low)):
        back = np.abs(tap)
        source = start[line] + np.where(n == 1, 0, np.where(back > n - 1, 2 * (n - 1) - back, back))
        used = weight != 0
        out[used] += weight[used] * total[source[used]]
        seen |= used & (rows[source] > 0)
        sure |= used & (valued[source] > 0)
    return line[seen], place[seen], out[seen], sure[seen]
