"""Embedding whitening with components from contour integration.

The covariance of the distinct vectors adds up over all tasks; it has as many rows as a vector has
entries. Its eigenvalues are located by inertia counts (the signs of the pivots of shifted matrices),
which cut the wanted part of the spectrum into intervals at its gaps. For each interval a quadrature
of shifted complex solves around it projects a few vectors onto the eigenvectors inside, Rayleigh-Ritz
takes these out, and the inertia count says whether one is missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import Scratch
from voxmill.llm.hardneg import finite, matrix

#: Eigenvalues to an interval, unless they are too close to be parted, and nodes of half a contour.
MOST_INSIDE = 6
NODES = 8
#: Eigenvalues below this share of the largest count as 0.
NOTHING = 1e-12


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, squares beside it) of a tridiagonal matrix with the inertia of ``v`` at every shift."""
    v = v.copy()
    for k in range(len(v) - 2):
        x = v[k + 1:, k].copy()
        size = np.linalg.norm(x)
        if not size:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        part = v[k + 1:, k + 1:]
        p = part @ x
        w = p - x * (x @ p)
        part -= 2 * (np.outer(x, w) + np.outer(w, x))
        v[k + 1:, k] = v[k, k + 1:] = 0
        v[k + 1, k] = v[k, k + 1] = size
    return np.diag(v).copy(), np.diag(v, -1) ** 2


def below(parts: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each shift: the negative pivots of the shifted matrix."""
    diagonal, beside = parts
    least = 1e-300 + np.finfo(float).eps ** 2 * beside.max(initial=0.0)
    count, pivot = np.zeros(len(shifts), dtype=np.int64), np.ones(len(shifts))
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shifts - (beside[k - 1] / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def located(parts: tuple[np.ndarray, np.ndarray], bound: float, rounds: int = 45) -> np.ndarray:
    """All eigenvalues, falling, to about bound / 2^rounds, by bisection of inertia counts."""
    n = len(parts[0])
    nth = n - np.arange(n)
    lo, hi = np.full(n, -bound), np.full(n, bound)
    for _ in range(rounds):
        mid = (lo + hi) / 2
        low = below(parts, mid) >= nth
        lo, hi = np.where(low, lo, mid), np.where(low, mid, hi)
    return (lo + hi) / 2


def intervals(values: np.ndarray, wanted: int, bound: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top, cut at the widest gaps, until ``wanted`` are inside."""
    out, start, high = [], 0, bound
    while start < wanted:
        ends = range(start + 1, min(start + MOST_INSIDE, len(values)) + 1)
        gap = {e: values[e - 1] - values[e] if e < len(values) else np.inf for e in ends}
        end = max(ends, key=lambda e: (gap[e], -e)) if start + MOST_INSIDE < len(values) or wanted < len(values) else len(values)
        while end < len(values) and values[end - 1] - values[end] <= 1e-9 * bound:
            end += 1
        low = (values[end - 1] + values[end]) / 2 if end < len(values) else -bound
        out.append((low, high, end - start))
        start, high = end, low
    return out


def project(v: np.ndarray, low: float, high: float, inside: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) between ``low`` and ``high``, of which there are ``inside``."""
    n, size = len(v), max(1e-300, float(np.abs(v).sum(axis=1).max()))
    centre, radius = (low + high) / 2, (high - low) / 2
    angles = np.pi * (np.arange(NODES) + 0.5) / NODES
    nodes = centre + radius * np.exp(1j * angles)
    shifted = nodes[:, None, None] * np.eye(n) - v
    columns = min(n, 2 * inside + 8)
    while True:
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, columns)))[0]
        last = np.inf
        for _ in range(60):
            solved = np.linalg.solve(shifted, np.broadcast_to(q.astype(complex), (NODES, *q.shape)))
            q = np.linalg.qr((radius * np.exp(1j * angles)[:, None, None] * solved).real.mean(axis=0))[0]
            small, turn = np.linalg.eigh(q.T @ v @ q)
            q = q @ turn
            own = (small > low) & (small < high)
            wrong = np.linalg.norm(v @ q[:, own] - q[:, own] * small[own], axis=0).max(initial=0.0)
            if own.sum() == inside and wrong <= 1e-14 * size:
                return small[own], q[:, own]
            if own.sum() == inside and wrong <= 1e-12 * size and wrong >= last / 2:
                # no better in another round: rounding is all that is left
                return small[own], q[:, own]
            last = wrong
        if columns == n:
            raise ArithmeticError(f"{inside} eigenvalues between {low} and {high} are not all found")
        columns = min(n, 2 * columns)


def components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, at most ``wanted``, and their unit eigenvectors as columns."""
    wanted = min(wanted, len(v))
    if not wanted or not np.abs(v).max(initial=0.0):
        return np.zeros(0), np.zeros((len(v), 0))
    bound = float(np.abs(v).sum(axis=1).max()) * 1.01
    parts = tridiagonal(v)
    found = []
    for low, high, inside in intervals(located(parts, bound), wanted, bound):
        held = np.diff(below(parts, np.array([low, high])))[0]
        if held != inside:
            raise ArithmeticError(f"{held} eigenvalues between {low} and {high}, not {inside}")
        found.append(project(v, low, high, inside))
    values, vectors = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found], axis=1)
    order = np.argsort(-values, kind="stable")[:wanted]
    order = order[values[order] > NOTHING * values.max()]
    return values[order], vectors[:, order]


def _sums(rows: DataFrame, add, names: tuple[str, ...]) -> dict:
    """Sums over all rows of arrays that ``add`` makes of a batch, entry by entry; tasks add up their own first."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = add(matrix(b.column("x")))
                total = own if total is None else total + own
        if total is not None:
            at = np.indices(total.shape).reshape(total.ndim, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(total.ravel())], names=[*names, "v"])

    schema = ", ".join([*(f"{n} int" for n in names), "v double"])
    # one number for each pair of dimensions, however many rows there are
    return {tuple(r[n] for n in names): r["v"] for r in rows.select("x").mapInArrow(partial, schema).groupBy(*names).agg(F.sum("v").alias("v")).collect()}


def whiten(embeddings: DataFrame, scale: int = 64, shift: int = 1_000_000, wanted: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per row and component.

    Entries become floor(scale * entry) + shift. The fit list is each distinct vector once, n of them; the
    components are the eigenvectors of its covariance by falling eigenvalue, ``wanted`` at most. ``whitened`` is the
    centred vector projected on the component over the root of its eigenvalue, ``explained`` the eigenvalue's share of
    all variance, ``deviation`` the sum over dimensions of (n * x - sum of x)^2, exact (null beyond a long), and
    ``identity_error`` how far the covariance of what is whitened, taken over the fit list, is from the identity.
    Rows whose vector is null or holds null or infinite entries or NaN are left out; a null vec_id and repeated
    rows take part. Shorter vectors are filled up with entries of 0. Components without variance are not
    returned, so equal vectors alone, and empty tables, give no rows.
    """
    scratch = Scratch(embeddings.sparkSession)
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint") + F.lit(shift))
    rows = embeddings.filter(finite(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = scratch.keep(rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(shift).cast("bigint"), F.lit(width) - F.size("x")))))
    fit = scratch.keep(rows.select("x").distinct())
    n = fit.count()
    sums = {r["at"]: int(r["s"]) for r in fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(
        F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect()}
    total = [sums[k] for k in range(width)] if n else []
    # the mean as a whole part and a rest, so that centring loses nothing
    whole = np.array([s // n for s in total], dtype=np.int64)
    rest = np.array([s % n / n for s in total])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(float) - rest

    def products(x: np.ndarray) -> np.ndarray:
        d = centred(x)
        return d.T @ d

    v = np.zeros((width, width))
    for (i, j), value in _sums(fit, products, ("i", "j")).items():
        v[i, j] = value / n
    v = (v + v.T) / 2
    values, vectors = components(v, wanted)
    scaled = vectors / np.sqrt(values)

    def whitened_products(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ scaled
        return w.T @ w

    close = _sums(fit, whitened_products, ("i", "j")) if len(values) else {}
    error = max((abs(value / n - (i == j)) for (i, j), value in close.items()), default=0.0)
    trace = float(np.trace(v))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"))
            w = centred(x) @ scaled
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(_deviation(x, n, total), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))], names=["vec_id", "deviation", "w"])

    if not len(values):
        rows = rows.limit(0)
    out = rows.mapInArrow(projected, "vec_id bigint, deviation bigint, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(float(e / trace)) for e in values]).cast("array<double>"), F.col("at"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                      explained.alias("explained"), F.lit(float(error)).alias("identity_error"))


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - total)^2 as whole numbers of any size; None beyond a long."""
    if not x.size:
        return [0] * len(x)
    low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
    far = max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, total))
    largest = max(max(map(abs, total)), n * max(map(abs, [*low, *high])))
    if far * far * len(total) < 2 ** 63 and largest < 2 ** 63:
        off = n * x - np.array(total, dtype=np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, total)) for row in x.tolist()]
    return [e if e < 2 ** 63 else None for e in exact]
