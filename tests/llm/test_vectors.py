"""Hard negatives and whitening against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.llm import hardneg, whitening
from voxmill.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, label int, q string, rkey string"


def brute_negatives(rows, scale=16, k=5):
    """rows of (vec_id, vector, label) -> the result's rows; equal rows count once."""
    kept = {}
    for v, e, label in rows:
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            kept[v, label, tuple(math.floor(scale * x) for x in e)] = None
    kept = list(kept)
    out = []
    for a in kept:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a[2], r[2])), r[0] is None, r[0] or 0, r) for r in kept if r != a), key=lambda t: t[:3])
        for ps, _, _, pos in [t for t in scored if t[3][1] == a[1]][:k]:
            window = [t for t in scored if t[3][1] != a[1] and 80 * -ps <= 100 * -t[0] <= 100 * -ps][:k]
            out += [(a[0], pos[0], n + 1, t[3][0], -ps, -t[0]) for n, t in enumerate(window)]
    return sorted(map(str, out))


def vectors(n, dims, seed, hot=0.3):
    rng = np.random.default_rng(seed)
    rows = []
    centre = rng.normal(size=dims)
    for i in range(n):
        e = centre if rng.random() < hot / 3 else centre + rng.normal(size=dims) * 0.3 if rng.random() < hot else rng.normal(size=dims)
        rows.append((i, [float(x) for x in e / np.linalg.norm(e) * (1 + rng.random())], int(rng.integers(0, 4))))
    return rows


def mined(spark, rows, scale=16):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    q = hardneg.quantised(docs, scale)
    return sorted(str(tuple(r)) for r in hardneg.mine(q, q.filter("vec_id % 100 = 0")).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_are_those_of_brute_force(spark, seed):
    rows = vectors(900, 12, seed)
    rows += [(1000, rows[0][1], 1), (1100, rows[0][1], 1), (1100, rows[0][1], 1), (1200, [0.0] * 12, 2), (1201, [-x for x in rows[0][1]], 0)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_blocks_of_rows_and_anchors(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 100)
    monkeypatch.setattr(hardneg, "BLOCK_ANCHORS", 2)
    rows = vectors(700, 8, 5)
    assert mined(spark, rows) == brute_negatives(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 2.0, 3.0], 1), (2, [1.0], 2), (3, [], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
            (7, [None, 1.0], 1), (8, [1.0, 2.0], None), (None, [1.0, 1.9], 2), (None, [1.0, 1.9], 2), (None, [1.0, 2.0], 1), (9, [1.0, 1.9], 2), (100, [], 3),
            (200, [-1.0, -2.0], 1), (10, [1.0, 1.8], 3)]
    assert mined(spark, rows) == brute_negatives(rows)
    huge = [(0, [1e12, 1.0], 1), (1, [1e12, 2.0], 1), (2, [1e12, 1.5], 2), (3, [9e11, 1.0], 2), (4, [1e12, 1.25], 2)]
    assert len(mined(spark, huge, 1)) > 0  # scores beyond a long
    far = [(0, [3e9, 1.0], 1), (1, [3e9, 2.0], 1), (2, [3e9, 1.0], 2), (3, [2.9e9, 1.0], 2), (4, [3e9, 0.0], 2)]
    assert mined(spark, far, 1) == brute_negatives(far, 1)
    assert mined(spark, []) == [] and mined(spark, rows[4:8]) == []


def test_an_index_omits_what_its_threshold_allows_and_loses_no_pair():
    rng = np.random.default_rng(3)
    x = np.rint(rng.normal(size=(400, 24)) * np.linspace(60, 1, 24)).astype(np.int64)
    a = x[::20]
    exact = a @ x.T
    thresholds = np.quantile(exact, 0.98, axis=1)
    index = hardneg.build_index(x.astype(float), float(np.linalg.norm(a, axis=1).max()), float(thresholds.min()))
    assert (index.kept < 24).mean() > 0.5 and np.count_nonzero(index.indexed) < 0.9 * np.count_nonzero(x)
    got = sorted((i, j, s) for found in hardneg.search(x, a, thresholds) for i, j, s in zip(*(f.tolist() for f in found)))
    assert got == sorted((i, j, int(exact[i, j])) for i, j in zip(*(n.tolist() for n in np.nonzero(exact >= thresholds[:, None]))))


# --- whitening

def brute_whitening(x):
    fit = np.unique(x, axis=0)
    d = fit - fit.mean(axis=0)
    e, u = np.linalg.eigh(d.T @ d / len(fit))
    return fit, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("kind", ["plain", "clusters", "flat", "few", "ties"])
def test_components_are_those_of_a_dense_solver(kind):
    rng = np.random.default_rng(4)
    n, dims = (4000, 48) if kind != "few" else (9, 40)
    x = rng.normal(size=(n, dims)) * np.linspace(30, 5, dims)
    if kind == "clusters":
        x[: n // 2] += 400
    if kind == "flat":
        x[:, 5:] = 0
    if kind == "ties":
        v = np.diag([9.0, 9.0, 9.0, 9.0 * (1 + 1e-13), 4.0, 4.0, *[1.0] * 20])
        e, u = whitening.components(v, 5)
        assert np.allclose(e, [9, 9, 9, 9, 4]) and np.allclose(u.T @ u, np.eye(5), atol=1e-12) and np.allclose(v @ u, u * e, atol=1e-12)
        return
    x = np.floor(x)
    d = x - x.mean(axis=0)
    v = d.T @ d / n
    e, u = whitening.components(v, 16)
    want, w = np.linalg.eigh(v)
    want, w = want[::-1], w[:, ::-1]
    m = min(16, int((want > 1e-12 * want[0]).sum()))
    assert len(e) == m and np.allclose(e, want[:m], rtol=1e-11)
    assert np.allclose(u.T @ u, np.eye(m), atol=1e-11)
    assert np.allclose(np.abs((u * w[:, :m]).sum(axis=0)), 1, atol=1e-10)


def test_inertia_counts():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(30, 30))
    v = v + v.T
    e = np.linalg.eigvalsh(v)
    shifts = np.concatenate([e - 1e-6, e + 1e-6])
    assert (whitening.below(whitening.tridiagonal(v), shifts) == (e[None, :] < shifts[:, None]).sum(axis=1)).all()


def checked(got, ids, x, wanted=16):
    fit, e, u = brute_whitening(x)
    n, total = len(fit), fit.sum(axis=0)
    assert (got["n"] == n).all() and got["identity_error"].max() < 1e-9
    m = int((e[:wanted] > 1e-12 * e[0]).sum())
    w = (x - fit.mean(axis=0)) @ u[:, :m] / np.sqrt(e[:m])
    assert len(got) == len(ids) * m
    for c in range(m):
        own = got[got["component"] == c + 1]
        assert np.allclose(own["explained"], e[c] / e.sum(), rtol=1e-9)
        mine, other = np.sort(own["whitened"]), np.sort(w[:, c])
        assert np.allclose(mine, other, atol=1e-8) or np.allclose(mine, np.sort(-other), atol=1e-8)
    deviation = sorted(sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total)) for r in x)
    assert sorted(got[got["component"] == 1]["deviation"]) == deviation


def test_whitening_of_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 20))
    base = np.concatenate([base, np.repeat(base[:1], 60, axis=0)])
    rows = [(i if i % 50 else None, [float(v) for v in e], 1, None, "x") for i, e in enumerate(base)]
    odd = [(7, None, 1, "", ""), (8, [float("nan")] * 20, 1, "", ""), (9, [None] * 20, None, "", ""), (10, [float("inf")] * 20, 1, "", "")]
    got = whitening.whiten(spark.createDataFrame(rows + odd, SCHEMA)).toPandas()
    checked(got, base, np.floor(64 * base).astype(np.int64) + 1_000_000)
    short = [(1, [1.0], 1, "", ""), (2, [1.0, 2.0], 1, "", ""), (3, [], 1, "", ""), (3, [0.5, -2.0], 1, "", "")]
    got = whitening.whiten(spark.createDataFrame(short, SCHEMA)).toPandas()
    checked(got, [1, 2, 3, 3], np.floor(64 * np.array([[1.0, 0], [1, 2], [0, 0], [0.5, -2]])).astype(np.int64) + 1_000_000)


def test_whitening_of_nothing(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).isEmpty()
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "", "") for i in range(5)], SCHEMA)
    assert whitening.whiten(same).isEmpty()
    assert whitening.whiten(spark.createDataFrame([(1, [], 1, "", ""), (2, [], 1, "", "")], SCHEMA)).isEmpty()


def test_registered_whitening(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toPandas()
    x = np.floor(64 * np.stack(rows["embedding"].to_numpy()).astype(float)).astype(np.int64) + 1_000_000
    got = QUERIES["op12_whitening"](spark, sf).toPandas()
    checked(got, rows["vec_id"], x)
    assert got["whitened"].dtype == float and set(got["component"]) == set(range(1, 17))


def test_finite(spark):
    rows = [([1.0], True), ([], True), (None, False), ([None], False), ([float("nan")], False), ([1.0, float("-inf")], False)]
    got = spark.createDataFrame(rows, "v array<double>, want boolean").select("want", hardneg.finite(F.col("v")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)
