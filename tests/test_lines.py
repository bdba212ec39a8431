"""Line kernels against brute force, and their cost."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxmill.operators import lines as L
from voxmill.operators import morphology as M


def some_lines(rng, n, width, share):
    pos, height, first = [], [], [0]
    for _ in range(n):
        own = np.flatnonzero(rng.random(width) < share)
        pos.append(own)
        height.append(rng.choice([0.0, 1.0, rng.random() * 90], size=len(own)))
        first.append(first[-1] + len(own))
    keep = np.append(True, np.diff(first) > 0)
    return np.array(first)[keep], np.concatenate(pos).astype(float), np.concatenate(height), rng.random(int(keep.sum()) - 1) * 3 + 0.2


def brute(first, pos, height, step, line, place):
    return np.array([(height[first[l]:first[l + 1]] + ((q - pos[first[l]:first[l + 1]]) * step[l]) ** 2).min() for l, q in zip(line, place)])


@pytest.mark.parametrize("share", [0.05, 0.5, 1.0])
def test_lower_envelopes(share):
    rng = np.random.default_rng(6)
    first, pos, height, step = some_lines(rng, 60, 40, share)
    n = len(step)
    line, place, value = L.fill_lines(first, pos, height, step, np.full(n, 3.0), np.full(n, 47.0))
    assert len(line) == n * 45 and (place.reshape(n, -1) == np.arange(3, 48)).all()
    assert np.allclose(value, brute(first, pos, height, step, line, place))
    near = L.fill_lines(first, pos, height, step, np.zeros(n), np.full(n, 39.0), 5.0)
    every = L.fill_lines(first, pos, height, step, np.zeros(n), np.full(n, 39.0))
    within = every[2] <= 25.0
    assert all(np.allclose(a, b[within]) for a, b in zip(near, every))
    asked = rng.integers(0, n, 300), rng.integers(-5, 60, 300)
    assert np.allclose(L.envelope_at(first, pos, height, step, *asked), brute(first, pos, height, step, *asked))


def test_lines_without_seeds_are_infinite():
    got = L.envelope_at(np.array([0, 0, 1, 1]), np.array([2.0]), np.array([0.0]), np.ones(3), np.array([0, 1, 2, 1]), np.array([1.0, 2.0, 5.0, 4.0]))
    assert got.tolist() == [np.inf, 0.0, np.inf, 4.0]


def test_the_cost_of_a_line_is_linear():
    rng = np.random.default_rng(0)

    def seconds(width):
        first, pos = np.arange(0, 41 * width, width), np.tile(np.arange(float(width)), 40)
        height = rng.random(40 * width) * 1000
        best = np.inf
        for _ in range(3):
            began = time.perf_counter()
            L.fill_lines(first, pos, height, np.ones(40), np.zeros(40), np.full(40, width - 1.0))
            best = min(best, time.perf_counter() - began)
        return best

    seconds(200)
    assert seconds(10_000) < 25 * seconds(1_000)


def dense_spline(old, new):
    def mirror(i):
        return 0 if old == 1 else (old - 1) - abs((old - 1) - (abs(i) % (2 * (old - 1))))
    solve, basis = np.zeros((old, old)), np.zeros((new, old))
    for r in range(old):
        for shift, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            solve[r, mirror(r + shift)] += w
    for o in range(new):
        x = (o + 0.5) * old / new - 0.5
        for m in range(int(np.floor(x)) - 1, int(np.floor(x)) + 3):
            d = abs(x - m)
            basis[o, mirror(m)] += (4 - 6 * d * d + 3 * d ** 3) / 6 if d < 1 else (2 - d) ** 3 / 6 if d < 2 else 0.0
    return basis @ np.linalg.inv(solve)


def test_recursive_splines_are_those_of_a_dense_solve():
    rng = np.random.default_rng(1)
    old = np.array([1, 2, 2, 3, 8, 9, 40, 40, 117])
    new = np.array([4, 5, 1, 3, 3, 9, 57, 7, 60])
    first = np.concatenate([[0], np.cumsum(old)])
    values = rng.normal(size=first[-1])
    got, starts = L.resample_lines(first, values, new)
    for k, (n, m) in enumerate(zip(old, new)):
        assert np.allclose(got[starts[k]:starts[k + 1]], dense_spline(n, m) @ values[first[k]:first[k + 1]], atol=1e-11)


def test_long_lines_take_no_matrix():
    x = np.sin(np.arange(10_000) / 50)
    got, _ = L.resample_lines(np.array([0, 10_000]), x, np.array([20_000]))
    at = (np.arange(20_000) + 0.5) / 2 - 0.5
    assert np.allclose(got[100:-100], np.sin(at / 50)[100:-100], atol=1e-6)


def test_lines_that_batches_cut(spark, monkeypatch):
    rows = spark.range(4000).select((F.col("id") % 7).cast("string").alias("a"), (F.col("id") % 3).alias("b"), F.floor(F.col("id") / 21).cast("int").alias("k"),
                                    F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("n"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        def work(table, first):
            return L.carried(table, ["a", "b", "n"], first[:-1], size=np.diff(first))
        got = L.over_lines(rows, ["a", "b", "n"], ["k"], work, L.ddl(rows, ["a", "b", "n"], size="bigint"), ["a"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r["a"], r["b"]): r["n_"] for r in rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_")).collect()}
    assert {(r["a"], r["b"]): r["size"] for r in got} == want and len(got) == 21


def test_two_exchanges_give_signed_distances(spark):
    segs = spark.range(1000).select(F.lit("c").alias("case_id"), *[(F.floor(F.col("id") / d) % 10).cast("int").alias(a) for a, d in zip("ijk", (100, 10, 1))],
                                    F.when(F.col("id") % 17 == 0, 1).otherwise(0).cast("tinyint").alias("label"))
    cases = spark.createDataFrame([("c", [10, 10, 10], [1.0, 1.0, 2.5])], "case_id string, shape array<int>, spacing array<double>")
    plan = M.signed_distance(segs, [1], cases)._jdf.queryExecution().executedPlan().toString()
    # three for the edges (two are one and the same), one for both passes within slabs, one for the last pass with its queries
    assert plan.count("REPARTITION_BY_COL") == 5 and "SortMergeJoin" not in plan and "explode(sequence" not in plan


def test_long_lines_of_few_rows_are_worked_on_in_bounded_pieces():
    rng = np.random.default_rng(4)
    counts, becomes = rng.integers(1, 4, size=3000), rng.integers(1, 400, size=3000)
    becomes[7] = 3 * L.ROWS_AT_ONCE
    first = np.concatenate([[0], np.cumsum(counts)])
    table = pa.table({"at": np.arange(first[-1])})
    seen, line = [], 0
    for part, own in L.pieces(table, first, becomes):
        assert own[0] == 0 and own[-1] == part.num_rows and (np.diff(own) == counts[line:line + len(own) - 1]).all()
        rows = becomes[line:line + len(own) - 1]
        assert len(rows) == 1 or rows[1:].sum() <= L.ROWS_AT_ONCE
        seen += part.column("at").to_pylist()
        line += len(rows)
    assert line == 3000 and seen == list(range(first[-1]))
