"""Patches as whole arrays against sampling cell by cell."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from voxmill.operators import augment as A
from voxmill.operators.dense import axes_of, coarsener


def sampled(dense, matrix, shift, out, axes, nearest):
    """One output cell at a time."""
    result = np.zeros(out)
    for cell in itertools.product(*map(range, out)):
        at = [sum(matrix[r][t] * (cell[b] - (out[b] - 1) / 2) for t, b in enumerate(axes)) + shift(cell, r) + (dense.shape[a] - 1) / 2
              for r, a in enumerate(axes)]
        for pick in itertools.product((0,) if nearest else (0, 1), repeat=len(axes)):
            place, weight = list(cell), 1.0
            for a, p, high in zip(axes, at, pick):
                place[a] = int(np.rint(p)) if nearest else math.floor(p) + high
                weight *= 1.0 if nearest else 1 - abs(p - place[a])
                weight *= 0 <= place[a] < dense.shape[a]
            result[cell] += weight * dense[tuple(place)] if weight else 0
    return result


def table_of(spark, patches, axes):
    rows = [(b, s, c, *cell, float(dense[cell])) for (b, s, c), dense in patches.items() for cell in np.ndindex(dense.shape) if dense[cell]]
    return spark.createDataFrame(rows, "batch bigint, slot int, channel int, " + ", ".join(f"{a} int" for a in axes) + ", value double")


def check(spark, axes, size, out, warped, nearest, bent):
    rng = np.random.default_rng(5)
    n = len(warped)
    patches = {(b, s, c): np.round(rng.normal(size=size) + 3) for b in (0, 7) for s in range(3) for c in (0, None, 4)}
    matrices = {(b, s): rng.normal(size=(n, n)) * 0.6 + np.eye(n) for b in (0, 7) for s in range(2)}
    slots = spark.createDataFrame([(b, s, *map(float, m.ravel())) for (b, s), m in matrices.items()],
                                  "batch bigint, slot int, " + ", ".join(f"m{r}{t} double" for r in range(n) for t in range(n)))
    move = lambda cell, r: 0.31 * (r + 1) - 0.1 * sum(cell) if bent else 0.0
    offsets = spark.createDataFrame([(b, s, *cell, *(move(cell, r) for r in range(n))) for b, s in matrices for cell in np.ndindex(out)],
                                    "batch bigint, slot int, " + ", ".join(f"{a} int" for a in axes) + "".join(f", e{r} double" for r in range(n)))
    # cells that are 0 are not in the table; one row is beyond the patch
    table = table_of(spark, patches, axes).unionByName(spark.createDataFrame([(0, 0, 0, *[99] * len(axes), 5.0)], table_of(spark, patches, axes).schema))
    got = A.warp(table, slots, size, out, "value", nearest, warped, offsets if bent else None).collect()
    # the slots without parameters give nothing
    assert len(got) == len(matrices) * 3 * math.prod(out)
    by_patch = {}
    for r in got:
        by_patch.setdefault((r["batch"], r["slot"], r["channel"]), np.full(out, np.nan))[tuple(r[a] for a in axes)] = r["value"]
    for key, result in by_patch.items():
        np.testing.assert_allclose(result, sampled(patches[key], matrices[key[:2]], move, out, warped, nearest), atol=1e-9)


def test_warp_of_volumes(spark):
    check(spark, "ijk", (4, 5, 6), (3, 5, 4), (0, 1, 2), False, True)


def test_warp_of_slices_and_flat_patches(spark):
    check(spark, "ijk", (3, 6, 5), (3, 4, 6), (1, 2), False, True)
    check(spark, "jk", (6, 5), (4, 7), (0, 1), True, False)


def test_a_warp_exchanges_its_rows_once(spark):
    table = table_of(spark, {(0, 0, 0): np.ones((4, 4, 4))}, "ijk")
    slots = spark.createDataFrame([(0, 0)], "batch bigint, slot int")
    params = A.spatial_params(slots, 1, 0.5, 1.0, 1.0, (0.7, 1.4))
    plan = A.warp(table, params, (4, 4, 4), (4, 4, 4), "value")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan


def test_coarser_grids(spark):
    line = np.arange(10, dtype=float).reshape(1, 10)
    for share in (0.05, 0.3, 0.5, 0.95, 1.0):
        m = max(1, round(10 * share))
        coarse = [line[0, d * 10 // m] for d in range(m)]
        x = np.clip((np.arange(10) + 0.5) * m / 10 - 0.5, 0, m - 1)
        want = np.interp(x, np.arange(m), coarse)
        np.testing.assert_allclose(coarsener((1, 10), (1,))(np.array([share]), line, None)[0], want)


def test_flat_patches_go_through_every_step(spark):
    rng = np.random.default_rng(1)
    image = table_of(spark, {(0, s, c): rng.normal(size=(8, 8)) for s in range(4) for c in range(2)}, "jk")
    label = image.filter("channel = 0").select("batch", "slot", "j", "k", F.lit(-1).cast("tinyint").alias("label"))
    slots = image.select("batch", "slot").distinct()
    family = {**A.FAMILIES["extended"], "cutmix": {"p": 0.5, "alpha": 1}}
    out = A.augment({"image": image, "label": label}, slots, (8, 8), (6, 6), 2, 3, family=family, batch_size=4, mask_channels=[1])
    assert axes_of(out["image"]) == ["j", "k"] and out["image"].count() == 4 * 2 * 36 and out["label"].count() == 4 * 36
    assert out["image"].filter("isnan(value) OR value IS NULL OR j NOT BETWEEN 0 AND 5 OR k NOT BETWEEN 0 AND 5").isEmpty()
    levels = A.downsample_labels(out["label"], (6, 6), [(1.0, 1.0), (0.5, 0.5)])
    assert {r["level"]: r["count"] for r in levels.groupBy("level").count().collect()} == {0: 4 * 36, 1: 4 * 9}
