"""The search for a coarser grid against the plain loop, step by step; rotated patches against theirs; how planning is dealt."""

import math
import random

from pyspark.sql import functions as F

from voxmill.plans.configure import LOWRES_THRESHOLD, SCALE_RANGE, SPACING_STEP, augmentation_geometry, configurations, lowres_spacing


def plain(median, spacing, patch):
    enough = math.prod(patch)
    if math.prod(median) <= 0 or enough / math.prod(median) >= LOWRES_THRESHOLD:
        return None
    wider = list(spacing)
    while True:
        shape = [round(m * s / w) for m, s, w in zip(median, spacing, wider)]
        if math.prod(shape) <= 0 or enough / math.prod(shape) >= LOWRES_THRESHOLD:
            return wider, shape
        wider = [w * SPACING_STEP for w in wider]


def test_same_step_as_the_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for n in range(3000):
        axes = rng.choice([2, 3])
        # from axes of one voxel, whose rounding is not monotone in the volume, to long ones
        top = rng.choice([3, 12, 80, 700, 20000])
        rows.append((n, [rng.randint(1, top) for _ in range(axes)], [rng.choice([0.5, 0.7, 1.0, 3.3]) for _ in range(axes)],
                     [rng.randint(1, rng.choice([2, 9, 60, 300])) for _ in range(axes)]))
    rows += [(3000, [0, 5, 5], [1.0] * 3, [1, 1, 1]), (3001, [1, 1, 400], [1.0] * 3, [1, 1, 1]), (3002, [8, 8, 8], [1.0] * 3, [8, 4, 4]),
             (3003, [8, 8, 8], [1.0] * 3, [8, 8, 1]), (3004, [10 ** 5] * 3, [1.0] * 3, [1, 1, 1])]
    table = spark.createDataFrame(rows, "id int, median array<int>, spacing array<double>, patch array<int>")
    got = {r.id: (r.low_spacing, r.low_median) for r in lowres_spacing(table).collect()}
    want = {i: found for i, m, s, p in rows if (found := plain(m, s, p))}
    assert len(want) > 1000
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][1] == want[i][1] and got[i][0] == want[i][0], rows[i]


def one_file_of_datasets(spark, n=400):
    """All in one partition, like a file of a few MB."""
    return spark.range(n).coalesce(1).select(
        F.col("id").alias("dataset_id"), F.array(*[F.lit(0.5) + (F.col("id") % m) * 0.25 for m in (7, 5, 11)]).alias("target_spacing"),
        F.array(*[F.lit(64) + (F.col("id") % m).cast("int") for m in (400, 300, 200)]).alias("median_size"))


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_augmentation_geometry_is_dealt_and_reaches_as_far_as_a_rotated_patch(spark):
    """F12"""
    assert tasks(augmentation_geometry(configurations(one_file_of_datasets(spark), divisor=8))) > 1
    rng = random.Random(3)
    patches = [[rng.choice([8, 16, 24, 96, 200]) for _ in range(rng.choice([2, 3]))] for _ in range(300)] + [[8], [8, 8, 8]]
    table = spark.createDataFrame(list(enumerate(patches)), "id int, patch_size array<int>")
    got = augmentation_geometry(table)
    assert got.columns == ["id", "patch_size", "dummy_2d", "rotation", "mirror_axes", "initial_patch_size"]
    for r in got.collect():
        def grown(a, size):
            if r.dummy_2d and a == 0:
                return size
            reach = [abs(math.sin(r.rotation)) * other + abs(math.cos(r.rotation)) * size for b, other in enumerate(r.patch_size) if b != a]
            return math.ceil(max([size, *reach]) / SCALE_RANGE[0])
        assert r.initial_patch_size == [grown(a, size) for a, size in enumerate(r.patch_size)], r


def test_configurations_of_one_file_are_dealt(spark):
    """F14; the search for coarser grids alone as well"""
    plan = one_file_of_datasets(spark)
    out = configurations(plan, divisor=8, patch_override=[30, 40, 50])
    assert tasks(out) > 1
    patches = {r.config: r.patch_size for r in out.select("config", "patch_size").distinct().collect()}
    assert patches["3d_fullres"] == [32, 40, 56] and patches["2d"] == [40, 56]
    alone = plan.select("dataset_id", F.col("target_spacing").alias("spacing"), F.col("median_size").alias("median"),
                        F.array(*[F.lit(8)] * 3).alias("patch"))
    assert tasks(lowres_spacing(alone)) > 1


def test_size_variants_are_dealt_and_differ_in_patches_only(spark):
    """F18"""
    out = configurations(one_file_of_datasets(spark), divisor=8, ref_3d=96, ref_2d=1024, size_variants=True, variants=(("_s", 48, 512),))
    assert tasks(out.filter(F.col("config").endswith("_s"))) > 1
    kept = ["dataset_id", "data_identifier", "spacing", "median_image_size"]
    small, whole = out.filter(F.col("config").endswith("_s")).select(kept), out.filter(~F.col("config").endswith("_s")).select(kept)
    assert small.count() == whole.count() and small.exceptAll(whole).isEmpty()
