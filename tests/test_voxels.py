"""Brute force on small volumes and properties that must hold."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill import session
from voxmill.operators import augment as A
from voxmill.operators import morphology as M
from voxmill.operators import normalize as N
from voxmill.operators import resample as Z
from voxmill.operators import spread as S
from voxmill.operators import voxel as V
from voxmill.plans.configure import half_even
from voxmill.plans.preprocess import Configuration, preprocess, revert, revert_labels


def long_form(spark, array, case="c", channel=0):
    rows = [(case, channel, *map(int, ijk), float(array[ijk])) for ijk in np.ndindex(array.shape)]
    return spark.createDataFrame(rows, "case_id string, channel int, i int, j int, k int, value double")


def labels_of(spark, array, case="c"):
    rows = [(case, *map(int, ijk), int(array[ijk])) for ijk in np.ndindex(array.shape)]
    return spark.createDataFrame(rows, "case_id string, i int, j int, k int, label tinyint")


def case_row(spark, shape, spacing=(1.0, 1.0, 1.0), case="c"):
    return spark.createDataFrame([(case, 0, list(map(int, shape)), [float(s) for s in spacing])],
                                 "case_id string, dataset_id int, shape array<int>, spacing array<double>")


def dense(df, shape, value):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["i"], r["j"], r["k"]] = r[value]
    return out


def flood(inside):
    """Background reached from the border, by repeated growth."""
    reached = np.zeros_like(inside)
    edge = np.ones_like(inside)
    edge[1:-1, 1:-1, 1:-1] = False
    reached |= edge & ~inside
    while True:
        grown = reached.copy()
        for a in range(3):
            for s in (1, -1):
                moved = np.roll(reached, s, a)
                cut = [slice(None)] * 3
                cut[a] = 0 if s == 1 else -1
                moved[tuple(cut)] = False
                grown |= moved
        grown &= ~inside
        if (grown == reached).all():
            return reached
        reached = grown


def test_fill_holes(spark):
    rng = np.random.default_rng(3)
    inside = rng.random((7, 6, 9)) < 0.62
    mask = spark.createDataFrame([("c", *map(int, x), bool(inside[x])) for x in np.ndindex(inside.shape)],
                                 "case_id string, i int, j int, k int, inside boolean")
    cases = case_row(spark, inside.shape)
    once = M.fill_holes(mask, cases).cache()
    got = dense(once.withColumn("v", F.col("inside").cast("int")), inside.shape, "v").astype(bool)
    assert (got == ~flood(inside)).all()
    assert (got >= inside).all()
    assert (dense(M.fill_holes(once, cases).withColumn("v", F.col("inside").cast("int")), inside.shape, "v") == got).all()


def test_long_tunnels(spark):
    inside = np.ones((70, 7, 9), bool)
    inside[1:-1, 1, 4] = False          # closed
    inside[0:-1, 3, 4] = False          # open at one end
    for i in range(1, 69):              # winding, closed
        inside[i, 5, 2:7] = i % 2 == 0
        if i % 2 == 0:
            inside[i, 5, 2 if i % 4 else 6] = False
    mask = spark.createDataFrame([("c", *map(int, x), bool(inside[x])) for x in np.ndindex(inside.shape)],
                                 "case_id string, i int, j int, k int, inside boolean")
    out = M.fill_holes(mask, case_row(spark, inside.shape)).withColumn("v", F.col("inside").cast("int"))
    assert (dense(out, inside.shape, "v").astype(bool) == ~flood(inside)).all()


def test_runs_of_small_files_stay_off_the_driver(spark, monkeypatch):
    """Files of runs are below the threshold, as they take few bytes a row; beyond BROADCAST_ROWS rows no join broadcasts them."""
    rng = np.random.default_rng(5)
    inside = rng.random((9, 8, 9)) < 0.62
    mask = spark.createDataFrame([("c", *map(int, x), bool(inside[x])) for x in np.ndindex(inside.shape)],
                                 "case_id string, i int, j int, k int, inside boolean")
    plans, kept = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def settle(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return session.settle(df)

    monkeypatch.setattr(M, "settle", settle)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        for most, broadcast in ((S.BROADCAST_ROWS, True), (100, False)):
            monkeypatch.setattr(S, "BROADCAST_ROWS", most)
            del plans[:]
            out = M.fill_holes(mask, case_row(spark, inside.shape)).withColumn("v", F.col("inside").cast("int"))
            # the first plan makes the runs, which the one case joins; the table of closed components joins in the last
            _, edges, nodes, *rounds = plans
            assert len(rounds) >= 4
            assert [("BroadcastExchange" in p) for p in [edges, nodes, *rounds]] == [broadcast, False, *[broadcast] * len(rounds)]
            placed = re.search(r"(\w+) \[case_id#\d+, run#\w+\]", out._jdf.queryExecution().executedPlan().toString())
            assert placed[1] == ("BroadcastHashJoin" if broadcast else "SortMergeJoin")
            assert (dense(out, inside.shape, "v").astype(bool) == ~flood(inside)).all()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_signed_distance(spark):
    rng = np.random.default_rng(4)
    seg = (rng.random((6, 7, 5)) < 0.15) * rng.integers(1, 3, (6, 7, 5))
    spacing = np.array([4.0, 1.5, 0.7])
    got = M.signed_distance(labels_of(spark, seg), [1, 2, 3], case_row(spark, seg.shape, spacing))
    points = np.array(list(np.ndindex(seg.shape)))
    for c in (1, 2, 3):
        mask = np.array([seg[tuple(p)] == c for p in points])
        want = np.empty(len(points))
        for n, p in enumerate(points):
            others = points[mask != mask[n]]
            d = np.sqrt((((others - p) * spacing) ** 2).sum(1)).min() if len(others) else np.inf
            want[n] = min(d, 10.0) * (-1 if mask[n] else 1)
        out = dense(got.filter(F.col("cls") == c), seg.shape, "dist").ravel()
        assert np.allclose(out, want, atol=1e-9)


def test_surface_scores_of_equal_and_missing_sides(spark):
    seg = np.zeros((6, 6, 6), int)
    seg[1:4, 1:4, 1:4] = 1
    other = seg.copy()
    seg[5, 5, 5] = 2
    scores = {r["cls"]: r for r in M.surface_distance_scores(
        labels_of(spark, seg), labels_of(spark, other), case_row(spark, seg.shape)).collect()}
    assert scores[1]["hd95"] == 0.0 and scores[1]["surface_dice"] == 1.0
    assert math.isinf(scores[2]["hd95"]) and scores[2]["surface_dice"] == 0.0


def test_cubic_resampling_is_exact_in_the_middle_of_a_parabola_and_clipped(spark):
    x = np.arange(24.0)
    array = np.broadcast_to((x ** 2)[:, None, None], (24, 1, 1)).copy()
    shapes = spark.createDataFrame([("c", [24, 1, 1], [48, 1, 1])], "case_id string, old_shape array<int>, new_shape array<int>")
    out = dense(Z.resample(long_form(spark, array), shapes, 3), (48, 1, 1), "value").ravel()
    at = (np.arange(48) + 0.5) / 2 - 0.5
    # mirrored ends bend the curve near the border only
    assert np.allclose(out[20:28], at[20:28] ** 2, atol=1e-3)
    assert out.min() >= 0 and out.max() <= 23 ** 2


def test_resampling_same_shape_is_untouched(spark):
    array = np.random.default_rng(1).normal(size=(3, 4, 5))
    shapes = spark.createDataFrame([("c", [3, 4, 5], [3, 4, 5])], "case_id string, old_shape array<int>, new_shape array<int>")
    for order in (0, 1, 3):
        assert (dense(Z.resample(long_form(spark, array), shapes, order), array.shape, "value") == array).all()


def test_unknown_scheme_is_an_error(spark):
    vox = long_form(spark, np.ones((2, 2, 2)))
    plan = spark.createDataFrame([(0, "Mystery", False)], "channel int, scheme string, use_mask boolean")
    with pytest.raises(Exception, match="unknown normalization scheme"):
        N.normalize(vox, plan)[0].collect()


def test_registered_normalizer(spark):
    N.register_normalizer("Halve", lambda v, p: v / 2)
    plan = spark.createDataFrame([(0, "Halve", False)], "channel int, scheme string, use_mask boolean")
    out = N.normalize(long_form(spark, np.full((2, 2, 2), 3.0)), plan)[0]
    assert {r["value"] for r in out.collect()} == {1.5}


def test_zscore_with_empty_mask_is_unchanged(spark):
    array = np.random.default_rng(2).normal(size=(3, 3, 3))
    outside = labels_of(spark, np.full((3, 3, 3), -1))
    out = N.normalize_zscore(long_form(spark, array), outside, use_mask=True)
    assert np.allclose(dense(out, array.shape, "value"), array)


def test_all_zero_volume_keeps_labels(spark):
    seg = np.zeros((3, 3, 3), int)
    seg[1, 1, 1] = 2
    mask = V.nonzero_mask(long_form(spark, np.zeros((3, 3, 3))))
    assert (dense(V.mark_outside(labels_of(spark, seg), mask), seg.shape, "label") == seg).all()
    assert (dense(V.mark_outside(None, mask), seg.shape, "label") == -1).all()
    box = V.nonzero_bbox(long_form(spark, np.zeros((3, 3, 3))), case_row(spark, (3, 3, 3))).first()
    assert (box["lo"], box["hi"]) == ([0, 0, 0], [3, 3, 3])


def test_half_even(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double").select(half_even(F.col("x")).alias("r"))
    assert [r["r"] for r in got.collect()] == [0, 2, 2, 0]


def test_preprocess_then_revert_gives_the_labels_back(spark):
    rng = np.random.default_rng(5)
    image = np.zeros((6, 7, 8))
    image[1:5, 2:6, 1:7] = rng.normal(size=(4, 4, 6)) + 5
    seg = np.zeros(image.shape, int)
    seg[2:4, 3:5, 2:5] = rng.integers(0, 3, (2, 2, 3))
    vox, lab = long_form(spark, image), labels_of(spark, seg)
    cases = case_row(spark, image.shape, (1.0, 1.0, 2.0))
    config = Configuration("3d_fullres", (2.0, 1.0, 1.0), transpose_forward=(2, 0, 1), labels=(0, 1, 2))
    done = preprocess(vox, lab, cases, config)
    # nothing is rescaled, so only the outside marker may differ
    back = dense(revert_labels(done["label"], done["properties"]), seg.shape, "label")
    assert (np.where(back < 0, 0, back) == seg).all()
    whole = dense(revert(done["image"], done["properties"]), image.shape, "value")
    assert np.allclose(whole[1:5, 2:6, 1:7], image[1:5, 2:6, 1:7])
    assert done["distance"].count() == 2 * 4 * 4 * 6


def test_warp_of_the_identity_is_a_centre_crop(spark):
    array = np.random.default_rng(6).normal(size=(6, 6, 6))
    image = long_form(spark, array).select(F.lit(0).alias("batch"), F.lit(0).alias("slot"), "channel", "i", "j", "k", "value")
    slots = spark.createDataFrame([(0, 0)], "batch int, slot int")
    still = A.spatial_params(slots, 1, 0.5, 0.0, 0.0, (0.7, 1.4))
    out = A.warp(image, still, (6, 6, 6), (4, 4, 4), "value")
    assert np.allclose(dense(out, (4, 4, 4), "value"), array[1:5, 1:5, 1:5])


@pytest.mark.parametrize("family", list(A.FAMILIES))
def test_augmentation_keeps_shape_and_labels(spark, family):
    rng = np.random.default_rng(7)
    cells = list(np.ndindex((5, 5, 5)))
    image = spark.createDataFrame([(b, s, 0, *x, float(rng.normal())) for b, s in itertools.product(range(2), range(2)) for x in cells],
                                  "batch int, slot int, channel int, i int, j int, k int, value double")
    label = spark.createDataFrame([(b, s, *x, int(rng.integers(-1, 3))) for b, s in itertools.product(range(2), range(2)) for x in cells],
                                  "batch int, slot int, i int, j int, k int, label tinyint")
    slots = image.select("batch", "slot").distinct()
    out = A.augment({"image": image, "label": label}, slots, (5, 5, 5), (4, 4, 4), 1, 3, family=family)
    per = out["image"].groupBy("batch", "slot").agg(F.count_distinct("i", "j", "k").alias("n"), F.count("value").alias("m")).collect()
    assert len(per) == 4 and all(r["n"] == 64 and r["m"] == 64 for r in per)
    assert {r["label"] for r in out["label"].select("label").distinct().collect()} <= {0, 1, 2}


def test_downsampled_labels_cover_their_grids(spark):
    label = labels_of(spark, np.arange(27).reshape(3, 3, 3) % 5).select(F.lit(0).alias("batch"), F.lit(0).alias("slot"), "i", "j", "k", "label")
    out = A.downsample_labels(label, (3, 3, 3), [[1, 1, 1], [1, 0.5, 0.34]])
    assert {(r["level"], r["count"]) for r in out.groupBy("level").count().collect()} == {(0, 27), (1, 3 * 2 * 1)}


@pytest.mark.parametrize("old,new", [(3, 18), (2, 20), (12, 2), (1, 6), (4, 40)])
@pytest.mark.parametrize("axis", [0, 1, 2])
def test_linear_resampling_keeps_constants(spark, old, new, axis):
    shape, target = [2, 2, 2], [2, 2, 2]
    shape[axis], target[axis] = old, new
    cells = [(1, i, j, k, 1.0) for i in range(shape[0]) for j in range(shape[1]) for k in range(shape[2])]
    grid = spark.createDataFrame(cells, "case_id int, i int, j int, k int, value double")
    shapes = spark.createDataFrame([(1, shape, target)], "case_id int, old_shape array<int>, new_shape array<int>")
    got = [r["value"] for r in Z.resample(grid, shapes, 1).collect()]
    assert len(got) == target[0] * target[1] * target[2] and all(abs(v - 1) < 1e-12 for v in got)


def linear_volume(old, new, value):
    """Plain interpolation of the voxels there are, axis by axis; value maps (i, j, k) to a number or None."""
    for a in range(3):
        sums = {}
        for at, v in value.items():
            for o in range(new[a]):
                x = (o + 0.5) * old[a] / new[a] - 0.5
                low, weight = math.floor(x), 0.0
                for tap, w in ((low, 1 - (x - low)), (low + 1, x - low)):
                    back = abs(tap)
                    weight += w if at[a] == (0 if old[a] == 1 else 2 * (old[a] - 1) - back if back > old[a] - 1 else back) else 0.0
                if weight:
                    sums.setdefault((*at[:a], o, *at[a + 1:]), []).append(None if v is None else weight * v)
        value = {at: (sum(x for x in parts if x is not None) if any(x is not None for x in parts) else None) for at, parts in sums.items()}
    return value


def test_interpolation_makes_no_rows_but_its_outputs(spark):
    """voxels of a line meet as they are, not once for each output that they may reach."""
    shapes = spark.createDataFrame([("c", [4, 3, 2], [7, 2, 5])], "case_id string, old_shape array<int>, new_shape array<int>")
    table = long_form(spark, np.arange(24.0).reshape(4, 3, 2))
    assert "Generate" not in Z.resample(table, shapes, 1)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("order", [1, 3])
def test_voxels_carry_one_size_for_each_axis_to_come(spark, monkeypatch, order):
    """what a voxel carries is shuffled and sorted with it."""
    carried, whole = [], Z.lines.over_lines
    monkeypatch.setattr(Z.lines, "over_lines", lambda df, *more: carried.append(len(df.columns)) or whole(df, *more))
    shapes = spark.createDataFrame([("c", [4, 3, 2], [7, 2, 5]), ("d", [4, 3, 2], [4, 3, 2])], "case_id string, old_shape array<int>, new_shape array<int>")
    table = long_form(spark, np.arange(24.0).reshape(4, 3, 2))
    out = Z.resample(table, shapes, order)
    assert [n - len(table.columns) for n in carried] == [3, 2, 1]
    assert out.columns == table.columns


def test_resampling_to_a_long_axis(spark):
    """sizes go packed, two to a number."""
    shapes = spark.createDataFrame([("long", [1, 2, 1], [1, 70000, 1])], "case_id string, old_shape array<int>, new_shape array<int>")
    table = spark.createDataFrame([("long", 0, j, 0, float(j)) for j in range(2)], "case_id string, i int, j int, k int, value double")
    for order in (0, 1):
        assert [tuple(r) for r in Z.resample(table, shapes, order).agg(F.count("value"), F.max("j"), F.avg("value")).collect()] == [(70000, 69999, 0.5)]


def test_wide_interpolation_of_holes_nulls_and_infinities(spark):
    """F13"""
    rng = np.random.default_rng(4)
    shapes, rows, want = [], [], {}
    for case, (old, new) in enumerate([((4, 3, 2), (24, 3, 1)), ((1, 5, 4), (6, 2, 9)), ((6, 2, 1), (3, 2, 4)), ((3, 3, 3), (3, 3, 3))]):
        shapes.append((str(case), list(old), list(new)))
        own = {at: float(rng.normal()) for at in np.ndindex(old) if rng.random() < 0.8}
        for n, at in enumerate(list(own)):
            own[at] = None if n % 7 == 3 else math.inf if n == 5 else own[at]
        for channel in (0, None):
            rows += [(str(case), channel, *map(int, at), v) for at, v in own.items()]
            want |= {(str(case), channel, *at): v for at, v in (own if old == new else linear_volume(old, new, own)).items()}
    rows += [("0", 0, 9, 0, 0, 5.0), ("0", 0, -1, 0, 0, 5.0)]  # outside of the shape
    table = spark.createDataFrame(rows, "case_id string, channel int, i int, j int, k int, value double")
    out = Z.resample(table, spark.createDataFrame(shapes, "case_id string, old_shape array<int>, new_shape array<int>"), 1)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r[:5]): r["value"] for r in out.collect()}
    assert got.keys() == want.keys()
    for at, v in want.items():
        assert got[at] == v or (v is not None and got[at] == pytest.approx(v, rel=1e-12, abs=1e-12)), (at, v, got[at])


def test_long_keys_stay_apart(spark):
    from voxmill.catalog.manifest import padded
    ids = [7, 12345, 123456, 1234567, 1234568]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "n bigint").select(padded(F.col("n"), 5)).collect()]
    assert got == ["00007", "12345", "123456", "1234567", "1234568"]


def test_wrong_channel_counts_and_unknown_sources_are_errors(spark):
    from voxmill.operators import manifest
    files = spark.createDataFrame([("a", 0, "p"), ("a", 1, "q"), ("b", 0, "r")], "case_id string, channel int, path string")
    with pytest.raises(RuntimeError, match="b"):
        manifest.group_cases(files, 2)
    assert manifest.group_cases(files, 2, on_mismatch="drop").count() == 1
    sources = spark.createDataFrame([("liver",), ("nowhere",)], "source string")
    assert manifest.catalogue_labels(sources, unknown="drop").filter("source <> 'liver'").isEmpty()
    with pytest.raises(Exception, match="nowhere"):
        manifest.catalogue_labels(sources).collect()


def test_requests_meet_voxels_by_tile(spark):
    import random
    from voxmill.operators.voxel import crop_and_pad
    rng = random.Random(2)
    table = spark.range(40 ** 3).select(F.lit(1).alias("case_id"), *[(F.floor(F.col("id") / 40 ** p) % 40).cast("int").alias(a) for p, a in enumerate("ijk")],
                                        F.col("id").cast("double").alias("value"))
    boxes = []
    for n in range(30):
        lo = [rng.randrange(-6, 38) for _ in range(3)]
        boxes.append((0, n, 1, lo, [x + rng.randrange(1, 9) for x in lo]))
    requests = spark.createDataFrame(boxes, "batch int, slot int, case_id int, lo array<int>, hi array<int>")
    shapes = spark.createDataFrame([(1, [40, 40, 40])], "case_id int, shape array<int>")
    got = {(r["slot"], r["i"], r["j"], r["k"]): r["value"] for r in crop_and_pad(table, requests, shapes, "value", -1.0).collect()}
    want = {}
    for _, n, _, lo, hi in boxes:
        for i in range(hi[0] - lo[0]):
            for j in range(hi[1] - lo[1]):
                for k in range(hi[2] - lo[2]):
                    at = (lo[0] + i, lo[1] + j, lo[2] + k)
                    want[n, i, j, k] = float(at[0] + 40 * at[1] + 1600 * at[2]) if all(0 <= x < 40 for x in at) else -1.0
    assert got == want


def test_box_difference_is_disjoint_and_makes_no_other_cell(spark):
    rng = np.random.default_rng(11)
    rows = []
    for n in range(60):
        lo, inner = rng.integers(-3, 4, 3), rng.integers(-4, 6, 3)
        rows.append((n, [int(x) for x in inner], [int(x) for x in inner + rng.integers(-1, 6, 3)], [int(x) for x in lo], [int(x) for x in lo + rng.integers(0, 6, 3)]))
    boxes = spark.createDataFrame(rows, "n int, a array<int>, b array<int>, c array<int>, d array<int>")
    parts = boxes.select("n", F.explode(V.box_difference((F.col("a"), F.col("b")), (F.col("c"), F.col("d")))).alias("p")).collect()
    for n, a, b, c, d in rows:
        want = {p for p in itertools.product(*[range(c[x], d[x]) for x in range(3)]) if not all(a[x] <= p[x] < b[x] for x in range(3))}
        own = [r["p"] for r in parts if r["n"] == n]
        got = [p for r in own for p in itertools.product(*[range(r["lo"][x], r["hi"][x]) for x in range(3)])]
        assert len(own) <= 6 and len(got) == len(set(got)) and set(got) == want
