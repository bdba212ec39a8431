"""The plan document: what is written is what preprocessing reads back."""

import pytest
from pyspark.sql import functions as F

from voxmill.plans import document as D


@pytest.fixture(scope="module")
def inputs(spark):
    geometry = spark.createDataFrame(
        [(d, f"{d}-{c}", [1.0, 1.0, 1.0 + d], [40 + c, 50, 30], 0.5) for d in (1, 2) for c in range(5)],
        "dataset_id long, case_id string, spacing array<double>, shape_after_crop array<int>, crop_ratio double")
    meta = spark.createDataFrame(
        [(1, {"0": "CT", "1": "T1"}, {"background": "0", "lesion": "1", "both": "[1, 2]"}), (2, {"0": "T2"}, {"0": "background", "7": "organ"}),
         (3, {"0": "CT"}, {"background": "0"})], "dataset_id long, channel_names map<string,string>, labels map<string,string>")
    stats = "struct<mean:double,std:double,median:double,min:double,max:double,percentile_00_5:double,percentile_99_5:double>"
    fingerprint = spark.createDataFrame(
        [(1, 5, {0: (0.1, 1 / 3, 0.0, -1.0, 2.0, -0.9, 1.9), 1: (5.0, 2.0, 5.0, 1.0, 9.0, 1.1, 8.9)}, {0: 0.75, 1: 0.25}),
         (2, 5, {0: (1e-17, 1.0, 0.0, -3.0, 3.0, -2.9, 2.9)}, None)],
        f"dataset_id long, num_cases long, intensity_per_channel map<int,{stats}>, label_class_ratios map<int,double>")
    return meta, fingerprint, geometry


@pytest.fixture(scope="module")
def plans(spark, inputs, tmp_path_factory):
    plan = D.experiment_plan(*inputs, divisor=8)
    path = str(tmp_path_factory.mktemp("plan") / "plan.json")
    D.write_plan(plan, path)
    return plan, D.read_plan(spark, path)


def test_round_trip_is_exact(plans):
    made, read = (sorted(p.collect(), key=lambda r: r.dataset_id) for p in plans)
    assert [r.dataset_id for r in read] == ["1", "2"]           # a dataset without cases has no plan
    assert made == read
    assert read[1].label_class_ratios is None and read[0].label_class_ratios == {"0": 0.75, "1": 0.25}


def test_configuration_comes_from_the_document(plans):
    _, plan = plans
    c = D.configuration_of(plan, 1, "3d_fullres")
    assert c.schemes == ("CTNormalization", "ZScoreNormalization") and c.use_mask == (False, True)
    assert c.labels == (0, 1) and c.transpose_forward == (2, 0, 1) and c.spacing == (2.0, 1.0, 1.0)
    assert D.configuration_of(plan, 2, "3d_fullres").labels == (0, 7)
    flat = D.configuration_of(plan, 1, "2d")
    assert len(flat.spacing) == 2 and flat.through_plane_spacing == 2.0


def test_statistics_come_from_the_document(plans):
    rows = {(r.dataset_id, r.channel): (r.mean, r.std) for r in D.foreground_statistics(plans[1]).collect()}
    assert rows == {("1", 0): (0.1, 1 / 3), ("1", 1): (5.0, 2.0), ("2", 0): (1e-17, 1.0)}


def test_what_is_missing_or_doubled_is_an_error(plans):
    _, plan = plans
    with pytest.raises(ValueError, match="no configuration 'huge' of dataset 1"):
        D.configuration_of(plan, 1, "huge")
    with pytest.raises(ValueError, match="no configuration"):
        D.configuration_of(plan, 3, "2d")
    with pytest.raises(ValueError, match="more than one"):
        D.configuration_of(plan.unionByName(plan), 1, "2d")
    with pytest.raises(ValueError, match="no dataset"):
        D.preprocess_planned(plan, "huge", None, None, None)


def test_no_datasets_no_plans(inputs):
    meta, fingerprint, geometry = inputs
    assert D.experiment_plan(meta, fingerprint, geometry.filter(F.lit(False))).count() == 0
