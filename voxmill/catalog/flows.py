"""Queries on reading and writing, incremental statistics, preprocessing and its inverse."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.catalog.base import flat, q6, query, r6, rounded
from voxmill.catalog.fingerprint import FG, INBOX, SQL_STATS, STATS
from voxmill.catalog.inputs import cases, one_channel, segs, table, voxels, with_grid
from voxmill.catalog.manifest import FOLDS, customer_splits
from voxmill.catalog.plan import CONFIGS, PLANNED, TARGET
from voxmill.operators import fingerprint as P
from voxmill.plans import document as D
from voxmill.plans.preprocess import Configuration, crop_stage, label_stage, preprocess, revert, revert_labels
from voxmill.session import scratch_path, settle
from voxmill.sources import files as S
from voxmill.streaming import incremental as I


@query("dataset_meta", """
SELECT p_partkey AS dataset_id, p_brand AS channel_name, p_size::VARCHAR AS label_value, '.nii.gz' AS file_ending FROM part""")
def _(spark, sf):
    names = F.create_map(F.lit("0"), F.col("p_brand"))
    # every second dataset uses the older key
    old = F.col("p_partkey") % 2 == 0
    doc = F.to_json(F.struct(F.when(~old, names).alias("channel_names"), F.when(old, names).alias("modality"),
                             F.create_map(F.col("p_name"), F.col("p_size")).alias("labels"), F.lit(".nii.gz").alias("file_ending")))
    meta = S.parse_dataset_meta(table(spark, sf, "part").select(F.col("p_partkey").alias("dataset_id"), doc.alias("doc"), "p_name"), "doc")
    return meta.select("dataset_id", F.element_at("channel_names", F.lit("0")).alias("channel_name"),
                       F.element_at("labels", F.col("p_name")).alias("label_value"), "file_ending")


@query("voxel_round_trip", with_grid("SELECT * FROM voxels"))
def _(spark, sf):
    path = scratch_path(spark, "voxels")
    S.write_voxels(voxels(spark, sf), path)
    return S.read_voxels(spark, path)


@query("preprocessed_round_trip", with_grid("""
SELECT case_id, channel, i, j, k, value, 'plans_3d_fullres' AS data_identifier, 'train' AS split FROM voxels WHERE case_id % 4 <> 0"""))
def _(spark, sf):
    path = scratch_path(spark, "preprocessed")
    role = F.when(F.col("case_id") % 4 == 0, "test").otherwise("train")
    S.write_preprocessed(voxels(spark, sf).withColumn("data_identifier", F.lit("plans_3d_fullres")).withColumn("split", role), path)
    return S.read_preprocessed(spark, path, "plans_3d_fullres", "train")


@query("json_artifact", "WITH " + FOLDS + " SELECT fold::BIGINT AS fold, role, case_id FROM splits")
def _(spark, sf):
    path = scratch_path(spark, "splits")
    S.write_json_artifact(customer_splits(spark, sf), path)
    return spark.read.schema("fold bigint, role string, case_id string").json(path)


@query("copy_gt_if_absent", with_grid("""
SELECT * FROM segs WHERE case_id NOT IN (SELECT case_id FROM cases WHERE case_id % 3 = 1)"""))
def _(spark, sf):
    return S.copy_gt_if_absent(segs(spark, sf), cases(spark, sf).filter("case_id % 3 = 1"))


def streamed_partials(spark, sf):
    """Cases arrive in three files, one per micro-batch, which reads the buckets of its cases."""
    source, root, checkpoint, images, labels = (scratch_path(spark, n) for n in ("arrivals", "partials", "progress", "images", "labels"))
    S.write_bucketed(voxels(spark, sf), images)
    S.write_bucketed(segs(spark, sf), labels)
    table_of_cases = cases(spark, sf)
    table_of_cases.repartition(3, "case_id").write.parquet(source)
    arriving = spark.readStream.schema(table_of_cases.schema).option("maxFilesPerTrigger", 1).parquet(source)
    I.stream_statistics(arriving, S.read_bucketed(spark, images), S.read_bucketed(spark, labels), root, checkpoint).awaitTermination()
    return I.read_statistics(spark, root)


@query("incremental_statistics", with_grid(f"SELECT dataset_id, channel, {SQL_STATS} FROM fg GROUP BY 1, 2", FG))
def _(spark, sf):
    return rounded(P.partial_intensity_stats(streamed_partials(spark, sf)), *STATS)


# --- preprocessing: last axis first, then to a spacing of 0.8 ---------------------------

CONFIG = dict(name="3d_fullres", spacing=(1.5, 0.8, 0.8), transpose_forward=(2, 0, 1),
              schemes=("CTNormalization", "ZScoreNormalization"), use_mask=(False, True), labels=(0, 1, 2, 3))

PREP = """
tb AS (SELECT case_id, lo2 AS l0, lo0 AS l1, lo1 AS l2, hi2-lo2 AS c0, hi0-lo0 AS c1, hi1-lo1 AS c2, sz AS s0, sx AS s1, sy AS s2 FROM bbox JOIN cases USING (case_id)),
tn AS (SELECT *, round_even(c0 * s0 / 1.5::DOUBLE, 0)::INT AS n0, round_even(c1 * s1 / 0.8::DOUBLE, 0)::INT AS n1, round_even(c2 * s2 / 0.8::DOUBLE, 0)::INT AS n2 FROM tb),
marked AS (SELECT case_id, k AS i, i AS j, j AS k, (CASE WHEN label = 0 AND NOT inside AND h.case_id IS NOT NULL THEN -1 ELSE label END)::TINYINT AS label
  FROM segs JOIN mask USING (case_id, i, j, k) LEFT JOIN (SELECT case_id FROM hit) h USING (case_id)),
ncell AS (SELECT t.*, x::INT AS i, y::INT AS j, z::INT AS k FROM tn t, range(40) a(x), range(40) b(y), range(40) c(z) WHERE x < n0 AND y < n1 AND z < n2),
plabel AS (SELECT n.case_id, n.i, n.j, n.k, label FROM ncell n JOIN marked m ON m.case_id = n.case_id
  AND m.i - l0 = least(floor(((n.i + 0.5::DOUBLE) * c0 / n0 - 0.5) + 0.5), c0 - 1)
  AND m.j - l1 = least(floor(((n.j + 0.5::DOUBLE) * c1 / n1 - 0.5) + 0.5), c1 - 1)
  AND m.k - l2 = least(floor(((n.k + 0.5::DOUBLE) * c2 / n2 - 0.5) + 0.5), c2 - 1))""".replace(
      "LEFT JOIN (SELECT case_id FROM hit) h USING (case_id)", "LEFT JOIN hit h ON h.case_id = segs.case_id").replace(
      "SELECT case_id, k AS i, i AS j", "SELECT segs.case_id, segs.k AS i, segs.i AS j").replace(", j AS k, (CASE", ", segs.j AS k, (CASE")


def cropped(spark, sf):
    return crop_stage(voxels(spark, sf), segs(spark, sf), cases(spark, sf), Configuration(**CONFIG))


def prepared(spark, sf):
    stats = settle(P.foreground_intensity_stats(voxels(spark, sf), segs(spark, sf)))
    return preprocess(voxels(spark, sf), segs(spark, sf), cases(spark, sf), Configuration(**CONFIG), stats)


@query("preprocess")
def _(spark, sf):
    return rounded(prepared(spark, sf)["image"], "value")


@query("preprocess_labels", with_grid("SELECT * FROM plabel", PREP))
def _(spark, sf):
    return label_stage(cropped(spark, sf), Configuration(**CONFIG))["label"]


@query("preprocess_geometry", with_grid("""
SELECT case_id, c0 || ',' || c1 || ',' || c2 AS shape_after_crop, n0 || ',' || n1 || ',' || n2 AS resampled_shape FROM tn""", PREP))
def _(spark, sf):
    geometry = cropped(spark, sf)["geometry"]
    return flat(geometry.select("case_id", "shape_after_crop", "resampled_shape"), "shape_after_crop", "resampled_shape")


D2 = "((a.i-b.i)*1.5)*((a.i-b.i)*1.5) + ((a.j-b.j)*0.8)*((a.j-b.j)*0.8) + ((a.k-b.k)*0.8)*((a.k-b.k)*0.8)".replace("1.5", "1.5::DOUBLE").replace("0.8", "0.8::DOUBLE")


@query("preprocess_distance", with_grid(f"""
SELECT a.case_id, c.c::INT AS cls, a.i, a.j, a.k,
  {q6('CASE WHEN a.label = c.c THEN -least(10.0, coalesce(sqrt(min(CASE WHEN b.label <> c.c THEN ' + D2 + ' END)), 10.0)) ELSE least(10.0, coalesce(sqrt(min(CASE WHEN b.label = c.c THEN ' + D2 + ' END)), 10.0)) END')} AS dist
FROM plabel a CROSS JOIN (SELECT unnest([1, 2, 3]) AS c) c JOIN plabel b USING (case_id)
GROUP BY a.case_id, c.c, a.i, a.j, a.k, a.label""", PREP))
def _(spark, sf):
    return rounded(label_stage(cropped(spark, sf), Configuration(**CONFIG))["distance"], "dist")


@query("properties_round_trip", with_grid("""
SELECT case_id::VARCHAR AS case_id, '1,2,0' AS transpose_backward, c0 || ',' || c1 || ',' || c2 AS shape_after_crop, 2 AS n_params,
  array_to_string([l0 || ':' || (l0 + c0), l1 || ':' || (l1 + c1), l2 || ':' || (l2 + c2)], ',') AS crop_bbox FROM tn""", PREP))
def _(spark, sf):
    path = scratch_path(spark, "properties")
    S.write_properties(prepared(spark, sf)["properties"], path)
    back = S.read_properties(spark, path)
    return flat(back.select(
        "case_id", "transpose_backward", "shape_after_crop", F.size("normalization_params").alias("n_params"),
        F.transform("crop_bbox", lambda b: F.concat(b["lo"].cast("string"), F.lit(":"), b["hi"].cast("string"))).alias("crop_bbox")),
        "transpose_backward", "shape_after_crop", "crop_bbox")


@query("revert_labels", with_grid("""
SELECT c.case_id, c.i, c.j, c.k, coalesce(p.label, m.fill) AS label
FROM (SELECT t.*, x::INT AS i, y::INT AS j, z::INT AS k, z - l0 AS q0, x - l1 AS q1, y - l2 AS q2
      FROM tn t JOIN cases USING (case_id), range(8) a(x), range(8) b(y), range(8) e(z) WHERE x < nx) c
JOIN (SELECT case_id, min(label) AS fill FROM (
    SELECT p.case_id, p.label FROM plabel p JOIN tn t USING (case_id), range(8) a(x), range(8) b(y), range(8) e(z) WHERE x < c0 AND y < c1 AND z < c2
      AND p.i = least(floor(((x + 0.5::DOUBLE) * n0 / c0 - 0.5) + 0.5), n0 - 1) AND p.j = least(floor(((y + 0.5::DOUBLE) * n1 / c1 - 0.5) + 0.5), n1 - 1)
      AND p.k = least(floor(((z + 0.5::DOUBLE) * n2 / c2 - 0.5) + 0.5), n2 - 1)) GROUP BY 1) m USING (case_id)
LEFT JOIN plabel p ON p.case_id = c.case_id AND q0 >= 0 AND q0 < c0 AND q1 >= 0 AND q1 < c1 AND q2 >= 0 AND q2 < c2
  AND p.i = least(floor(((q0 + 0.5::DOUBLE) * n0 / c0 - 0.5) + 0.5), n0 - 1) AND p.j = least(floor(((q1 + 0.5::DOUBLE) * n1 / c1 - 0.5) + 0.5), n1 - 1)
  AND p.k = least(floor(((q2 + 0.5::DOUBLE) * n2 / c2 - 0.5) + 0.5), n2 - 1)""", PREP))
def _(spark, sf):
    done = prepared(spark, sf)
    return revert_labels(done["label"], done["properties"])


@query("revert_image")
def _(spark, sf):
    done = prepared(spark, sf)
    return rounded(revert(done["image"], done["properties"]), "value")


# --- the plan document: written, read back, and preprocessing that takes its configuration from it --------

def written_plan(spark, sf):
    grid, labels, every = voxels(spark, sf), segs(spark, sf), cases(spark, sf)
    names = F.create_map(F.lit("0"), F.lit("CT"), F.lit("1"), F.lit("T1"))
    classes = F.create_map(*[F.lit(x) for n, name in enumerate(("background", "one", "two", "three")) for x in (name, str(n))])
    meta = every.select("dataset_id").distinct().select(
        "dataset_id", F.concat(F.lit("set_"), F.col("dataset_id")).alias("dataset_name"), names.alias("channel_names"), classes.alias("labels"))
    plan = D.experiment_plan(meta, settle(P.dataset_fingerprint(grid, labels, every)), settle(P.cropped_geometry(grid, labels, every)),
                             divisor=8, ref_3d=96, ref_2d=1024, size_variants=True, variants=(("_s", 48, 512), ("_l", 176, 2880)))
    path = scratch_path(spark, "plan")
    D.write_plan(plan, path)
    return D.read_plan(spark, path)


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("experiment_plan", recursive(with_grid(f"""
SELECT dataset_id::VARCHAR AS dataset_id, 'set_' || dataset_id AS dataset_name, 'plans' AS plans_name, 'CT,T1' AS channels, 4 AS n_labels,
  num_cases, b || tag AS config, 'plans_' || b AS data_identifier, array_to_string(fw, ',') AS transpose_forward,
  array_to_string(p, ',') AS patch_size, array_to_string(m, ',') AS median_image_size, 'CTNormalization,ZScoreNormalization' AS schemes,
  mean, upper, background
FROM patched JOIN (SELECT dataset_id, fw FROM tf) USING (dataset_id) JOIN (SELECT dataset_id, count(*) AS num_cases FROM fcases GROUP BY 1) USING (dataset_id)
JOIN (SELECT dataset_id, {q6('avg(value)')} AS mean, {q6('quantile_cont(value, 0.995)')} AS upper FROM fg WHERE channel = 1 GROUP BY 1) USING (dataset_id)
JOIN (SELECT dataset_id, {q6("count(*) FILTER (WHERE label = 0) / count(*)::DOUBLE")} AS background FROM inbox GROUP BY 1) USING (dataset_id)""",
                                             FG, INBOX, TARGET + PLANNED + CONFIGS)))
def _(spark, sf):
    long = written_plan(spark, sf).select("*", F.explode("configurations").alias("config", "c"))
    stats = F.element_at("foreground_intensity_per_channel", F.lit("1"))
    return flat(long.select(
        "dataset_id", "dataset_name", "plans_name", F.array_sort(F.map_values("channel_names")).alias("channels"),
        F.size("labels").alias("n_labels"), "num_cases", "config", "c.data_identifier", "transpose_forward", "c.patch_size",
        "c.median_image_size", F.col("c.normalization_schemes").alias("schemes"), r6(stats["mean"]).alias("mean"),
        r6(stats["percentile_99_5"]).alias("upper"), r6(F.element_at("label_class_ratios", F.lit("0"))).alias("background")),
        "channels", "transpose_forward", "patch_size", "median_image_size", "schemes")


@query("preprocess_planned", recursive(with_grid("""
SELECT case_id, array_to_string([c[fw[x]+1] FOR x IN [1,2,3]], ',') AS shape_after_crop,
  array_to_string([round_even(c[fw[x]+1] * s[fw[x]+1] / st[x], 0)::INT FOR x IN [1,2,3]], ',') AS resampled_shape,
  '3d_fullres' AS configuration
FROM (SELECT b.case_id, dataset_id, [hi0-lo0, hi1-lo1, hi2-lo2] AS c, [sx, sy, sz] AS s FROM bbox b JOIN cases USING (case_id))
JOIN (SELECT dataset_id, fw, st FROM pl) USING (dataset_id)""", TARGET + PLANNED)))
def _(spark, sf):
    done = D.preprocess_planned(written_plan(spark, sf), "3d_fullres", voxels(spark, sf), segs(spark, sf), cases(spark, sf), holes=False)
    return flat(done["properties"].select("case_id", "shape_after_crop", "resampled_shape", "configuration"), "shape_after_crop", "resampled_shape")
