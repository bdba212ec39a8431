"""Queries on voxel tables: layout, masks, boxes, cropping, padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.catalog.base import flat, q6, query, rounded
from voxmill.catalog.inputs import cases, one_channel, segs, table, voxels, with_grid
from voxmill.functions.columns import AXES
from voxmill.operators import voxel as V

def box_columns():
    return [F.col(side)[a].alias(f"{side}_{x}") for side in ("lo", "hi") for a, x in enumerate(AXES)]


SQL_BOX = "lo0 lo_i, lo1 lo_j, lo2 lo_k, hi0 hi_i, hi1 hi_j, hi2 hi_k"


@query("explode_volumes", """
SELECT vec_id AS case_id, 0 AS channel, (p // 16)::INT AS i, ((p // 4) % 4)::INT AS j, (p % 4)::INT AS k,
       embedding[p+1]::DOUBLE AS value FROM embeddings, range(64) t(p)""")
def _(spark, sf):
    volumes = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("case_id"), F.lit(0).alias("channel"),
        F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"), F.col("embedding").alias("data"))
    return V.explode_volumes(volumes)


@query("transpose_axes", with_grid(
    "SELECT case_id, channel, k AS i, i AS j, j AS k, value FROM voxels"))
def _(spark, sf):
    return V.transpose_axes(voxels(spark, sf), [2, 0, 1])


@query("transpose_axes_backward", with_grid(
    "SELECT case_id, channel, i, j, k, value FROM voxels"))
def _(spark, sf):
    forward = [2, 0, 1]
    return V.transpose_axes(V.transpose_axes(voxels(spark, sf), forward), V.inverse_permutation(forward))


@query("nonzero_mask", with_grid("SELECT * FROM mask"))
def _(spark, sf):
    return V.nonzero_mask(voxels(spark, sf))


@query("nonzero_bbox", with_grid(f"SELECT case_id, {SQL_BOX} FROM bbox"))
def _(spark, sf):
    return V.nonzero_bbox(voxels(spark, sf), cases(spark, sf)).select("case_id", *box_columns())


@query("nonzero_bbox_fingerprint", with_grid(f"SELECT case_id, {SQL_BOX} FROM fbbox"))
def _(spark, sf):
    return V.nonzero_bbox(voxels(spark, sf), cases(spark, sf), segs(spark, sf)).select("case_id", *box_columns())


@query("crop_ratio", with_grid(f"""
SELECT case_id, ax || ',' || ay || ',' || az AS shape_after_crop, {q6('crop_ratio')} AS crop_ratio FROM fcases"""))
def _(spark, sf):
    grid_cases = cases(spark, sf)
    box = V.nonzero_bbox(voxels(spark, sf), grid_cases, segs(spark, sf))
    return flat(rounded(V.crop_ratio(box, grid_cases), "crop_ratio"), "shape_after_crop")


@query("crop_to_bbox", with_grid("SELECT * FROM crop"))
def _(spark, sf):
    vox = voxels(spark, sf)
    return V.crop_to_bbox(vox, V.nonzero_bbox(vox, cases(spark, sf)))


# boxes that reach beyond the volume on both sides
REQUESTS = """requests AS (SELECT (case_id % 7)::INT AS batch, (case_id // 7)::INT AS slot, case_id,
  (case_id % 5)::INT - 2 AS r0, (case_id % 3)::INT - 1 AS r1, (case_id % 4)::INT AS r2 FROM cases),
cells AS (SELECT r.*, nx, ny, nz, a.a::INT AS i, b.b::INT AS j, c.c::INT AS k
  FROM requests r JOIN cases USING (case_id), range(6) a(a), range(6) b(b), range(6) c(c))"""


def box_requests(spark, sf):
    case = F.col("case_id")
    low = [(case % 5).cast("int") - 2, (case % 3).cast("int") - 1, (case % 4).cast("int")]
    return cases(spark, sf).select(
        (case % 7).cast("int").alias("batch"), F.floor(case / 7).cast("int").alias("slot"), "case_id",
        F.array(*low).alias("lo"), F.array(*[x + 6 for x in low]).alias("hi"))


@query("crop_and_pad_image", with_grid("""
SELECT batch, slot, c.case_id, ch.channel AS channel, c.i, c.j, c.k, coalesce(value, 0.0::DOUBLE) AS value
FROM cells c CROSS JOIN (SELECT unnest([0,1]) AS channel) ch
LEFT JOIN voxels v ON v.case_id = c.case_id AND v.channel = ch.channel
 AND v.i = c.i + r0 AND v.j = c.j + r1 AND v.k = c.k + r2""", REQUESTS))
def _(spark, sf):
    return V.crop_and_pad(voxels(spark, sf), box_requests(spark, sf), cases(spark, sf), "value", 0.0,
                          extra=("channel",))


@query("crop_and_pad_label", with_grid("""
SELECT batch, slot, c.case_id, c.i, c.j, c.k, coalesce(label, -1)::TINYINT AS label
FROM cells c LEFT JOIN segs v ON v.case_id = c.case_id AND v.i = c.i + r0 AND v.j = c.j + r1 AND v.k = c.k + r2""",
                                       REQUESTS))
def _(spark, sf):
    return V.crop_and_pad(segs(spark, sf), box_requests(spark, sf), cases(spark, sf), "label", -1)


@query("uncrop", with_grid("""
SELECT c.case_id, ch.channel AS channel, a.a::INT AS i, b.b::INT AS j, d.d::INT AS k,
       coalesce(v.value, m.fill) AS value
FROM cases c JOIN bbox USING (case_id) CROSS JOIN (SELECT unnest([0,1]) AS channel) ch
JOIN (SELECT case_id, min(value) AS fill FROM crop GROUP BY 1) m USING (case_id),
range(8) a(a), range(8) b(b), range(8) d(d)
LEFT JOIN crop v ON v.case_id = c.case_id AND v.channel = ch.channel
 AND v.i = a.a - lo0 AND v.j = b.b - lo1 AND v.k = d.d - lo2
WHERE a.a < nx"""))
def _(spark, sf):
    vox, grid_cases = voxels(spark, sf), cases(spark, sf)
    box = V.nonzero_bbox(vox, grid_cases)
    return V.uncrop(V.crop_to_bbox(vox, box), box, grid_cases)


OUTSIDE = """
SELECT s.case_id, s.i, s.j, s.k,
  (CASE WHEN s.label = 0 AND NOT m.inside AND h.case_id IS NOT NULL THEN -1 ELSE s.label END)::TINYINT AS label
FROM segs s JOIN mask m USING (case_id, i, j, k) LEFT JOIN hit h ON h.case_id = s.case_id"""


@query("mark_outside", with_grid(OUTSIDE))
def _(spark, sf):
    return V.mark_outside(segs(spark, sf), V.nonzero_mask(voxels(spark, sf)))


@query("mark_outside_without_labels", with_grid(
    "SELECT case_id, i, j, k, (CASE WHEN inside THEN 0 ELSE -1 END)::TINYINT AS label FROM mask"))
def _(spark, sf):
    return V.mark_outside(None, V.nonzero_mask(voxels(spark, sf)))


@query("binarize", with_grid(
    f"SELECT case_id, i, j, k, (CASE WHEN label > 0 THEN 1 ELSE 0 END)::TINYINT AS label FROM ({OUTSIDE})"))
def _(spark, sf):
    return V.binarize(V.mark_outside(segs(spark, sf), V.nonzero_mask(voxels(spark, sf))))


@query("remove_outside_label", with_grid(
    f"SELECT case_id, i, j, k, (CASE WHEN label = -1 THEN 0 ELSE label END)::TINYINT AS label FROM ({OUTSIDE})"))
def _(spark, sf):
    return V.remove_outside_label(V.mark_outside(segs(spark, sf), V.nonzero_mask(voxels(spark, sf))))


@query("mask_image", with_grid(f"""
SELECT v.case_id, channel, v.i, v.j, v.k,
       CASE WHEN channel = 1 AND label < 0 THEN 0.0::DOUBLE ELSE value + channel END AS value
FROM voxels v JOIN ({OUTSIDE}) s USING (case_id, i, j, k)"""))
def _(spark, sf):
    vox = voxels(spark, sf)
    labels = V.mark_outside(segs(spark, sf), V.nonzero_mask(vox))
    return V.mask_image(vox.withColumn("value", F.col("value") + F.col("channel")), labels, [1])


@query("cropped_labels", with_grid("""
SELECT s.case_id, (s.i-lo0)::INT AS i, (s.j-lo1)::INT AS j, (s.k-lo2)::INT AS k, label
FROM segs s JOIN bbox USING (case_id)
WHERE s.i>=lo0 AND s.i<hi0 AND s.j>=lo1 AND s.j<hi1 AND s.k>=lo2 AND s.k<hi2"""))
def _(spark, sf):
    return V.crop_to_bbox(segs(spark, sf), V.nonzero_bbox(one_channel(spark, sf), cases(spark, sf)))
