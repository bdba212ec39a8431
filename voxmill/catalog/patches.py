"""Queries on patch sampling and augmentation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxmill.catalog.base import q6, query, rounded
from voxmill.catalog.fingerprint import LOCATED
from voxmill.catalog.inputs import cases, htoken, one_channel, segs, udraw, voxels, with_grid
from voxmill.catalog.voxel import box_columns
from voxmill.operators import augment as A
from voxmill.operators import fingerprint as P
from voxmill.operators import patches as S
from voxmill.operators.voxel import crop_and_pad
from voxmill.session import settle

SEED = 42


def sdraw(name: str, *more: str, seed: int = SEED) -> str:
    return udraw(str(seed), "batch", "slot", f"'{name}'", *more)


def bdraw(name: str, seed: int = SEED) -> str:
    return udraw(str(seed), "batch", f"'{name}'")


# --- sampling: one batch of four patches per case ------------------------------------

DRAWN = f"""
batches AS (SELECT case_id AS batch FROM cases),
ranked AS (SELECT case_id, row_number() OVER (ORDER BY {htoken(str(SEED), 'case_id')}, case_id) - 1 AS rank, count(*) OVER () AS n FROM cases),
slots0 AS (SELECT batch, s::INT AS slot, floor({udraw(str(SEED), 'batch', 's', "'case'")} * (SELECT count(*) FROM cases))::BIGINT AS rank
   FROM batches, range(4) r(s)),
drawn AS (SELECT batch, slot, case_id FROM slots0 JOIN ranked USING (rank)),
forced AS (SELECT *, slot >= round_even(4 * (1 - 0.33::DOUBLE), 0) AS force_fg FROM drawn),
cnt AS (SELECT case_id, label, count(*) AS n FROM located GROUP BY 1, 2),
shares AS (SELECT case_id, label, (sum(w) OVER x - w) / sum(w) OVER y AS lo, (sum(w) OVER x) / sum(w) OVER y AS hi
   FROM (SELECT *, CASE label WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM cnt)
   WINDOW x AS (PARTITION BY case_id ORDER BY label), y AS (PARTITION BY case_id)),
classed AS (SELECT f.*, s.label AS cls FROM (SELECT *, {sdraw('class')} AS u FROM forced) f LEFT JOIN shares s
   ON s.case_id = f.case_id AND u >= lo AND u < hi)"""


def located(spark, sf):
    return P.sample_locations(segs(spark, sf), [1, 2, 3], min_num=5, share=0.3)


def with_boxes(spark, sf, patch=(10, 6, 6), final=(9, 4, 4)):
    """Boxes from one written table of locations, as it is read for counts and for coordinates."""
    locations = settle(located(spark, sf))
    return S.patch_bbox(classed_slots(spark, sf, locations), cases(spark, sf), locations, patch, final, SEED)


def drawn_slots(spark, sf):
    batches = cases(spark, sf).select(F.col("case_id").alias("batch"))
    return S.draw_cases(cases(spark, sf), batches, 4, SEED)


def classed_slots(spark, sf, locations=None):
    weights = spark.createDataFrame([(1, 3.0), (2, 0.5)], "label tinyint, weight double")
    counts = P.location_counts(cases(spark, sf), [1, 2, 3], locations if locations is not None else located(spark, sf))
    return S.choose_class(S.mark_foreground_slots(drawn_slots(spark, sf), 4), counts, SEED, weights)


@query("draw_cases", with_grid("SELECT * FROM drawn", LOCATED, DRAWN))
def _(spark, sf):
    return drawn_slots(spark, sf)


@query("mark_foreground_slots", with_grid("SELECT * FROM forced", LOCATED, DRAWN))
def _(spark, sf):
    return S.mark_foreground_slots(drawn_slots(spark, sf), 4)


@query("mark_foreground_slots_by_chance", with_grid(
    f"SELECT *, {sdraw('foreground')} < 0.33 AS force_fg FROM drawn", LOCATED, DRAWN))
def _(spark, sf):
    return S.mark_foreground_slots(drawn_slots(spark, sf), 4, probabilistic=True, seed=SEED)


@query("choose_class", with_grid(
    "SELECT batch, slot, case_id, force_fg, coalesce(cls, -5)::TINYINT AS cls FROM classed", LOCATED, DRAWN))
def _(spark, sf):
    return classed_slots(spark, sf).withColumn("cls", F.coalesce("cls", F.lit(-5)).cast("tinyint"))


def boxes_sql(patch: tuple, final: tuple) -> str:
    n = "xyz"
    need = ", ".join(f"greatest({p - f}, {p} - n{x}) AS d{a}" for a, (p, f, x) in enumerate(zip(patch, final, n)))
    low = ", ".join(f"floor(-d{a} / 2.0)::INT AS l{a}" for a in range(3))
    high = ", ".join(f"n{x} + d{a} // 2 + d{a} % 2 - {p} AS h{a}" for a, (p, x) in enumerate(zip(patch, n)))
    corner = ", ".join(f"(CASE WHEN vi IS NOT NULL THEN greatest(l{a}, v{x} - {p // 2}) ELSE l{a} + floor({sdraw(f'lo{a}')} * (h{a} - l{a} + 1)) END)::INT AS b{a}"
                       for a, (p, x) in enumerate(zip(patch, "ijk")))
    return f"""
based AS (SELECT c.*, nx, ny, nz FROM classed c JOIN cases USING (case_id)),
nloc AS (SELECT case_id, label, count(*) AS n FROM located GROUP BY 1, 2),
pick AS (SELECT b.batch, b.slot, l.i AS vi, l.j AS vj, l.k AS vk FROM (
   SELECT b.*, floor({sdraw('voxel')} * n)::BIGINT AS rank FROM based b JOIN nloc ON nloc.case_id = b.case_id AND nloc.label = b.cls WHERE force_fg) b
   JOIN located l ON l.case_id = b.case_id AND l.label = b.cls AND l.rank = b.rank),
needs AS (SELECT b.*, vi, vj, vk, {need} FROM based b LEFT JOIN pick USING (batch, slot)),
lows AS (SELECT *, {low}, {high} FROM needs),
boxes AS (SELECT batch, slot, case_id, {corner} FROM lows)"""


BOXES = boxes_sql((10, 6, 6), (9, 4, 4))


@query("patch_bbox", with_grid("""
SELECT batch, slot, case_id, b0 AS lo_i, b1 AS lo_j, b2 AS lo_k, b0 + 10 AS hi_i, b1 + 6 AS hi_j, b2 + 6 AS hi_k FROM boxes""",
                               LOCATED, DRAWN, BOXES))
def _(spark, sf):
    return with_boxes(spark, sf).select("batch", "slot", "case_id", *box_columns())


CELLS = """cells AS (SELECT b.*, x.x::INT AS i, y.y::INT AS j, z.z::INT AS k FROM boxes b, range(10) x(x), range(6) y(y), range(6) z(z))"""


@query("extract_patches_image", with_grid("""
SELECT batch, slot, h.channel AS channel, c.i, c.j, c.k, coalesce(value, 0.0::DOUBLE) AS value
FROM cells c CROSS JOIN (SELECT unnest([0, 1]) AS channel) h LEFT JOIN voxels v ON v.case_id = c.case_id AND v.channel = h.channel
 AND v.i = c.i + b0 AND v.j = c.j + b1 AND v.k = c.k + b2""", LOCATED, DRAWN, BOXES, CELLS))
def _(spark, sf):
    return S.extract_patches(settle(with_boxes(spark, sf)), cases(spark, sf), voxels(spark, sf))["image"]


@query("extract_patches_label", with_grid("""
SELECT batch, slot, c.i, c.j, c.k, coalesce(label, -1)::TINYINT AS label FROM cells c LEFT JOIN segs v
ON v.case_id = c.case_id AND v.i = c.i + b0 AND v.j = c.j + b1 AND v.k = c.k + b2""", LOCATED, DRAWN, BOXES, CELLS))
def _(spark, sf):
    return S.extract_patches(settle(with_boxes(spark, sf)), cases(spark, sf), voxels(spark, sf), segs(spark, sf))["label"]


@query("extract_patches_distance", with_grid("""
SELECT batch, slot, 1 AS cls, c.i, c.j, c.k, coalesce(value, 0.0::DOUBLE) AS dist FROM cells c LEFT JOIN one_channel v
ON v.case_id = c.case_id AND v.i = c.i + b0 AND v.j = c.j + b1 AND v.k = c.k + b2""", LOCATED, DRAWN, BOXES, CELLS))
def _(spark, sf):
    # any per-voxel field will do as a distance map here
    field = one_channel(spark, sf).select("case_id", F.lit(1).alias("cls"), "i", "j", "k", F.col("value").alias("dist"))
    return S.extract_patches(settle(with_boxes(spark, sf)), cases(spark, sf), voxels(spark, sf), distance=field)["distance"]


@query("extract_patches_2d", with_grid("""
SELECT b.batch, b.slot, h.channel, y::INT AS j, z::INT AS k, coalesce(value, 0.0::DOUBLE) AS value, coalesce(label, -1)::TINYINT AS label
FROM boxes b CROSS JOIN range(6) y(y) CROSS JOIN range(6) z(z) CROSS JOIN (SELECT unnest([0, 1]) AS channel) h
LEFT JOIN voxels v ON v.case_id = b.case_id AND v.channel = h.channel AND v.i = b0 AND v.j = y + b1 AND v.k = z + b2
LEFT JOIN segs s ON s.case_id = b.case_id AND s.i = b0 AND s.j = y + b1 AND s.k = z + b2""", LOCATED, DRAWN, boxes_sql((1, 6, 6), (1, 4, 4))))
def _(spark, sf):
    """Flat patches: one slice of a case each, through the voxel where foreground is asked for."""
    boxes = settle(with_boxes(spark, sf, (1, 6, 6), (1, 4, 4)))
    out = S.extract_patches(boxes, cases(spark, sf), voxels(spark, sf), segs(spark, sf), flat=True)
    return out["image"].join(out["label"], ["batch", "slot", "j", "k"])


# --- augmentation: every case is one patch of 8x8x8, four to a batch --------------------

SIZE = (8, 8, 8)
PATCHES = """
slots AS (SELECT case_id // 4 AS batch, (case_id % 4)::INT AS slot, case_id, nx FROM cases),
pim AS (SELECT batch, slot, channel, i, j, k, value FROM slots JOIN voxels USING (case_id)
  UNION ALL SELECT batch, slot, c::INT, x::INT, y::INT, z::INT, 0.0::DOUBLE FROM slots, range(2) a(c), range(8) b(x), range(8) d(y), range(8) e(z) WHERE x >= nx),
plb AS (SELECT batch, slot, i, j, k, label FROM slots JOIN segs USING (case_id)
  UNION ALL SELECT batch, slot, x::INT, y::INT, z::INT, (-1)::TINYINT FROM slots, range(8) b(x), range(8) d(y), range(8) e(z) WHERE x >= nx)"""


def requests(spark, sf):
    c = F.col("case_id")
    corner = [F.array(*[F.lit(x)] * 3) for x in (0, 8)]
    return cases(spark, sf).select(F.floor(c / 4).alias("batch"), (c % 4).cast("int").alias("slot"), "case_id",
                                   corner[0].alias("lo"), corner[1].alias("hi"))


def slots(spark, sf):
    return requests(spark, sf).select("batch", "slot")


def image(spark, sf):
    return crop_and_pad(voxels(spark, sf), requests(spark, sf), cases(spark, sf), "value", 0.0, extra=("channel",)).drop("case_id")


def label(spark, sf):
    return crop_and_pad(segs(spark, sf), requests(spark, sf), cases(spark, sf), "label", -1).drop("case_id")


def flipped(c: str, a: int) -> str:
    return f"(CASE WHEN {sdraw(f'mirror{a}')} < 0.5 THEN 7 - {c} ELSE {c} END) AS {c}"


FLIP = ", ".join(flipped(c, a) for a, c in enumerate("ijk"))


@query("mirror", with_grid(f"SELECT batch, slot, channel, {FLIP}, value FROM pim", PATCHES))
def _(spark, sf):
    return A.mirror(image(spark, sf), slots(spark, sf), SIZE, (0, 1, 2), SEED)


@query("mirror_labels", with_grid(f"SELECT batch, slot, {FLIP}, label FROM plb", PATCHES))
def _(spark, sf):
    return A.mirror(label(spark, sf), slots(spark, sf), SIZE, (0, 1, 2), SEED)


@query("center_crop", with_grid("""
SELECT batch, slot, channel, i - 1 AS i, j - 2 AS j, k AS k, value FROM pim
WHERE i BETWEEN 1 AND 5 AND j BETWEEN 2 AND 5""", PATCHES))
def _(spark, sf):
    return A.center_crop(image(spark, sf), SIZE, (5, 4, 8))


ROT = math.pi / 6
PARAMS = f"""
sp AS (SELECT batch, slot, t.turned, t.scaled, CASE WHEN scaled THEN 0.7::DOUBLE + {sdraw('scaling')} * (1.4::DOUBLE - 0.7::DOUBLE) ELSE 1.0 END AS sc,
  {', '.join(f"CASE WHEN turned THEN {-ROT}::DOUBLE + {sdraw(f'angle{a}')} * {2 * ROT}::DOUBLE ELSE 0.0 END AS a{a}" for a in range(3))}
  FROM (SELECT batch, slot, {sdraw('p_rotation')} < 0.6 AS turned, {sdraw('p_scaling')} < 0.5 AS scaled FROM slots) t),
m3 AS (SELECT batch, slot, cos(a2)*cos(a1)*sc AS m00, (cos(a2)*sin(a1)*sin(a0)-sin(a2)*cos(a0))*sc AS m01, (cos(a2)*sin(a1)*cos(a0)+sin(a2)*sin(a0))*sc AS m02,
  sin(a2)*cos(a1)*sc AS m10, (sin(a2)*sin(a1)*sin(a0)+cos(a2)*cos(a0))*sc AS m11, (sin(a2)*sin(a1)*cos(a0)-cos(a2)*sin(a0))*sc AS m12,
  -sin(a1)*sc AS m20, cos(a1)*sin(a0)*sc AS m21, cos(a1)*cos(a0)*sc AS m22 FROM sp),
pos AS (SELECT batch, slot, x::INT AS i, y::INT AS j, z::INT AS k, m00*(x-2.5)+m01*(y-2.0)+m02*(z-2.5)+3.5 AS px,
  m10*(x-2.5)+m11*(y-2.0)+m12*(z-2.5)+3.5 AS py, m20*(x-2.5)+m21*(y-2.0)+m22*(z-2.5)+3.5 AS pz
  FROM m3, range(6) a(x), range(5) b(y), range(6) c(z))"""


def params(spark, sf, dims=3):
    return A.spatial_params(slots(spark, sf), SEED, ROT, 0.6, 0.5, (0.7, 1.4), dims)


@query("affine_warp", with_grid(f"""
SELECT o.batch, o.slot, h.channel AS channel, o.i, o.j, o.k,
  {q6('sum(coalesce(value, 0) * (1 - abs(px - floor(px) - dx)) * (1 - abs(py - floor(py) - dy)) * (1 - abs(pz - floor(pz) - dz)))')} AS value
FROM pos o, range(2) p(dx), range(2) q(dy), range(2) r(dz), (SELECT unnest([0, 1]) AS channel) h
LEFT JOIN pim v ON v.batch = o.batch AND v.slot = o.slot AND v.channel = h.channel AND v.i = floor(px) + dx AND v.j = floor(py) + dy AND v.k = floor(pz) + dz
GROUP BY ALL""", PATCHES, PARAMS))
def _(spark, sf):
    return rounded(A.warp(image(spark, sf), params(spark, sf), SIZE, (6, 5, 6), "value"), "value")


@query("affine_warp_labels", with_grid("""
SELECT o.batch, o.slot, o.i, o.j, o.k, coalesce(label, 0)::TINYINT AS label FROM pos o LEFT JOIN plb v
ON v.batch = o.batch AND v.slot = o.slot AND v.i = round_even(px, 0) AND v.j = round_even(py, 0) AND v.k = round_even(pz, 0)""", PATCHES, PARAMS))
def _(spark, sf):
    return A.warp(label(spark, sf), params(spark, sf), SIZE, (6, 5, 6), "label", nearest=True)


@query("dummy_2d_warp", with_grid(f"""
SELECT o.batch, o.slot, h.channel AS channel, o.i, o.j, o.k,
  {q6('sum(coalesce(value, 0) * (1 - abs(py - floor(py) - dy)) * (1 - abs(pz - floor(pz) - dz)))')} AS value
FROM (SELECT batch, slot, x::INT AS i, y::INT AS j, z::INT AS k, (cos(a0)*(y-2.0) - sin(a0)*(z-2.5))*sc + 3.5 AS py,
        (sin(a0)*(y-2.0) + cos(a0)*(z-2.5))*sc + 3.5 AS pz FROM sp, range(8) a(x), range(5) b(y), range(6) c(z)) o,
  range(2) q(dy), range(2) r(dz), (SELECT unnest([0, 1]) AS channel) h
LEFT JOIN pim v ON v.batch = o.batch AND v.slot = o.slot AND v.channel = h.channel AND v.i = o.i AND v.j = floor(py) + dy AND v.k = floor(pz) + dz
GROUP BY ALL""", PATCHES, PARAMS))
def _(spark, sf):
    return rounded(A.warp(image(spark, sf), params(spark, sf, 2), SIZE, (8, 5, 6), "value", axes=(1, 2)), "value")


def enormal() -> str:
    def u(end: str) -> str:
        return sdraw("elastic", "r", "i", "j", "k", f"'{end}'")
    return f"sqrt(-2.0 * ln(1.0 - {u('a')})) * cos(6.283185307179586::DOUBLE * {u('b')})"


ELASTIC = f"""
ep AS (SELECT batch, slot, (0.05::DOUBLE + {bdraw('elastic_scale')} * (0.2::DOUBLE - 0.05::DOUBLE)) * 8 AS sg, {bdraw('elastic_magnitude')} * 0.2::DOUBLE * 8 AS mg
   FROM slots WHERE {sdraw('p_elastic')} < 0.5),
ek AS (SELECT *, list_sum([exp(-(x*x) / (2*sg*sg)) FOR x IN range(-h, h + 1)]) AS zz FROM (SELECT *, greatest(ceil(3 * sg), 1)::INT AS h FROM ep)),
en AS (SELECT *, {enormal()} AS n FROM (SELECT ek.*, a.r, x.i::INT AS i, y.j::INT AS j, z.k::INT AS k FROM ek, range(3) a(r), range(8) x(i), range(8) y(j), range(8) z(k))),
eo AS (SELECT p.batch, p.slot, p.r, p.i, p.j, p.k, any_value(p.mg) * sum(v.n * exp(-((v.i-p.i)*(v.i-p.i) + (v.j-p.j)*(v.j-p.j) + (v.k-p.k)*(v.k-p.k)) / (2*p.sg*p.sg)) / (p.zz*p.zz*p.zz)) AS e
   FROM en p JOIN en v ON v.batch = p.batch AND v.slot = p.slot AND v.r = p.r AND abs(v.i - p.i) <= p.h AND abs(v.j - p.j) <= p.h AND abs(v.k - p.k) <= p.h
   GROUP BY ALL),
ew AS (SELECT batch, slot, i, j, k, max(e) FILTER (WHERE r = 0) AS e0, max(e) FILTER (WHERE r = 1) AS e1, max(e) FILTER (WHERE r = 2) AS e2 FROM eo GROUP BY ALL),
epos AS (SELECT m3.batch, m3.slot, x::INT AS i, y::INT AS j, z::INT AS k, m00*(x-3.5)+m01*(y-3.5)+m02*(z-3.5)+3.5 + coalesce(e0, 0) AS px,
  m10*(x-3.5)+m11*(y-3.5)+m12*(z-3.5)+3.5 + coalesce(e1, 0) AS py, m20*(x-3.5)+m21*(y-3.5)+m22*(z-3.5)+3.5 + coalesce(e2, 0) AS pz
  FROM m3, range(8) a(x), range(8) b(y), range(8) c(z) LEFT JOIN ew ON ew.batch = m3.batch AND ew.slot = m3.slot AND ew.i = x AND ew.j = y AND ew.k = z)""".replace(
      "FROM m3, range(8) a(x), range(8) b(y), range(8) c(z) LEFT JOIN ew ON",
      "FROM m3 CROSS JOIN range(8) a(x) CROSS JOIN range(8) b(y) CROSS JOIN range(8) c(z) LEFT JOIN ew ON")


@query("elastic_warp", with_grid(f"""
SELECT o.batch, o.slot, h.channel AS channel, o.i, o.j, o.k,
  {q6('sum(coalesce(value, 0) * (1 - abs(px - floor(px) - dx)) * (1 - abs(py - floor(py) - dy)) * (1 - abs(pz - floor(pz) - dz)))')} AS value
FROM epos o CROSS JOIN range(2) p(dx) CROSS JOIN range(2) q(dy) CROSS JOIN range(2) r(dz) CROSS JOIN (SELECT unnest([0, 1]) AS channel) h
LEFT JOIN pim v ON v.batch = o.batch AND v.slot = o.slot AND v.channel = h.channel AND v.i = floor(px) + dx AND v.j = floor(py) + dy AND v.k = floor(pz) + dz
GROUP BY ALL""", PATCHES, PARAMS, ELASTIC))
def _(spark, sf):
    offsets = A.elastic_offsets(slots(spark, sf), SIZE, SEED, 0.5, (0.05, 0.2), (0.0, 0.2))
    return rounded(A.warp(image(spark, sf), params(spark, sf), SIZE, SIZE, "value", offsets=offsets), "value")


NOISE = f"sqrt(-2.0 * ln(1.0 - {sdraw('noise', 'channel', 'i', 'j', 'k', chr(39) + 'a' + chr(39))})) * cos(6.283185307179586::DOUBLE * {sdraw('noise', 'channel', 'i', 'j', 'k', chr(39) + 'b' + chr(39))})"


@query("gaussian_noise", with_grid(f"""
SELECT batch, slot, channel, i, j, k, {q6(f"CASE WHEN {sdraw('p_noise')} < 0.5 THEN value + sqrt({sdraw('variance')} * 0.1::DOUBLE) * {NOISE} ELSE value END")} AS value
FROM pim""", PATCHES))
def _(spark, sf):
    return rounded(A.gaussian_noise(image(spark, sf), slots(spark, sf), SEED, 0.5, (0.0, 0.1)), "value")


BLUR = f"""
bp AS (SELECT batch, slot, {sdraw('p_blur')} < 0.5 AS sel, [{sdraw('blur_channel', '0')}, {sdraw('blur_channel', '1')}] AS ch,
   0.5::DOUBLE + {bdraw('sigma')} * 0.5::DOUBLE AS sg FROM slots),
ker AS (SELECT *, greatest(ceil(3 * sg), 1)::INT AS h FROM bp),
taps AS (SELECT *, list_sum([exp(-(x*x) / (2*sg*sg)) FOR x IN range(-h, h + 1)]) AS zz FROM ker)"""


@query("gaussian_blur", with_grid(f"""
SELECT p.batch, p.slot, p.channel, p.i, p.j, p.k, {q6("CASE WHEN any_value(sel AND ch[p.channel + 1] < 0.5) THEN sum(v.value * exp(-((v.i-p.i)*(v.i-p.i) + (v.j-p.j)*(v.j-p.j) + (v.k-p.k)*(v.k-p.k)) / (2*sg*sg)) / (zz*zz*zz)) ELSE any_value(p.value) END")} AS value
FROM pim p JOIN taps t ON t.batch = p.batch AND t.slot = p.slot JOIN pim v ON v.batch = p.batch AND v.slot = p.slot AND v.channel = p.channel
 AND abs(v.i - p.i) <= h AND abs(v.j - p.j) <= h AND abs(v.k - p.k) <= h GROUP BY 1, 2, 3, 4, 5, 6""", PATCHES, BLUR))
def _(spark, sf):
    return rounded(A.gaussian_blur(image(spark, sf), slots(spark, sf), SIZE, 2, SEED, 0.5, (0.5, 1.0)), "value")


@query("brightness", with_grid(f"""
SELECT batch, slot, channel, i, j, k, {q6(f"CASE WHEN {sdraw('p_brightness')} < 0.5 THEN value * (0.75::DOUBLE + {sdraw('brightness', 'channel')} * 0.5::DOUBLE) ELSE value END")} AS value FROM pim""", PATCHES))
def _(spark, sf):
    return rounded(A.brightness(image(spark, sf), slots(spark, sf), 2, SEED, 0.5, (0.75, 1.25)), "value")


@query("contrast", with_grid(f"""
SELECT batch, slot, channel, i, j, k, {q6(f"CASE WHEN {sdraw('p_contrast')} < 0.5 THEN least(greatest((value - avg(value) OVER w) * (0.75::DOUBLE + {sdraw('contrast', 'channel')} * 0.5::DOUBLE) + avg(value) OVER w, min(value) OVER w), max(value) OVER w) ELSE value END")} AS value
FROM pim WINDOW w AS (PARTITION BY batch, slot, channel)""", PATCHES))
def _(spark, sf):
    return rounded(A.contrast(image(spark, sf), slots(spark, sf), 2, SEED, 0.5, (0.75, 1.25)), "value")


LOW = f"""
lp AS (SELECT batch, slot, {sdraw('p_low')} < 0.5 AS sel, [{sdraw('low_channel', '0')}, {sdraw('low_channel', '1')}] AS ch,
   greatest(1, round_even(8 * (0.5::DOUBLE + {bdraw('low_scale')} * 0.5::DOUBLE), 0))::INT AS m FROM slots),
lx AS (SELECT batch, slot, sel, ch, m, o::INT AS o, greatest(0.0, (o + 0.5::DOUBLE) * m / 8 - 0.5) AS x FROM lp, range(8) r(o)),
lt AS (SELECT batch, slot, o, floor(least(floor(x), m - 1) * 8.0::DOUBLE / m)::INT AS s, 1 - (x - floor(x)) AS w FROM lx
   UNION ALL SELECT batch, slot, o, floor(least(floor(x) + 1, m - 1) * 8.0::DOUBLE / m)::INT, x - floor(x) FROM lx)"""


# one axis at a time, so that no step joins more than one table of taps
LOW_PASSES = """
l0 AS MATERIALIZED (SELECT p.* FROM pim p JOIN lp USING (batch, slot) WHERE sel AND ch[channel + 1] < 0.5),
l1 AS MATERIALIZED (SELECT l0.batch, l0.slot, channel, o AS i, j, k, sum(value * w) AS value FROM l0 JOIN lt ON lt.batch = l0.batch AND lt.slot = l0.slot AND lt.s = l0.i GROUP BY ALL),
l2 AS MATERIALIZED (SELECT l1.batch, l1.slot, channel, i, o AS j, k, sum(value * w) AS value FROM l1 JOIN lt ON lt.batch = l1.batch AND lt.slot = l1.slot AND lt.s = l1.j GROUP BY ALL),
l3 AS MATERIALIZED (SELECT l2.batch, l2.slot, channel, i, j, o AS k, sum(value * w) AS value FROM l2 JOIN lt ON lt.batch = l2.batch AND lt.slot = l2.slot AND lt.s = l2.k GROUP BY ALL)"""


@query("simulate_low_resolution", with_grid(f"""
SELECT batch, slot, channel, i, j, k, {q6('value')} AS value FROM l3
UNION ALL SELECT batch, slot, channel, i, j, k, {q6('value')} FROM pim JOIN lp USING (batch, slot) WHERE NOT (sel AND ch[channel + 1] < 0.5)""",
                                             PATCHES, LOW, LOW_PASSES))
def _(spark, sf):
    return rounded(A.low_resolution(image(spark, sf), slots(spark, sf), SIZE, 2, SEED, 0.5, (0.5, 1.0)), "value")


def sql_gamma(name: str, sign: str) -> str:
    return with_grid(f"""
SELECT batch, slot, channel, i, j, k, {q6(f"CASE WHEN {sdraw('p_' + name)} < 0.5 THEN {sign}((g - avg(g) OVER w) / greatest(stddev_samp(g) OVER w, 1e-7) * s + m) ELSE value END")} AS value
FROM (SELECT *, pow(least(greatest((v - lo) / greatest(hi - lo, 1e-7), 0), 1), 0.7::DOUBLE + {sdraw(name, 'channel')} * 0.8::DOUBLE) * greatest(hi - lo, 1e-7) + lo AS g FROM (
  SELECT *, {sign}value AS v, avg({sign}value) OVER w AS m, stddev_samp({sign}value) OVER w AS s, min({sign}value) OVER w AS lo, max({sign}value) OVER w AS hi
  FROM pim WINDOW w AS (PARTITION BY batch, slot, channel)))
WINDOW w AS (PARTITION BY batch, slot, channel)""", PATCHES)


@query("gamma", sql_gamma("gamma", ""))
def _(spark, sf):
    return rounded(A.gamma(image(spark, sf), slots(spark, sf), 2, SEED, 0.5, (0.7, 1.5)), "value")


@query("gamma_inverted", sql_gamma("gamma_inverted", "-"))
def _(spark, sf):
    return rounded(A.gamma(image(spark, sf), slots(spark, sf), 2, SEED, 0.5, (0.7, 1.5), invert=True), "value")


@query("downsample_labels", with_grid("""
SELECT l.level, p.batch, p.slot, x.x::INT AS i, y.y::INT AS j, z.z::INT AS k, p.label
FROM (VALUES (0, 8, 8, 8), (1, 8, 4, 4), (2, 4, 2, 2), (3, 3, 6, 5)) l(level, n0, n1, n2), range(8) x(x), range(8) y(y), range(8) z(z), plb p
WHERE x.x < n0 AND y.y < n1 AND z.z < n2 AND p.i = floor((x.x + 0.5) * 8 / n0) AND p.j = floor((y.y + 0.5) * 8 / n1) AND p.k = floor((z.z + 0.5) * 8 / n2)""", PATCHES))
def _(spark, sf):
    return A.downsample_labels(label(spark, sf), SIZE, [[1, 1, 1], [1, 0.5, 0.5], [0.5, 0.25, 0.25], [0.4, 0.75, 0.6]])


MIX = f"""
mixed AS (SELECT batch, slot, (CASE WHEN o >= slot THEN o + 1 ELSE o END)::INT AS partner,
  {', '.join(f"greatest(0, c{a} - floor(floor(8 * r) / 2))::INT AS lo{a}, least(8, c{a} + floor(floor(8 * r) / 2))::INT AS hi{a}" for a in range(3))}
  FROM (SELECT batch, slot, floor({sdraw('partner')} * 3)::INT AS o, sqrt(1 - {sdraw('lambda0')}) AS r,
     {', '.join(f"floor({sdraw(f'centre{a}')} * 8)::INT AS c{a}" for a in range(3))} FROM slots WHERE {sdraw('p_cutmix')} <= 0.5) d
  WHERE EXISTS (SELECT 1 FROM slots x WHERE x.batch = d.batch AND x.slot = CASE WHEN o >= d.slot THEN o + 1 ELSE o END)),
inbox AS (SELECT p.batch, m.slot, p.channel, p.i, p.j, p.k, p.value FROM pim p JOIN mixed m ON m.batch = p.batch AND m.partner = p.slot
  WHERE i >= lo0 AND i < hi0 AND j >= lo1 AND j < hi1 AND k >= lo2 AND k < hi2)"""


@query("cutmix_pairs", with_grid("SELECT batch, slot, partner, lo0 AS lo_i, lo1 AS lo_j, lo2 AS lo_k, hi0 AS hi_i, hi1 AS hi_j, hi2 AS hi_k FROM mixed", PATCHES, MIX))
def _(spark, sf):
    return A.cutmix_pairs(slots(spark, sf), SIZE, 4, SEED).select("batch", "slot", "partner", *box_columns())


MIXED = with_grid("""
SELECT * FROM inbox UNION ALL
SELECT p.* FROM pim p LEFT JOIN mixed m USING (batch, slot)
WHERE m.slot IS NULL OR NOT (i >= lo0 AND i < hi0 AND j >= lo1 AND j < hi1 AND k >= lo2 AND k < hi2)""", PATCHES, MIX)


@query("cutmix", MIXED)
def _(spark, sf):
    return A.cutmix({"image": image(spark, sf)}, slots(spark, sf), SIZE, 4, SEED)["image"]


@query("augment_cutmix", MIXED)
def _(spark, sf):
    """The mixing step of the family "cutmix", through the whole chain without its other steps."""
    family = {"cutmix": A.FAMILIES["cutmix"]["cutmix"]}
    return A.augment({"image": image(spark, sf)}, slots(spark, sf), SIZE, SIZE, 2, SEED, family=family, batch_size=4)["image"]


@query("augment_more", with_grid(f"""
SELECT batch, slot, channel, i - 1 AS i, j - 1 AS j, k - 1 AS k, {q6('abs(value) * 2.0 + channel')} AS value FROM pim
WHERE i BETWEEN 1 AND 6 AND j BETWEEN 1 AND 6 AND k BETWEEN 1 AND 6""", PATCHES))
def _(spark, sf):
    """Functions of the caller's own in the chain."""
    own = [lambda t: t.withColumn("value", F.abs("value")), lambda t: t.withColumn("value", F.col("value") * 2.0 + F.col("channel"))]
    return rounded(A.augment({"image": image(spark, sf)}, slots(spark, sf), SIZE, (6, 6, 6), 2, SEED, family={}, more=own)["image"], "value")


FLAT = """
fpos AS (SELECT batch, slot, y::INT AS j, z::INT AS k, (cos(a0)*(y-2.5) - sin(a0)*(z-2.5))*sc + 3.5 AS py,
   (sin(a0)*(y-2.5) + cos(a0)*(z-2.5))*sc + 3.5 AS pz FROM sp, range(6) b(y), range(6) c(z)),
fimage AS (SELECT o.batch, o.slot, h.channel AS channel, o.j, o.k,
     sum(coalesce(value, 0) * (1 - abs(py - floor(py) - dy)) * (1 - abs(pz - floor(pz) - dz))) AS value
   FROM fpos o CROSS JOIN range(2) q(dy) CROSS JOIN range(2) r(dz) CROSS JOIN (SELECT unnest([0, 1]) AS channel) h
   LEFT JOIN pim v ON v.batch = o.batch AND v.slot = o.slot AND v.channel = h.channel AND v.i = 3 AND v.j = floor(py) + dy AND v.k = floor(pz) + dz
   GROUP BY ALL),
flabel AS (SELECT o.batch, o.slot, o.j, o.k, greatest(coalesce(label, 0), 0)::TINYINT AS label FROM fpos o
   LEFT JOIN plb v ON v.batch = o.batch AND v.slot = o.slot AND v.i = 3 AND v.j = round_even(py, 0) AND v.k = round_even(pz, 0))"""


@query("augment_2d", with_grid(f"""
SELECT batch, slot, channel, (CASE WHEN {sdraw('mirror0')} < 0.5 THEN 5 - j ELSE j END)::INT AS j,
  (CASE WHEN {sdraw('mirror1')} < 0.5 THEN 5 - k ELSE k END)::INT AS k,
  {q6(f"CASE WHEN {sdraw('p_brightness')} < 0.5 THEN value * (0.75::DOUBLE + {sdraw('brightness', 'channel')} * 0.5::DOUBLE) ELSE value END")} AS value, label
FROM fimage JOIN flabel USING (batch, slot, j, k)""", PATCHES, PARAMS, FLAT))
def _(spark, sf):
    """Flat patches, the middle slice of each case, through the chain: turned, scaled, brightened, mirrored."""
    family = {"spatial": {"p_rotation": 0.6, "p_scaling": 0.5, "scaling": (0.7, 1.4)}, "brightness": {"p": 0.5, "range": (0.75, 1.25)}, "mirror": {}}
    flat = {n: S.drop_depth(t.filter("i = 3")) for n, t in (("image", image(spark, sf)), ("label", label(spark, sf)))}
    out = A.augment(flat, slots(spark, sf), SIZE[1:], (6, 6), 2, SEED, rotation=ROT, family=family)
    return rounded(out["image"].join(out["label"], ["batch", "slot", "j", "k"]), "value")


@query("augment")
def _(spark, sf):
    tables = {"image": image(spark, sf), "label": label(spark, sf)}
    out = A.augment(tables, slots(spark, sf), SIZE, (6, 6, 6), 2, SEED, mask_channels=[1])
    return rounded(out["image"].join(out["label"], ["batch", "slot", "i", "j", "k"]), "value")


@query("augment_extended")
def _(spark, sf):
    out = A.augment({"image": image(spark, sf)}, slots(spark, sf), SIZE, (6, 6, 6), 2, SEED, family="extended")
    return rounded(out["image"], "value")
