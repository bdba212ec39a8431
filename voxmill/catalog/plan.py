"""Queries on planning: spacing, patches, configurations, augmentation geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.catalog.base import flat, q6, query, r6, rounded
from voxmill.catalog.inputs import cases, segs, table, voxels, with_grid
from voxmill.operators import fingerprint as P
from voxmill.plans import configure as L


def geometry(spark, sf):
    return P.cropped_geometry(voxels(spark, sf), segs(spark, sf), cases(spark, sf))


def spread_out(df, *names):
    """Array columns as one rounded column per axis."""
    out = df
    for n in names:
        out = out.withColumns({f"{n}_{x}": r6(F.get(n, F.lit(a)).cast("double")) for a, x in enumerate("ijk")})
    return out.drop(*names)


TARGET = """
med AS (SELECT dataset_id, [quantile_cont(sx,0.5), quantile_cont(sy,0.5), quantile_cont(sz,0.5)] AS sp,
   [quantile_cont(sx,0.1), quantile_cont(sy,0.1), quantile_cont(sz,0.1)] AS p10,
   [quantile_cont(ax,0.5), quantile_cont(ay,0.5), quantile_cont(az,0.5)] AS sz FROM fcases GROUP BY 1),
wax AS (SELECT *, list_position(sp, list_max(sp)) AS w FROM med),
oth AS (SELECT *, list_max([sp[x] FOR x IN [1,2,3] IF x <> w]) AS om, list_min([sz[x] FOR x IN [1,2,3] IF x <> w]) AS osz FROM wax),
ani AS (SELECT *, sp[w] > 3.0 * om AND sz[w] * 3.0 < osz AS aniso FROM oth),
target AS (SELECT dataset_id, aniso, w, sz,
   [CASE WHEN aniso AND x = w THEN greatest(p10[w], om + 1e-5) ELSE sp[x] END FOR x IN [1,2,3]] AS sp FROM ani)"""


@query("target_spacing", with_grid(f"""
SELECT dataset_id, {q6('sp[1]')} AS target_spacing_i, {q6('sp[2]')} AS target_spacing_j, {q6('sp[3]')} AS target_spacing_k,
  aniso AS is_anisotropic, (CASE WHEN aniso THEN w - 1 ELSE -1 END)::INT AS anisotropic_axis,
  {q6('sz[1]')} AS median_size_i, {q6('sz[2]')} AS median_size_j, {q6('sz[3]')} AS median_size_k FROM target""", TARGET))
def _(spark, sf):
    out = L.target_spacing(geometry(spark, sf)).fillna(-1, subset=["anisotropic_axis"])
    return spread_out(out, "target_spacing", "median_size")


# part rows as datasets: sizes and spacings from their columns, so that all branches of the rules occur
PARTS = """
parts AS (SELECT p_partkey AS dataset_id,
   [0.5::DOUBLE + (p_partkey % 7) * 0.25::DOUBLE, 0.5::DOUBLE + (p_partkey % 5) * 0.25::DOUBLE, 0.5::DOUBLE + (p_size % 10) * 0.75::DOUBLE] AS sp,
   [64 + (p_partkey % 400)::INT, 64 + (p_partkey % 300)::INT, 8 + p_size * 8] AS sz FROM part),
tp AS (SELECT *, list_position(sp, list_max(sp)) AS w FROM parts),
tf AS (SELECT *, CASE w WHEN 1 THEN [0,1,2] WHEN 2 THEN [1,0,2] ELSE [2,0,1] END AS fw,
                 CASE w WHEN 1 THEN [0,1,2] WHEN 2 THEN [1,0,2] ELSE [1,2,0] END AS bw FROM tp),
pl AS (SELECT *, [sp[f+1] FOR f IN fw] AS st, [sz[f+1] FOR f IN fw] AS mt FROM tf)"""


def part_datasets(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        key.alias("dataset_id"),
        F.array(0.5 + (key % 7) * 0.25, 0.5 + (key % 5) * 0.25, 0.5 + (size % 10) * 0.75).alias("target_spacing"),
        F.array(64 + (key % 400).cast("int"), 64 + (key % 300).cast("int"), 8 + size * 8).alias("median_size"),
        "p_name")


@query("transpose_plan", "WITH " + PARTS + """
SELECT dataset_id, array_to_string(fw, ',') AS transpose_forward, array_to_string(bw, ',') AS transpose_backward FROM tf""")
def _(spark, sf):
    return flat(L.transpose_plan(part_datasets(spark, sf)), "transpose_forward", "transpose_backward") \
        .select("dataset_id", "transpose_forward", "transpose_backward")


@query("iso_spacing", "WITH " + PARTS + f"""
SELECT dataset_id, {q6('pow(sp[1]*sp[2]*sp[3], 1.0::DOUBLE/3)')} AS voxel_budget, {q6('list_max(sp)')} AS max_target,
  {q6('list_sort(sp)[2]')} AS median_target FROM parts""")
def _(spark, sf):
    sp = F.col("target_spacing")
    return part_datasets(spark, sf).select(
        "dataset_id", *[r6(L.iso_spacing(sp, s)).alias(s) for s in L.SPACING_STRATEGIES])


CHANNELS = """SELECT p_partkey AS dataset_id, (p_size % 4)::INT AS channel,
  CASE p_size % 8 WHEN 0 THEN 'CT' WHEN 1 THEN 'ct' WHEN 2 THEN 'noNorm' WHEN 3 THEN 'None' WHEN 4 THEN 'nonorm'
    ELSE p_name END AS name, (p_partkey % 100) / 100.0::DOUBLE AS median_crop_ratio FROM part"""


@query("normalization_plan", f"""
SELECT *, scheme = 'ZScoreNormalization' AND median_crop_ratio < 0.75 AS use_mask FROM (
  SELECT *, CASE WHEN name IN ('ct','CT') THEN 'CTNormalization'
    WHEN name IN ('nonorm','noNorm','NoNorm','none','None') THEN 'NoNormalization' ELSE 'ZScoreNormalization' END AS scheme
  FROM ({CHANNELS}))""")
def _(spark, sf):
    kind = F.col("p_size") % 8
    name = F.col("p_name")
    for code, word in enumerate(["CT", "ct", "noNorm", "None", "nonorm"]):
        name = F.when(kind == code, word).otherwise(name)
    return L.normalization_plan(table(spark, sf, "part").select(
        F.col("p_partkey").alias("dataset_id"), (F.col("p_size") % 4).cast("int").alias("channel"), name.alias("name"),
        ((F.col("p_partkey") % 100) / 100.0).alias("median_crop_ratio")))


@query("new_shape", "WITH " + PARTS + """
SELECT dataset_id, array_to_string([round_even(sz[x] * sp[x] / 0.75::DOUBLE, 0)::INT FOR x IN [1,2,3]], ',') AS shape FROM parts""")
def _(spark, sf):
    return flat(part_datasets(spark, sf).select("dataset_id", L.new_shape(
        F.col("median_size"), F.col("target_spacing"), F.array(*[F.lit(0.75)] * 3)).alias("shape")), "shape")


@query("initial_patch", "WITH " + PARTS + """,
sc AS (SELECT *, pow(pow(256.0::DOUBLE, 3) / (1/sp[1] * (1/sp[2]) * (1/sp[3])), 1.0::DOUBLE/3) AS scale FROM parts)
SELECT dataset_id, array_to_string([least(round_even(1/sp[x] * scale, 0)::INT, sz[x]) FOR x IN [1,2,3]], ',') AS patch FROM sc""")
def _(spark, sf):
    return flat(part_datasets(spark, sf).select("dataset_id", L.initial_patch(
        F.col("target_spacing"), F.col("median_size"), 256).alias("patch")), "patch")


@query("pad_to_multiple", "WITH " + PARTS + """
SELECT dataset_id, array_to_string([(ceil(sz[1]/32.0)*32)::INT, (ceil(sz[2]/16.0)*16)::INT, (ceil(sz[3]/5.0)*5)::INT], ',') AS shape FROM parts""")
def _(spark, sf):
    return flat(part_datasets(spark, sf).select("dataset_id", L.pad_to_multiple(
        F.col("median_size"), F.array(F.lit(32), F.lit(16), F.lit(5))).alias("shape")), "shape")


STEPS = """,
grow AS (SELECT dataset_id, st, mt, 0 AS step, st AS s FROM pl
   UNION ALL SELECT dataset_id, st, mt, step + 1, [x * 1.03::DOUBLE FOR x IN s] FROM grow
   WHERE 48.0 * 48 * 48 / (round_even(mt[1]*st[1]/s[1],0) * round_even(mt[2]*st[2]/s[2],0) * round_even(mt[3]*st[3]/s[3],0)) < 0.25 AND step < 2000),
low AS (SELECT DISTINCT ON (dataset_id) *, [round_even(mt[x]*st[x]/s[x],0)::INT FOR x IN [1,2,3]] AS m FROM grow ORDER BY dataset_id, step DESC)"""


@query("lowres_spacing", "WITH RECURSIVE " + PARTS + STEPS + f"""
SELECT dataset_id, {q6('s[1]')} AS spacing_i, {q6('s[2]')} AS spacing_j, {q6('s[3]')} AS spacing_k,
  array_to_string(m, ',') AS median FROM low WHERE 48.0 * 48 * 48 / (mt[1]*mt[2]*mt[3]) < 0.25""")
def _(spark, sf):
    base = L.transpose_plan(part_datasets(spark, sf))
    base = base.select("dataset_id", L.permute(F.col("target_spacing"), F.col("transpose_forward")).alias("spacing"),
                       L.permute(F.col("median_size"), F.col("transpose_forward")).alias("median"),
                       F.array(*[F.lit(48)] * 3).alias("patch"))
    out = L.lowres_spacing(base).select("dataset_id", F.col("low_spacing").alias("spacing"), F.col("low_median").alias("median"))
    return flat(spread_out(out, "spacing"), "median")


# all configurations, written out once more as SQL
def _sql_patch(sp: str, md: str, ref: str, n: int) -> str:
    inv = " * ".join(f"(1/{sp}[{x}])" for x in range(1, n + 1))
    idx = "[1,2,3]" if n == 3 else "[1,2]"
    return (f"[(ceil(least(round_even(1/{sp}[x] * pow(pow({ref}::DOUBLE, {n}) / ({inv}), 1.0::DOUBLE/{n}), 0), {md}[x]) / 8.0) * 8)::INT"
            f" FOR x IN {idx}]")


CONFIGS = f""",
iso AS (SELECT *, pow(st[1]*st[2]*st[3], 1.0::DOUBLE/3) AS e FROM pl),
iso2 AS (SELECT *, [e,e,e] AS ie, [round_even(mt[x]*st[x]/e,0)::INT FOR x IN [1,2,3]] AS im FROM iso),
pt AS (SELECT *, {_sql_patch('st', 'mt', '96', 3)} AS fp, {_sql_patch('ie', 'im', '96', 3)} AS ip FROM iso2),
two AS (SELECT dataset_id, 'low' AS kind, st AS s0, mt AS m0, fp[1]::DOUBLE*fp[2]*fp[3] AS pv FROM pt
        UNION ALL SELECT dataset_id, 'iso', ie, im, ip[1]::DOUBLE*ip[2]*ip[3] FROM pt),
grow AS (SELECT *, 0 AS step, s0 AS s FROM two WHERE pv / (m0[1]::DOUBLE*m0[2]*m0[3]) < 0.25
   UNION ALL SELECT dataset_id, kind, s0, m0, pv, step + 1, [x * 1.03::DOUBLE FOR x IN s] FROM grow
   WHERE pv / (round_even(m0[1]*s0[1]/s[1],0) * round_even(m0[2]*s0[2]/s[2],0) * round_even(m0[3]*s0[3]/s[3],0)) < 0.25 AND step < 2000),
low AS (SELECT DISTINCT ON (dataset_id, kind) *, [round_even(m0[x]*s0[x]/s[x],0)::INT FOR x IN [1,2,3]] AS m FROM grow ORDER BY dataset_id, kind, step DESC),
base AS (SELECT dataset_id, '3d_fullres' AS b, st AS s, mt AS m, NULL::DOUBLE AS t FROM pt
  UNION ALL SELECT dataset_id, '2d', st[2:3], mt[2:3], st[1] FROM pt
  UNION ALL SELECT dataset_id, '3d_fullres_iso', ie, im, NULL FROM pt
  UNION ALL SELECT dataset_id, '2d_iso', ie[2:3], im[2:3], st[1] FROM pt
  UNION ALL SELECT dataset_id, CASE kind WHEN 'low' THEN '3d_lowres' ELSE '3d_lowres_iso' END, s, m, NULL FROM low),
sized AS (SELECT base.*, tag, r3, r2 FROM base, (VALUES ('', 96, 1024), ('_s', 48, 512), ('_l', 176, 2880)) v(tag, r3, r2)),
patched AS (SELECT *, CASE len(s) WHEN 3 THEN {_sql_patch('s', 'm', 'r3', 3)} ELSE {_sql_patch('s', 'm', 'r2', 2)} END AS p FROM sized)"""


def planned(spark, sf):
    return L.configurations(part_datasets(spark, sf), divisor=8, ref_3d=96, ref_2d=1024, size_variants=True,
                            variants=(("_s", 48, 512), ("_l", 176, 2880)))


@query("configurations", "WITH RECURSIVE " + PARTS + CONFIGS + f"""
SELECT dataset_id, b || tag AS config, 'plans_' || b AS data_identifier, {q6('s[1]')} AS spacing_i, {q6('s[2]')} AS spacing_j,
  coalesce({q6('s[3]')}, -1) AS spacing_k, coalesce({q6('t')}, -1) AS through_plane_spacing,
  array_to_string(m, ',') AS median_image_size, array_to_string(p, ',') AS patch_size FROM patched""")
def _(spark, sf):
    out = planned(spark, sf).select("dataset_id", "config", "data_identifier", "spacing", r6("through_plane_spacing").alias(
        "through_plane_spacing"), "median_image_size", "patch_size")
    return flat(spread_out(out, "spacing"), "median_image_size", "patch_size").fillna(-1.0)


@query("size_variants", "WITH RECURSIVE " + PARTS + CONFIGS + """
SELECT data_identifier, config, count(*) AS n, sum(p[1])::BIGINT AS first_sides FROM (
  SELECT 'plans_' || b AS data_identifier, b || tag AS config, p FROM patched WHERE tag <> '') GROUP BY 1, 2""")
def _(spark, sf):
    return planned(spark, sf).filter(F.col("config").rlike("_[sl]$")).groupBy("data_identifier", "config").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.get("patch_size", F.lit(0))).alias("first_sides"))


@query("augmentation_geometry", "WITH RECURSIVE " + PARTS + CONFIGS + """,
geo AS (SELECT *, len(p) = 3 AND list_max(p)::DOUBLE / p[1] > 3.0 AS dummy FROM patched),
rot AS (SELECT *, (CASE WHEN len(p) = 2 THEN CASE WHEN list_max(p)::DOUBLE / list_min(p) > 1.5 THEN 15.0 ELSE 180.0 END
   ELSE CASE WHEN dummy THEN 180.0 ELSE 30.0 END END)::DOUBLE / 360 * 2 * pi() AS r FROM geo)
SELECT dataset_id, b || tag AS config, dummy AS dummy_2d, round(r, 6) AS rotation, len(p)::INT AS mirror_axes,
  array_to_string([CASE WHEN dummy AND x = 1 THEN p[x] ELSE ceil(list_max([greatest(p[x]::DOUBLE, abs(sin(r)) * p[y] + abs(cos(r)) * p[x])
    FOR y IN (CASE len(p) WHEN 3 THEN [1,2,3] ELSE [1,2] END) IF y <> x]) / 0.85::DOUBLE)::INT END
    FOR x IN (CASE len(p) WHEN 3 THEN [1,2,3] ELSE [1,2] END)], ',') AS initial_patch_size FROM rot""")
def _(spark, sf):
    out = L.augmentation_geometry(planned(spark, sf)).select(
        "dataset_id", "config", "dummy_2d", r6("rotation").alias("rotation"), F.size("mirror_axes").alias("mirror_axes"),
        "initial_patch_size")
    return flat(out, "initial_patch_size")


@query("select_target_spacing", "WITH RECURSIVE " + PARTS + CONFIGS + f"""
SELECT dataset_id, b AS config, {q6('CASE WHEN t IS NULL THEN s[1] ELSE 7.5::DOUBLE END')} AS target_i,
  {q6('CASE WHEN t IS NULL THEN s[2] ELSE s[1] END')} AS target_j,
  {q6('CASE WHEN t IS NULL THEN s[3] ELSE s[2] END')} AS target_k FROM base""")
def _(spark, sf):
    configs = L.configurations(part_datasets(spark, sf), divisor=8, ref_3d=96, ref_2d=1024)
    own = configs.withColumn("spacing_t", F.array(F.lit(7.5), F.lit(1.0), F.lit(1.0)))
    return spread_out(L.select_target_spacing(own).select("dataset_id", "config", "target"), "target")


PLANNED = """,
tp AS (SELECT dataset_id, sp, sz, list_position(sp, list_max(sp)) AS w FROM target),
tf AS (SELECT *, CASE w WHEN 1 THEN [0,1,2] WHEN 2 THEN [1,0,2] ELSE [2,0,1] END AS fw FROM tp),
pl AS (SELECT *, [sp[f+1] FOR f IN fw] AS st, [round_even(sz[f+1], 0)::INT FOR f IN fw] AS mt FROM tf)"""


@query("plan_datasets", with_grid(f"""
SELECT dataset_id, b || tag AS config, {q6('s[1]')} AS spacing_i, {q6('s[2]')} AS spacing_j, coalesce({q6('s[3]')}, -1) AS spacing_k,
  array_to_string(p, ',') AS patch_size, 'CTNormalization,ZScoreNormalization' AS normalization_schemes,
  CASE WHEN ratio < 0.75 THEN 'false,true' ELSE 'false,false' END AS use_mask_for_norm
FROM patched JOIN (SELECT dataset_id, quantile_cont(crop_ratio, 0.5) AS ratio FROM fcases GROUP BY 1) USING (dataset_id)""",
                                TARGET + PLANNED + CONFIGS).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    cased = geometry(spark, sf)
    channels = cased.select("dataset_id").distinct().select("dataset_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.lit(n).alias("name")) for c, n in enumerate(("CT", "T1"))])))
    out = L.plan_datasets(cased, channels, divisor=8, ref_3d=96, ref_2d=1024, size_variants=True,
                          variants=(("_s", 48, 512), ("_l", 176, 2880)))
    out = out.select("dataset_id", "config", "spacing", "patch_size", "normalization_schemes", "use_mask_for_norm")
    return flat(spread_out(out, "spacing"), "patch_size", "normalization_schemes", "use_mask_for_norm").fillna(-1.0)
