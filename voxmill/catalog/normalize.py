"""Queries on normalisation and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.catalog.base import q6, query, rounded
from voxmill.catalog.fingerprint import FG, SQL_STATS
from voxmill.catalog.inputs import cases, one_channel, segs, voxels, with_grid
from voxmill.operators import fingerprint as P
from voxmill.operators import normalize as N
from voxmill.operators import resample as Z
from voxmill.operators.voxel import mark_outside, nonzero_mask
from voxmill.plans.configure import new_shape

STATS = f"st AS (SELECT channel, {SQL_STATS} FROM fg GROUP BY 1)"
# unrounded statistics for further computing
RAW = """st AS (SELECT channel, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.005) AS lo,
  quantile_cont(value, 0.995) AS hi FROM fg GROUP BY 1)"""
Z0 = "zs AS (SELECT case_id, channel, avg(value) AS m, greatest(stddev_pop(value), 1e-8) AS s FROM voxels GROUP BY 1, 2)"
ZM = """zm AS (SELECT case_id, channel, avg(value) AS m, greatest(stddev_pop(value), 1e-8) AS s
  FROM voxels JOIN mask USING (case_id, i, j, k) WHERE inside OR label > 0 GROUP BY 1, 2)""".replace(
    "JOIN mask USING (case_id, i, j, k)", "JOIN mask USING (case_id, i, j, k) JOIN segs USING (case_id, i, j, k)")
OUT = "outm AS (SELECT case_id, i, j, k, inside OR label > 0 AS inside FROM mask JOIN segs USING (case_id, i, j, k))"


def stats(spark, sf):
    return P.foreground_intensity_stats(voxels(spark, sf), segs(spark, sf))


def body_labels(spark, sf):
    return mark_outside(segs(spark, sf), nonzero_mask(voxels(spark, sf)))


@query("attach_channel_stats", with_grid(f"""
SELECT case_id, v.channel, i, j, k, value, {q6('mean')} AS mean, {q6('std')} AS std FROM voxels v LEFT JOIN st USING (channel)""", FG, RAW))
def _(spark, sf):
    return rounded(N.attach_channel_stats(voxels(spark, sf), stats(spark, sf).select("channel", "mean", "std")), "mean", "std")


@query("normalize_ct", with_grid(f"""
SELECT case_id, channel, i, j, k, {q6('(least(greatest(value, lo), hi) - mean) / greatest(std, 1e-8)')} AS value
FROM voxels JOIN st USING (channel)""", FG, RAW))
def _(spark, sf):
    return rounded(N.normalize_ct(voxels(spark, sf), stats(spark, sf)), "value")


@query("normalize_ct_without_stats", with_grid(f"""
SELECT case_id, channel, i, j, k, {q6('value')} AS value FROM voxels"""))
def _(spark, sf):
    return rounded(N.normalize_ct(voxels(spark, sf), None), "value")


@query("normalize_zscore", with_grid(f"""
SELECT case_id, channel, i, j, k, {q6('(value - m) / s')} AS value FROM voxels JOIN zs USING (case_id, channel)""", Z0))
def _(spark, sf):
    return rounded(N.normalize_zscore(voxels(spark, sf)), "value")


@query("normalize_zscore_masked", with_grid(f"""
SELECT case_id, channel, i, j, k, CASE WHEN inside THEN {q6('(value - m) / s')} ELSE 0.0 END AS value
FROM voxels JOIN zm USING (case_id, channel) JOIN outm USING (case_id, i, j, k)""", ZM, OUT))
def _(spark, sf):
    return rounded(N.normalize_zscore(voxels(spark, sf), body_labels(spark, sf), use_mask=True), "value")


@query("registered_normalizer", with_grid(f"""
SELECT case_id, channel, i, j, k, {q6('(value - m) / (s + 1.0)')} AS value FROM voxels JOIN zs USING (case_id, channel)""", Z0))
def _(spark, sf):
    """A scheme that the caller adds to the registry."""
    N.register_normalizer("Soft", lambda v, p: (v - p["mean"]) / (p["std"] + 1.0))
    return rounded(N.normalize(voxels(spark, sf), ("Soft", False))[0], "value")


@query("normalize_none", with_grid("SELECT * FROM voxels"))
def _(spark, sf):
    return N.normalize_none(voxels(spark, sf))


@query("zscore_window", with_grid(f"""
SELECT case_id, channel, i, j, k, {q6('(value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-8)')} AS value
FROM voxels WINDOW w AS (PARTITION BY case_id, channel)"""))
def _(spark, sf):
    return rounded(N.zscore_window(voxels(spark, sf)), "value")


def two_scheme_plan(spark, sf):
    """Channel 0 like CT, channel 1 z-scored inside the mask; a list entry covers the rest."""
    channels = voxels(spark, sf).select("channel").distinct()
    return N.channel_plan(channels, F.array(F.lit("CTNormalization"), F.lit("ZScore")), F.array(F.lit(False), F.lit(True)))


MIXED = f"""
SELECT case_id, channel, i, j, k, CASE channel WHEN 0 THEN {q6('(least(greatest(value, lo), hi) - mean) / greatest(std, 1e-8)')}
  ELSE CASE WHEN inside THEN {q6('(value - m) / s')} ELSE 0.0 END END AS value
FROM voxels JOIN st USING (channel) JOIN zm USING (case_id, channel) JOIN outm USING (case_id, i, j, k)"""


@query("normalize", with_grid(MIXED, FG, RAW, ZM, OUT))
def _(spark, sf):
    out, _params = N.normalize(voxels(spark, sf), two_scheme_plan(spark, sf), stats(spark, sf), body_labels(spark, sf))
    return rounded(out, "value")


@query("normalization_params", with_grid(f"""
SELECT case_id, channel, CASE channel WHEN 0 THEN 'CT' ELSE 'ZScore' END AS scheme,
  {q6('CASE channel WHEN 0 THEN mean ELSE m END')} AS mean, {q6('CASE channel WHEN 0 THEN std ELSE s END')} AS std,
  {q6('lo')} AS lower_clip, {q6('hi')} AS upper_clip, channel = 1 AS use_mask, false AS empty
FROM st JOIN zm USING (channel)""", FG, RAW, ZM))
def _(spark, sf):
    params = N.normalization_params(voxels(spark, sf), two_scheme_plan(spark, sf), stats(spark, sf), body_labels(spark, sf))
    return rounded(params, "mean", "std", "lower_clip", "upper_clip")


@query("denormalize", with_grid(f"""
SELECT case_id, channel, i, j, k, {q6('CASE WHEN channel = 0 THEN least(greatest(value, lo), hi) WHEN inside THEN value ELSE 0 END')} AS value
FROM voxels JOIN st USING (channel) JOIN outm USING (case_id, i, j, k)""", FG, RAW, OUT))
def _(spark, sf):
    out, params = N.normalize(voxels(spark, sf), two_scheme_plan(spark, sf), stats(spark, sf), body_labels(spark, sf))
    return rounded(N.denormalize(out, params), "value")


# --- resampling: 8x8x8 (or 4x8x8) to a shape that depends on the case ----------------

SHAPES = """shapes AS (SELECT case_id, nx AS o0, 8 AS o1, 8 AS o2,
  CASE WHEN case_id % 4 = 3 THEN nx ELSE (5 + case_id % 6)::INT END AS n0, CASE WHEN case_id % 4 = 3 THEN 8 ELSE (4 + case_id % 8)::INT END AS n1,
  CASE WHEN case_id % 4 >= 2 THEN 8 ELSE (3 + case_id % 9)::INT END AS n2 FROM cases),
outs AS (SELECT s.*, x.x::INT AS i, y.y::INT AS j, z.z::INT AS k,
    (x.x + 0.5::DOUBLE) * o0 / n0 - 0.5 AS px, (y.y + 0.5::DOUBLE) * o1 / n1 - 0.5 AS py, (z.z + 0.5::DOUBLE) * o2 / n2 - 0.5 AS pz
  FROM shapes s, range(12) x(x), range(12) y(y), range(12) z(z) WHERE x.x < n0 AND y.y < n1 AND z.z < n2)"""


def shapes(spark, sf):
    c = F.col("case_id")
    nx = F.col("shape")[0]
    new = F.array(F.when(c % 4 == 3, nx).otherwise((5 + c % 6).cast("int")),
                  F.when(c % 4 == 3, 8).otherwise((4 + c % 8).cast("int")),
                  F.when(c % 4 >= 2, 8).otherwise((3 + c % 9).cast("int")))
    return cases(spark, sf).select("case_id", F.col("shape").alias("old_shape"), new.alias("new_shape"), "spacing",
                                   F.col("spacing").alias("target"))


NEAREST = """
SELECT v.case_id, o.i, o.j, o.k, v.label FROM outs o JOIN segs v ON v.case_id = o.case_id
 AND v.i = least(floor(px + 0.5), o0 - 1) AND v.j = least(floor(py + 0.5), o1 - 1) AND v.k = least(floor(pz + 0.5), o2 - 1)"""


@query("resample_labels", with_grid(NEAREST, SHAPES))
def _(spark, sf):
    return Z.resample_labels(segs(spark, sf), shapes(spark, sf))


@query("needs_separate_z", with_grid("SELECT case_id, greatest(sx, sy, sz) / least(sx, sy, sz) > 3.0 AS separate FROM cases"))
def _(spark, sf):
    return cases(spark, sf).select("case_id", Z.needs_separate_z(F.col("spacing")).alias("separate"))


def _taps(p: str, n: str) -> str:
    """Two neighbours with weights along one axis, mirrored at the ends."""
    def fold(e: str) -> str:
        return f"(CASE WHEN abs({e}) > {n} - 1 THEN 2 * ({n} - 1) - abs({e}) ELSE abs({e}) END)"
    return (f"[{{'s': {fold(f'floor({p})')}::INT, 'w': 1 - ({p} - floor({p}))}}, "
            f"{{'s': {fold(f'(floor({p}) + 1)')}::INT, 'w': {p} - floor({p})}}]")


LINEAR = f"""
SELECT case_id, channel, i, j, k, {q6('sum(value * wa * wb * wc)')} AS value FROM (
  SELECT o.case_id, o.i, o.j, o.k, channel, value, a.w AS wa, b.w AS wb, c.w AS wc
  FROM (SELECT *, unnest({_taps('px', 'o0')}) AS a FROM outs) o
  JOIN LATERAL (SELECT unnest({_taps('o.py', 'o.o1')}) AS b) ON true JOIN LATERAL (SELECT unnest({_taps('o.pz', 'o.o2')}) AS c) ON true
  JOIN one_channel v ON v.case_id = o.case_id AND v.i = a.s AND v.j = b.s AND v.k = c.s) GROUP BY ALL"""


@query("resample_linear", with_grid(LINEAR, SHAPES))
def _(spark, sf):
    return rounded(Z.resample(one_channel(spark, sf), shapes(spark, sf), 1), "value")


@query("interpolation_join", with_grid(LINEAR.replace("JOIN one_channel v", "JOIN voxels v"), SHAPES))
def _(spark, sf):
    return rounded(Z.resample(voxels(spark, sf), shapes(spark, sf), 1), "value")


# six times as many slices, and an axis shrunk to one voxel
WIDE = """shapes AS (SELECT case_id, nx AS o0, 8 AS o1, 8 AS o2, (6 * nx)::INT AS n0, 8 AS n1, 1 AS n2 FROM cases),
outs AS (SELECT s.*, x.x::INT AS i, y.y::INT AS j, z.z::INT AS k,
    (x.x + 0.5::DOUBLE) * o0 / n0 - 0.5 AS px, (y.y + 0.5::DOUBLE) * o1 / n1 - 0.5 AS py, (z.z + 0.5::DOUBLE) * o2 / n2 - 0.5 AS pz
  FROM shapes s, range(48) x(x), range(8) y(y), range(1) z(z) WHERE x.x < n0)"""


@query("resample_linear_wide", with_grid(LINEAR, WIDE))
def _(spark, sf):
    wide = cases(spark, sf).select("case_id", F.col("shape").alias("old_shape"),
                                   F.array(F.col("shape")[0] * 6, F.lit(8), F.lit(1)).alias("new_shape"))
    return rounded(Z.resample(one_channel(spark, sf), wide, 1), "value")


SEPARATE = LINEAR.replace(_taps("px", "o0"), "[{'s': least(floor(px + 0.5), o0 - 1)::INT, 'w': 1.0::DOUBLE}]")


@query("resample_separate_z", with_grid(SEPARATE, SHAPES))
def _(spark, sf):
    return rounded(Z.resample_separate_z(one_channel(spark, sf), shapes(spark, sf), 1, 0), "value")


@query("resample_auto", with_grid(f"""
SELECT q.* FROM ({LINEAR}) q JOIN cases USING (case_id) WHERE NOT greatest(sx, sy, sz) / least(sx, sy, sz) > 3.0
UNION ALL SELECT q.* FROM ({SEPARATE}) q JOIN cases USING (case_id) WHERE greatest(sx, sy, sz) / least(sx, sy, sz) > 3.0""", SHAPES))
def _(spark, sf):
    return rounded(Z.resample_auto(one_channel(spark, sf), shapes(spark, sf), 1, 0), "value")


# cubic B-spline weights from the closed form of the inverse filter, sqrt(3) * z^|n| with z = sqrt(3) - 2
CUBIC = """
pairs AS (SELECT o0 AS old, n0 AS new FROM shapes UNION SELECT o1, n1 FROM shapes UNION SELECT o2, n2 FROM shapes),
xo AS (SELECT old, new, o, (o + 0.5::DOUBLE) * old / new - 0.5 AS x FROM pairs, range(12) r(o) WHERE o < new),
bm AS (SELECT old, new, o, m, CASE WHEN d < 1 THEN (4 - 6*d*d + 3*d*d*d) / 6 ELSE pow(2 - d, 3) / 6 END AS b
   FROM (SELECT *, floor(x)::INT + t AS m, abs(x - (floor(x) + t)) AS d FROM xo, range(-1, 3) r(t)) WHERE d < 2),
cw AS (SELECT old, new, o::INT AS o, ((old - 1) - abs((old - 1) - abs(m - n) % (2 * (old - 1))))::INT AS s, sum(b * sqrt(3) * pow(sqrt(3) - 2, abs(n))) AS w
   FROM bm, range(-60, 61) r(n) GROUP BY ALL),
rng AS (SELECT case_id, min(value) AS lo, max(value) AS hi FROM one_channel GROUP BY 1),
srng AS (SELECT case_id, i, min(value) AS lo, max(value) AS hi FROM one_channel GROUP BY 1, 2)"""


@query("resample_cubic", with_grid(f"""
SELECT case_id, channel, i, j, k, {q6('least(greatest(v, lo), hi)')} AS value FROM (
  SELECT v.case_id, channel, a.o AS i, b.o AS j, c.o AS k, sum(value * a.w * b.w * c.w) AS v FROM one_channel v JOIN shapes USING (case_id)
  JOIN cw a ON a.old = o0 AND a.new = n0 AND a.s = v.i JOIN cw b ON b.old = o1 AND b.new = n1 AND b.s = v.j
  JOIN cw c ON c.old = o2 AND c.new = n2 AND c.s = v.k GROUP BY ALL) JOIN rng USING (case_id)""", SHAPES, CUBIC))
def _(spark, sf):
    return rounded(Z.resample(one_channel(spark, sf), shapes(spark, sf), 3), "value")


@query("resample_cubic_separate_z", with_grid(f"""
SELECT p.case_id, channel, z.z::INT AS i, j, k, {q6('value')} AS value FROM (
  SELECT case_id, channel, i, j, k, least(greatest(v, lo), hi) AS value FROM (
    SELECT v.case_id, channel, v.i AS i, b.o AS j, c.o AS k, sum(value * b.w * c.w) AS v FROM one_channel v JOIN shapes USING (case_id)
    JOIN cw b ON b.old = o1 AND b.new = n1 AND b.s = v.j JOIN cw c ON c.old = o2 AND c.new = n2 AND c.s = v.k GROUP BY ALL)
  JOIN srng USING (case_id, i)) p JOIN shapes s ON s.case_id = p.case_id, range(12) z(z)
WHERE z.z < n0 AND p.i = least(floor(((z.z + 0.5::DOUBLE) * o0 / n0 - 0.5) + 0.5), o0 - 1)""", SHAPES, CUBIC))
def _(spark, sf):
    return rounded(Z.resample_separate_z(one_channel(spark, sf), shapes(spark, sf), 3, 0), "value")


@query("resampled_shapes", with_grid("""
SELECT case_id, round_even(nx * sx / 0.8::DOUBLE, 0)::INT || ',' || round_even(8 * sy / 0.8::DOUBLE, 0)::INT || ',' || round_even(8 * sz / 0.8::DOUBLE, 0)::INT AS shape FROM cases"""))
def _(spark, sf):
    return cases(spark, sf).select("case_id", F.array_join(new_shape(
        F.col("shape"), F.col("spacing"), F.array(*[F.lit(0.8)] * 3)).cast("array<string>"), ",").alias("shape"))
