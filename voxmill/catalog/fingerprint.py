"""Queries on dataset statistics and seeded sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.catalog.base import flat, q6, query, r6, rounded
from voxmill.catalog.inputs import cases, htoken, one_channel, segs, udraw, voxels, with_grid
from voxmill.operators import fingerprint as P
from voxmill.operators.spread import value_counts
from voxmill.operators.voxel import nonzero_bbox, nonzero_mask, mark_outside
from voxmill.session import settle
from voxmill.sources.files import rows_of_cases

STATS = ("mean", "std", "min", "max", "percentile_00_5", "median", "percentile_99_5")
SQL_STATS = ", ".join([
    f"{q6('avg(value)')} AS mean", f"{q6('stddev_pop(value)')} AS std",
    f"{q6('min(value)')} AS min", f"{q6('max(value)')} AS max", "count(*) AS n_voxels",
    f"{q6('quantile_cont(value, 0.005)')} AS percentile_00_5",
    f"{q6('quantile_cont(value, 0.5)')} AS median",
    f"{q6('quantile_cont(value, 0.995)')} AS percentile_99_5"])
FG = "fg AS (SELECT v.*, case_id % 3 AS dataset_id FROM voxels v JOIN segs USING (case_id, i, j, k) WHERE label > 0)"
INBOX = """inbox AS (SELECT s.*, case_id % 3 AS dataset_id FROM segs s JOIN bbox USING (case_id)
  WHERE i>=lo0 AND i<hi0 AND j>=lo1 AND j<hi1 AND k>=lo2 AND k<hi2)"""


@query("foreground_intensity_stats", with_grid(f"SELECT channel, {SQL_STATS} FROM fg GROUP BY 1", FG))
def _(spark, sf):
    return rounded(P.foreground_intensity_stats(voxels(spark, sf), segs(spark, sf)), *STATS)


@query("foreground_intensity_stats_unlabelled", with_grid(
    f"SELECT channel, {SQL_STATS} FROM voxels JOIN mask USING (case_id, i, j, k) WHERE inside GROUP BY 1"))
def _(spark, sf):
    return rounded(P.foreground_intensity_stats(voxels(spark, sf)), *STATS)


# percentiles of a sketch are right within its documented rank error, its other statistics exactly
SKETCHED = f"""n_voxels, {q6('mean')} AS mean, {q6('std')} AS std, {q6('min')} AS min, {q6('max')} AS max,
  TRUE AS percentile_00_5_ok, TRUE AS median_ok, TRUE AS percentile_99_5_ok
FROM (SELECT %s, count(*) AS n_voxels, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM fg GROUP BY ALL)"""


def with_ranks(stats, counts, keys):
    kept = stats.select(*keys, "n_voxels", "mean", "std", "min", "max")
    return rounded(kept.join(P.ranks_of(counts, stats, keys), keys), "mean", "std", "min", "max")


@query("foreground_intensity_stats_sketch", with_grid("SELECT channel, " + SKETCHED % "channel", FG))
def _(spark, sf):
    stats = settle(P.foreground_intensity_stats(voxels(spark, sf), segs(spark, sf), approx=True))
    counts = value_counts(P.foreground(voxels(spark, sf), segs(spark, sf)), ["channel"], "value")
    return with_ranks(stats, counts, ["channel"])


@query("merged_sketches", with_grid("SELECT dataset_id, channel, " + SKETCHED % "dataset_id, channel", FG))
def _(spark, sf):
    """Partial tables of three batches of cases, merged."""
    keys, every = ["dataset_id", "channel"], cases(spark, sf)
    parts = None
    for batch in range(3):
        some = every.filter(F.pmod(F.xxhash64("case_id"), F.lit(3)) == batch)
        part = settle(P.sketch_partial(rows_of_cases(voxels(spark, sf), some), rows_of_cases(segs(spark, sf), some), some))
        parts = part if parts is None else parts.unionByName(part)
    stats = settle(P.stats_of_sketches(P.merge_sketches(parts, keys), keys))
    fg = P.foreground(voxels(spark, sf), segs(spark, sf)).join(every.select("case_id", "dataset_id"), "case_id")
    return with_ranks(stats, value_counts(fg, keys, "value"), keys)


@query("label_class_ratios", with_grid(f"""
SELECT dataset_id, label, count(*) AS n,
       {q6('count(*) / (sum(count(*)) OVER (PARTITION BY dataset_id))::DOUBLE')} AS ratio
FROM inbox GROUP BY 1, 2""", INBOX))
def _(spark, sf):
    grid_cases = cases(spark, sf)
    return rounded(P.label_class_ratios(segs(spark, sf), nonzero_bbox(voxels(spark, sf), grid_cases), grid_cases), "ratio")


@query("label_inventory", with_grid("""
SELECT dataset_id, string_agg(label::VARCHAR, ',' ORDER BY label) AS labels, count(*) AS num_classes
FROM (SELECT DISTINCT case_id % 3 AS dataset_id, label FROM segs) GROUP BY 1"""))
def _(spark, sf):
    return flat(P.label_inventory(segs(spark, sf), cases(spark, sf)), "labels")


@query("channel_moments", with_grid(
    f"SELECT case_id, channel, {q6('avg(value)')} AS mean, {q6('stddev_pop(value)')} AS std FROM voxels GROUP BY 1, 2"))
def _(spark, sf):
    return rounded(P.channel_moments(voxels(spark, sf)), "mean", "std")


@query("channel_moments_masked", with_grid(f"""
SELECT case_id, channel, {q6('avg(value) FILTER (WHERE inside)')} AS mean,
       {q6('stddev_pop(value) FILTER (WHERE inside)')} AS std
FROM voxels JOIN mask USING (case_id, i, j, k) GROUP BY 1, 2"""))
def _(spark, sf):
    vox = voxels(spark, sf)
    labels = mark_outside(segs(spark, sf), nonzero_mask(vox))
    return rounded(P.channel_moments(vox, labels, use_mask=True), "mean", "std")


@query("volume_range", with_grid(
    "SELECT case_id, channel, min(value) AS min, max(value) AS max FROM voxels GROUP BY 1, 2"))
def _(spark, sf):
    return P.volume_range(voxels(spark, sf))


SQL_GEOMETRY = ", ".join(
    [f"{q6(f'quantile_cont({c}, {p})')} AS {n}_{a}"
     for n, p, cs in (("median_spacing", 0.5, "sx sy sz"), ("p10_spacing", 0.1, "sx sy sz"),
                      ("median_size", 0.5, "ax ay az"))
     for a, c in zip("ijk", cs.split())] + [f"{q6('quantile_cont(crop_ratio, 0.5)')} AS median_crop_ratio"])


def geometry_columns():
    return [r6(F.col(c)[a]).alias(f"{n}_{x}")
            for n, c in (("median_spacing", "median_spacing"), ("p10_spacing", "p10_spacing"),
                         ("median_size", "median_size_after_crop"))
            for a, x in enumerate("ijk")] + [r6("median_crop_ratio").alias("median_crop_ratio")]


@query("geometry_summary", with_grid(
    f"SELECT dataset_id, count(*) AS num_cases, {SQL_GEOMETRY} FROM fcases GROUP BY 1"))
def _(spark, sf):
    geometry = P.cropped_geometry(voxels(spark, sf), segs(spark, sf), cases(spark, sf))
    return P.geometry_summary(geometry).select("dataset_id", "num_cases", *geometry_columns())


@query("merge_statistics", with_grid(f"SELECT dataset_id, channel, {SQL_STATS} FROM fg GROUP BY 1, 2", FG))
def _(spark, sf):
    vox, seg, grid_cases = voxels(spark, sf), segs(spark, sf), cases(spark, sf)
    halves = [P.statistics_partial(*[t.filter(F.col("case_id") % 2 == h) for t in (vox, seg, grid_cases)])
              for h in (0, 1)]
    return rounded(P.partial_intensity_stats(P.merge_statistics(*halves)), *STATS)


@query("merge_label_statistics", with_grid(f"""
SELECT dataset_id, label::INT AS label, count(*) AS n,
       {q6('count(*) / (sum(count(*)) OVER (PARTITION BY dataset_id))::DOUBLE')} AS ratio
FROM inbox GROUP BY 1, 2""", INBOX))
def _(spark, sf):
    vox, seg, grid_cases = voxels(spark, sf), segs(spark, sf), cases(spark, sf)
    halves = [P.statistics_partial(*[t.filter(F.col("case_id") % 2 == h) for t in (vox, seg, grid_cases)])
              for h in (0, 1)]
    return rounded(P.partial_class_ratios(P.merge_statistics(*halves)), "ratio")


@query("dataset_fingerprint", with_grid(f"""
SELECT g.*, c.num_classes, f.channel, mean, std, median, percentile_00_5, percentile_99_5, r.background
FROM (SELECT dataset_id, count(*) AS num_cases, {SQL_GEOMETRY} FROM fcases GROUP BY 1) g
JOIN (SELECT case_id % 3 AS dataset_id, count(DISTINCT label) AS num_classes FROM segs GROUP BY 1) c USING (dataset_id)
JOIN (SELECT dataset_id, channel, {SQL_STATS} FROM fg GROUP BY 1, 2) f USING (dataset_id)
JOIN (SELECT dataset_id, {q6("count(*) FILTER (WHERE label = 0) / count(*)::DOUBLE")} AS background
      FROM inbox GROUP BY 1) r USING (dataset_id)""", FG, INBOX))
def _(spark, sf):
    wide = P.dataset_fingerprint(voxels(spark, sf), segs(spark, sf), cases(spark, sf))
    long = wide.select("*", F.explode("intensity_per_channel").alias("channel", "s"))
    return long.select("dataset_id", "num_cases", *geometry_columns(), "num_classes", "channel",
                       *[r6(F.col(f"s.{c}")).alias(c) for c in ("mean", "std", "median", "percentile_00_5", "percentile_99_5")],
                       r6(F.element_at("label_class_ratios", F.lit(0))).alias("background"))


@query("dataset_fingerprint_unlabelled", with_grid(f"""
SELECT g.*, f.channel, mean, std, median, percentile_00_5, percentile_99_5
FROM (SELECT dataset_id, count(*) AS num_cases, {SQL_GEOMETRY} FROM icases GROUP BY 1) g
JOIN (SELECT case_id % 3 AS dataset_id, channel, {SQL_STATS} FROM voxels JOIN mask USING (case_id, i, j, k) WHERE inside GROUP BY 1, 2) f
  USING (dataset_id)""", """icases AS (SELECT c.case_id % 3 AS dataset_id, hi0-lo0 AS ax, hi1-lo1 AS ay, hi2-lo2 AS az, sx, sy, sz,
  ((hi0-lo0)*(hi1-lo1)*(hi2-lo2))::DOUBLE / (nx*ny*nz) AS crop_ratio FROM cases c JOIN bbox USING (case_id))"""))
def _(spark, sf):
    wide = P.dataset_fingerprint(voxels(spark, sf), None, cases(spark, sf))
    long = wide.filter("num_classes IS NULL AND label_class_ratios IS NULL").select("*", F.explode("intensity_per_channel").alias("channel", "s"))
    return long.select("dataset_id", "num_cases", *geometry_columns(), "channel",
                       *[r6(F.col(f"s.{c}")).alias(c) for c in ("mean", "std", "median", "percentile_00_5", "percentile_99_5")])


DRAWN = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id, channel ORDER BY {htoken('7', 'i', 'j', 'k')}) - 1 AS rank,
             count(*) OVER (PARTITION BY case_id, channel) AS size FROM fg),
draws AS (SELECT case_id, channel, t, floor({udraw('7', 'case_id', 'channel', 't')} * size)::BIGINT AS rank
          FROM (SELECT DISTINCT case_id, channel, size FROM ranked), range(20) r(t) WHERE t < size)"""


@query("sample_with_replacement", with_grid(
    "SELECT d.case_id, d.channel, t, i, j, k, value FROM draws d JOIN ranked USING (case_id, channel, rank)", FG, DRAWN))
def _(spark, sf):
    chosen = P.foreground(voxels(spark, sf), segs(spark, sf))
    return P.sample_with_replacement(chosen, ("case_id", "channel"), ("i", "j", "k"), 20, 7)


LABEL_DRAWS = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {htoken('9', 'i', 'j', 'k')}) - 1 AS rank,
             count(*) OVER (PARTITION BY case_id) AS size FROM inbox),
draws AS (SELECT case_id, t, floor({udraw('9', 'case_id', 't')} * size)::BIGINT AS rank
          FROM (SELECT DISTINCT case_id, size FROM ranked), range(30) r(t) WHERE t < size)"""


@query("sample_labels", with_grid(f"""
SELECT dataset_id, label, count(*) AS n, {q6('count(*) / (sum(count(*)) OVER (PARTITION BY dataset_id))::DOUBLE')} AS ratio
FROM draws JOIN ranked USING (case_id, rank) GROUP BY 1, 2""", INBOX, LABEL_DRAWS))
def _(spark, sf):
    grid_cases = cases(spark, sf)
    drawn = P.sample_labels(segs(spark, sf), nonzero_bbox(voxels(spark, sf), grid_cases), 30, 9)
    counts = drawn.groupBy((F.col("case_id") % 3).alias("dataset_id"), "label").agg(F.count(F.lit(1)).alias("n"))
    return rounded(P.class_shares(counts, ["dataset_id"]), "ratio")


LOCATED = f"""
located AS (SELECT * FROM (
  SELECT case_id, label, i, j, k,
    row_number() OVER (PARTITION BY case_id, label ORDER BY {htoken('1234', 'i', 'j', 'k')}) - 1 AS rank,
    count(*) OVER (PARTITION BY case_id, label) AS total FROM segs WHERE label > 0)
  WHERE rank < least(total, greatest(5, ceil(total * 0.3::DOUBLE))))"""


@query("sample_locations", with_grid("SELECT case_id, label, i, j, k, rank FROM located", LOCATED))
def _(spark, sf):
    return P.sample_locations(segs(spark, sf), [1, 2, 3], min_num=5, share=0.3)


@query("location_counts", with_grid("""
SELECT c.case_id, l.label::TINYINT AS label, count(x.rank) AS n
FROM cases c CROSS JOIN (SELECT unnest([1,2,3]) AS label) l
LEFT JOIN located x ON x.case_id = c.case_id AND x.label = l.label GROUP BY 1, 2""", LOCATED))
def _(spark, sf):
    chosen = P.sample_locations(segs(spark, sf), [1, 2, 3], min_num=5, share=0.3)
    return P.location_counts(cases(spark, sf), [1, 2, 3], chosen)


@query("case_budget", with_grid("""
SELECT case_id, greatest(1, 100000000 // count(*) OVER (PARTITION BY dataset_id)) AS budget FROM cases"""))
def _(spark, sf):
    return P.case_budget(cases(spark, sf))
