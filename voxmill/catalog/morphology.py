"""Queries on holes, distances and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.catalog.base import q6, query, rounded
from voxmill.catalog.inputs import cases, segs, with_grid
from voxmill.catalog.registry import PRED, prediction
from voxmill.operators import morphology as M

# the labelled voxels of a ball are scattered, so their complement has many holes
FLOOD = """
bg AS (SELECT case_id, i, j, k FROM segs WHERE label = 0 OR (i + j + k) % 5 = 0),
lim AS (SELECT case_id, nx FROM cases),
reach AS (
  SELECT bg.case_id, i, j, k FROM bg JOIN lim USING (case_id)
  WHERE i = 0 OR j = 0 OR k = 0 OR i = nx - 1 OR j = 7 OR k = 7
  UNION
  SELECT bg.case_id, bg.i, bg.j, bg.k FROM reach r JOIN bg ON bg.case_id = r.case_id
   AND abs(bg.i - r.i) + abs(bg.j - r.j) + abs(bg.k - r.k) = 1)"""


def holed_mask(spark, sf):
    return segs(spark, sf).select("case_id", "i", "j", "k",
                                    (~((F.col("label") == 0) | ((F.col("i") + F.col("j") + F.col("k")) % 5 == 0))).alias("inside"))


@query("fill_holes", with_grid("""
SELECT s.case_id, s.i, s.j, s.k, r.case_id IS NULL AS inside FROM segs s LEFT JOIN reach r USING (case_id, i, j, k)""",
                               FLOOD).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    return M.fill_holes(holed_mask(spark, sf), cases(spark, sf))


D2 = "((a.i-b.i)*sx)*((a.i-b.i)*sx) + ((a.j-b.j)*sy)*((a.j-b.j)*sy) + ((a.k-b.k)*sz)*((a.k-b.k)*sz)"


@query("signed_distance", with_grid(f"""
SELECT a.case_id, c.c::INT AS cls, a.i, a.j, a.k,
  {q6('''CASE WHEN a.label = c.c THEN -least(10.0, coalesce(sqrt(min(CASE WHEN b.label <> c.c THEN %s END)), 10.0))
        ELSE least(10.0, coalesce(sqrt(min(CASE WHEN b.label = c.c THEN %s END)), 10.0)) END''' % (D2, D2))} AS dist
FROM segs a CROSS JOIN (SELECT unnest([1, 2, 3]) AS c) c JOIN segs b USING (case_id) JOIN cases USING (case_id)
GROUP BY a.case_id, c.c, a.i, a.j, a.k, a.label"""))
def _(spark, sf):
    return rounded(M.signed_distance(segs(spark, sf), [1, 2, 3], cases(spark, sf)), "dist")


SURFACES = """
surf AS (SELECT side, case_id, label::INT AS cls, i, j, k FROM (
   SELECT side, case_id, i, j, k, label,
     lag(label) OVER x IS NOT DISTINCT FROM label AND lead(label) OVER x IS NOT DISTINCT FROM label AND
     lag(label) OVER y IS NOT DISTINCT FROM label AND lead(label) OVER y IS NOT DISTINCT FROM label AND
     lag(label) OVER z IS NOT DISTINCT FROM label AND lead(label) OVER z IS NOT DISTINCT FROM label AS deep
   FROM (SELECT 'g' AS side, * FROM segs UNION ALL SELECT 'p', * FROM pred)
   WINDOW x AS (PARTITION BY side, case_id, j, k ORDER BY i), y AS (PARTITION BY side, case_id, i, k ORDER BY j),
          z AS (PARTITION BY side, case_id, i, j ORDER BY k)) WHERE label > 0 AND NOT deep),
near AS (SELECT a.side, a.case_id, a.cls, a.i, a.j, a.k, sqrt(min(%s)) AS d FROM surf a JOIN surf b
   ON a.case_id = b.case_id AND a.cls = b.cls AND a.side <> b.side JOIN cases c ON c.case_id = a.case_id GROUP BY ALL)""" % D2


@query("surface_voxels", with_grid("SELECT case_id, cls, i, j, k FROM surf WHERE side = 'g'", PRED, SURFACES))
def _(spark, sf):
    return M.surface_voxels(segs(spark, sf))


@query("surface_distance_scores", with_grid(f"""
SELECT case_id, cls, coalesce({q6('hd')}, 'inf'::DOUBLE) AS hd95, {q6('coalesce(within, 0) / n::DOUBLE')} AS surface_dice
FROM (SELECT case_id, cls, count(*) AS n FROM surf GROUP BY 1, 2)
LEFT JOIN (SELECT case_id, cls, quantile_cont(d, 0.95) AS hd, count(*) FILTER (WHERE d <= 2.0) AS within FROM near GROUP BY 1, 2)
USING (case_id, cls)""", PRED, SURFACES))
def _(spark, sf):
    return rounded(M.surface_distance_scores(segs(spark, sf), prediction(spark, sf), cases(spark, sf)), "hd95", "surface_dice")
