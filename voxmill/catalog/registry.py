"""Queries on the experiment registry and on scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.catalog.base import flat, q6, query, r6, rounded
from voxmill.catalog.inputs import segs, table, udraw, with_grid
from voxmill.functions.columns import draw
from voxmill.operators import metrics as E
from voxmill.operators import registry as R

RUNS = """
run_folds AS (
  SELECT o_custkey AS run_id, (o_orderkey % 5)::INT AS fold,
    CASE WHEN s = 'F' THEN 'done' WHEN s = 'P' THEN 'running' WHEN p LIKE '1%' THEN 'failed' ELSE 'planned' END AS status,
    CASE WHEN s = 'F' AND o_orderkey % 7 <> 0 THEN t / 600000.0::DOUBLE END AS dice
  FROM (SELECT o_custkey, o_orderkey, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS t,
     row_number() OVER (PARTITION BY o_custkey, o_orderkey % 5 ORDER BY o_orderkey, o_totalprice, o_orderstatus, o_orderpriority) AS rn FROM orders) WHERE rn = 1),
runs AS (SELECT c_custkey AS run_id, c_mktsegment AS grp,
   CASE c_custkey % 3 WHEN 0 THEN [0] WHEN 1 THEN [2,1,0] ELSE [0,1,2,3,4] END AS folds_intended,
   list_concat(CASE WHEN c_custkey % 4 = 0 AND c_custkey > 0 THEN [c_custkey - 1] ELSE [] END,
               CASE WHEN c_custkey % 50 = 0 THEN [-1::BIGINT] ELSE [] END) AS depends_on FROM customer),
intended AS (SELECT run_id, grp, unnest(folds_intended) AS fold, unnest(range(len(folds_intended))) AS pos FROM runs),
fs AS (SELECT i.*, coalesce(status, 'planned') AS status, dice FROM intended i LEFT JOIN run_folds USING (run_id, fold)),
es AS (SELECT run_id, CASE WHEN bool_and(status = 'done') THEN 'done' WHEN bool_or(status = 'done') THEN 'partial'
   WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'planned' END AS status FROM fs GROUP BY 1),
deps AS (SELECT run_id, unnest(depends_on) AS dependency FROM runs),
blk AS (SELECT d.run_id, d.dependency, CASE WHEN e.status IS NULL THEN 'NOT FOUND' ELSE 'status: ' || e.status END AS reason
   FROM deps d LEFT JOIN es e ON e.run_id = d.dependency WHERE e.status IS NULL OR e.status <> 'done'),
nf AS (SELECT run_id, min(fold) AS next_fold FROM fs WHERE status IN ('planned','running','failed') GROUP BY 1)"""


def sql(body: str) -> str:
    return f"WITH {RUNS}\n{body}"


def run_folds(spark, sf):
    first = table(spark, sf, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 5).alias("f")).agg(
        F.min(F.struct("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")).alias("o")).select("o_custkey", "o.*")
    s = F.col("o_orderstatus")
    return first.select(
        F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 5).cast("int").alias("fold"),
        F.when(s == "F", "done").when(s == "P", "running").when(F.col("o_orderpriority").startswith("1"), "failed")
        .otherwise("planned").alias("status"),
        F.when((s == "F") & (F.col("o_orderkey") % 7 != 0), F.col("o_totalprice") / 600000.0).alias("dice"))


def runs(spark, sf):
    key = F.col("c_custkey")

    def ints(*v):
        return F.array(*[F.lit(x) for x in v])

    none = F.array().cast("array<bigint>")
    return table(spark, sf, "customer").select(
        key.alias("run_id"), F.col("c_mktsegment").alias("grp"),
        F.when(key % 3 == 0, ints(0)).when(key % 3 == 1, ints(2, 1, 0)).otherwise(ints(0, 1, 2, 3, 4)).alias("folds_intended"),
        F.concat(F.when((key % 4 == 0) & (key > 0), F.array(key - 1)).otherwise(none),
                 F.when(key % 50 == 0, F.array(F.lit(-1).cast("bigint"))).otherwise(none)).alias("depends_on"))


@query("flatten_runs", sql("SELECT grp, run_id, len(folds_intended)::INT AS n FROM runs"))
def _(spark, sf):
    # the nested form: one row per customer stands for one group entry
    groups = runs(spark, sf).select("grp", F.array(F.struct("run_id", "folds_intended")).alias("runs"))
    return R.flatten_runs(groups).select("grp", "run_id", F.size("folds_intended").alias("n"))


@query("fold_statuses", sql("SELECT run_id, fold, status FROM fs"))
def _(spark, sf):
    return R.fold_statuses(runs(spark, sf), run_folds(spark, sf))


@query("experiment_status", sql("SELECT * FROM es"))
def _(spark, sf):
    return R.experiment_status(runs(spark, sf), run_folds(spark, sf))


@query("status_counts", sql("SELECT coalesce(status, 'total') AS status, count(*) AS n FROM es GROUP BY ROLLUP (status)"))
def _(spark, sf):
    return R.status_counts(R.experiment_status(runs(spark, sf), run_folds(spark, sf)))


@query("mean_dice", sql("SELECT run_id, round_even(avg(dice), 4) AS mean_dice FROM fs WHERE status = 'done' AND dice IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return R.mean_dice(runs(spark, sf), run_folds(spark, sf))


@query("recorded_mean_dice", sql("SELECT run_id, round_even(avg(dice), 6) AS mean_dice FROM run_folds GROUP BY 1"))
def _(spark, sf):
    return R.recorded_mean_dice(run_folds(spark, sf))


@query("next_fold", sql("SELECT * FROM nf"))
def _(spark, sf):
    return R.next_fold(runs(spark, sf), run_folds(spark, sf))


@query("blocking_dependencies", sql("SELECT * FROM blk"))
def _(spark, sf):
    return R.blocking_dependencies(runs(spark, sf), run_folds(spark, sf))


@query("blocked_runs", sql("SELECT * FROM blk WHERE run_id IN (SELECT run_id FROM es WHERE status = 'planned')"))
def _(spark, sf):
    return R.blocked_runs(runs(spark, sf), run_folds(spark, sf))


@query("resumable_runs", sql("""
SELECT run_id, e.status, e.status = 'running' AS interrupted,
  string_agg('fold ' || fold || '=' || fs.status, ', ' ORDER BY fold) AS remaining
FROM es e JOIN fs USING (run_id) WHERE e.status IN ('partial', 'running') AND fs.status <> 'done' GROUP BY 1, 2"""))
def _(spark, sf):
    return R.resumable_runs(runs(spark, sf), run_folds(spark, sf))


@query("ready_runs", sql("""
SELECT run_id, status, status = 'running' AS resume, next_fold FROM es JOIN nf USING (run_id)
WHERE status IN ('planned','partial','running') AND run_id NOT IN (SELECT run_id FROM blk)"""))
def _(spark, sf):
    return R.ready_runs(runs(spark, sf), run_folds(spark, sf))


@query("folds_to_validate", sql("SELECT run_id, fold FROM fs WHERE status = 'done'"))
def _(spark, sf):
    return R.folds_to_validate(runs(spark, sf), run_folds(spark, sf))


@query("one_fold_to_validate", sql("SELECT run_id, fold FROM fs WHERE fold = 2"))
def _(spark, sf):
    return R.folds_to_validate(runs(spark, sf), run_folds(spark, sf), 2)


@query("sorted_listing", sql("""
SELECT r.grp, r.run_id, e.status, string_agg(f.fold || ':' || CASE f.status WHEN 'done' THEN '✓' WHEN 'failed' THEN '✗'
  WHEN 'running' THEN '►' ELSE '·' END, ' ' ORDER BY f.pos) AS folds,
  round_even(avg(f.dice) FILTER (WHERE f.status = 'done'), 4) AS mean_dice
FROM runs r JOIN es e USING (run_id) JOIN fs f USING (run_id) WHERE r.grp = 'BUILDING' GROUP BY 1, 2, 3"""))
def _(spark, sf):
    return R.sorted_listing(runs(spark, sf), run_folds(spark, sf), "BUILDING")


UPSERT = """
olds AS (SELECT run_id, fold, dice, dice * 10 AS hd95, run_id * 100 AS num_params FROM run_folds WHERE run_id % 5 <> 4),
news AS (SELECT run_id, fold, dice / 2 AS dice, CASE WHEN fold > 1 THEN dice END AS hd95,
            CASE WHEN run_id % 2 = 0 THEN run_id * 7 END AS num_params FROM run_folds WHERE run_id % 5 >= 2 AND fold >= 1)"""


@query("upsert_fold_results", f"""WITH {RUNS}, {UPSERT},
prm AS (SELECT run_id, coalesce(max(g), max(o)) AS num_params FROM (SELECT run_id, num_params AS o, NULL AS g FROM olds
        UNION ALL SELECT run_id, NULL, num_params FROM news) GROUP BY 1)
SELECT run_id, fold, CASE WHEN n.run_id IS NOT NULL THEN n.dice ELSE o.dice END AS dice,
  CASE WHEN n.run_id IS NOT NULL THEN n.hd95 ELSE o.hd95 END AS hd95, coalesce(prm.num_params, -1) AS num_params
FROM olds o FULL JOIN news n USING (run_id, fold) JOIN prm USING (run_id)""")
def _(spark, sf):
    base = run_folds(spark, sf)
    old = base.filter("run_id % 5 <> 4").select("run_id", "fold", "dice", (F.col("dice") * 10).alias("hd95"),
                                                (F.col("run_id") * 100).alias("num_params"))
    new = base.filter("run_id % 5 >= 2 AND fold >= 1").select(
        "run_id", "fold", (F.col("dice") / 2).alias("dice"), F.when(F.col("fold") > 1, F.col("dice")).alias("hd95"),
        F.when(F.col("run_id") % 2 == 0, F.col("run_id") * 7).alias("num_params"))
    return R.upsert_fold_results(old, new).fillna(-1, subset=["num_params"])


# --- scores -------------------------------------------------------------------------

METRICS = """
base AS (SELECT l_suppkey % 10 AS run_id, l_linenumber % 5 AS fold, (l_suppkey % 4)::VARCHAR AS cls,
   CASE l_returnflag WHEN 'A' THEN 'dice' WHEN 'N' THEN 'hd95' ELSE 'iou' END AS metric, avg(l_discount) * 10 AS v
   FROM lineitem GROUP BY ALL),
cls_rows AS (SELECT run_id, fold, cls, metric, CASE WHEN fold::VARCHAR = cls THEN 'inf'::DOUBLE ELSE v END AS value FROM base
   WHERE NOT (fold = 2 AND cls = '1' ) AND NOT (fold = 3 AND metric = 'hd95')),
fg_rows AS (SELECT run_id, fold, NULL::VARCHAR AS cls, metric, avg(v) AS value FROM base
   WHERE NOT (fold = 1 AND metric = 'hd95') AND NOT (fold = 0 AND metric = 'iou') AND NOT (run_id = 3 AND metric = 'hd95') GROUP BY ALL),
fm AS (SELECT * FROM cls_rows UNION ALL SELECT * FROM fg_rows)"""


def fold_metrics(spark, sf):
    flag = F.col("l_returnflag")
    base = table(spark, sf, "lineitem").groupBy(
        (F.col("l_suppkey") % 10).alias("run_id"), (F.col("l_linenumber") % 5).alias("fold"),
        (F.col("l_suppkey") % 4).cast("string").alias("cls"),
        F.when(flag == "A", "dice").when(flag == "N", "hd95").otherwise("iou").alias("metric")) \
        .agg((F.avg("l_discount") * 10).alias("v"))
    per_class = base.filter("NOT (fold = 2 AND cls = '1') AND NOT (fold = 3 AND metric = 'hd95')").select(
        "run_id", "fold", "cls", "metric",
        F.when(F.col("fold").cast("string") == F.col("cls"), float("inf")).otherwise(F.col("v")).alias("value"))
    fore = base.filter("NOT (fold = 1 AND metric = 'hd95') AND NOT (fold = 0 AND metric = 'iou') AND NOT (run_id = 3 AND metric = 'hd95')") \
        .groupBy("run_id", "fold", "metric").agg(F.avg("v").alias("value")) \
        .select("run_id", "fold", F.lit(None).cast("string").alias("cls"), "metric", "value")
    return per_class.unionByName(fore)


CV = """,
folds AS (SELECT DISTINCT run_id, fold FROM fm),
m4 AS (SELECT unnest(['dice','iou','sensitivity','precision']) AS metric),
fg_all AS (SELECT run_id, 'foreground' AS cls, fold, m.metric, coalesce(value, CASE m.metric WHEN 'hd95' THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END) AS value
   FROM folds CROSS JOIN (SELECT * FROM m4 UNION ALL SELECT 'hd95') m LEFT JOIN fg_rows USING (run_id, fold, metric)
   WHERE m.metric <> 'hd95' OR run_id IN (SELECT run_id FROM fg_rows WHERE metric = 'hd95')),
hc AS (SELECT DISTINCT run_id, cls, fold FROM cls_rows),
cl_all AS (SELECT h.run_id, h.cls, r.fold, m4.metric, r.value FROM (SELECT DISTINCT run_id, cls FROM hc) h CROSS JOIN m4 LEFT JOIN cls_rows r USING (run_id, cls, metric)
   UNION ALL SELECT run_id, cls, fold, 'hd95', coalesce(value, 'inf'::DOUBLE) FROM hc LEFT JOIN (SELECT * FROM cls_rows WHERE metric = 'hd95') USING (run_id, cls, fold)
   WHERE (run_id, cls) IN (SELECT (run_id, cls) FROM cls_rows WHERE metric = 'hd95')),
every AS (SELECT * FROM fg_all UNION ALL SELECT * FROM cl_all)"""


@query("cross_validation_summary", "WITH " + METRICS + CV + f"""
SELECT run_id, cls, metric, coalesce({q6('avg(value) FILTER (WHERE isfinite(value))')}, -1) AS mean,
  CASE WHEN count(*) FILTER (WHERE isfinite(value)) > 1 THEN {q6('stddev_samp(value) FILTER (WHERE isfinite(value))')} ELSE 0.0 END AS std,
  count(fold) AS n_folds, count(*) FILTER (WHERE isinf(value)) AS n_inf, count(*) FILTER (WHERE isnan(value)) AS n_nan
FROM every GROUP BY 1, 2, 3""")
def _(spark, sf):
    out = E.cross_validation_summary(fold_metrics(spark, sf))

    def matching(test):
        return F.size(F.filter("per_fold", test)).cast("bigint")

    return out.select(
        "run_id", F.coalesce("cls", F.lit("foreground")).alias("cls"), "metric",
        F.when(F.isnan("mean"), -1.0).otherwise(r6("mean")).alias("mean"), r6("std").alias("std"),
        F.size("per_fold").cast("bigint").alias("n_folds"), matching(lambda v: v == float("inf")).alias("n_inf"),
        matching(F.isnan).alias("n_nan"))


@query("class_key_union", "WITH " + METRICS + " SELECT DISTINCT cls FROM cls_rows")
def _(spark, sf):
    return E.class_key_union(fold_metrics(spark, sf))


@query("fold_score_summary", f"""
SELECT o_custkey AS run_id, {q6('avg(o_totalprice)')} AS mean, {q6('stddev_samp(o_totalprice)')} AS std
FROM orders GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    scores = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_totalprice").alias("score"))
    return rounded(E.fold_score_summary(scores), "mean", "std")


@query("project_metrics", f"""
SELECT o_orderkey, o_custkey, m AS metric, v AS value FROM (SELECT o_orderkey, o_custkey, unnest(['dice','hd95']) AS m,
  unnest([o_totalprice / 600000.0::DOUBLE, o_totalprice]) AS v FROM orders)""")
def _(spark, sf):
    names = ("foreground_mean_dice", "foreground_mean_hd95", "something_else")
    values = (F.col("o_totalprice") / 600000.0, F.col("o_totalprice"), F.lit(1.0))
    summaries = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.create_map(
        *[x for n, v in zip(names, values) for x in (F.lit(n), v)]).alias("metrics"))
    return E.long_metrics(E.project_metrics(summaries, E.FOREGROUND_KEYS))


@query("project_class_metrics", f"""
SELECT o_orderkey, o_custkey, m AS metric, v AS value FROM (SELECT o_orderkey, o_custkey, unnest(['dice_std','surface_dice']) AS m,
  unnest([o_totalprice / 600000.0::DOUBLE, o_totalprice]) AS v FROM orders)""")
def _(spark, sf):
    names = ("Dice_std", "SurfaceDice", "Volume")
    values = (F.col("o_totalprice") / 600000.0, F.col("o_totalprice"), F.lit(1.0))
    summaries = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.create_map(
        *[x for n, v in zip(names, values) for x in (F.lit(n), v)]).alias("metrics"))
    return E.long_metrics(E.project_metrics(summaries, E.CLASS_KEYS))


PRED = """
pred AS (SELECT case_id, i, j, k - 1 AS k, label FROM segs WHERE k > 0),
both_sides AS (SELECT case_id, coalesce(g.label, 0) AS g, coalesce(p.label, 0) AS p FROM segs g FULL JOIN pred p USING (case_id, i, j, k)),
conf AS (SELECT case_id, c::INT AS cls, count(*) FILTER (WHERE g = c AND p = c) AS tp, count(*) FILTER (WHERE p = c AND g <> c) AS fp,
   count(*) FILTER (WHERE g = c AND p <> c) AS fn FROM both_sides, range(1, 4) r(c) GROUP BY 1, 2 HAVING tp + fp + fn > 0)"""


def prediction(spark, sf):
    return segs(spark, sf).filter("k > 0").withColumn("k", F.col("k") - 1)


def confusion(spark, sf):
    return E.segmentation_confusion(segs(spark, sf), prediction(spark, sf))


@query("segmentation_confusion", with_grid("SELECT * FROM conf", PRED))
def _(spark, sf):
    return confusion(spark, sf)


SCORES = ("dice", "iou", "sensitivity", "precision")
SQL_SCORES = {"dice": "2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0)", "iou": "tp::DOUBLE / nullif(tp + fp + fn, 0)",
              "sensitivity": "tp::DOUBLE / nullif(tp + fn, 0)", "precision": "tp::DOUBLE / nullif(tp + fp, 0)"}


@query("segmentation_scores", with_grid(
    "SELECT case_id, cls, " + ", ".join(f"{q6(e)} AS {n}" for n, e in SQL_SCORES.items()) + " FROM conf", PRED))
def _(spark, sf):
    return rounded(E.segmentation_scores(confusion(spark, sf)), *SCORES)


@query("class_score_summary", with_grid(
    "SELECT cls, " + ", ".join(f"{q6(f'avg({e})')} AS {n}, {q6(f'stddev_pop({e})')} AS {n}_std" for n, e in SQL_SCORES.items())
    + " FROM conf GROUP BY 1", PRED))
def _(spark, sf):
    out = E.class_score_summary(E.segmentation_scores(confusion(spark, sf)))
    return rounded(out, *[n + s for n in SCORES for s in ("", "_std")])


@query("ensemble_average", with_grid(f"""
SELECT case_id, i, j, k, cls::INT AS label, {q6('p')} AS score FROM (
  SELECT case_id, i, j, k, c AS cls, avg({udraw('f', 'c', 'case_id', 'i', 'j', 'k')}) AS p
  FROM segs, range(5) a(f), range(4) b(c) GROUP BY 1, 2, 3, 4, 5)
QUALIFY row_number() OVER (PARTITION BY case_id, i, j, k ORDER BY p DESC, cls) = 1"""))
def _(spark, sf):
    def upto(n):
        return F.explode(F.array(*[F.lit(x) for x in range(n)]))

    probs = segs(spark, sf).drop("label").select("*", upto(5).alias("fold")).select("*", upto(4).alias("cls"))
    probs = probs.withColumn("p", draw(*[F.col(c) for c in ("fold", "cls", "case_id", "i", "j", "k")]))
    return rounded(E.ensemble_average(probs), "score")
