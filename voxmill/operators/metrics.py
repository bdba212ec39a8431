"""Segmentation scores, fold aggregation and ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.columns import VOXEL

# fixed values: summary keys and their short names
FOREGROUND_KEYS = {
    "foreground_mean_dice": "dice", "foreground_mean_iou": "iou",
    "foreground_mean_sensitivity": "sensitivity", "foreground_mean_precision": "precision",
    "foreground_mean_hd95": "hd95", "foreground_mean_surface_dice": "surface_dice",
}
CLASS_KEYS = {
    "Dice": "dice", "Dice_std": "dice_std", "IoU": "iou", "IoU_std": "iou_std",
    "Sensitivity": "sensitivity", "Sensitivity_std": "sensitivity_std",
    "Precision": "precision", "Precision_std": "precision_std",
    "HD95": "hd95", "SurfaceDice": "surface_dice", "SurfaceDice_std": "surface_dice_std",
}
ALWAYS = ("dice", "iou", "sensitivity", "precision")
OPTIONAL = {"hd95": float("inf"), "surface_dice": float("nan")}


def project_metrics(summaries: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rename known keys of the map column ``metrics``; unknown ones are dropped."""
    short = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    kept = F.map_filter("metrics", lambda k, _: F.array_contains(F.array(*[F.lit(k) for k in keys]), k))
    return summaries.withColumn("metrics", F.transform_keys(kept, lambda k, _: F.element_at(short, k)))


def long_metrics(summaries: DataFrame) -> DataFrame:
    rest = [c for c in summaries.columns if c != "metrics"]
    return summaries.select(*rest, F.explode("metrics").alias("metric", "value"))


def class_key_union(fold_metrics: DataFrame) -> DataFrame:
    return fold_metrics.filter("cls IS NOT NULL").select("cls").distinct().orderBy(F.col("cls").cast("int"))


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def _summaries(values: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and sample std of the finite values; all values, by fold, in ``per_fold``."""
    good = F.when(_finite(F.col("value")), F.col("value"))
    return values.groupBy(*keys).agg(
        F.coalesce(F.avg(good), F.lit(float("nan"))).alias("mean"),
        F.when(F.count(good) > 1, F.stddev_samp(good)).otherwise(F.lit(0.0)).alias("std"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("fold").isNotNull(), F.struct("fold", "value")))),
                    lambda x: x["value"]).alias("per_fold"))


def cross_validation_summary(fold_metrics: DataFrame) -> DataFrame:
    """(run_id, cls, metric) with mean, std and per_fold; cls is null for the foreground.

    Foreground: every fold counts; a missing metric is NaN, a missing hd95 infinite, and
    hd95 and surface_dice appear only if some fold has them. Per class: folds without
    the class are left out.
    """
    run = ["run_id"]
    folds = fold_metrics.select("run_id", "fold").distinct()
    fore = fold_metrics.filter("cls IS NULL").select("run_id", "fold", "metric", "value")
    names = F.array(*[F.lit(m) for m in ALWAYS])
    default = F.create_map(*[F.lit(x) for m in ALWAYS for x in (m, float("nan"))],
                           *[F.lit(x) for pair in OPTIONAL.items() for x in pair])
    optional = fore.filter(F.col("metric").isin(*OPTIONAL)).select("run_id", "metric").distinct()
    wanted = folds.select("run_id", "fold", F.explode(names).alias("metric")).unionByName(
        folds.join(optional, run).select("run_id", "fold", "metric"))
    filled = wanted.join(fore, ["run_id", "fold", "metric"], "left").withColumn(
        "value", F.coalesce("value", F.element_at(default, F.col("metric"))))
    foreground = _summaries(filled, ["run_id", "metric"]).withColumn("cls", F.lit(None).cast("string"))

    per = fold_metrics.filter("cls IS NOT NULL").select("run_id", "cls", "fold", "metric", "value")
    has_class = per.select("run_id", "cls", "fold").distinct()
    plain = has_class.select("run_id", "cls").distinct().select("run_id", "cls", F.explode(names).alias("metric")) \
        .join(per, ["run_id", "cls", "metric"], "left")
    extra = has_class.join(per.filter(F.col("metric").isin(*OPTIONAL)).select("run_id", "cls", "metric").distinct(),
                           ["run_id", "cls"])
    extra = extra.join(per, ["run_id", "cls", "fold", "metric"], "left").withColumn(
        "value", F.coalesce("value", F.element_at(default, F.col("metric"))))
    classes = _summaries(plain.unionByName(extra.select(*plain.columns)), ["run_id", "cls", "metric"])
    return foreground.select(*classes.columns).unionByName(classes)


def fold_score_summary(scores: DataFrame) -> DataFrame:
    """Mean and sample std of the best scores, for runs with more than one fold."""
    return (scores.groupBy("run_id").agg(F.count("score").alias("n"), F.avg("score").alias("mean"),
                                         F.stddev_samp("score").alias("std"))
            .filter("n > 1").drop("n"))


def segmentation_confusion(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(case_id, cls, tp, fp, fn); a voxel absent on one side counts as background.

    Voxels are first counted by label pair, so only small tables are expanded."""
    pairs = (gt.select(*VOXEL, F.col("label").alias("g")).join(
        pred.select(*VOXEL, F.col("label").alias("p")), list(VOXEL), "full")
        .groupBy("case_id", F.coalesce("g", F.lit(0)).cast("int").alias("g"), F.coalesce("p", F.lit(0)).cast("int").alias("p"))
        .agg(F.count(F.lit(1)).alias("n")))
    zero = F.lit(0).cast("bigint")

    def entry(cls, tp, fp, fn):
        return F.struct(cls.alias("cls"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    n, g, p = F.col("n"), F.col("g"), F.col("p")
    roles = F.when(g == p, F.array(entry(g, n, zero, zero))).otherwise(
        F.array(entry(p, zero, n, zero), entry(g, zero, zero, n)))
    return (pairs.select("case_id", F.inline(roles)).filter("cls > 0").groupBy("case_id", "cls")
            .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


def segmentation_scores(confusion: DataFrame) -> DataFrame:
    """Dice, IoU, sensitivity and precision per case and class; null when undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion.select(
        "case_id", "cls", F.try_divide(2 * tp, 2 * tp + fp + fn).alias("dice"),
        F.try_divide(tp, tp + fp + fn).alias("iou"), F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tp, tp + fp).alias("precision"))


def class_score_summary(scores: DataFrame) -> DataFrame:
    """Per class mean and population std over the cases."""
    names = [c for c in scores.columns if c not in ("case_id", "cls")]
    return scores.groupBy("cls").agg(*[f(n).alias(n + s) for n in names
                                       for f, s in ((F.avg, ""), (F.stddev_pop, "_std"))])


def ensemble_average(fold_probs: DataFrame) -> DataFrame:
    """Mean score per class over the folds, and the class with the highest (lowest of ties)."""
    mean = fold_probs.groupBy(*VOXEL, "cls").agg(F.avg("p").alias("p"))
    best = F.max_by(F.col("cls"), F.struct("p", -F.col("cls")))
    return mean.groupBy(*VOXEL).agg(best.alias("label"), F.max("p").alias("score"))
