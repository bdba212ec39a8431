"""Experiment registry: ``runs(run_id, grp, folds_intended, depends_on)`` and
``run_folds(run_id, fold, status, dice, best_ema_dice)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: markers of the listing
MARKERS = {"done": "✓", "failed": "✗", "running": "►"}
OTHER_MARKER = "·"


def flatten_runs(groups: DataFrame) -> DataFrame:
    """groups(grp, runs array of structs) to one row per run, tagged with its group."""
    return groups.select("grp", F.inline("runs"))


def fold_statuses(runs: DataFrame, run_folds: DataFrame) -> DataFrame:
    """Status of every intended fold; ``planned`` where nothing is recorded."""
    intended = runs.select("run_id", F.explode("folds_intended").alias("fold"))
    return intended.join(run_folds.select("run_id", "fold", "status"), ["run_id", "fold"], "left") \
        .select("run_id", "fold", F.coalesce("status", F.lit("planned")).alias("status"))


def experiment_status(runs: DataFrame, run_folds: DataFrame) -> DataFrame:
    """done if all folds are, partial if some are, else running, failed or planned."""
    def some(s: str):
        return F.bool_or(F.col("status") == s)

    per_run = fold_statuses(runs, run_folds).groupBy("run_id").agg(
        F.when(F.bool_and(F.col("status") == "done"), "done").when(some("done"), "partial")
        .when(some("running"), "running").when(some("failed"), "failed").otherwise("planned").alias("_status"))
    # a run without intended folds has nothing left to do
    return runs.select("run_id").join(per_run, "run_id", "left") \
        .select("run_id", F.coalesce("_status", F.lit("done")).alias("status"))


def status_counts(status: DataFrame) -> DataFrame:
    """Runs per status, and their total in the row named ``total``."""
    return status.rollup("status").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.coalesce("status", F.lit("total")).alias("status"), "n")


def mean_dice(runs: DataFrame, run_folds: DataFrame) -> DataFrame:
    """Mean over intended folds that are done and have a value, 4 decimals."""
    intended = runs.select("run_id", F.explode("folds_intended").alias("fold"))
    done = intended.join(run_folds.filter("status = 'done' AND dice IS NOT NULL"), ["run_id", "fold"])
    return done.groupBy("run_id").agg(F.bround(F.avg("dice"), 4).alias("mean_dice"))


def recorded_mean_dice(results: DataFrame) -> DataFrame:
    """Mean over all recorded folds, 6 decimals; null when none has a value."""
    return results.groupBy("run_id").agg(F.bround(F.avg("dice"), 6).alias("mean_dice"))


def next_fold(runs: DataFrame, run_folds: DataFrame) -> DataFrame:
    """Lowest fold that is planned or can be resumed."""
    return fold_statuses(runs, run_folds).filter(F.col("status").isin("planned", "running", "failed")) \
        .groupBy("run_id").agg(F.min("fold").alias("next_fold"))


def blocking_dependencies(runs: DataFrame, run_folds: DataFrame) -> DataFrame:
    """Dependencies that are not done, or not found at all, with the reason."""
    status = experiment_status(runs, run_folds)
    wanted = runs.select("run_id", F.explode("depends_on").alias("dependency"))
    found = wanted.join(status.select(F.col("run_id").alias("dependency"), F.col("status").alias("_s")),
                        "dependency", "left")
    why = F.when(F.col("_s").isNull(), "NOT FOUND").otherwise(F.concat(F.lit("status: "), F.col("_s")))
    return found.filter("_s IS NULL OR _s <> 'done'").select("run_id", "dependency", why.alias("reason"))


def blocked_runs(runs: DataFrame, run_folds: DataFrame) -> DataFrame:
    """Planned runs and what blocks each."""
    planned = experiment_status(runs, run_folds).filter("status = 'planned'")
    return blocking_dependencies(runs, run_folds).join(planned, "run_id", "left_semi")


def resumable_runs(runs: DataFrame, run_folds: DataFrame) -> DataFrame:
    """Partial or running runs with the folds that remain, in fold order."""
    open_runs = experiment_status(runs, run_folds).filter(F.col("status").isin("partial", "running"))
    left = fold_statuses(runs, run_folds).filter("status <> 'done'").groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("fold", "status"))).alias("remaining"))
    text = F.array_join(F.transform("remaining", lambda f: F.concat(
        F.lit("fold "), f["fold"].cast("string"), F.lit("="), f["status"])), ", ")
    return open_runs.join(left, "run_id").select(
        "run_id", "status", (F.col("status") == "running").alias("interrupted"), text.alias("remaining"))


def ready_runs(runs: DataFrame, run_folds: DataFrame) -> DataFrame:
    """Planned, partial or running runs without blockers, and the fold to run next."""
    startable = experiment_status(runs, run_folds).filter(F.col("status").isin("planned", "partial", "running"))
    return (startable.join(blocking_dependencies(runs, run_folds), "run_id", "left_anti")
            .join(next_fold(runs, run_folds), "run_id")
            .select("run_id", "status", (F.col("status") == "running").alias("resume"), "next_fold"))


def folds_to_validate(runs: DataFrame, run_folds: DataFrame, fold: int | None = None) -> DataFrame:
    """Folds that are done, or one fold wherever it is intended."""
    if fold is not None:
        return runs.filter(F.array_contains("folds_intended", fold)).select("run_id", F.lit(fold).alias("fold"))
    return fold_statuses(runs, run_folds).filter("status = 'done'").select("run_id", "fold")


def sorted_listing(runs: DataFrame, run_folds: DataFrame, group: str | None = None) -> DataFrame:
    """Runs by group with one marker per intended fold."""
    chosen = runs if group is None else runs.filter(F.col("grp") == group)
    marker = F.lit(OTHER_MARKER)
    for status, sign in MARKERS.items():
        marker = F.when(F.col("status") == status, sign).otherwise(marker)
    folds = fold_statuses(chosen, run_folds).select("run_id", "fold", marker.alias("mark")).groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("fold", "mark"))).alias("_marks"))
    text = F.array_join(F.transform("folds_intended", lambda f: F.concat(
        f.cast("string"), F.lit(":"), F.element_at(F.col("_marks"), f))), " ")
    return (chosen.join(experiment_status(chosen, run_folds), "run_id").join(folds, "run_id", "left")
            .join(mean_dice(chosen, run_folds), "run_id", "left")
            .select("grp", "run_id", "status", F.coalesce(text, F.lit("")).alias("folds"), "mean_dice")
            .orderBy("grp", "run_id"))


def upsert_fold_results(existing: DataFrame, new: DataFrame, metrics: tuple[str, ...] = ("dice", "hd95")) -> DataFrame:
    """Insert or replace whole folds keyed (run_id, fold).

    num_params belongs to the run and changes only when a new value is given."""
    old = existing.select("run_id", "fold", *[F.col(m).alias(f"_o_{m}") for m in metrics])
    fresh = new.select("run_id", "fold", *[F.col(m).alias(f"_n_{m}") for m in metrics], F.lit(True).alias("_new"))
    merged = old.join(fresh, ["run_id", "fold"], "full").select(
        "run_id", "fold", *[F.when(F.col("_new"), F.col(f"_n_{m}")).otherwise(F.col(f"_o_{m}")).alias(m) for m in metrics])
    params = (existing.select("run_id", F.col("num_params").alias("_old"), F.lit(None).cast("bigint").alias("_given"))
              .unionByName(new.select("run_id", F.lit(None).cast("bigint").alias("_old"),
                                      F.col("num_params").alias("_given")))
              .groupBy("run_id").agg(F.coalesce(F.max("_given"), F.max("_old")).alias("num_params")))
    return merged.join(params, "run_id")
