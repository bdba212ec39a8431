"""Dataset statistics: intensities, class shares, geometry, and seeded sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.columns import AXES, VOXEL, draw_index, inside_box, per_axis
from voxmill.operators.spread import (
    attach, exact_percentiles, numbered, percentiles_of_counts, rank_by_hash, value_counts)
from voxmill.operators.voxel import crop_ratio, nonzero_bbox
from voxmill.session import settle

# fixed values: percentiles of the intensity summary, voxel budget of a dataset
INTENSITY_PERCENTILES = {"percentile_00_5": 0.005, "median": 0.5, "percentile_99_5": 0.995}
VOXEL_BUDGET = 10 ** 8
MIN_LOCATIONS = 10000
LOCATION_SHARE = 0.01


def foreground(voxels: DataFrame, segs: DataFrame | None = None) -> DataFrame:
    """Voxels with a positive label, or without labels those where any channel is not 0."""
    if segs is None:
        # a voxel's few channels meet once
        rest = [c for c in voxels.columns if c not in VOXEL]
        whole = voxels.groupBy(*VOXEL).agg(F.max(F.col("value") != 0).alias("_any"), F.collect_list(F.struct(*rest)).alias("_rows"))
        return whole.filter("_any").select(*VOXEL, F.inline("_rows")).select(*voxels.columns)
    marked = segs.filter(F.col("label") > 0).select(*VOXEL)
    # labels fill a small part of a volume: voxels beyond their box need not be shuffled
    box = marked.groupBy("case_id").agg(F.array(*[F.min(a) for a in AXES]).alias("_lo"),
                                        F.array(*[F.max(a) + 1 for a in AXES]).alias("_hi"))
    near = attach(voxels, box, ["case_id"]).filter(inside_box(F.col("_lo"), F.col("_hi"))).select(*voxels.columns)
    return near.join(marked, list(VOXEL), "left_semi")


def stats_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population std, min, max and percentiles of weighted values (keys, v, n)."""
    base = counts.groupBy(*keys).agg(
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.sum("n").alias("n_voxels"))
    centred = attach(counts, base.select(*keys, "mean"), keys)
    off = F.col("v") - F.col("mean")
    spread = centred.groupBy(*keys).agg(F.sqrt(F.sum(off * off * F.col("n")) / F.sum("n")).alias("std"))
    return base.join(spread, keys).join(percentiles_of_counts(counts, keys, INTENSITY_PERCENTILES), keys)


def foreground_intensity_stats(voxels: DataFrame, segs: DataFrame | None = None,
                               keys: tuple[str, ...] = ("channel",), approx: bool = False) -> DataFrame:
    """Per channel mean, population std, median, min, max, p0.5 and p99.5 of the foreground.

    Exact by default: equal values collapse into counts before anything is shuffled.
    ``approx=True`` reads the percentiles from mergeable sketches instead (:func:`sketch_partial`).
    """
    keys = list(keys)
    chosen = foreground(voxels, segs)
    if approx:
        return stats_of_sketches(sketches(chosen, keys), keys)
    return stats_of_counts(settle(value_counts(chosen, keys, "value")), keys)


def labels_in_box(segs: DataFrame, bbox: DataFrame) -> DataFrame:
    joined = attach(segs, bbox.select("case_id", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), ["case_id"])
    return joined.filter(inside_box(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def class_shares(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each label from (keys, label, n)."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    return (counts.join(total, keys)
            .select(*keys, "label", "n", (F.col("n") / F.col("_total")).alias("ratio")))


def label_class_ratios(segs: DataFrame, bbox: DataFrame, cases: DataFrame) -> DataFrame:
    """Per dataset the share of each label inside the image-only box."""
    per_case = labels_in_box(segs, bbox).groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"))
    counts = (per_case.join(cases.select("case_id", "dataset_id"), "case_id")
              .groupBy("dataset_id", "label").agg(F.sum("n").alias("n")))
    return class_shares(counts, ["dataset_id"])


def label_inventory(segs: DataFrame, cases: DataFrame) -> DataFrame:
    """Labels that occur anywhere in the full volumes, per dataset, and how many."""
    seen = segs.select("case_id", "label").distinct().join(cases.select("case_id", "dataset_id"), "case_id") \
        .select("dataset_id", "label").distinct()
    return seen.groupBy("dataset_id").agg(
        F.sort_array(F.collect_set("label")).alias("labels"), F.count(F.lit(1)).alias("num_classes"))


def channel_moments(voxels: DataFrame, segs: DataFrame | None = None, use_mask: bool = False) -> DataFrame:
    """Per case and channel mean and population std; with ``use_mask`` over label >= 0.

    Both are null when the mask is empty."""
    value = F.col("value")
    table = voxels
    if use_mask and segs is not None:
        table = voxels.join(segs.select(*VOXEL, "label"), list(VOXEL), "left")
        value = F.when(F.col("label") >= 0, value)
    return table.groupBy("case_id", "channel").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def volume_range(voxels: DataFrame, keys: tuple[str, ...] = ("case_id", "channel")) -> DataFrame:
    return voxels.groupBy(*keys).agg(F.min("value").alias("min"), F.max("value").alias("max"))


def cropped_geometry(voxels: DataFrame, segs: DataFrame | None, cases: DataFrame) -> DataFrame:
    """cases with shape_after_crop and crop_ratio (box over image and, if there are any, labels)."""
    return cases.join(crop_ratio(nonzero_bbox(voxels, cases, segs), cases), "case_id")


def geometry_summary(geometry: DataFrame) -> DataFrame:
    """Per dataset: median and 10th-percentile spacing, median cropped size and ratio.

    One row per case goes in. Percentiles come from counts of equal values, so a dataset
    may have any number of cases.
    """
    def value(what: str, column: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), column.cast("double").alias("value"))

    values = F.array(*[value(f"spacing{a}", F.col("spacing")[a]) for a in range(3)],
                     *[value(f"size{a}", F.col("shape_after_crop")[a]) for a in range(3)],
                     *([value("ratio", F.col("crop_ratio"))] if "crop_ratio" in geometry.columns else []))
    long = geometry.select("dataset_id", F.inline(values))
    found = exact_percentiles(long, ["dataset_id", "what"], "value", {"p50": 0.5, "p10": 0.1})

    def of(what: str, p: str) -> Column:
        return F.max(F.when(F.col("what") == what, F.col(p)))

    wide = found.groupBy("dataset_id").agg(
        per_axis(lambda a: of(f"spacing{a}", "p50")).alias("median_spacing"),
        per_axis(lambda a: of(f"spacing{a}", "p10")).alias("p10_spacing"),
        per_axis(lambda a: of(f"size{a}", "p50")).alias("median_size_after_crop"),
        F.coalesce(of("ratio", "p50"), F.lit(1.0)).alias("median_crop_ratio"))
    return geometry.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("num_cases")).join(wide, "dataset_id", "left")


# --- sketches of intensities that merge in any order ------------------------------------

#: Size of a sketch. The rank of a percentile read from it is off by less than RANK_ERROR of all values with 99 % probability.
SKETCH_K = 800
RANK_ERROR = 0.006


def sketches(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, m2, min, max, sketch): what partial tables keep of the values, a few kilobytes for any number of them."""
    v = F.col("value").cast("double")
    return values.filter("value IS NOT NULL").groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.kll_sketch_agg_double(v, SKETCH_K).alias("sketch"))


def sketch_partial(voxels: DataFrame, segs: DataFrame | None, cases: DataFrame) -> DataFrame:
    """Sketches of the foreground of some cases by dataset and channel, to be merged with those of others."""
    return sketches(attach(foreground(voxels, segs), cases.select("case_id", "dataset_id"), ["case_id"]), ["dataset_id", "channel"])


def merge_sketches(partials: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of partial tables in any order and grouping; a merge of merges is a merge."""
    total = partials.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_mean"))
    off = F.col("mean") - F.col("_mean")
    # partial tables have a row per batch and key: attach keeps a key's many batches apart
    return attach(partials, total, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))


def stats_of_sketches(merged: DataFrame, keys: list[str]) -> DataFrame:
    """The statistics of :func:`stats_of_counts` from one sketch per key; percentiles are values that occur."""
    read = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in INTENSITY_PERCENTILES.items()]
    return merged.select(*keys, "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"), "min", "max", F.col("n").alias("n_voxels"), *read)


def ranks_of(counts: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, <name>_ok): whether each percentile's rank among all values, given as counts, is within RANK_ERROR."""
    n = F.sum("n")
    met = attach(counts, stats.select(*keys, *INTENSITY_PERCENTILES), keys).groupBy(*keys).agg(*[
        ((F.sum(F.when(F.col("v") < F.col(name), F.col("n")).otherwise(0)) / n <= p + RANK_ERROR)
         & (F.sum(F.when(F.col("v") <= F.col(name), F.col("n")).otherwise(0)) / n >= p - RANK_ERROR)).alias(f"{name}_ok")
        for name, p in INTENSITY_PERCENTILES.items()])
    return met


# --- partial results that merge in any order -------------------------------------

def statistics_partial(voxels: DataFrame, segs: DataFrame | None, cases: DataFrame) -> DataFrame:
    """Mergeable statistics of some cases: (dataset_id, kind, id, v, n).

    ``intensity``: count of each foreground value per channel; ``label``: voxels per
    label inside the image box; ``seen``: voxels per label in the full volume;
    ``case``: number of cases. Merging adds counts, so nothing is lost and the order
    of arrival does not matter. Without labels the foreground is where any channel is not
    0, and there are no rows of the two label kinds.
    """
    dataset = cases.select("case_id", "dataset_id")
    box = nonzero_bbox(voxels, cases)

    def rows(kind: str, table: DataFrame, id_col: Column, v: Column) -> DataFrame:
        return table.groupBy("dataset_id", F.lit(kind).alias("kind"), id_col.cast("int").alias("id"),
                             v.cast("double").alias("v")).agg(F.sum("n").alias("n"))

    per_value = attach(foreground(voxels, segs), dataset, ["case_id"]).withColumn("n", F.lit(1).cast("bigint"))
    nothing = F.lit(None)
    always = (rows("intensity", per_value, F.col("channel"), F.col("value"))
              .unionByName(rows("case", dataset.withColumn("n", F.lit(1).cast("bigint")), F.lit(0), nothing)))
    if segs is None:
        return always
    per_case = segs.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n")).join(dataset, "case_id")
    boxed = labels_in_box(segs, box).groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n")) \
        .join(dataset, "case_id")
    return (always.unionByName(rows("label", boxed, F.col("label"), nothing))
            .unionByName(rows("seen", per_case, F.col("label"), nothing)))


def merge_statistics(*partials: DataFrame) -> DataFrame:
    merged = partials[0]
    for p in partials[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy("dataset_id", "kind", "id", "v").agg(F.sum("n").alias("n"))


def partial_intensity_stats(partial: DataFrame) -> DataFrame:
    counts = partial.filter("kind = 'intensity'").select("dataset_id", F.col("id").alias("channel"), "v", "n")
    return stats_of_counts(settle(counts), ["dataset_id", "channel"])


def partial_class_ratios(partial: DataFrame) -> DataFrame:
    counts = partial.filter("kind = 'label'").select("dataset_id", F.col("id").alias("label"), "n")
    return class_shares(counts, ["dataset_id"])


def dataset_fingerprint(voxels: DataFrame, segs: DataFrame | None, cases: DataFrame) -> DataFrame:
    """One row per dataset; without labels, classes and their ratios are null. Per-case spacings and shapes stay in their own table
    (:func:`cropped_geometry`), which may be as long as there are cases."""
    partial = settle(statistics_partial(voxels, segs, cases))
    intensity = partial_intensity_stats(partial)
    fields = ["mean", "std", "median", "min", "max", "percentile_00_5", "percentile_99_5"]
    per_channel = intensity.groupBy("dataset_id").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("channel", F.struct(*fields).alias("stats"))))).alias("intensity_per_channel"))
    ratios = partial_class_ratios(partial).groupBy("dataset_id").agg(F.map_from_entries(F.sort_array(
        F.collect_list(F.struct("label", "ratio")))).alias("label_class_ratios"))
    classes = partial.filter("kind = 'seen'").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("num_classes"))
    return (geometry_summary(cropped_geometry(voxels, segs, cases))
            .join(classes, "dataset_id", "left").join(per_channel, "dataset_id", "left")
            .join(ratios, "dataset_id", "left"))


# --- sampling ----------------------------------------------------------------------

def case_budget(cases: DataFrame) -> DataFrame:
    """Voxels to draw per case and channel so that a dataset stays within its budget."""
    n = cases.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    return cases.join(n, "dataset_id").select(
        "case_id", F.greatest(F.lit(1), F.floor(F.lit(VOXEL_BUDGET) / F.col("_n"))).alias("budget"))


def sample_with_replacement(table: DataFrame, keys: tuple[str, ...], ids: tuple[str, ...], n, seed: int) -> DataFrame:
    """min(n, size) rows per group, drawn with replacement; ``t`` numbers the draws.

    A draw picks a hashed rank, so the rows need no driver and no common order.
    """
    keys = list(keys)
    ranked = rank_by_hash(table, keys, list(ids), seed)
    sizes = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.withColumn("_m", F.least(F.lit(n).cast("bigint"), F.col("_size")))
    draws = numbered(sizes, "_m", "t").withColumn(
        "rank", draw_index(F.col("_size"), F.lit(seed), *[F.col(c) for c in keys], F.col("t")))
    return draws.select(*keys, "t", "rank").join(ranked.drop("total"), [*keys, "rank"]).drop("rank")


def sample_labels(segs: DataFrame, bbox: DataFrame, n, seed: int) -> DataFrame:
    return sample_with_replacement(labels_in_box(segs, bbox), ("case_id",), ("i", "j", "k"), n, seed)


def sample_locations(segs: DataFrame, labels: list[int], seed: int = 1234,
                     min_num: int = MIN_LOCATIONS, share: float = LOCATION_SHARE) -> DataFrame:
    """Per case and label, min(size, max(min_num, ceil(share*size))) distinct voxels."""
    ranked = rank_by_hash(segs.filter(F.col("label").isin(labels)), ["case_id", "label"], ["i", "j", "k"], seed)
    target = F.least(F.col("total"), F.greatest(F.lit(min_num).cast("bigint"), F.ceil(F.col("total") * F.lit(share))))
    return ranked.filter(F.col("rank") < target).select("case_id", "label", "i", "j", "k", "rank")


def location_counts(cases: DataFrame, labels: list[int], locations: DataFrame) -> DataFrame:
    """Sampled voxels per case and label; labels that are absent count 0."""
    counts = locations.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("_n"))
    wanted = cases.select("case_id", F.explode(F.array(*[F.lit(x).cast("tinyint") for x in labels])).alias("label"))
    return wanted.join(counts, ["case_id", "label"], "left") \
        .select("case_id", "label", F.coalesce("_n", F.lit(0).cast("bigint")).alias("n"))
