"""The plan of a dataset as one nested document, and what preprocessing reads back from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.operators.manifest import normalize_labels
from voxmill.plans.configure import plan_datasets
from voxmill.plans.preprocess import Configuration, preprocess
from voxmill.sources.files import write_json_artifact
from voxmill.session import settle

_STATS = ("mean", "std", "median", "min", "max", "percentile_00_5", "percentile_99_5")
#: JSON keys are text, so channels and labels are text in the document's maps.
CONFIGURATION_SCHEMA = ("data_identifier string, spacing array<double>, patch_size array<int>, shape_must_be_divisible_by int, "
                        "batch_size int, median_image_size array<int>, through_plane_spacing double, "
                        "normalization_schemes array<string>, use_mask_for_norm array<boolean>, data_order int, data_order_z int, "
                        "seg_order int, seg_order_z int, aniso_threshold double")
PLAN_SCHEMA = ("dataset_id string, dataset_name string, plans_name string, channel_names map<string,string>, labels map<string,string>, "
               "num_cases bigint, transpose_forward array<int>, transpose_backward array<int>, "
               f"foreground_intensity_per_channel map<string,struct<{', '.join(f'{s}: double' for s in _STATS)}>>, "
               "label_class_ratios map<string,double>, "
               "configurations map<string,struct<" + ", ".join(": ".join(c.split(" ")) for c in CONFIGURATION_SCHEMA.split(", ")) + ">>")


def experiment_plan(meta: DataFrame, fingerprint: DataFrame, geometry: DataFrame, plans_name: str = "plans", **options) -> DataFrame:
    """One row per dataset: metadata, statistics, axis order and all configurations by name.

    meta(dataset_id, channel_names, labels and, if there is one, dataset_name), the keys of channel_names being channel numbers;
    fingerprint: :func:`voxmill.operators.fingerprint.dataset_fingerprint`; geometry: one row per case. ``options`` go to
    :func:`voxmill.plans.configure.configurations`. A document is as long as its dataset has channels, labels and
    configurations, however many cases there are; datasets without cases have none. Without labels, class ratios are null.
    """
    channels = meta.select("dataset_id", F.explode("channel_names").alias("key", "name")) \
        .select("dataset_id", F.col("key").cast("int").alias("channel"), "name")
    fields = [f.name for f in T._parse_datatype_string(CONFIGURATION_SCHEMA).fields]
    configs = plan_datasets(geometry, channels, plans_name=plans_name, **options)
    by_name = configs.groupBy("dataset_id").agg(
        F.first("transpose_forward").alias("transpose_forward"), F.first("transpose_backward").alias("transpose_backward"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("config", F.struct(*fields).alias("value"))))).alias("configurations"))
    named = meta if "dataset_name" in meta.columns else meta.withColumn("dataset_name", F.col("dataset_id").cast("string"))
    found = (named.select("dataset_id", "dataset_name", "channel_names", "labels")
             .join(fingerprint.select("dataset_id", "num_cases", "intensity_per_channel", "label_class_ratios"), "dataset_id")
             .join(by_name, "dataset_id"))
    texts = {"foreground_intensity_per_channel": F.transform_keys("intensity_per_channel", lambda k, _: k.cast("string")),
             "label_class_ratios": F.transform_keys("label_class_ratios", lambda k, _: k.cast("string")),
             "plans_name": F.lit(plans_name)}
    schema = T._parse_datatype_string(PLAN_SCHEMA)
    return found.withColumns(texts).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_plan(plan: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per dataset."""
    write_json_artifact(plan, path, mode)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLAN_SCHEMA).json(path)


def configurations_of(plan: DataFrame) -> DataFrame:
    """One row per dataset and configuration, the document's own axis order beside it."""
    return plan.select("dataset_id", "transpose_forward", "transpose_backward", F.explode("configurations").alias("config", "c")) \
        .select("dataset_id", "config", "transpose_forward", "transpose_backward", "c.*")


def foreground_statistics(plan: DataFrame) -> DataFrame:
    """(dataset_id, channel, mean, std, ...): the statistics that normalisation takes."""
    return plan.select("dataset_id", F.explode("foreground_intensity_per_channel").alias("key", "s")) \
        .select("dataset_id", F.col("key").cast("int").alias("channel"), "s.*")


def _row(plan: DataFrame, dataset_id, what: str):
    found = plan.filter(F.col("dataset_id") == F.lit(str(dataset_id))).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} {what} of dataset {dataset_id}")
    return found[0]


def configuration_of(plan: DataFrame, dataset_id, name: str) -> Configuration:
    """The named configuration of one dataset as :func:`voxmill.plans.preprocess.preprocess` takes it.

    A configuration in two dimensions keeps each case's own first axis, so its spacing is that of the other two."""
    c = _row(configurations_of(plan).filter(F.col("config") == name), dataset_id, f"configuration {name!r}")
    labels = normalize_labels(plan.filter(F.col("dataset_id") == F.lit(str(dataset_id))))
    ids = sorted(r[0] for r in labels.filter("label_id IS NOT NULL").select("label_id").distinct().collect())
    return Configuration(
        name=name, spacing=tuple(c["spacing"]), data_identifier=c["data_identifier"], transpose_forward=tuple(c["transpose_forward"]),
        through_plane_spacing=c["through_plane_spacing"], schemes=tuple(c["normalization_schemes"]),
        use_mask=tuple(c["use_mask_for_norm"]), labels=tuple(ids), data_order=c["data_order"], data_order_z=c["data_order_z"],
        extra={k: c[k] for k in ("patch_size", "batch_size", "shape_must_be_divisible_by", "median_image_size")})


def preprocess_planned(plan: DataFrame, name: str, voxels: DataFrame, segs: DataFrame | None, cases: DataFrame,
                       holes: bool = True) -> dict[str, DataFrame]:
    """The named configuration applied to the cases of every dataset of the plan that has it.

    One chain per dataset, each over the voxels of its own cases; the results of all datasets come as one table each."""
    ids = [r[0] for r in configurations_of(plan).filter(F.col("config") == name).select("dataset_id").distinct().orderBy("dataset_id").collect()]
    if not ids:
        raise ValueError(f"no dataset has a configuration {name!r}")
    done = []
    for dataset_id in ids:
        own = settle(cases.filter(F.col("dataset_id").cast("string") == dataset_id))
        stats = foreground_statistics(plan.filter(F.col("dataset_id") == dataset_id))
        done.append(preprocess(voxels.join(own.select("case_id"), "case_id", "left_semi"),
                               None if segs is None else segs.join(own.select("case_id"), "case_id", "left_semi"),
                               own, configuration_of(plan, dataset_id, name), stats, holes=holes))
    shared = set.intersection(*(set(d) for d in done))
    return {k: reduce(DataFrame.unionByName, [d[k] for d in done]) for k in done[0] if k in shared}
