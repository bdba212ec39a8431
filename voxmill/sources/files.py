"""Reading and writing: dataset metadata, manifests, voxel tables, preprocessed sets, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.operators.manifest import manifest_of
from voxmill.operators.spread import attach

_STRINGS = T.MapType(T.StringType(), T.StringType())
META_SCHEMA = T.StructType([
    T.StructField("channel_names", _STRINGS), T.StructField("modality", _STRINGS),
    T.StructField("labels", _STRINGS), T.StructField("file_ending", T.StringType())])

VOXEL_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("channel", T.IntegerType()),
    *[T.StructField(a, T.IntegerType()) for a in "ijk"], T.StructField("value", T.FloatType())])

_DOUBLES, _INTS = T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())
PROPERTIES_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("original_spacing", _DOUBLES), T.StructField("original_shape", _INTS),
    T.StructField("origin", _DOUBLES), T.StructField("direction", _DOUBLES),
    T.StructField("transpose_forward", _INTS), T.StructField("transpose_backward", _INTS),
    T.StructField("spacing_after_transpose", _DOUBLES),
    T.StructField("shape_before_crop", _INTS), T.StructField("shape_after_crop", _INTS),
    T.StructField("crop_bbox", T.ArrayType(T.StructType([
        T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))),
    T.StructField("resampled_spacing", _DOUBLES), T.StructField("resampled_shape", _INTS),
    T.StructField("configuration", T.StringType()),
    T.StructField("normalization_params", T.ArrayType(T.StructType([
        T.StructField("channel", T.IntegerType()), T.StructField("scheme", T.StringType()),
        T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType()),
        T.StructField("lower_clip", T.DoubleType()), T.StructField("upper_clip", T.DoubleType()),
        T.StructField("use_mask", T.BooleanType())])))])


def checked_meta(meta: DataFrame) -> DataFrame:
    """``modality`` stands in for ``channel_names``; rows lacking a required key fail."""
    rest = [c for c in meta.columns if c not in META_SCHEMA.names]
    names = F.coalesce("channel_names", "modality")
    return meta.select(
        *rest,
        F.when(names.isNull(), F.raise_error(F.lit("dataset.json must contain 'channel_names'"))).otherwise(names).alias("channel_names"),
        F.when(F.col("labels").isNull(), F.raise_error(F.lit("dataset.json must contain 'labels'"))).otherwise(F.col("labels")).alias("labels"),
        "file_ending")


def read_dataset_meta(spark: SparkSession, path: str) -> DataFrame:
    """dataset.json files (one object each, may span lines); ``path`` may be a glob."""
    raw = spark.read.schema(META_SCHEMA).option("multiLine", True).json(path)
    return checked_meta(raw.select(F.col("_metadata.file_path").alias("path"), "*"))


def parse_dataset_meta(df: DataFrame, text: str) -> DataFrame:
    """The same from a column of JSON text."""
    return checked_meta(df.withColumn("_m", F.from_json(text, META_SCHEMA)).select(
        *[c for c in df.columns if c != text], "_m.*"))


def scan_manifest(spark: SparkSession, root: str, pattern: str = "*.nii.gz", check: bool = True) -> DataFrame:
    """manifest(path, split, kind, case_id, channel) of the files below ``root``.

    Only paths are asked for, so no file is opened."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(root).select("path"))
    manifest = manifest_of(files)
    if check and manifest.isEmpty():
        raise FileNotFoundError(f"no images found below {root}")
    return manifest


def laid_out(table: DataFrame, *prefix: str) -> DataFrame:
    """Rows in the order that compresses best and prunes row groups by case.

    Ranges split a large case as well, so no task writes a whole one."""
    order = [c for c in (*prefix, "case_id", "channel", "cls", "i", "j", "k") if c in table.columns]
    return table.repartitionByRange(*order).sortWithinPartitions(*order)


def read_voxels(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_voxels(voxels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    laid_out(voxels).write.mode(mode).parquet(path)


#: Buckets of a table that is read case by case; at least as many as cases, if each is to be read once.
BUCKETS = 4096


def case_bucket(case_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(case_id), F.lit(buckets)).cast("int")


def write_bucketed(table: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """A voxel table in folders bucket=n by a hash of the case, so that some cases can be read without the others.

    Folders that no case falls into do not exist, so many buckets cost nothing while there are few cases.
    """
    laid_out(table.withColumn("bucket", case_bucket(F.col("case_id"), buckets)), "bucket") \
        .write.mode(mode).partitionBy("bucket").parquet(path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table that :func:`write_bucketed` wrote. Spark lists folders by a task each, of which most would be the start of the task;
    here each core lists a few runs of them."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    kept = spark.conf.get(name)
    spark.conf.set(name, str(min(int(kept), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(name, kept)


def rows_of_cases(table: DataFrame, cases: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of these cases. Of a table that :func:`write_bucketed` wrote, only the cases' own folders are read:
    their numbers, at most ``buckets``, are a filter on the folders."""
    ids = cases.select("case_id").distinct()
    if "bucket" in table.columns:
        numbers = [r[0] for r in ids.select(case_bucket(F.col("case_id"), buckets)).distinct().collect()]
        table = table.filter(F.col("bucket").isin(numbers) if numbers else F.lit(False)).drop("bucket")
    return attach(table, ids, ["case_id"], "left_semi")


def write_preprocessed(table: DataFrame, root: str, mode: str = "append") -> None:
    """One set for all configurations that share it: folders data_identifier=, split=."""
    laid_out(table, "data_identifier", "split").write.mode(mode).partitionBy("data_identifier", "split").parquet(root)


def read_preprocessed(spark: SparkSession, root: str, data_identifier: str | None = None,
                      split: str | None = None) -> DataFrame:
    table = spark.read.parquet(root)
    for name, wanted in (("data_identifier", data_identifier), ("split", split)):
        if wanted is not None:
            table = table.filter(F.col(name) == wanted)
    return table


def write_properties(properties: DataFrame, path: str, mode: str = "append") -> None:
    """Case metadata; sampled locations are long and have their own table."""
    columns = [F.col(f.name).cast(f.dataType) for f in PROPERTIES_SCHEMA.fields if f.name in properties.columns]
    properties.select(*[c.alias(n) for c, n in zip(columns, [f.name for f in PROPERTIES_SCHEMA.fields if f.name in properties.columns])]) \
        .write.mode(mode).parquet(path)


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROPERTIES_SCHEMA).parquet(path)


def write_json_artifact(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Fingerprints, plans, splits or summaries as JSON lines, one object per row."""
    df.write.mode(mode).json(path)


def copy_gt_if_absent(source: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of cases that the target does not have yet; to be appended to it."""
    known = present.select("case_id").distinct().withColumn("_known", F.lit(True))
    return attach(source, known, ["case_id"], "left").filter("_known IS NULL").drop("_known")
