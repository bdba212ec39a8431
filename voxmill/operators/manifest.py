"""File manifests: naming rules, channel grouping, pairing with labels, split roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators.spread import attach

# fixed values: naming patterns, split folders, modality limit, channel names of known sources
ENDING = r"\.nii\.gz$"
CASE_CHANNEL = r"^(.+)_(\d{4})$"
SPLIT_FOLDERS = {"train": ("imagesTr", "labelsTr"), "val": ("imagesVal", "labelsVal"),
                 "test": ("imagesTs", "labelsTs")}
LAST_CT_NUMBER = 500
MODALITIES = ("t1n", "t1c", "t2f", "t2w")
CHANNEL_CATALOGUE = (
    ("ct", 0, "CT"), ("mri", 0, "MRI"), ("all", 0, "CT_or_MRI"),
    ("spleen", 0, "CT"), ("liver", 0, "CT"), ("pancreas", 0, "CT"), ("hepaticVessel", 0, "CT"),
    ("heart", 0, "MRI"), ("hippocampus", 0, "MRI"), ("lung", 0, "CT"), ("colon", 0, "CT"),
)
LABEL_CATALOGUE = (
    ("spleen", 0, "background"), ("spleen", 1, "spleen"),
    ("liver", 0, "background"), ("liver", 1, "liver"), ("liver", 2, "cancer"),
    ("pancreas", 0, "background"), ("pancreas", 1, "pancreas"), ("pancreas", 2, "cancer"),
    ("hepaticVessel", 0, "background"), ("hepaticVessel", 1, "Vessel"), ("hepaticVessel", 2, "Tumour"),
    ("heart", 0, "background"), ("heart", 1, "left atrium"),
    ("hippocampus", 0, "background"), ("hippocampus", 1, "Anterior"), ("hippocampus", 2, "Posterior"),
    ("lung", 0, "background"), ("lung", 1, "cancer"),
    ("colon", 0, "background"), ("colon", 1, "colon cancer primaries"),
    ("kidney", 0, "background"), ("kidney", 1, "kidney"), ("kidney", 2, "tumor"), ("kidney", 3, "cyst"),
    ("abdomen", 0, "background"), ("abdomen", 1, "spleen"), ("abdomen", 2, "right kidney"),
    ("abdomen", 3, "left kidney"), ("abdomen", 4, "gallbladder"), ("abdomen", 5, "esophagus"),
    ("abdomen", 6, "liver"), ("abdomen", 7, "stomach"), ("abdomen", 8, "aorta"),
    ("abdomen", 9, "inferior vena cava"), ("abdomen", 10, "pancreas"), ("abdomen", 11, "right adrenal gland"),
    ("abdomen", 12, "left adrenal gland"), ("abdomen", 13, "duodenum"), ("abdomen", 14, "bladder"),
    ("abdomen", 15, "prostate/uterus"),
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_name(path: Column) -> Column:
    return F.get(F.reverse(F.split(path, "/")), F.lit(1))


def visible_files(files: DataFrame) -> DataFrame:
    """Image files by name, without hidden ones."""
    name = file_name(F.col("path"))
    return files.filter(name.rlike(ENDING) & ~name.startswith("."))


def parse_case_channel(files: DataFrame) -> DataFrame:
    """case_id and channel from ``{case}_{4 digits}``; without the suffix channel 0."""
    stem = F.regexp_replace(file_name(F.col("path")), ENDING, "")
    numbered = stem.rlike(CASE_CHANNEL)
    return files.withColumns({
        "case_id": F.when(numbered, F.regexp_extract(stem, CASE_CHANNEL, 1)).otherwise(stem),
        "channel": F.when(numbered, F.regexp_extract(stem, CASE_CHANNEL, 2).cast("int")).otherwise(F.lit(0))})


def manifest_of(files: DataFrame) -> DataFrame:
    """manifest(path, split, kind, case_id, channel) from paths below a dataset folder."""
    folder = folder_name(F.col("path"))
    split, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (images, labels) in SPLIT_FOLDERS.items():
        split = F.when(folder.isin(images, labels), name).otherwise(split)
        kind = F.when(folder == images, "image").when(folder == labels, "label").otherwise(kind)
    return parse_case_channel(visible_files(files)).select(
        "path", split.alias("split"), kind.alias("kind"), "case_id", "channel").filter(F.col("split").isNotNull())


def split_manifest(manifest: DataFrame, split: str) -> DataFrame:
    """Images of a split with their label path, null where there is none.

    A folder that is absent gives no rows."""
    if split not in SPLIT_FOLDERS:
        raise ValueError(f"unknown split {split!r}")
    chosen = manifest.filter(F.col("split") == split)
    labels = chosen.filter("kind = 'label'").groupBy("case_id").agg(F.max("path").alias("label_path"))
    return attach(chosen.filter("kind = 'image'").select("case_id", "channel", "path"), labels, ["case_id"], "left")


def group_cases(manifest: DataFrame, n_channels: int, on_mismatch: str = "raise") -> DataFrame:
    """Paths per case in channel order.

    A case with another number of channels is an error, or is left out with
    ``on_mismatch="drop"``; :func:`channel_mismatches` lists these. Counted first: a case with far
    too many files is never gathered."""
    if on_mismatch not in ("raise", "drop"):
        raise ValueError(f"unknown on_mismatch {on_mismatch!r}")
    if on_mismatch == "raise":
        raise_if_any(channel_mismatches(manifest, n_channels), "case_id", f"cases without {n_channels} channels")
    counts = manifest.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    good = counts.filter(F.col("_n") == n_channels).select("case_id")
    return (attach(manifest, good, ["case_id"]).groupBy("case_id")
            .agg(F.sort_array(F.collect_list(F.struct("channel", "path"))).alias("_files"))
            .select("case_id", F.transform("_files", lambda f: f["path"]).alias("paths")))


def channel_mismatches(manifest: DataFrame, n_channels: int) -> DataFrame:
    return manifest.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_channels")) \
        .filter(F.col("n_channels") != n_channels)


def report_first(bad: DataFrame, order: str, n: int = 5) -> DataFrame:
    """One row: how many offenders, the first few by name, and how many more."""
    first = bad.select(order).orderBy(order).limit(n).agg(
        F.array_join(F.sort_array(F.collect_list(order)), ", "))
    return bad.agg(F.count(F.lit(1)).alias("n_bad")).select(
        "n_bad", first.scalar().alias("first"), F.greatest(F.col("n_bad") - n, F.lit(0)).alias("more"))


def raise_if_any(bad: DataFrame, order: str, message: str, n: int = 5) -> None:
    """Fail with the first offenders and the number of the others."""
    row = report_first(bad, order, n).first()
    if row["n_bad"]:
        raise RuntimeError(f"{message}: {row['first']}" + (f" (+{row['more']} more)" if row["more"] else ""))


def match_labels(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Each case with its label path, null when missing."""
    return cases.select("case_id").distinct().join(
        labels.groupBy("case_id").agg(F.max("path").alias("label_path")), "case_id", "left")


def missing_labels(cases: DataFrame, labels: DataFrame) -> DataFrame:
    return cases.select("case_id").distinct().join(labels.select("case_id").distinct(), "case_id", "left_anti")


def surplus_labels(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: numbers of cases and labels, and whether there are more labels."""
    sides = cases.select(F.lit("c").alias("side"), "case_id").unionByName(
        labels.select(F.lit("l").alias("side"), "case_id")).distinct()
    counts = sides.agg(F.count_if(F.col("side") == "c").alias("n_cases"), F.count_if(F.col("side") == "l").alias("n_labels"))
    return counts.withColumn("more_labels", F.col("n_labels") > F.col("n_cases"))


def pair_existing(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images whose case also has a label. Nothing comes from the labels, so they are neither counted nor repeated."""
    return images.join(labels.select("case_id"), "case_id", "left_semi")


def unpaired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases present on one side only, and which side is missing."""
    a = images.select("case_id").distinct().withColumn("has_image", F.lit(True))
    b = labels.select("case_id").distinct().withColumn("has_label", F.lit(True))
    return a.join(b, "case_id", "full").filter("has_image is null or has_label is null").select(
        "case_id", F.when(F.col("has_image").isNull(), "image").otherwise("label").alias("missing"))


def common_cases(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("case_id").intersect(b.select("case_id"))


def pair_arrays_with_properties(arrays: DataFrame, properties: DataFrame, case_id=None) -> DataFrame:
    """Arrays joined to their metadata; optionally one case only."""
    chosen = arrays if case_id is None else arrays.filter(F.col("case_id") == case_id)
    return attach(chosen, properties, ["case_id"])


def arrays_without_properties(arrays: DataFrame, properties: DataFrame) -> DataFrame:
    return arrays.select("case_id").distinct().join(properties.select("case_id").distinct(), "case_id", "left_anti")


def normalize_labels(datasets: DataFrame) -> DataFrame:
    """labels map in either orientation to (dataset_id, label_id, name)."""
    entry = datasets.select("dataset_id", F.explode("labels").alias("key", "val"))
    as_id = F.expr("try_cast(trim(key) AS INT)")
    return entry.select("dataset_id", F.coalesce(as_id, F.expr("try_cast(trim(val) AS INT)")).alias("label_id"),
                        F.when(as_id.isNull(), F.col("key")).otherwise(F.col("val")).alias("name"))


def foreground_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("label_id") != 0)


def modality_filter(manifest: DataFrame, modality: str = "all") -> DataFrame:
    """Cases numbered up to 500 are CT, the others MRI."""
    number = F.element_at(F.split("case_id", "_"), -1).cast("bigint")
    if modality == "ct":
        return manifest.filter(number <= LAST_CT_NUMBER)
    if modality == "mri":
        return manifest.filter(number > LAST_CT_NUMBER)
    return manifest


def parse_modality_suffix(files: DataFrame) -> DataFrame:
    """modality (or ``seg``) from the last ``-`` part of the file name, case id from its
    folder without the trailing ``-NNN``; the split folder is the one above."""
    stem = F.regexp_replace(file_name(F.col("path")), ENDING, "")
    parts = F.reverse(F.split("path", "/"))
    return files.withColumns({
        "modality": F.lower(F.substring_index(stem, "-", -1)),
        "case_dir": F.get(parts, F.lit(1)),
        "split_dir": F.get(parts, F.lit(2)),
        "case_id": F.regexp_replace(F.get(parts, F.lit(1)), "-[^-]*$", "")})


def _looked_up(sources: DataFrame, known: DataFrame, unknown: str) -> DataFrame:
    """Join a catalogue, which is a constant of a few rows; a source it lacks is an error unless dropped."""
    if unknown not in ("raise", "drop"):
        raise ValueError(f"unknown choice {unknown!r}")
    if unknown == "drop":
        return sources.join(F.broadcast(known), "source")
    found = sources.join(F.broadcast(known.withColumn("_known", F.lit(True))), "source", "left")
    checked = F.when(F.col("_known"), F.col("source")).otherwise(
        F.raise_error(F.concat(F.lit("source is not in the catalogue: "), F.coalesce("source", F.lit("null")))))
    return found.withColumn("source", checked).drop("_known")


def catalogue_channels(sources: DataFrame, unknown: str = "raise") -> DataFrame:
    """Channel names of sources; ``unknown="drop"`` leaves out sources that have none."""
    known = sources.sparkSession.createDataFrame(CHANNEL_CATALOGUE, "source string, channel int, channel_name string")
    return _looked_up(sources, known, unknown)


def catalogue_labels(sources: DataFrame, unknown: str = "raise") -> DataFrame:
    """Label names of sources; ``unknown="drop"`` leaves out sources that have none."""
    known = sources.sparkSession.createDataFrame(LABEL_CATALOGUE, "source string, label_id int, name string")
    return _looked_up(sources, known, unknown)


def split_role_inference(files: DataFrame) -> DataFrame:
    """A folder is for training if its first case (lowest name) has a segmentation."""
    per_case = files.groupBy("split_dir", "case_dir").agg(F.max(F.col("modality") == "seg").alias("has_seg"))
    return per_case.groupBy("split_dir").agg(F.min_by("has_seg", "case_dir").alias("_seg")) \
        .select("split_dir", F.when(F.col("_seg"), "train").otherwise("test").alias("role"))


def _case_modalities(files: DataFrame, modalities: tuple[str, ...]) -> DataFrame:
    wanted = files.filter(F.col("modality").isin(*modalities, "seg"))
    have = wanted.groupBy("case_id").agg(F.collect_set("modality").alias("_have"))
    every = files.select("case_id").distinct().join(have, "case_id", "left")
    order = F.array(*[F.lit(m) for m in modalities])
    none = F.array().cast("array<string>")
    return every.select("case_id", F.array_except(order, F.coalesce("_have", none)).alias("missing"),
                        F.array_contains(F.coalesce("_have", none), "seg").alias("has_seg"))


def require_complete_cases(files: DataFrame, modalities: tuple[str, ...] = MODALITIES,
                           need_seg: bool = False) -> DataFrame:
    """(case_id, channel, path) of cases that have every modality, channel = its position."""
    checked = _case_modalities(files, modalities).filter(F.size("missing") == 0)
    if need_seg:
        checked = checked.filter("has_seg")
    order = F.array(*[F.lit(m) for m in modalities])
    latest = files.filter(F.col("modality").isin(*modalities)).groupBy("case_id", "modality") \
        .agg(F.max("path").alias("path"))
    return latest.join(checked.select("case_id"), "case_id").select(
        "case_id", (F.array_position(order, F.col("modality")) - 1).cast("int").alias("channel"), "path")


def incomplete_cases(files: DataFrame, modalities: tuple[str, ...] = MODALITIES, need_seg: bool = False) -> DataFrame:
    """Cases that are left out, with what they lack."""
    checked = _case_modalities(files, modalities)
    lacks_seg = ~F.col("has_seg") if need_seg else F.lit(False)
    return checked.filter((F.size("missing") > 0) | lacks_seg).select(
        "case_id", F.when(F.size("missing") > 0, F.array_join("missing", ",")).otherwise("seg").alias("missing"))


def merge_validation(train: DataFrame, val: DataFrame, test: DataFrame, merge: bool) -> DataFrame:
    """Validation cases join the training cases, or else the test cases."""
    return (train.select("case_id", F.lit("train").alias("split"))
            .unionByName(val.select("case_id", F.lit("train" if merge else "test").alias("split")))
            .unionByName(test.select("case_id", F.lit("test").alias("split"))))
