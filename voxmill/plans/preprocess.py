"""Preprocessing a dataset for one configuration, and taking it back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.columns import permute
from voxmill.operators.fingerprint import sample_locations
from voxmill.operators.morphology import fill_holes, signed_distance
from voxmill.operators.normalize import apply_normalization, channel_plan, denormalize, normalization_params
from voxmill.operators.resample import resample, resample_auto, resample_labels
from voxmill.operators.spread import attach
from voxmill.operators.voxel import (
    binarize, box_shape, crop_to_bbox, inverse_permutation, mark_outside, nonzero_bbox, nonzero_mask,
    transpose_axes, uncrop)
from voxmill.plans.configure import new_shape, select_target_spacing
from voxmill.session import settle


@dataclass
class Configuration:
    """What preprocessing takes from a plan; axes are in transposed order."""

    name: str
    spacing: Sequence[float]
    data_identifier: str = "plans"
    transpose_forward: Sequence[int] = (0, 1, 2)
    through_plane_spacing: float | None = None
    schemes: Sequence[str] = ("ZScoreNormalization",)
    use_mask: Sequence[bool] = (False,)
    labels: Sequence[int] = ()
    data_order: int = 3
    data_order_z: int = 0
    extra: dict = field(default_factory=dict)


def case_geometry(cases: DataFrame, bbox: DataFrame, config: Configuration) -> DataFrame:
    """Per case: transposed spacing, box, shapes before and after, and what to resample to."""
    order = F.array(*[F.lit(a) for a in config.transpose_forward])
    table = cases.join(bbox, "case_id").select(
        "case_id", F.col("spacing").alias("original_spacing"), F.col("shape").alias("original_shape"),
        permute(F.col("spacing"), order).alias("spacing_t"), permute(F.col("shape"), order).alias("shape_before_crop"),
        "lo", "hi", box_shape(F.col("lo"), F.col("hi")).alias("shape_after_crop"),
        F.array(*[F.lit(float(s)) for s in config.spacing]).alias("spacing"),
        F.lit(config.through_plane_spacing).cast("double").alias("through_plane_spacing"))
    table = select_target_spacing(table)
    return table.withColumn("resampled_shape", new_shape(F.col("shape_after_crop"), F.col("spacing_t"), F.col("target")))


def transposed_cases(cases: DataFrame, forward: Sequence[int]) -> DataFrame:
    order = F.array(*[F.lit(a) for a in forward])
    return cases.select("case_id", permute(F.col("shape"), order).alias("shape"), permute(F.col("spacing"), order).alias("spacing"))


def crop_stage(voxels: DataFrame, segs: DataFrame | None, cases: DataFrame, config: Configuration,
               holes: bool = True) -> dict[str, DataFrame]:
    """Transposed and cropped image and label (-1 outside the body), and the case geometry.

    ``holes=False`` skips the filling of holes when the body mask is known to have none.
    Tables that later stages read more than once are written here.
    """
    forward = list(config.transpose_forward)
    turned = transpose_axes(voxels, forward)
    turned_cases = transposed_cases(cases, forward)
    bbox = settle(nonzero_bbox(turned, turned_cases))
    mask = nonzero_mask(turned)
    if holes:
        mask = fill_holes(settle(mask), turned_cases)
    marked = mark_outside(None if segs is None else transpose_axes(segs, forward), mask)
    return {"image": crop_to_bbox(turned, bbox), "label": settle(crop_to_bbox(marked, bbox)),
            "geometry": settle(case_geometry(cases, bbox, config))}


def _resampling(geometry: DataFrame) -> DataFrame:
    return geometry.select("case_id", F.col("shape_after_crop").alias("old_shape"), F.col("resampled_shape").alias("new_shape"),
                           F.col("spacing_t").alias("spacing"), "target")


def image_stage(cropped: dict[str, DataFrame], config: Configuration, stats: DataFrame | None = None) -> dict[str, DataFrame]:
    """Normalised (before resampling), then resampled image, with the parameters used."""
    image, label = settle(cropped["image"]), cropped["label"]
    plan = channel_plan(image.select("channel").distinct(), F.array(*[F.lit(s) for s in config.schemes]),
                        F.array(*[F.lit(m) for m in config.use_mask]))
    params = settle(normalization_params(image, settle(plan), stats, label))
    image = settle(apply_normalization(image, params, label))
    return {"image": resample_auto(image, _resampling(cropped["geometry"]), config.data_order, config.data_order_z),
            "params": params}


def label_stage(cropped: dict[str, DataFrame], config: Configuration, binary: bool = False,
                labelled: bool = True) -> dict[str, DataFrame]:
    """Resampled label, signed distances and sampled locations.

    With ``binary`` distances follow the merged label, locations the original ones."""
    geometry = cropped["geometry"]
    label = settle(resample_labels(cropped["label"], _resampling(geometry)))
    foreground = [x for x in config.labels if x != 0]
    out = {}
    if labelled and foreground:
        out["locations"] = sample_locations(label, foreground)
        target = geometry.select("case_id", F.col("resampled_shape").alias("shape"), F.col("target").alias("spacing"))
        out["distance"] = signed_distance(binarize(label) if binary else label, [1] if binary else foreground, target)
    out["label"] = binarize(label) if binary and labelled else label
    return out


def preprocess(voxels: DataFrame, segs: DataFrame | None, cases: DataFrame, config: Configuration,
               stats: DataFrame | None = None, binary: bool = False, holes: bool = True) -> dict[str, DataFrame]:
    """Transpose, crop, normalise, resample, distances, locations.

    Returns image, label, distance, locations, params, geometry and properties."""
    cropped = crop_stage(voxels, segs, cases, config, holes)
    out = {"geometry": cropped["geometry"], **image_stage(cropped, config, stats),
           **label_stage(cropped, config, binary, segs is not None)}
    out["properties"] = case_properties(out["geometry"], out["params"], config)
    return out


def case_properties(geometry: DataFrame, params: DataFrame, config: Configuration) -> DataFrame:
    """What is needed to go back; channels per case are few."""
    per_channel = params.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(
        "channel", "scheme", "mean", "std", "lower_clip", "upper_clip", "use_mask"))).alias("normalization_params"))
    forward = list(config.transpose_forward)
    return geometry.join(per_channel, "case_id").select(
        F.col("case_id"), "original_spacing", "original_shape",
        F.array(*[F.lit(a) for a in forward]).alias("transpose_forward"),
        F.array(*[F.lit(a) for a in inverse_permutation(forward)]).alias("transpose_backward"),
        F.col("spacing_t").alias("spacing_after_transpose"), "shape_before_crop", "shape_after_crop",
        F.zip_with("lo", "hi", lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))).alias("crop_bbox"),
        F.col("target").alias("resampled_spacing"), "resampled_shape", F.lit(config.name).alias("configuration"),
        "normalization_params")


def revert(table: DataFrame, properties: DataFrame, value: str = "value", order: int = 3) -> DataFrame:
    """Resample to the cropped shape in one step, put the crop back, undo the transpose and,
    for images, the normalisation. Labels: ``value="label", order=0``."""
    shapes = properties.select("case_id", F.col("resampled_shape").alias("old_shape"), F.col("shape_after_crop").alias("new_shape"))
    cropped = settle(resample(table, shapes, order, value))
    boxes = properties.select("case_id", F.transform("crop_bbox", lambda b: b["lo"]).alias("lo"),
                              F.transform("crop_bbox", lambda b: b["hi"]).alias("hi"))
    full = uncrop(cropped, boxes, properties.select("case_id", F.col("shape_before_crop").alias("shape")), value)
    backward = properties.select("case_id", F.col("transpose_backward").alias("_back"))
    turned = transpose_axes(attach(full, backward, ["case_id"]).select(*full.columns, "_back"), "_back").drop("_back")
    if "channel" not in table.columns:
        return turned
    params = properties.select("case_id", F.inline("normalization_params"))
    return denormalize(turned, params)


def revert_labels(segs: DataFrame, properties: DataFrame) -> DataFrame:
    return revert(segs, properties, "label", 0)
