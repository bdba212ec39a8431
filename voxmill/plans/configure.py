"""Planning: from dataset statistics to preprocessing configurations.

Every function takes one row per dataset (or configuration) and adds columns, so a
million datasets are planned like one; arrays hold one entry per spatial axis.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.columns import array_median, as_col, bound, half_even, permute, product
from voxmill.operators.fingerprint import geometry_summary
from voxmill.operators.spread import dealt

# fixed values: rules of the planner
ANISO_THRESHOLD = 3.0
NONZERO_MASK_THRESHOLD = 0.75
LOWRES_THRESHOLD = 0.25
SPACING_STEP = 1.03
CHANNEL_SCHEMES = {
    "ct": "CTNormalization", "CT": "CTNormalization",
    "nonorm": "NoNormalization", "noNorm": "NoNormalization", "NoNorm": "NoNormalization",
    "none": "NoNormalization", "None": "NoNormalization",
}
DEFAULT_SCHEME = "ZScoreNormalization"
PATCH_REF_3D, PATCH_REF_2D = 256, 2048
SIZE_VARIANTS = (("_s", 96, 1024), ("_l", 176, 2880))
SPACING_STRATEGIES = ("voxel_budget", "max_target", "median_target")
SCALE_RANGE = (0.85, 1.25)


def worst_axis(spacing: Column) -> Column:
    """0-based position of the largest spacing, the first of ties."""
    return (F.array_position(spacing, F.array_max(spacing)) - 1).cast("int")


def _others(values: Column, axis: Column) -> Column:
    return F.filter(values, lambda _, a: a != axis)


def target_spacing(geometry: DataFrame) -> DataFrame:
    """Per dataset the median spacing, with its coarsest axis refined when both spacing
    and size say that the axis is under-sampled; also the median size after cropping."""
    medians = geometry_summary(geometry).select(
        "dataset_id", F.col("median_spacing").alias("_sp"), F.col("p10_spacing").alias("_p10"),
        F.col("median_size_after_crop").alias("median_size"))
    axis = worst_axis(F.col("_sp"))
    coarse = F.array_max("_sp") > ANISO_THRESHOLD * F.array_max(_others(F.col("_sp"), F.col("_axis")))
    few = F.get("median_size", F.col("_axis")) * ANISO_THRESHOLD \
        < F.array_min(_others(F.col("median_size"), F.col("_axis")))
    floor_spacing = F.array_max(_others(F.col("_sp"), F.col("_axis"))) + 1e-5
    refined = F.transform("_sp", lambda s, a: F.when(
        F.col("is_anisotropic") & (a == F.col("_axis")),
        F.greatest(F.get("_p10", F.col("_axis")), floor_spacing)).otherwise(s))
    return (medians.withColumn("_axis", axis).withColumn("is_anisotropic", coarse & few)
            .select("dataset_id", refined.alias("target_spacing"), "is_anisotropic",
                    F.when(F.col("is_anisotropic"), F.col("_axis")).alias("anisotropic_axis"), "median_size"))


def transpose_plan(df: DataFrame, spacing: str = "target_spacing") -> DataFrame:
    """Coarsest axis first, the others in order; ``transpose_backward`` undoes it."""
    worst = worst_axis(F.col(spacing))
    axes = F.sequence(F.lit(0), F.size(spacing) - 1)
    forward = F.concat(F.array(worst), F.filter(axes, lambda a: a != worst))
    backward = F.transform(axes, lambda a: (F.array_position(F.col("transpose_forward"), a) - 1).cast("int"))
    return df.withColumn("transpose_forward", forward).withColumn("transpose_backward", backward)


def iso_spacing(spacing: Column, strategy: str = "voxel_budget") -> Column:
    """One spacing for all axes: geometric mean, maximum or median of the target."""
    if strategy == "voxel_budget":
        return F.pow(product(spacing), F.lit(1.0) / F.size(spacing))
    if strategy == "max_target":
        return F.array_max(spacing)
    if strategy == "median_target":
        return array_median(spacing)
    raise ValueError(f"unknown spacing strategy {strategy!r}; expected one of {SPACING_STRATEGIES}")


def scheme_of(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CHANNEL_SCHEMES.items() for x in pair])
    return F.coalesce(F.element_at(known, name), F.lit(DEFAULT_SCHEME))


def normalization_plan(channels: DataFrame) -> DataFrame:
    """channels(dataset_id, channel, name, median_crop_ratio) with scheme and mask use.

    Only z-scored channels use the mask, and only where cropping removed enough."""
    scheme = scheme_of(F.col("name"))
    return channels.withColumn("scheme", scheme).withColumn(
        "use_mask", (F.col("scheme") == DEFAULT_SCHEME) & (F.col("median_crop_ratio") < NONZERO_MASK_THRESHOLD))


def new_shape(shape: Column, old: Column, new: Column) -> Column:
    """Shape after a change of spacing, rounded half to even."""
    return F.transform(F.arrays_zip(shape.alias("n"), old.alias("o"), new.alias("t")),
                       lambda x: half_even(x["n"].cast("double") * x["o"] / x["t"]))


def initial_patch(spacing: Column, median: Column, ref: Column | int, override: Column | None = None) -> Column:
    """Patch with the aspect ratio of the voxels and the volume ref**n, at most the median size."""
    inverse = F.transform(spacing, lambda s: 1.0 / s)
    n = F.size(spacing)
    scale = F.pow(F.pow(as_col(ref).cast("double"), n) / product(inverse), F.lit(1.0) / n)
    capped = bound(scale, lambda by: F.zip_with(spacing, median, lambda s, m: F.least(half_even(1.0 / s * by), m.cast("int"))))
    return capped if override is None else F.coalesce(override, capped)


def pad_to_multiple(shape: Column, divisor: Column | int) -> Column:
    if isinstance(divisor, int):
        return F.transform(shape, lambda s: (F.ceil(s / divisor) * divisor).cast("int"))
    return F.zip_with(shape, divisor, lambda s, d: (F.ceil(s / d) * d).cast("int"))


def lowres_plan(median: Column, spacing: Column, patch: Column) -> Column:
    """struct(spacing, median): spacing grows by 3 % until the patch covers a quarter of the volume.
    Null when the patch covers that much from the start.

    After k steps an axis of m voxels has between m/1.03^k - 1/2 and m/1.03^k + 1/2, so the step that ends the
    search lies between two numbers in closed form; only the steps between them, a few unless an axis is
    very short, are tried one by one.
    """
    n, patch_volume, volume = F.size(spacing), product(patch), product(median)
    share = F.pow(4.0 * patch_volume / volume, 1.0 / n)
    half = 0.5 / F.array_min(median)

    def steps_to(scale: Column) -> Column:
        return -F.log(scale) / math.log(SPACING_STEP)

    # rounding at most doubles an axis (or makes it 0, which ends the search), so this many always do
    most = F.ceil(F.log(F.pow(F.lit(2.0), n) * volume / (4.0 * patch_volume)) / (n * math.log(SPACING_STEP))) + 3
    # the margin is far above what repeated multiplication rounds away
    since = F.greatest(F.lit(0), F.ceil(steps_to(share + half) - 1e-6))
    until = F.least(most, F.when(share > half, F.ceil(steps_to(share - half) + 1e-6)))
    none, tries = F.lit(0), (F.greatest(until - since, F.lit(0)) + 1).cast("int")
    begin = bound(F.array_repeat(none, since.cast("int")), lambda skipped: F.transform(
        spacing, lambda s: F.aggregate(skipped, s, lambda x, _: x * SPACING_STEP)))

    def step(state: Column, _) -> Column:
        shape = F.zip_with(state["length"], state["spacing"], lambda size, s: F.rint(size / s))
        wider = F.transform(state["spacing"], lambda s: s * SPACING_STEP)
        # an empty volume ends the search too
        return F.when(state["done"], state) \
            .when(product(shape) * LOWRES_THRESHOLD <= state["enough"], _state(state["length"], state["spacing"], state["enough"], True)) \
            .otherwise(_state(state["length"], wider, state["enough"], False))

    length = F.zip_with(median, spacing, lambda m, s: m.cast("double") * s)
    found = F.aggregate(F.array_repeat(none, tries), _state(length, begin, patch_volume, False), step, lambda state: F.struct(
        state["spacing"].alias("spacing"),
        F.zip_with(state["length"], state["spacing"], lambda size, s: half_even(size / s)).alias("median")))
    needed = (volume > 0) & (patch_volume / volume < LOWRES_THRESHOLD)
    return F.when(needed, found)


def _state(length: Column, spacing: Column, enough: Column, done: bool) -> Column:
    return F.struct(length.alias("length"), spacing.alias("spacing"), enough.alias("enough"), F.lit(done).alias("done"))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that a costly expression is evaluated once per
    row and not again in every place that reads it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def lowres_spacing(df: DataFrame) -> DataFrame:
    """Rows (median, spacing, patch) that need a coarser grid, with ``low_spacing``, ``low_median``."""
    ready = pinned(dealt(df), _m=F.col("median"), _s=F.col("spacing"), _p=F.col("patch"))
    return pinned(ready, _low=lowres_plan(F.col("_m"), F.col("_s"), F.col("_p"))).filter("_low is not null").select(
        *df.columns, F.col("_low.spacing").alias("low_spacing"), F.col("_low.median").alias("low_median"))


def configurations(plan: DataFrame, divisor: int = 1, batch_size: int = 2, strategy: str = "voxel_budget",
                   plans_name: str = "plans", size_variants: bool = False,
                   ref_3d: int = PATCH_REF_3D, ref_2d: int = PATCH_REF_2D,
                   patch_override: list[int] | None = None,
                   variants: tuple = SIZE_VARIANTS) -> DataFrame:
    """One row per dataset and configuration from (dataset_id, target_spacing, median_size).

    ``divisor`` stands for what the network asks of a patch; any override of the patch
    is padded to it as well.
    """
    def patch(spacing: Column, median: Column, d3: Column, d2: Column) -> Column:
        wanted = None if patch_override is None else F.array(*[F.lit(x) for x in patch_override])
        flat = F.size(spacing) == 2
        if wanted is not None:
            wanted = F.when(flat, F.slice(wanted, -2, 2)).otherwise(wanted)
        return pad_to_multiple(initial_patch(spacing, median, F.when(flat, d2).otherwise(d3), wanted), divisor)

    base = transpose_plan(dealt(plan.select("dataset_id", "target_spacing", "median_size")))
    base = base.withColumn("sp", permute(F.col("target_spacing"), F.col("transpose_forward"))) \
        .withColumn("med", F.transform(permute(F.col("median_size"), F.col("transpose_forward")), half_even))
    edge = iso_spacing(F.col("sp"), strategy)
    base = base.withColumn("iso", bound(edge, lambda e: F.transform("sp", lambda _: e)))
    base = base.withColumn("iso_med", new_shape(F.col("med"), F.col("sp"), F.col("iso")))
    three, two = F.lit(ref_3d), F.lit(ref_2d)
    base = pinned(base.select("dataset_id", "transpose_forward", "transpose_backward", "sp", "med", F.col("iso").alias("_iso"),
                              F.col("iso_med").alias("_iso_med")), iso=F.col("_iso"), iso_med=F.col("_iso_med"))
    base = pinned(base, full_patch=patch(F.col("sp"), F.col("med"), three, two), iso_patch=patch(F.col("iso"), F.col("iso_med"), three, two))
    base = pinned(base, low=lowres_plan(F.col("med"), F.col("sp"), F.col("full_patch")),
                  iso_low=lowres_plan(F.col("iso_med"), F.col("iso"), F.col("iso_patch")))

    def tail(c: str) -> Column:
        return F.slice(F.col(c), 2, 2)

    none = F.lit(None).cast("double")
    thick = F.get("sp", F.lit(0))
    rows = [("3d_fullres", F.col("sp"), F.col("med"), none, F.lit(True)),
            ("2d", tail("sp"), tail("med"), thick, F.lit(True)),
            ("3d_fullres_iso", F.col("iso"), F.col("iso_med"), none, F.lit(True)),
            ("2d_iso", tail("iso"), tail("iso_med"), thick, F.lit(True)),
            ("3d_lowres", F.col("low.spacing"), F.col("low.median"), none, F.col("low").isNotNull()),
            ("3d_lowres_iso", F.col("iso_low.spacing"), F.col("iso_low.median"), none, F.col("iso_low").isNotNull())]
    listed = F.array(*[F.struct(F.lit(name).alias("base"), s.alias("spacing"), m.alias("median_image_size"),
                                t.alias("through_plane_spacing"), w.alias("wanted")) for name, s, m, t, w in rows])
    out = base.select("dataset_id", "transpose_forward", "transpose_backward", F.inline(listed)).filter("wanted")
    sizes = [("", ref_3d, ref_2d), *(variants if size_variants else ())]
    tags = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(a).alias("r3"), F.lit(b).alias("r2")) for t, a, b in sizes])
    out = out.select("*", F.inline(tags))
    return out.select(
        "dataset_id", F.concat("base", "tag").alias("config"),
        F.concat(F.lit(f"{plans_name}_"), "base").alias("data_identifier"), "spacing",
        patch(F.col("spacing"), F.col("median_image_size"), F.col("r3"), F.col("r2")).alias("patch_size"),
        F.lit(divisor).alias("shape_must_be_divisible_by"), F.lit(batch_size).alias("batch_size"),
        "median_image_size", "through_plane_spacing", "transpose_forward", "transpose_backward",
        F.lit(3).alias("data_order"), F.lit(0).alias("data_order_z"), F.lit(1).alias("seg_order"),
        F.lit(0).alias("seg_order_z"), F.lit(ANISO_THRESHOLD).alias("aniso_threshold"))


def augmentation_geometry(configs: DataFrame) -> DataFrame:
    """Rotation limit, dummy-2D flag, mirror axes and the larger patch to cut, per patch_size."""
    patch = F.col("patch_size")
    flat_patch = F.size(patch) == 2
    long_side = F.array_max(patch)
    dummy = ~flat_patch & (long_side / F.get(patch, F.lit(0)) > ANISO_THRESHOLD)
    degrees = F.when(flat_patch, F.when(long_side / F.array_min(patch) > 1.5, 15.0).otherwise(180.0)) \
        .otherwise(F.when(dummy, 180.0).otherwise(30.0))
    out = configs.withColumn("dummy_2d", dummy).withColumn("rotation", degrees / 360.0 * 2 * math.pi)
    out = pinned(out, _sin=F.abs(F.sin("rotation")), _cos=F.abs(F.cos("rotation")), _long=F.array_max(patch),
                 _next=F.try_element_at(F.sort_array(patch), F.lit(-2)), _at=F.array_position(patch, F.array_max(patch)) - 1)

    def enlarged(size: Column, axis: Column) -> Column:
        # the longest other axis reaches furthest
        other = F.when(axis == F.col("_at"), F.col("_next")).otherwise(F.col("_long"))
        widest = F.col("_sin") * other + F.col("_cos") * size
        grown = F.ceil(F.greatest(size.cast("double"), widest) / SCALE_RANGE[0]).cast("int")
        return F.when(F.col("dummy_2d") & (axis == 0), size.cast("int")).otherwise(grown)

    axes = F.sequence(F.lit(0), F.size(patch) - 1)
    return out.withColumn("mirror_axes", axes).withColumn("initial_patch_size", F.transform(patch, enlarged)) \
        .drop("_sin", "_cos", "_long", "_next", "_at")


def select_target_spacing(cases: DataFrame) -> DataFrame:
    """Spacing to resample a case to: 2-D configurations keep the case's own first axis.

    Takes (spacing_t, spacing, through_plane_spacing) with spacing_t transposed."""
    own = F.concat(F.slice("spacing_t", 1, 1), F.col("spacing"))
    return cases.withColumn("target", F.when(F.col("through_plane_spacing").isNotNull(), own).otherwise(F.col("spacing")))


def plan_datasets(geometry: DataFrame, channels: DataFrame, **options) -> DataFrame:
    """Configurations of every dataset with the scheme and mask flag of each channel.

    geometry: one row per case (dataset_id, spacing, shape_after_crop, crop_ratio);
    channels(dataset_id, channel, name). ``options`` go to :func:`configurations`.
    """
    ratio = geometry_summary(geometry).select("dataset_id", "median_crop_ratio")
    schemes = normalization_plan(channels.join(ratio, "dataset_id")).groupBy("dataset_id").agg(
        F.sort_array(F.collect_list(F.struct("channel", "scheme", "use_mask"))).alias("_c")).select(
        "dataset_id", F.transform("_c", lambda c: c["scheme"]).alias("normalization_schemes"),
        F.transform("_c", lambda c: c["use_mask"]).alias("use_mask_for_norm"))
    return configurations(target_spacing(geometry), **options).join(schemes, "dataset_id")
