"""Intensity normalisation and its inverse, as expressions over per-channel parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.columns import VOXEL
from voxmill.operators.fingerprint import channel_moments
from voxmill.operators.spread import attach

# fixed values: smallest std, scheme names with their aliases
MIN_STD = 1e-8
SCHEMES = {"CT": "CT", "CTNormalization": "CT", "ZScore": "ZScore", "ZScoreNormalization": "ZScore",
           "None": "NoNormalization", "NoNormalization": "NoNormalization"}

Normalizer = Callable[[Column, dict[str, Column]], Column]


def _standardized(value: Column, p: dict[str, Column]) -> Column:
    return (value - p["mean"]) / p["std"]


_NORMALIZERS: dict[str, Normalizer] = {
    "CT": lambda v, p: _standardized(F.least(F.greatest(v, p["lower_clip"]), p["upper_clip"]), p),
    "ZScore": lambda v, p: F.when(p["outside"], F.when(p["empty"], v).otherwise(0.0)).otherwise(_standardized(v, p)),
    "NoNormalization": lambda v, p: v,
}


def register_normalizer(name: str, fn: Normalizer) -> None:
    """Add a scheme: ``fn(value, params) -> Column`` with params mean, std, lower_clip,
    upper_clip (doubles) and outside, empty (booleans)."""
    _NORMALIZERS[name] = fn
    SCHEMES[name] = name


def channel_plan(channels: DataFrame, schemes: Column, use_mask: Column) -> DataFrame:
    """Scheme and mask flag of each channel; lists that are too short repeat their last entry."""
    def pick(values: Column) -> Column:
        return F.coalesce(F.get(values, F.col("channel")), F.element_at(values, -1))

    return channels.withColumn("scheme", pick(schemes)).withColumn("use_mask", pick(use_mask))


def attach_channel_stats(voxels: DataFrame, stats: DataFrame) -> DataFrame:
    """Dataset statistics of the channel on every voxel; null for unknown channels."""
    return attach(voxels, stats, ["channel"], "left")


def canonical_scheme(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SCHEMES.items() for x in pair])
    return F.coalesce(F.element_at(known, name),
                      F.raise_error(F.concat(F.lit("unknown normalization scheme: "), name)).cast("string"))


def normalization_params(voxels: DataFrame, plan: DataFrame | tuple[str, bool], stats: DataFrame | None = None,
                         segs: DataFrame | None = None) -> DataFrame:
    """One row per case and channel with what a scheme needs, and what undoes it.

    plan(channel, scheme, use_mask), or one scheme and mask flag for all channels; stats(channel, mean, std,
    percentile_00_5, percentile_99_5). Range and moments come from one aggregation; only channels that use
    the mask are read again, with the labels.
    """
    plain = voxels.groupBy("case_id", "channel").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    if segs is not None:
        wanted = voxels if isinstance(plan, tuple) else attach(voxels, plan.filter("use_mask").select("channel"), ["channel"])
        masked = channel_moments(wanted, segs, use_mask=True)
        plain = plain.join(masked.withColumnsRenamed({"mean": "m_mean", "std": "m_std"}), ["case_id", "channel"], "left")
    else:
        plain = plain.withColumn("m_mean", F.lit(None).cast("double")).withColumn("m_std", F.lit(None).cast("double"))
    if stats is None:
        joined = plain.withColumns({f"d_{c}": F.lit(None).cast("double") for c in ("mean", "std", "lo", "hi")})
    else:
        joined = attach(plain, stats.select("channel", F.col("mean").alias("d_mean"), F.col("std").alias("d_std"),
                                            F.col("percentile_00_5").alias("d_lo"), F.col("percentile_99_5").alias("d_hi")),
                        ["channel"], "left")
    if isinstance(plan, tuple):
        joined = joined.withColumns({"scheme": canonical_scheme(F.lit(plan[0])), "use_mask": F.lit(plan[1])})
    else:
        joined = attach(joined, plan.select("channel", canonical_scheme(F.col("scheme")).alias("scheme"), "use_mask"), ["channel"])
    ct = F.col("scheme") == "CT"
    masked_z = (F.col("scheme") == "ZScore") & F.col("use_mask") & F.lit(segs is not None)
    empty = masked_z & F.col("m_mean").isNull()
    mean = F.when(ct, F.coalesce("d_mean", F.lit(0.0))).when(empty, 0.0).when(masked_z, F.col("m_mean")).otherwise(F.col("mean"))
    std = F.when(ct, F.coalesce("d_std", F.lit(1.0))).when(empty, 1.0).when(masked_z, F.col("m_std")).otherwise(F.col("std"))
    return joined.select(
        "case_id", "channel", "scheme", mean.alias("mean"),
        F.when(empty, 1.0).otherwise(F.greatest(std, F.lit(MIN_STD))).alias("std"),
        F.coalesce("d_lo", "min").alias("lower_clip"), F.coalesce("d_hi", "max").alias("upper_clip"),
        masked_z.alias("use_mask"), empty.alias("empty"))


def apply_normalization(voxels: DataFrame, params: DataFrame, segs: DataFrame | None = None) -> DataFrame:
    """Normalised voxels. Labels are joined only to channels that use the mask."""
    p = {c: F.col(c) for c in ("mean", "std", "lower_clip", "upper_clip", "empty")}
    joined = attach(voxels, params, ["case_id", "channel"])
    if segs is None:
        ready = joined.withColumn("outside", F.lit(False))
    else:
        outside = segs.filter("label < 0").select(*VOXEL, F.lit(True).alias("outside"))
        masked = joined.filter("use_mask").join(outside, list(VOXEL), "left") \
            .withColumn("outside", F.coalesce("outside", F.lit(False)))
        ready = masked.unionByName(joined.filter("NOT use_mask").withColumn("outside", F.lit(False)))
    # with an empty mask every voxel is outside and stays as it is
    p["outside"] = F.col("outside") | F.col("empty")
    value = F.col("value")
    result = F.raise_error(F.concat(F.lit("no normalizer for "), F.col("scheme"))).cast("double")
    for name, fn in _NORMALIZERS.items():
        result = F.when(F.col("scheme") == name, fn(value, p)).otherwise(result)
    return ready.select(*[c for c in voxels.columns if c != "value"], result.alias("value"))


def normalize(voxels: DataFrame, plan: DataFrame | tuple[str, bool], stats: DataFrame | None = None,
              segs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(normalised voxels, parameters); the scheme of each channel comes from the plan."""
    params = normalization_params(voxels, plan, stats, segs)
    return apply_normalization(voxels, params, segs), params


def normalize_ct(voxels: DataFrame, stats: DataFrame | None) -> DataFrame:
    """Clip to the dataset's percentiles, then standardise; without statistics the clip
    limits are the volume's own and mean 0, std 1, which changes nothing.

    Nothing is taken from the case itself, so one pass over the voxels is enough."""
    if stats is None:
        return voxels.withColumn("value", F.col("value").cast("double"))
    limits = stats.select("channel", *[F.col(c).alias(f"_{c}") for c in ("mean", "std", "percentile_00_5", "percentile_99_5")])
    # greatest and least pass over limits that are null
    clipped = F.least(F.greatest(F.col("value"), F.col("_percentile_00_5")), F.col("_percentile_99_5"))
    out = (clipped - F.coalesce("_mean", F.lit(0.0))) / F.greatest(F.coalesce("_std", F.lit(1.0)), F.lit(MIN_STD))
    return attach(voxels, limits, ["channel"], "left").select(*[c for c in voxels.columns if c != "value"], out.alias("value"))


def normalize_zscore(voxels: DataFrame, segs: DataFrame | None = None, use_mask: bool = False) -> DataFrame:
    masked = use_mask and segs is not None
    return normalize(voxels, ("ZScore", masked), segs=segs if masked else None)[0]


def normalize_none(voxels: DataFrame) -> DataFrame:
    return voxels.select("*")


def zscore_window(voxels: DataFrame, keys: tuple[str, ...] = ("case_id", "channel")) -> DataFrame:
    """Each voxel against its case and channel.

    Aggregate and join back rather than a window: the group may be most of the data."""
    moments = voxels.groupBy(*keys).agg(F.avg("value").alias("_m"),
                                        F.greatest(F.stddev_pop("value"), F.lit(MIN_STD)).alias("_s"))
    return attach(voxels, moments, list(keys)).withColumn("value", (F.col("value") - F.col("_m")) / F.col("_s")) \
        .drop("_m", "_s")


def denormalize(voxels: DataFrame, params: DataFrame) -> DataFrame:
    """Undo a scheme from its parameters; with a mask every exact zero stays zero."""
    value = F.col("value")
    back = value * F.col("mul") + F.col("add")
    clipped = F.least(F.greatest(back, F.col("lower_clip")), F.col("upper_clip"))
    p = params.select("case_id", "channel", "scheme", "use_mask", "lower_clip", "upper_clip",
                      F.col("std").alias("mul"), F.col("mean").alias("add"))
    result = F.when(F.col("scheme") == "CT", clipped) \
        .when((F.col("scheme") == "ZScore") & F.col("use_mask") & (value == 0.0), 0.0) \
        .when(F.col("scheme") == "ZScore", back).otherwise(value)
    joined = attach(voxels, p, ["case_id", "channel"], "left")
    return joined.select(*[c for c in voxels.columns if c != "value"], result.alias("value"))
