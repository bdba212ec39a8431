"""Augmentation of patch tables.

``image(batch, slot, channel, i, j, k, value)``, ``label(batch, slot, i, j, k, label)``,
``distance(batch, slot, cls, i, j, k, dist)``; one table ``slots(batch, slot)``. Flat patches
have no column i, and sizes then have two entries. All patches have one size, so a patch is a bounded group: windows over it are safe at any number of
patches. Draws that hold for a whole patch are made once per slot and joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.columns import AXES, draw, draw_index, draw_normal, half_even
from voxmill.operators.dense import axes_of, coarsener, over_patches, sampler
from voxmill.operators.patches import PATCH, batch_draw, slot_draw
from voxmill.operators.resample import _nearest_axis, packed_sizes
from voxmill.operators.voxel import mask_image, remove_outside_label
from voxmill.session import settle

# fixed values: settings of the augmentation families; a missing entry disables the step
FAMILIES: dict[str, dict] = {
    "default": {
        "spatial": {"p_rotation": 0.2, "p_scaling": 0.2, "scaling": (0.7, 1.4), "p_elastic": 0.0},
        "noise": {"p": 0.1, "variance": (0.0, 0.1)}, "blur": {"p": 0.2, "sigma": (0.5, 1.0)},
        "brightness": {"p": 0.15, "range": (0.75, 1.25)}, "contrast": {"p": 0.15, "range": (0.75, 1.25)},
        "low_resolution": {"p": 0.25, "scale": (0.5, 1.0)},
        "gamma": {"p_inverted": 0.1, "p_normal": 0.3, "range": (0.7, 1.5)}, "mirror": {}},
    "fast": {
        "spatial": {"p_rotation": 0.15, "p_scaling": 0.15, "scaling": (0.8, 1.2), "p_elastic": 0.0},
        "noise": {"p": 0.05, "variance": (0.0, 0.05)}, "brightness": {"p": 0.1, "range": (0.8, 1.2)},
        "gamma": {"p_inverted": 0.05, "p_normal": 0.15, "range": (0.8, 1.3)}, "mirror": {}},
    "extended": {
        "spatial": {"p_rotation": 0.3, "p_scaling": 0.3, "scaling": (0.6, 1.5), "p_elastic": 0.4,
                    "elastic_scale": (0.0, 0.2), "elastic_magnitude": (0.0, 0.2)},
        "noise": {"p": 0.15, "variance": (0.0, 0.15)}, "blur": {"p": 0.3, "sigma": (0.3, 1.2)},
        "brightness": {"p": 0.2, "range": (0.7, 1.3)}, "contrast": {"p": 0.2, "range": (0.7, 1.3)},
        "low_resolution": {"p": 0.3, "scale": (0.4, 1.0)},
        "gamma": {"p_inverted": 0.15, "p_normal": 0.4, "range": (0.6, 1.6)}, "mirror": {}},
}
FAMILIES["cutmix"] = {**FAMILIES["default"], "cutmix": {"p": 0.5, "alpha": 1}}
MIN_SPREAD = 1e-7


def _between(u: Column, limits: Sequence[float]) -> Column:
    return F.lit(float(limits[0])) + u * (float(limits[1]) - float(limits[0]))


def _channel_draws(name: str, seed, n_channels: int) -> Column:
    return F.array(*[slot_draw(name, seed, F.lit(c)) for c in range(n_channels)])


def _by_slot(table: DataFrame, slots: DataFrame, **params: Column) -> DataFrame:
    return table.join(slots.select(*PATCH, *[c.alias(n) for n, c in params.items()]), list(PATCH))


# --- geometry --------------------------------------------------------------------------

def mirror(table: DataFrame, slots: DataFrame, size: Sequence[int], axes: Sequence[int], seed: int) -> DataFrame:
    """Independent flips with probability one half per axis; the same for every table."""
    own = axes_of(table)
    flags = {f"_flip{a}": slot_draw(f"mirror{a}", seed) < 0.5 for a in axes}
    moved = {own[a]: F.when(F.col(f"_flip{a}"), size[a] - 1 - F.col(own[a])).otherwise(F.col(own[a])) for a in axes}
    return _by_slot(table, slots, **flags).withColumns(moved).drop(*flags)


def center_crop(table: DataFrame, size: Sequence[int], out: Sequence[int], axes: Sequence[int] | None = None) -> DataFrame:
    for a, axis in enumerate(axes_of(table)):
        if axes is None or a in axes:
            start = (size[a] - out[a]) // 2
            x = F.col(axis)
            table = table.filter((x >= start) & (x < start + out[a])).withColumn(axis, x - start)
    return table


def spatial_params(slots: DataFrame, seed: int, rotation: float, p_rotation: float, p_scaling: float,
                   scaling: Sequence[float], dims: int = 3) -> DataFrame:
    """Rotation times scale per slot as columns m00.., and whether it is the identity."""
    turned, scaled = slot_draw("p_rotation", seed) < p_rotation, slot_draw("p_scaling", seed) < p_scaling
    scale = F.when(scaled, _between(slot_draw("scaling", seed), scaling)).otherwise(1.0)
    n_angles = 3 if dims == 3 else 1
    angle = [F.when(turned, _between(slot_draw(f"angle{a}", seed), (-rotation, rotation))).otherwise(0.0) for a in range(n_angles)]
    out = slots.withColumns({"_s": scale, "identity": ~turned & ~scaled, **{f"_a{a}": x for a, x in enumerate(angle)}})
    return rotation_matrix(out, dims)


def rotation_matrix(slots: DataFrame, dims: int = 3) -> DataFrame:
    """Columns m{r}{c} of scale ``_s`` times the rotation by angles ``_a0..`` (Rz.Ry.Rx, or 2-D)."""
    s = F.col("_s")
    if dims == 2:
        c, d = F.cos("_a0"), F.sin("_a0")
        m = [[c, -d], [d, c]]
    else:
        rot = []
        for a in range(3):
            c, d = F.cos(f"_a{a}"), F.sin(f"_a{a}")
            p, q = [x for x in range(3) if x != a]
            full = [[F.lit(1.0 if r == t else 0.0) for t in range(3)] for r in range(3)]
            full[p][p], full[q][q] = c, c
            sign = -1.0 if a == 1 else 1.0
            full[p][q], full[q][p] = d * -sign, d * sign
            rot.append(full)

        def times(x, y):
            return [[x[r][0] * y[0][t] + x[r][1] * y[1][t] + x[r][2] * y[2][t] for t in range(3)] for r in range(3)]

        m = times(rot[2], times(rot[1], rot[0]))
    columns = {f"m{r}{t}": m[r][t] * s for r in range(dims) for t in range(dims)}
    return slots.withColumns(columns).drop("_s", *[f"_a{a}" for a in range(3)])


def warp(table: DataFrame, slots: DataFrame, size: Sequence[int], out: Sequence[int], value: str,
         nearest: bool = False, axes: Sequence[int] | None = None, offsets: DataFrame | None = None) -> DataFrame:
    """Sample every patch at matrix * (output - centre) + centre, zero outside.

    Linear (all corners of the source cell) or nearest. ``axes`` are places among the axes of the table, all of them by
    default; each slice of the others is treated alike. ``offsets`` adds a displacement e0.. per output
    voxel. Patches are gathered once, as arrays, and sampled in place.
    """
    axes = range(len(axes_of(table))) if axes is None else axes
    n = len(axes)
    target = [out[a] if a in axes else x for a, x in enumerate(size)]
    params = slots.select(*PATCH, F.array(*[f"m{r}{t}" for r in range(n) for t in range(n)]).alias("p"))
    return over_patches(table, params, size, target, value, sampler(size, target, tuple(axes), nearest), offsets,
                        [f"e{r}" for r in range(n)] if offsets is not None else ())


def elastic_offsets(slots: DataFrame, out: Sequence[int], seed: int, p_elastic: float, scale: Sequence[float],
                    magnitude: Sequence[float], axes: Sequence[int] = (0, 1, 2), depth: int | None = None,
                    own: Sequence[str] = AXES) -> DataFrame:
    """Smoothed random displacement e0.. per output voxel, in voxels; zero where not drawn.

    In slice-wise mode (``depth``) every slice is drawn on its own. ``own`` are the axes of the patches."""
    names = [own[a] for a in axes]
    longest = max(out[a] for a in axes)
    noise = slots.select(*PATCH)
    extra = []
    if depth is not None:
        other = [x for x in own if x not in names][0]
        noise, extra = noise.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))), [other]
    noise = noise.withColumns({
        "_on": slot_draw("p_elastic", seed, *[F.col(x) for x in extra]) < p_elastic,
        "_sigma": _between(batch_draw("elastic_scale", seed), scale) * longest,
        "_mag": _between(batch_draw("elastic_magnitude", seed), magnitude) * longest})
    noise = noise.withColumn("_on", F.col("_on") & (F.col("_sigma") > 0) & (F.col("_mag") > 0))
    noise = _kernel(noise).withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(len(axes) - 1))))
    for a, x in zip(axes, names):
        noise = noise.withColumn(x, F.explode(F.sequence(F.lit(0), F.lit(out[a] - 1))))
    on = noise.filter("_on").withColumn("value", draw_normal(
        F.lit(seed), F.col("batch"), F.col("slot"), F.lit("elastic"), F.col("channel"), *[F.col(x) for x in (*extra, *names)]))
    keep = on.select(*PATCH, *extra, "channel", *names, "value", "_h", "_s2", "_z", "_mag")
    for a, x in zip(axes, names):
        keep = _blur_pass(keep, x, out[a])
    still = noise.filter("NOT _on").select(*PATCH, *extra, "channel", *names, F.lit(0.0).alias("value"), F.lit(0.0).alias("_mag"))
    both = keep.select(*still.columns).unionByName(still)
    return both.groupBy(*PATCH, *extra, *names).agg(*[
        F.max(F.when(F.col("channel") == r, F.col("value") * F.col("_mag"))).alias(f"e{r}") for r in range(len(axes))])


# --- intensities -----------------------------------------------------------------------

def gaussian_noise(image: DataFrame, slots: DataFrame, seed: int, p: float, variance: Sequence[float]) -> DataFrame:
    params = {"_on": slot_draw("p_noise", seed) < p, "_std": F.sqrt(_between(slot_draw("variance", seed), variance))}
    normal = draw_normal(F.lit(seed), F.col("batch"), F.col("slot"), F.lit("noise"), F.col("channel"), *[F.col(a) for a in axes_of(image)])
    return _by_slot(image, slots, **params).withColumn(
        "value", F.when(F.col("_on"), F.col("value") + F.col("_std") * normal).otherwise(F.col("value"))).drop(*params)


def _kernel(df: DataFrame) -> DataFrame:
    """Half width, 2*sigma^2 and norm of the kernel of ``_sigma`` (an odd width)."""
    half = F.greatest(F.ceil(3 * F.col("_sigma")), F.lit(1)).cast("int")
    df = df.withColumn("_h", half).withColumn("_s2", 2 * F.col("_sigma") * F.col("_sigma"))
    norm = F.aggregate(F.sequence(-F.col("_h"), F.col("_h")), F.lit(0.0),
                       lambda acc, x: acc + F.exp(-(x * x) / F.col("_s2")))
    return df.withColumn("_z", norm)


def _blur_pass(df: DataFrame, axis: str, n: int) -> DataFrame:
    """One axis of the blur, zero outside; kernel in _h, _s2, _z."""
    carried = [c for c in df.columns if c.startswith("_")]
    keys = [c for c in df.columns if c not in (axis, "value", *carried)]
    x = F.col(axis)
    sent = df.repartition(*keys).withColumn("_o", F.explode(F.sequence(
        F.greatest(F.lit(0), x - F.col("_h")), F.least(F.lit(n - 1), x + F.col("_h")))))
    off = F.col("_o") - x
    weight = F.exp(-(off * off) / F.col("_s2")) / F.col("_z")
    return sent.groupBy(*keys, "_o").agg(F.sum(weight * F.col("value")).alias("value"),
                                         *[F.first(c).alias(c) for c in carried]).withColumnRenamed("_o", axis)


def blur(image: DataFrame, sigma: Column, size: Sequence[int]) -> DataFrame:
    """Gaussian blur of every patch with the sigma of its row."""
    out = _kernel(image.withColumn("_sigma", sigma)).drop("_sigma")
    for a, axis in enumerate(axes_of(image)):
        if size[a] > 1 or axis != "i":
            out = _blur_pass(out, axis, size[a])
    return out.select(*image.columns)


def gaussian_blur(image: DataFrame, slots: DataFrame, size: Sequence[int], n_channels: int, seed: int, p: float,
                  sigma: Sequence[float]) -> DataFrame:
    """Selected patches, half of their channels, one sigma per batch."""
    params = {"_on": slot_draw("p_blur", seed) < p, "_c": _channel_draws("blur_channel", seed, n_channels),
              "_sg": _between(batch_draw("sigma", seed), sigma)}
    joined = _by_slot(image, slots, **params)
    chosen = F.col("_on") & (F.get("_c", F.col("channel")) < 0.5)
    done = blur(joined.filter(chosen).select(*image.columns, "_sg"), F.col("_sg"), size)
    return joined.filter(~chosen).select(*image.columns).unionByName(done.select(*image.columns))


def brightness(image: DataFrame, slots: DataFrame, n_channels: int, seed: int, p: float, limits: Sequence[float]) -> DataFrame:
    params = {"_on": slot_draw("p_brightness", seed) < p, "_c": _channel_draws("brightness", seed, n_channels)}
    factor = _between(F.get("_c", F.col("channel")), limits)
    return _by_slot(image, slots, **params).withColumn(
        "value", F.when(F.col("_on"), F.col("value") * factor).otherwise(F.col("value"))).drop(*params)


def _patch_window() -> Window:
    return Window.partitionBy(*PATCH, "channel")


def contrast(image: DataFrame, slots: DataFrame, n_channels: int, seed: int, p: float, limits: Sequence[float]) -> DataFrame:
    """(x - mean) * factor + mean, kept within the range of the patch."""
    params = {"_on": slot_draw("p_contrast", seed) < p, "_c": _channel_draws("contrast", seed, n_channels)}
    w, v = _patch_window(), F.col("value")
    joined = _by_slot(image, slots, **params).withColumns(
        {"_m": F.avg("value").over(w), "_lo": F.min("value").over(w), "_hi": F.max("value").over(w)})
    moved = (v - F.col("_m")) * _between(F.get("_c", F.col("channel")), limits) + F.col("_m")
    return joined.withColumn("value", F.when(F.col("_on"), F.least(F.greatest(moved, "_lo"), "_hi")).otherwise(v)) \
        .select(*image.columns)


def low_resolution(image: DataFrame, slots: DataFrame, size: Sequence[int], n_channels: int, seed: int, p: float,
                   scale: Sequence[float], dummy_2d: bool = False) -> DataFrame:
    """Selected patches and half of their channels lose detail, each as one array; the depth is kept in slice-wise mode."""
    params = {"_on": slot_draw("p_low", seed) < p, "_c": _channel_draws("low_channel", seed, n_channels),
              "_sc": _between(batch_draw("low_scale", seed), scale)}
    joined = _by_slot(image, slots, **params)
    chosen = F.col("_on") & (F.get("_c", F.col("channel")) < 0.5) & (F.col("_sc") < 1.0)
    axes = (1, 2) if dummy_2d else range(len(axes_of(image)))
    drawn = slots.select(*PATCH, F.array(params["_sc"]).alias("p"))
    done = over_patches(joined.filter(chosen).select(*image.columns), drawn, size, size, "value", coarsener(size, tuple(axes)))
    return joined.filter(~chosen).select(*image.columns).unionByName(done.select(*image.columns))


def gamma(image: DataFrame, slots: DataFrame, n_channels: int, seed: int, p: float, limits: Sequence[float],
          invert: bool = False) -> DataFrame:
    """Power of the range-normalised values; mean and sample std are restored."""
    name = "gamma_inverted" if invert else "gamma"
    params = {"_on": slot_draw(f"p_{name}", seed) < p, "_c": _channel_draws(name, seed, n_channels)}
    w = _patch_window()
    signed = -F.col("value") if invert else F.col("value")
    joined = _by_slot(image, slots, **params).withColumn("_v", signed).withColumns(
        {"_m": F.avg("_v").over(w), "_s": F.stddev_samp("_v").over(w), "_lo": F.min("_v").over(w), "_hi": F.max("_v").over(w)})
    spread = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(MIN_SPREAD))
    unit = F.least(F.greatest((F.col("_v") - F.col("_lo")) / spread, F.lit(0.0)), F.lit(1.0))
    powered = F.pow(unit, _between(F.get("_c", F.col("channel")), limits)) * spread + F.col("_lo")
    joined = joined.withColumn("_g", powered).withColumns({"_gm": F.avg("_g").over(w), "_gs": F.stddev_samp("_g").over(w)})
    restored = (F.col("_g") - F.col("_gm")) / F.greatest(F.col("_gs"), F.lit(MIN_SPREAD)) * F.col("_s") + F.col("_m")
    return joined.withColumn("value", F.when(F.col("_on"), -restored if invert else restored).otherwise(F.col("value"))) \
        .select(*image.columns)


# --- labels and batches ----------------------------------------------------------------

def downsample_labels(label: DataFrame, size: Sequence[int], scales: Sequence[Sequence[float]]) -> DataFrame:
    """One label grid per scale, nearest sample, in column ``level``; nothing is shuffled."""
    levels = F.array(*[F.struct(F.lit(n).alias("level"), *[F.lit(float(s)).alias(f"_f{a}") for a, s in enumerate(scale)])
                       for n, scale in enumerate(scales)])
    out = label.select("*", F.inline(levels)).withColumns(
        {f"_size{a}": packed_sizes(F.lit(x), half_even(x * F.col(f"_f{a}"))) for a, x in enumerate(size)})
    for a, axis in enumerate(axes_of(label)):
        out = _nearest_axis(out, axis, a)
    return out.select("level", *label.columns)


def cutmix_pairs(slots: DataFrame, size: Sequence[int], batch_size: int, seed: int, p: float = 0.5, alpha: int = 1) -> DataFrame:
    """(batch, slot, partner, lo, hi) of the slots that are mixed.

    The mixing coefficient is Beta(alpha, alpha): the middle of 2*alpha-1 uniform draws.
    """
    if batch_size < 2:
        return slots.select(*PATCH, F.lit(0).alias("partner"), F.array(F.lit(0)).alias("lo"), F.array(F.lit(0)).alias("hi")).limit(0)
    if alpha != int(alpha) or alpha < 1:
        raise ValueError("alpha must be a positive whole number")
    uniforms = F.array_sort(F.array(*[slot_draw(f"lambda{n}", seed) for n in range(2 * int(alpha) - 1)]))
    lam = F.get(uniforms, F.lit(int(alpha) - 1))
    other = draw_index(batch_size - 1, F.lit(seed), F.col("batch"), F.col("slot"), F.lit("partner")).cast("int")
    chosen = slots.filter(slot_draw("p_cutmix", seed) <= p).select(
        *PATCH, F.when(other >= F.col("slot"), other + 1).otherwise(other).alias("partner"), F.sqrt(1 - lam).alias("_r"))
    lo, hi = [], []
    for a, n in enumerate(size):
        half = F.floor(F.floor(n * F.col("_r")) / 2).cast("int")
        centre = draw_index(n, F.lit(seed), F.col("batch"), F.col("slot"), F.lit(f"centre{a}")).cast("int")
        lo.append(F.greatest(F.lit(0), centre - half))
        hi.append(F.least(F.lit(n), centre + half))
    # an incomplete batch may lack the partner; such a slot stays as it is
    present = slots.select("batch", F.col("slot").alias("partner"))
    return chosen.select(*PATCH, "partner", F.array(*lo).alias("lo"), F.array(*hi).alias("hi")) \
        .join(present, ["batch", "partner"], "left_semi")


def cutmix_paste(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Replace the box of each chosen slot by its partner's, as both were before mixing."""
    def in_box() -> Column:
        test = F.lit(True)
        for a, axis in enumerate(axes_of(table)):
            test = test & (F.col(axis) >= F.col("_lo")[a]) & (F.col(axis) < F.col("_hi")[a])
        return test

    boxes = pairs.select("batch", "slot", "partner", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    own = table.join(boxes.drop("partner"), list(PATCH), "left").filter(F.col("_lo").isNull() | ~in_box())
    donors = boxes.select("batch", F.col("slot").alias("_to"), F.col("partner").alias("slot"), "_lo", "_hi")
    given = table.join(donors, list(PATCH)).filter(in_box()).withColumn("slot", F.col("_to"))
    return own.select(*table.columns).unionByName(given.select(*table.columns))


def cutmix(tables: dict[str, DataFrame], slots: DataFrame, size: Sequence[int], batch_size: int, seed: int,
           p: float = 0.5, alpha: int = 1) -> dict[str, DataFrame]:
    """Image and label are mixed alike; distances are not."""
    pairs = cutmix_pairs(slots, size, batch_size, seed, p, alpha)
    return {name: cutmix_paste(t, pairs) if name in ("image", "label") else t for name, t in tables.items()}


# --- the whole chain -------------------------------------------------------------------

VALUE_OF = {"image": "value", "label": "label", "distance": "dist"}


def spatial(tables: dict[str, DataFrame], slots: DataFrame, size: Sequence[int], out: Sequence[int], seed: int,
            rotation: float, settings: dict, dummy_2d: bool = False) -> dict[str, DataFrame]:
    """Warp, or a plain centre crop for batches in which nothing is turned, scaled or bent."""
    own = axes_of(tables["image"])
    axes = (1, 2) if dummy_2d else tuple(range(len(own)))
    params = spatial_params(slots, seed, rotation, settings["p_rotation"], settings["p_scaling"], settings["scaling"], len(axes))
    params = params.withColumn("_still", F.min("identity").over(Window.partitionBy("batch")))
    bent = settings.get("p_elastic", 0.0) > 0
    offsets = None
    if bent:
        offsets = elastic_offsets(slots, out, seed, settings["p_elastic"], settings["elastic_scale"],
                                  settings["elastic_magnitude"], axes, out[0] if dummy_2d else None, own)
    result = {}
    params = settle(params)
    for name, table in tables.items():
        moving = params if bent else params.filter("NOT _still")
        warped = warp(table, moving, size, out, VALUE_OF[name], name == "label", axes, offsets)
        if not bent:
            still = table.join(params.filter("_still").select(*PATCH), list(PATCH), "left_semi")
            warped = warped.unionByName(center_crop(still, size, out, axes))
        result[name] = warped
    return result


def augment(tables: dict[str, DataFrame], slots: DataFrame, size: Sequence[int], out: Sequence[int], n_channels: int,
            seed: int, rotation: float = 30 / 180 * math.pi, family: str | dict = "default", dummy_2d: bool = False,
            mirror_axes: Sequence[int] | None = None, mask_channels: Sequence[int] = (),
            more: Sequence[Callable[[DataFrame], DataFrame]] = (), batch_size: int = 2) -> dict[str, DataFrame]:
    """Spatial, noise, blur, brightness, contrast, low resolution, gamma (inverted, then
    normal), mirror, mask, label clean-up, CutMix within batches of ``batch_size`` - in this order.
    ``more`` are further functions of the image table, applied after gamma. Patches without a column i are
    flat: sizes and mirror axes then count j and k, and all axes are mirrored by default."""
    cfg = FAMILIES[family] if isinstance(family, str) else family
    tables, own = dict(tables), axes_of(tables["image"])
    if "spatial" in cfg:
        tables = spatial(tables, slots, size, out, seed, rotation, cfg["spatial"], dummy_2d)
    else:
        tables = {n: center_crop(t, size, out, (1, 2) if dummy_2d else None) for n, t in tables.items()}
    image = tables["image"]
    if "noise" in cfg:
        image = gaussian_noise(image, slots, seed, cfg["noise"]["p"], cfg["noise"]["variance"])
    # steps that treat some patches apart read their input twice
    if "blur" in cfg:
        image = gaussian_blur(settle(image), slots, out, n_channels, seed, cfg["blur"]["p"], cfg["blur"]["sigma"])
    if "brightness" in cfg:
        image = brightness(image, slots, n_channels, seed, cfg["brightness"]["p"], cfg["brightness"]["range"])
    if "contrast" in cfg:
        image = contrast(image, slots, n_channels, seed, cfg["contrast"]["p"], cfg["contrast"]["range"])
    if "low_resolution" in cfg:
        image = low_resolution(settle(image), slots, out, n_channels, seed, cfg["low_resolution"]["p"],
                               cfg["low_resolution"]["scale"], dummy_2d)
    if "gamma" in cfg:
        image = gamma(image, slots, n_channels, seed, cfg["gamma"]["p_inverted"], cfg["gamma"]["range"], invert=True)
        image = gamma(image, slots, n_channels, seed, cfg["gamma"]["p_normal"], cfg["gamma"]["range"])
    for fn in more:
        image = image.transform(fn)
    tables["image"] = image
    if "mirror" in cfg:
        flipped = range(len(own)) if mirror_axes is None else mirror_axes
        tables = {n: mirror(t, slots, out, flipped, seed) for n, t in tables.items()}
    if "label" in tables:
        if mask_channels:
            tables["image"] = mask_image(tables["image"], tables["label"], list(mask_channels), (*PATCH, *own))
        tables["label"] = remove_outside_label(tables["label"])
    if "cutmix" in cfg:
        # images are read twice, as they were before mixing
        tables = {n: settle(t) if n in ("image", "label") else t for n, t in tables.items()}
        tables = cutmix(tables, slots, out, batch_size, seed, cfg["cutmix"]["p"], cfg["cutmix"]["alpha"])
    return tables
