"""Voxel tables: layout, masks, boxes, cropping and padding.

Long form: ``voxels(case_id, channel, i, j, k, value)``, ``segs(case_id, i, j, k, label)``;
one row per case: ``cases(case_id, dataset_id, shape, spacing)``. Voxel tables are
dense, so cells outside a box are generated from the geometry alone and never need a
join against a full grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.columns import AXES, VOXEL, as_col, inside_box, per_axis
from voxmill.operators.spread import attach, grid


def explode_volumes(volumes: DataFrame) -> DataFrame:
    """Array form (case_id, channel, shape, data) to long form."""
    ny, nz = F.col("shape")[1], F.col("shape")[2]
    return (volumes.select("case_id", "channel", "shape", F.posexplode("data").alias("pos", "v"))
            .select("case_id", "channel",
                    F.floor(F.col("pos") / (ny * nz)).cast("int").alias("i"),
                    (F.floor(F.col("pos") / nz) % ny).cast("int").alias("j"),
                    (F.col("pos") % nz).alias("k"),
                    F.col("v").cast("double").alias("value")))


def transpose_axes(df: DataFrame, order) -> DataFrame:
    """Output axis a is input axis ``order[a]``; ``order`` is a list, or the name of
    an array column when it differs by row."""
    if isinstance(order, str):
        coords = F.array(*[F.col(a) for a in AXES])
        moved = {axis: F.get(coords, F.col(order)[a]) for a, axis in enumerate(AXES)}
    else:
        moved = {axis: F.col(AXES[order[a]]) for a, axis in enumerate(AXES)}
    return df.withColumns(moved)


def inverse_permutation(order: list[int]) -> list[int]:
    return [order.index(a) for a in range(len(order))]


def nonzero_mask(voxels: DataFrame) -> DataFrame:
    """Union over channels of ``value != 0``."""
    return voxels.groupBy(*VOXEL).agg(F.max(F.col("value") != 0).alias("inside"))


def nonzero_bbox(voxels: DataFrame, cases: DataFrame, segs: DataFrame | None = None) -> DataFrame:
    """Box (lo, hi) of the non-zero voxels per case, hi exclusive; the whole volume
    when there is none. With ``segs``, labelled voxels count too (fingerprint variant).

    Holes lie inside the box, so they need not be filled for this.
    """
    hits = voxels.filter(F.col("value") != 0).select(*VOXEL)
    if segs is not None:
        hits = hits.unionByName(segs.filter(F.col("label") > 0).select(*VOXEL))
    found = hits.groupBy("case_id").agg(
        *[F.min(a).alias(f"lo_{a}") for a in AXES], *[(F.max(a) + 1).alias(f"hi_{a}") for a in AXES])
    return (cases.select("case_id", "shape").join(found, "case_id", "left")
            .select("case_id",
                    per_axis(lambda a: F.coalesce(F.col(f"lo_{AXES[a]}"), F.lit(0))).alias("lo"),
                    per_axis(lambda a: F.coalesce(F.col(f"hi_{AXES[a]}"), F.col("shape")[a])).alias("hi")))


def box_shape(lo: Column, hi: Column) -> Column:
    return F.zip_with(hi, lo, lambda h, l: h - l)


def crop_ratio(bbox: DataFrame, cases: DataFrame) -> DataFrame:
    """Cropped over full volume per case, 1.0 for an empty volume."""
    def volume(size) -> Column:
        return (size(0) * size(1) * size(2)).cast("double")

    after = volume(lambda a: (F.col("hi")[a] - F.col("lo")[a]).cast("bigint"))
    before = volume(lambda a: F.col("shape")[a].cast("bigint"))
    return (bbox.join(cases.select("case_id", "shape"), "case_id")
            .select("case_id", box_shape(F.col("lo"), F.col("hi")).alias("shape_after_crop"),
                    F.when(before > 0, after / before).otherwise(F.lit(1.0)).alias("crop_ratio")))


def crop_to_bbox(voxels: DataFrame, bbox: DataFrame) -> DataFrame:
    """Keep the voxels inside the case's box and shift them to its origin."""
    joined = attach(voxels, bbox.select("case_id", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")),
                    ["case_id"])
    kept = joined.filter(inside_box(F.col("_lo"), F.col("_hi")))
    return kept.withColumns({axis: F.col(axis) - F.col("_lo")[a] for a, axis in enumerate(AXES)}) \
        .drop("_lo", "_hi")


#: Voxels along each side of the tiles by which requests find their voxels.
TILE = 16


def box_difference(inner: tuple[Column, Column], outer: tuple[Column, Column]) -> Column:
    """The outer box without the inner one, as at most six boxes (lo, hi) that do not overlap.

    Each axis gives the part before and the part behind the inner box, between the inner box's sides
    on the axes already done. Boxes are (lo, hi) arrays; the inner one may reach out of the outer one.
    """
    c, d = ([F.get(side, F.lit(a)).cast("int") for a in range(3)] for side in outer)
    a = [F.greatest(F.get(inner[0], F.lit(x)).cast("int"), c[x]) for x in range(3)]
    b = [F.least(F.get(inner[1], F.lit(x)).cast("int"), d[x]) for x in range(3)]
    empty = (a[0] >= b[0]) | (a[1] >= b[1]) | (a[2] >= b[2])
    # without an inner box, all of the outer one is before it on the first axis
    a[0], b[0] = F.when(empty, d[0]).otherwise(a[0]), F.when(empty, d[0]).otherwise(b[0])

    def part(axis: int, lo: Column, hi: Column) -> Column:
        los = [a[x] if x < axis else lo if x == axis else c[x] for x in range(3)]
        his = [b[x] if x < axis else hi if x == axis else d[x] for x in range(3)]
        return F.struct(F.array(*los).alias("lo"), F.array(*his).alias("hi"))

    parts = F.array(*[p for x in range(3) for p in (part(x, c[x], a[x]), part(x, b[x], d[x]))])
    return F.filter(parts, lambda p: (p["lo"][0] < p["hi"][0]) & (p["lo"][1] < p["hi"][1]) & (p["lo"][2] < p["hi"][2]))


def _pad_rows(boxes: DataFrame, keys: list[str], inner_lo: list[Column], inner_hi: list[Column],
              outer_lo: list[Column], outer_hi: list[Column], carry: list[str]) -> DataFrame:
    """Cells of the outer box that are not in the inner box; no others are made."""
    parts = box_difference((F.array(*inner_lo), F.array(*inner_hi)), (F.array(*outer_lo), F.array(*outer_hi)))
    boxes = boxes.select(*keys, *carry, F.inline(parts).alias("_c", "_d"))
    return grid(boxes, [F.col("_c")[a] for a in range(3)], [F.col("_d")[a] for a in range(3)]).drop("_c", "_d")


def crop_and_pad(table: DataFrame, requests: DataFrame, shapes: DataFrame, value: str, pad,
                 request_keys: tuple[str, ...] = ("batch", "slot"),
                 extra: tuple[str, ...] = ()) -> DataFrame:
    """Cut the requested box out of each case; cells beyond the volume get ``pad``.

    requests(batch, slot, case_id, lo, hi), shapes(case_id, shape). ``extra`` names
    further axes of the table (channel, cls); their values are taken per case.
    """
    keys = list(request_keys)
    boxes = requests.select(*keys, "case_id", "lo", "hi").join(shapes.select("case_id", "shape"), "case_id")
    wanted = boxes.select(*keys, "case_id", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "shape")
    # a voxel meets only the requests that touch its tile, not all of the case's
    tiles = [f"_tile{a}" for a in range(3)]
    for a, tile in enumerate(tiles):
        first = F.floor(F.greatest(F.lit(0), F.col("_lo")[a]) / TILE)
        last = F.floor((F.least(F.col("shape")[a], F.col("_hi")[a]) - 1) / TILE)
        wanted = wanted.filter(first <= last).withColumn(tile, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    tiled = table.withColumns({tile: F.floor(F.col(axis) / TILE).cast("int") for tile, axis in zip(tiles, AXES)})
    cut = attach(tiled, wanted.drop("shape"), ["case_id", *tiles]).filter(inside_box(F.col("_lo"), F.col("_hi")))
    cut = cut.withColumns({axis: F.col(axis) - F.col("_lo")[a] for a, axis in enumerate(AXES)})
    columns = [*keys, "case_id", *extra, *AXES]

    outside = boxes.filter(F.exists(F.col("lo"), lambda x: x < 0)
                           | F.exists(F.zip_with("hi", "shape", lambda h, s: h > s), lambda x: x))
    if extra:
        layers = table.select("case_id", *extra).distinct()
        outside = outside.join(layers, "case_id")
    zero = F.lit(0)
    pads = _pad_rows(
        outside, [*keys, "case_id", *extra],
        [F.greatest(zero, F.col("lo")[a]) - F.col("lo")[a] for a in range(3)],
        [F.least(F.col("shape")[a], F.col("hi")[a]) - F.col("lo")[a] for a in range(3)],
        [zero] * 3, [F.col("hi")[a] - F.col("lo")[a] for a in range(3)], [])
    kind = table.schema[value].dataType
    return cut.select(*columns, value).unionByName(
        pads.select(*columns, as_col(pad).cast(kind).alias(value)))


def uncrop(voxels: DataFrame, bbox: DataFrame, shapes: DataFrame, value: str = "value",
           fill=None) -> DataFrame:
    """Put a crop back into the full volume; the rest gets ``fill``, by default the
    smallest value of the case over all its channels."""
    layers = [c for c in ("channel",) if c in voxels.columns]
    back = attach(voxels, bbox.select("case_id", F.col("lo").alias("_lo")), ["case_id"])
    back = back.withColumns({axis: F.col(axis) + F.col("_lo")[a] for a, axis in enumerate(AXES)}).drop("_lo")
    boxes = bbox.select("case_id", "lo", "hi").join(shapes.select("case_id", "shape"), "case_id")
    # one row per case and channel: which channels there are, and their smallest value
    per_layer = voxels.groupBy("case_id", *layers).agg(F.min(value).alias("_least"))
    boxes = boxes.join(per_layer.withColumn("_fill", F.min("_least").over(Window.partitionBy("case_id"))), "case_id")
    if fill is not None:
        boxes = boxes.withColumn("_fill", as_col(fill))
    rim = _pad_rows(boxes, ["case_id", *layers],
                    [F.col("lo")[a] for a in range(3)], [F.col("hi")[a] for a in range(3)],
                    [F.lit(0)] * 3, [F.col("shape")[a] for a in range(3)], ["_fill"])
    kind = voxels.schema[value].dataType
    columns = ["case_id", *layers, *AXES]
    return back.select(*columns, value).unionByName(
        rim.select(*columns, F.col("_fill").cast(kind).alias(value)))


def mark_outside(segs: DataFrame | None, mask: DataFrame) -> DataFrame:
    """Label -1 for background outside the body mask.

    Without segmentation: 0 inside, -1 outside. A case whose mask is empty keeps its
    segmentation (or is -1 throughout).
    """
    if segs is None:
        return mask.select(*VOXEL, F.when(F.col("inside"), 0).otherwise(-1).cast("tinyint").alias("label"))
    bodies = mask.filter("inside").select("case_id").distinct().withColumn("_body", F.lit(True))
    outside = F.col("_body") & ~F.coalesce(F.col("inside"), F.lit(False)) & (F.col("label") == 0)
    joined = attach(segs.join(mask, list(VOXEL), "left"), bodies, ["case_id"], "left")
    return joined.select(*VOXEL, F.when(outside, -1).otherwise(F.col("label")).cast("tinyint").alias("label"))


def binarize(segs: DataFrame) -> DataFrame:
    return segs.withColumn("label", (F.col("label") > 0).cast("tinyint"))


def remove_outside_label(segs: DataFrame) -> DataFrame:
    return segs.withColumn("label", F.when(F.col("label") == -1, 0).otherwise(F.col("label")).cast("tinyint"))


def mask_image(voxels: DataFrame, segs: DataFrame, channels: list[int],
               keys: tuple[str, ...] = VOXEL) -> DataFrame:
    """Zero the given channels where the label is negative; others pass untouched."""
    chosen = F.col("channel").isin(channels)
    outside = segs.filter(F.col("label") < 0).select(*keys).withColumn("_out", F.lit(True))
    masked = voxels.filter(chosen).join(outside, list(keys), "left")
    masked = masked.withColumn("value", F.when(F.col("_out"), 0.0).otherwise(F.col("value"))).drop("_out")
    return voxels.filter(~chosen).unionByName(masked.select(*voxels.columns))
