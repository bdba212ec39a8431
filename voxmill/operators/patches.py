"""Reproducible patch sampling: which case, which class, which box, and the voxels in it.

All draws are hashed from (seed, batch, slot, name), so they do not depend on how the
work is spread. ``slots(batch, slot)`` has one row per patch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.columns import AXES, draw, draw_index, half_floor
from voxmill.operators.spread import rank_by_hash
from voxmill.operators.voxel import crop_and_pad

PATCH = ("batch", "slot")


def slot_draw(name: str, seed, *more) -> Column:
    return draw(F.lit(seed), F.col("batch"), F.col("slot"), F.lit(name), *more)


def batch_draw(name: str, seed) -> Column:
    return draw(F.lit(seed), F.col("batch"), F.lit(name))


def draw_cases(cases: DataFrame, batches: DataFrame, size: int, seed: int) -> DataFrame:
    """A uniformly drawn case (with replacement) for each slot of each batch."""
    ranked = rank_by_hash(cases.select("case_id").distinct(), [], ["case_id"], seed)
    total = cases.select(F.count_distinct("case_id")).scalar()
    slots = batches.select("batch", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    slots = slots.withColumn("rank", draw_index(total, F.lit(seed), F.col("batch"), F.col("slot"), F.lit("case")))
    return slots.join(ranked.select("rank", "case_id"), "rank").select(*PATCH, "case_id")


def mark_foreground_slots(slots: DataFrame, size: int, share: float = 0.33, probabilistic: bool = False,
                          seed: int = 0) -> DataFrame:
    """Slots that must show foreground: the last ones of a batch, or each with a probability."""
    if probabilistic:
        forced = slot_draw("foreground", seed) < share
    else:
        forced = F.col("slot") >= F.rint(F.lit(size * (1 - share)))
    return slots.withColumn("force_fg", forced)


def choose_class(slots: DataFrame, counts: DataFrame, seed: int, weights: DataFrame | None = None) -> DataFrame:
    """A class for each slot, among those with locations in its case; null if there is none.

    counts(case_id, label, n); weights(label, weight) with 1.0 for labels it lacks, or
    equal chances. Classes per case are few, whatever the size of the case.
    """
    eligible = counts.filter((F.col("n") > 0) & (F.col("label") != -1)).select("case_id", "label")
    if weights is not None:
        eligible = eligible.join(weights, "label", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        eligible = eligible.withColumn("weight", F.lit(1.0))
    within = Window.partitionBy("case_id")
    upto = F.sum("weight").over(within.orderBy("label").rowsBetween(Window.unboundedPreceding, 0))
    share = eligible.select("case_id", "label", ((upto - F.col("weight")) / F.sum("weight").over(within)).alias("_lo"),
                            (upto / F.sum("weight").over(within)).alias("_hi"))
    drawn = slots.withColumn("_u", slot_draw("class", seed))
    hit = (drawn["case_id"] == share["case_id"]) & (drawn["_u"] >= share["_lo"]) & (drawn["_u"] < share["_hi"])
    return drawn.join(share.withColumnRenamed("label", "cls"), hit, "left") \
        .select(*[drawn[c] for c in slots.columns], "cls")


def patch_bbox(slots: DataFrame, cases: DataFrame, locations: DataFrame, patch: Sequence[int],
               final: Sequence[int], seed: int) -> DataFrame:
    """Box (lo, hi) of each slot.

    slots(batch, slot, case_id, force_fg, cls), locations(case_id, label, i, j, k, rank) with
    ranks 0.. per case and label. Forced slots are centred on a drawn location (kept
    from starting too low, but not from ending too high), others lie anywhere in the
    padded volume.
    """
    sizes = locations.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("_n"))
    base = slots.join(cases.select("case_id", "shape"), "case_id")
    picked = (base.filter("force_fg AND cls IS NOT NULL")
              .join(sizes.withColumnRenamed("label", "cls"), ["case_id", "cls"])
              .withColumn("rank", draw_index(F.col("_n"), F.lit(seed), F.col("batch"), F.col("slot"), F.lit("voxel")))
              .join(locations.withColumnRenamed("label", "cls"), ["case_id", "cls", "rank"])
              .select(*PATCH, F.array(*AXES).alias("_voxel")))
    base = base.join(picked, list(PATCH), "left")
    lo = []
    for a in range(3):
        size = F.col("shape")[a]
        need = F.greatest(F.lit(patch[a] - final[a]), F.lit(patch[a]) - size)
        low = half_floor(-need)
        high = size + half_floor(need) + need % 2 - patch[a]
        anywhere = low + F.floor(slot_draw(f"lo{a}", seed) * (high - low + 1)).cast("int")
        centred = F.greatest(low, F.col("_voxel")[a] - patch[a] // 2)
        lo.append(F.when(F.col("_voxel").isNotNull(), centred).otherwise(anywhere))
    return base.select(*PATCH, "case_id", F.array(*lo).alias("lo"),
                       F.array(*[x + patch[a] for a, x in enumerate(lo)]).alias("hi"))


def extract_patches(boxes: DataFrame, cases: DataFrame, voxels: DataFrame, segs: DataFrame | None = None,
                    distance: DataFrame | None = None, flat: bool = False) -> dict[str, DataFrame]:
    """Image (padded with 0), label (-1) and distance (0) voxels of each box.

    With ``flat`` the boxes are one voxel deep and the patches two-dimensional: they have no column i."""
    out = {"image": crop_and_pad(voxels, boxes, cases, "value", 0.0, extra=("channel",)).drop("case_id")}
    if segs is not None:
        out["label"] = crop_and_pad(segs, boxes, cases, "label", -1).drop("case_id")
    if distance is not None:
        out["distance"] = crop_and_pad(distance, boxes, cases, "dist", 0.0, extra=("cls",)).drop("case_id")
    return {n: drop_depth(t) for n, t in out.items()} if flat else out


def drop_depth(patches: DataFrame) -> DataFrame:
    return patches.drop("i")
