"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards, and each has a weight; a node weighs what its children
weigh together. A row descends from the root: at each level every child draws a number from the
row's key and its own name, scaled by its weight, and the best draw wins. A child's chance is its
share of the weight, and a changed weight moves rows only into or out of the subtree that holds it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import Scratch, md5_draw, running_sum


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Equal shards, ``per_rack`` to a rack and ``racks`` to a region; the last region may be partial."""
    return [Leaf(s // (per_rack * racks), s // per_rack % racks, s) for s in range(shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard in a region of its own: no other subtree's weight changes, so rows only move into it."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, 0, max(x.shard for x in tree) + 1, weight)]


def _drawn(key: Column, children: dict[int, float], place: str) -> Column:
    """The child with the smallest exponential draw; its rate is its weight."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct((-F.log(md5_draw(key, f"{place}/{c}")) / F.lit(float(w))).alias("d"), F.lit(c).alias("c"))
             for c, w in sorted(children.items())]
    return F.array_min(F.array(*draws))["c"]


def _weights(leaves: Sequence[Leaf], field: str) -> dict[int, float]:
    out: dict[int, float] = {}
    for x in leaves:
        out[getattr(x, field)] = out.get(getattr(x, field), 0.0) + x.weight
    return {c: w for c, w in out.items() if w > 0}


def descend(df: DataFrame, key: Column, tree: Sequence[Leaf], out: str) -> DataFrame:
    """Add the shard of each row as ``out``; children of weight 0 get none."""
    df = df.withColumn("_region", _drawn(key, _weights(tree, "region"), ""))
    racks, shards = None, None
    for r in _weights(tree, "region"):
        inside = [x for x in tree if x.region == r]
        pick = _drawn(key, _weights(inside, "rack"), f"{r}")
        racks = F.when(F.col("_region") == r, pick) if racks is None else racks.when(F.col("_region") == r, pick)
    df = df.withColumn("_rack", racks)
    for r in _weights(tree, "region"):
        for k in _weights([x for x in tree if x.region == r], "rack"):
            inside = [x for x in tree if (x.region, x.rack) == (r, k)]
            here = (F.col("_region") == r) & (F.col("_rack") == k)
            pick = _drawn(key, _weights(inside, "shard"), f"{r}/{k}")
            shards = F.when(here, pick) if shards is None else shards.when(here, pick)
    return df.withColumn(out, shards).drop("_region", "_rack")


def shard_documents(docs: DataFrame, tree: Sequence[Leaf]) -> DataFrame:
    """Shard and slot of every row, by the law ``key``.

    Returns doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32, law, shard, slot,
    grown_shard (the shard after one more is added). The shard depends on doc_id and the tree
    alone, so rows that repeat a doc_id share a shard, and a null doc_id has one of its own. Slots
    count from 0 without gaps in each shard, in the order of a hash of doc_id and text; a shard may hold any
    share of the rows, since slots are running sums over small cells. Empty tables give none; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = descend(rows, F.col("doc_id"), tree, "shard")
    rows = descend(rows, F.col("doc_id"), grown(tree), "grown_shard")
    # the text takes part in the draw, so that rows that repeat a doc_id spread over cells too
    rows = rows.withColumn("_draw", md5_draw("slot", F.col("doc_id"), F.col("text_crc32")))
    rows = scratch.keep(rows.withColumn("_one", F.lit(1).cast("bigint")))
    placed = running_sum(scratch, rows, ["shard"], "_draw", ["_draw", "doc_id", "size", "text_crc32"], "_one", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"),
                         F.col("slot").cast("bigint"), F.col("grown_shard").cast("int"))
