"""Connected components of a link table, without gathering any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import Scratch


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the smallest node that links reach from each node that has any.

    In each round a node takes the smallest label among its neighbours, what it was labelled with takes
    the smallest that its followers found, and labels are replaced by their labels' labels, which doubles
    the distance covered. Rounds go on until nothing changes; each is written to the shared folder.
    """
    scratch = Scratch(links.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.keep(both.filter("a <> b").distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        lower = labels.join(near, "node").withColumn("low", F.least("label", "near"))
        found = lower.groupBy(F.col("label").alias("node")).agg(F.min("low").alias("found"))
        hooked = scratch.keep(lower.join(found, "node", "left").select(
            "node", "label", F.least("low", F.coalesce("found", "low")).alias("low")))
        jumped = hooked.join(hooked.select(F.col("node").alias("low"), F.col("low").alias("next")), "low")
        new = scratch.keep(jumped.select("node", "label", "next"))
        same = new.filter("next <> label").isEmpty()
        scratch.drop(labels, hooked)
        labels = scratch.keep(new.select("node", F.col("next").alias("label")))
        scratch.drop(new)
        if same:
            scratch.drop(both)
            return labels
