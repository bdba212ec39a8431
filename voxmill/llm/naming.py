"""Exact dedup by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are
sorted and numbered; then adjacent pairs of numbers are sorted and numbered, and so on, until
one number is left per document. Two documents get the same number exactly when their
texts are equal: numbers are given to contents, never to hashes of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import SPACES, Scratch

ROW = ("doc_id", "text_sha256")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _numbered(content: DataFrame, *order: str) -> DataFrame:
    """Sort distinct contents within their partitions and number them."""
    return content.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _blocks(docs: DataFrame, size: int, digest) -> DataFrame:
    """One row per block: the row it is of, its place, how many there are, its bytes and their hash."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("_norm"))
    texts = texts.select("doc_id", F.sha2("_norm", 256).alias("text_sha256"), F.encode("_norm", "UTF-8").alias("_bytes"))
    texts = texts.withColumn("n", F.greatest(F.ceil(F.octet_length("_bytes") / size), F.lit(1)).cast("bigint"))
    cut = texts.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    block = F.substring(F.col("_bytes"), (F.col("at") * size + 1).cast("int"), F.lit(size))
    return cut.select(*ROW, "n", "at", block.alias("block")).withColumn("h", digest(F.col("block")))


def _name_blocks(scratch: Scratch, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of the distinct blocks, and the blocks' rows with their names.

    The hash of a block only says where its name is found. Contents that share a hash are
    numbered apart, and for these (none, as a rule) rows and names are matched by content.
    """
    names = blocks.groupBy("h").agg(F.collect_set("block").alias("contents"))
    names = names.select("h", (F.size("contents") > 1).alias("clash"), F.explode("contents").alias("block"))
    names = scratch.keep(_numbered(names, "h", "block").select(
        "h", "name", F.when(F.col("clash"), F.col("block")).alias("told")))
    clashes = names.filter(F.col("told").isNotNull()).select("h").distinct()
    told = F.lit(None).cast("binary")
    if not clashes.isEmpty():
        blocks = blocks.join(clashes.withColumn("clash", F.lit(True)), "h", "left")
        told = F.when(F.col("clash"), F.col("block"))
    rows = blocks.withColumn("told", told).drop("block").alias("l")
    named = rows.join(names.alias("r"), (F.col("l.h") == F.col("r.h")) & F.col("l.told").eqNullSafe(F.col("r.told")))
    return names, named.select(*[f"l.{c}" for c in (*ROW, "n", "at")], "name")


def name_documents(docs: DataFrame, size: int = 4096, digest=F.xxhash64) -> DataFrame:
    """(doc_id, text_sha256, copies, level, name): ``(level, name)`` identifies the text.

    ``copies`` counts rows that repeat both doc_id and text.
    """
    scratch = Scratch(docs.sparkSession)
    names, named = _name_blocks(scratch, _blocks(docs, size, digest))
    # rows that repeat doc_id and text have the same names; they are counted, not lost
    state = scratch.keep(named.groupBy(*ROW, "n", "at").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("copies")))
    scratch.drop(names)
    level = 0
    done: DataFrame | None = None
    while True:
        single = state.filter(F.col("n") == 1).select(*ROW, "copies", F.lit(level).alias("level"), "name")
        done = single if done is None else done.unionByName(single)
        state = state.filter(F.col("n") > 1)
        if state.isEmpty():
            return done
        half = F.floor(F.col("at") / 2).cast("bigint")
        # an odd last name is paired with -1, which is no name
        pairs = state.groupBy(*ROW, F.ceil(F.col("n") / 2).cast("bigint").alias("n"), half.alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            F.max("copies").alias("copies"))
        pairs = scratch.keep(pairs)
        names = scratch.keep(_numbered(pairs.select("a", "b").distinct(), "a", "b"))
        state = scratch.keep(pairs.join(names, ["a", "b"]).drop("a", "b"))
        scratch.drop(pairs, names)
        level += 1


def exact_dedup(docs: DataFrame, size: int = 4096, digest=F.xxhash64) -> DataFrame:
    """Group rows of equal normalised text; the row with the smallest doc_id stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row. A null text
    counts as empty, and empty texts equal each other. A null doc_id takes part and is larger
    than any other; of rows that repeat doc_id and text, one is kept. A group without any doc_id
    keeps one row and has a null keep_id. Empty tables give none; other columns are ignored.
    Any group of copies is only counted and joined, never gathered.
    """
    scratch = Scratch(docs.sparkSession)
    named = scratch.keep(name_documents(docs, size, digest))
    # written first: a join of two plain exchanges is one whose hot groups adaptive execution splits
    groups = scratch.keep(named.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return (named.join(groups, ["level", "name"])
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
            .select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256"))
