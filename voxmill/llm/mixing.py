"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents, in a hashed order that differs in each pass, form a stream of words that
ends at the source's target, and the stream is cut into blocks. The blocks of all sources are
dealt to output shards by a tree: each node splits its block counts between two children of equal
size by multivariate hypergeometric draws, so that the counts of the leaves are those of a
random permutation of all blocks, and add up exactly. A leaf draws its next blocks from each
source's permuted blocks, which no other leaf gets, and shuffles them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.common import WORD, Scratch, md5_draw, md5_of, running_sum, same, sized, text_key

#: Primes of which one is coprime to any number of blocks below their product.
STRIDES = (1_000_003, 1_000_033, 1_000_037)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size) -> src, target: shares of all words by weight, none above ``most`` sizes.

    Weights repeat over the sources in order, null last. What a source cannot take goes to the
    others by weight: they fill to one level, found by sorting sources by the level at which each is
    full. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth % len(weights) + 1).cast("int"))
    full = sizes.select("source", "source_size", nth.alias("src"), w.alias("w"),
                        (F.col("source_size") * F.lit(float(most))).alias("full"))
    by_level = Window.orderBy(F.col("full") / F.col("w"), "src")
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("full").over(earlier), F.lit(0.0))) / F.sum("w").over(rest)
    full = full.withColumn("level", level).withColumn("is_full", F.col("level") * F.col("w") > F.col("full"))
    common = F.min_by("level", F.when(~F.col("is_full"), F.col("full") / F.col("w"))).over(Window.partitionBy())
    return full.select("source", "source_size", "src",
                       F.when(F.col("is_full"), F.col("full")).otherwise(common * F.col("w")).alias("target"))


def _ln_factorial(n: Column) -> Column:
    x = F.greatest(n, F.lit(1)).cast("double")
    series = (x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
              + 1 / (1260 * x * x * x * x * x))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked ones among ``drawn`` of ``total``, by inversion of the uniform number ``u``.

    The sum runs over ten standard deviations to either side, outside of which the probability
    is below what a double can tell from 0.
    """
    mean = drawn * marked / F.greatest(total, F.lit(1))
    spread = F.sqrt(F.greatest(mean * (1 - marked / F.greatest(total, F.lit(1))), F.lit(0.0)))
    lowest, highest = F.greatest(F.lit(0).cast("bigint"), drawn - (total - marked)), F.least(marked, drawn)
    lo = F.greatest(lowest, F.floor(mean - 10 * spread - 10).cast("bigint"))
    hi = F.least(highest, F.ceil(mean + 10 * spread + 10).cast("bigint"))
    first = F.exp(_ln_choose(marked, lo) + _ln_choose(total - marked, drawn - lo) - _ln_choose(total, drawn))
    start = F.struct(first.alias("p"), F.lit(0.0).alias("sum"), F.lit(-1).cast("bigint").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        ratio = ((marked - x) * (drawn - x)) / ((x + 1).cast("double") * (total - marked - drawn + x + 1))
        reached = acc["sum"] + acc["p"]
        return F.struct((acc["p"] * ratio).alias("p"), reached.alias("sum"),
                        F.when((acc["at"] < 0) & (reached >= u), x).otherwise(acc["at"]).alias("at"))

    found = F.aggregate(F.sequence(lo, hi), start, step, lambda acc: F.when(acc["at"] < 0, hi).otherwise(acc["at"]))
    return F.when(lo >= hi, lo).otherwise(found)


def _left_counts(counts: Column, node: Column, drawn: Column, seed: str) -> Column:
    """Counts of each source in the first ``drawn`` of a random order of the node's blocks."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    start = F.struct(total.alias("rest"), drawn.alias("want"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, count: Column) -> Column:
        draw = F.pmod(F.xxhash64(F.lit(seed), node, F.size(acc["out"])), F.lit(1 << 52)).cast("double") / float(1 << 52)
        took = hypergeometric(acc["rest"], count, acc["want"], draw)
        # bound once: the draw is used three times
        return F.transform(F.array(took), lambda t: F.struct(
            (acc["rest"] - count).alias("rest"), (acc["want"] - t).alias("want"),
            F.concat(acc["out"], F.array(t)).alias("out")))[0]

    return F.aggregate(counts, start, step, lambda acc: acc["out"])


def splitting_tree(scratch: Scratch, quotas: DataFrame, depth: int, seed: str) -> DataFrame:
    """(src, blocks) -> (shard, src, first, blocks): each of ``2 ** depth`` shards' share of each source.

    ``first`` is where the shard's share begins among the source's permuted blocks. A node carries
    one count per source.
    """
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("src", "blocks"))).alias("all")).select(
        F.lit(1).cast("bigint").alias("node"), F.col("all.src").alias("srcs"), F.col("all.blocks").alias("counts"))
    for level in range(depth):
        half = F.floor(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x) / 2).cast("bigint")
        nodes = nodes.withColumn("left", _left_counts(F.col("counts"), F.col("node"), half, seed))
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")),
                           F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts")))
        nodes = nodes.select("srcs", F.explode(children).alias("c")).select("c.node", "srcs", "c.counts")
        if level % 4 == 3:
            nodes = scratch.keep(nodes.repartition("node"))
    leaves = nodes.select((F.col("node") - (1 << depth)).alias("shard"),
                          F.explode(F.arrays_zip("srcs", "counts")).alias("q"))
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.select("shard", F.col("q.srcs").alias("src"), F.col("q.counts").alias("blocks"))
    return leaves.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)))


def mix(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0, block_words: int = 512,
        shard_blocks: int = 4096, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Deal the words of all documents to shards so that sources get their target shares.

    Returns (pieces, rows). ``pieces`` has shard, slot (a shuffled order in the shard), source, doc_id,
    tkey, pass, first_word, n_words: which words of a document go where. ``rows`` has one row per
    input row: doc_id, tkey, source, size, source_size, target. A source's pieces add up to its target,
    rounded to a word; a word is taken at most ceil(most) times. Null texts have no words, null
    sources are a source of their own, rows that repeat a doc_id are taken each by itself as far as
    their texts differ. Empty tables give none; other columns are ignored. Everything is drawn
    from hashes of the seed, so reruns agree.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.keep(docs.select("doc_id", "source", text_key().alias("tkey"), word_count(F.col("text")).alias("size")))
    sizes = counted.groupBy("source").agg(F.sum("size").alias("source_size"))
    stop = F.round("target").cast("bigint")
    targets = scratch.keep(source_targets(sizes, weights, most).withColumns(
        {"stop": stop, "blocks": F.ceil(stop / block_words).cast("bigint")}))
    rows = counted.alias("l").join(targets.alias("r"), same("l", "r", "source")).select("l.*", "src", "source_size", "target", "stop", "blocks")
    total = targets.agg(F.sum("blocks")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, total) / shard_blocks)))

    passes = F.floor(F.col("stop") / F.col("source_size")).cast("bigint")
    passing = rows.filter("size > 0 AND stop > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), passes)))
    passing = passing.filter(F.col("pass") * F.col("source_size") < F.col("stop"))
    # rows that repeat a doc_id differ by text; equal ones may change places
    passing = passing.withColumn("order", md5_of(seed, F.col("pass"), F.col("doc_id")))
    passing = scratch.keep(passing.withColumn("draw", md5_draw(seed, F.col("pass"), F.col("doc_id"))))
    placed = running_sum(scratch, passing, ["src", "pass"], "draw", ["order", "doc_id", "tkey"], "size", "before")
    at = F.col("pass") * F.col("source_size") + F.col("before")
    placed = placed.withColumn("at", at).withColumn("end", F.least(F.col("at") + F.col("size"), F.col("stop"))).filter("at < end")
    lo, hi = F.floor(F.col("at") / block_words), F.floor((F.col("end") - 1) / block_words)
    cut = placed.withColumn("block", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    begin = F.greatest(F.col("at"), F.col("block") * block_words)
    n_words = F.least(F.col("end"), (F.col("block") + 1) * block_words) - begin
    stride = F.lit(STRIDES[-1])
    for prime in reversed(STRIDES[:-1]):
        stride = F.when(F.col("blocks") % prime != 0, F.lit(prime)).otherwise(stride)
    permuted = F.pmod(F.col("block") * stride + F.pmod(F.xxhash64(F.lit(seed), "src"), F.col("blocks")), F.col("blocks"))
    cut = cut.select("src", "source", "doc_id", "tkey", "pass", (begin - F.col("at")).alias("first_word"),
                     n_words.alias("n_words"), "block", permuted.alias("drawn"))

    shares = splitting_tree(scratch, targets.filter("blocks > 0").select("src", "blocks"), depth, seed)
    drawn = shares.filter("blocks > 0").select("shard", "src", F.explode(F.sequence(
        F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("drawn"))
    # there are as many blocks as the corpus has, though the table they are counted out from is small
    pieces = cut.join(drawn.hint("merge"), ["src", "drawn"])
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "src", "drawn"), "src", "drawn", "first_word",
                                                   "pass", "doc_id", "tkey")
    pieces = pieces.withColumn("slot", F.row_number().over(shuffled) - 1)
    return (pieces.select("shard", "slot", "source", "doc_id", "tkey", "pass", "first_word", "n_words"),
            rows.select("doc_id", "tkey", "source", "size", "source_size", "target"))


def taken_words(pieces: DataFrame, rows: DataFrame) -> DataFrame:
    """How many words of each row the mix takes; equal rows share what is taken of them.

    Equal rows (doc_id, text, source) are taken together: each gets an equal part, the first ones the rest.
    """
    key = ("doc_id", "tkey", "source")
    taken = pieces.groupBy(*key).agg(F.sum("n_words").alias("sum"))
    nth = Window.partitionBy(*key).orderBy("size")
    rows = rows.withColumn("nth", F.row_number().over(nth)).withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    out = rows.alias("l").join(taken.alias("r"), same("l", "r", *key), "left").select("l.*", F.coalesce("r.sum", F.lit(0)).alias("sum"))
    even = F.floor(F.col("sum") / F.col("copies"))
    extra = (F.col("nth") <= F.col("sum") - even * F.col("copies")).cast("bigint")
    return out.select("doc_id", "size", "source_size", "target", (even + extra).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them, with all their columns: once per pass.

    A document that a source's target cuts is taken whole if at least half its words are before the cut,
    and left out otherwise. Equal rows are taken equally often, rounded up. Documents without words
    have nothing to take.
    """
    scratch = Scratch(docs.sparkSession)
    pieces, rows = mix(docs, **options)
    key = ("doc_id", "tkey", "source")
    sizes = rows.groupBy(*key).agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    passes = pieces.groupBy(*key, "pass").agg(F.sum("n_words").alias("n"))
    took = passes.alias("l").join(sizes.alias("r"), same("l", "r", *key)).select(*[f"l.{k}" for k in key], "n", "size", "rows")
    took = took.groupBy(*key).agg(F.max("rows").alias("rows"), F.sum(F.round(F.col("n") / F.col("size"))).cast("bigint").alias("n"))
    took = scratch.keep(took.select(*key, F.ceil(F.col("n") / F.col("rows")).cast("int").alias("__times")).filter("__times > 0"))
    keyed = docs.withColumn("__tkey", text_key()).alias("l")
    test = (F.col("l.__tkey") == F.col("r.tkey")) & same("l", "r", "doc_id", "source")
    out = keyed.join(sized(took, took.count()).alias("r"), test).select(*[f"l.`{c}`" for c in docs.columns], "__times")
    return out.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__nth")
