"""Building blocks that keep work spread out when one key holds most rows.

A single case, channel or dataset may own a third of all voxels, so nothing here
gathers a group into one task: joins to per-group tables are salted, ranks and
percentiles are found through bounded histograms, grids are generated slab by
slab. Nothing is sampled or dropped; results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.columns import AXES, token
from voxmill.session import settle

SALTS = 32
MOST_SALTS = 1024
#: Bytes of the large side, by Spark's estimate, for each salt.
SALT_BYTES = 4 << 30
UNKNOWN_BYTES = 1 << 60
#: Rows of a per-group table that are broadcast, some 100 bytes each; larger ones are shuffled.
BROADCAST_ROWS = 250_000
CHUNK = 4096


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a table's size, by which it decides what to broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def read_bytes(df: DataFrame) -> int:
    """Bytes of the tables a plan reads. Spark's estimate of a join is the product of its sides, which says nothing of its rows."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(n).stats().sizeInBytes())) for n in range(leaves.size()))


def attach(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
           salts: int | None = None) -> DataFrame:
    """Join a per-group table to the rows of the groups.

    A per-group table below the broadcast threshold is joined as it is, which Spark does by
    broadcast. Otherwise it is written and counted, as its estimate comes from the voxels it was
    made from; up to BROADCAST_ROWS rows are broadcast, once each and never repeated. Beyond that
    the rows of a hot group are dealt over salts by a hash of the row's place (so a retried task
    deals them alike) and the per-group table is repeated once per salt. Estimates ignore that it is
    repeated, so that join is held to a merge join: no repeated row comes to the driver. Adaptive
    execution measures and splits what is still too large. The number of salts follows the size of
    the tables read for the large side, unless given or set as ``voxmill.salts`` in the session.
    Without a broadcast threshold (-1) nothing is broadcast.
    """
    spark = big.sparkSession
    threshold = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    if estimated_bytes(small) <= threshold:
        return big.join(small, list(on), how)
    if threshold >= 0:
        small = settle(small)
        if small.count() <= BROADCAST_ROWS:
            return big.join(F.broadcast(small), list(on), how)
    if salts is None:
        size = read_bytes(big)
        # rows that are not from files have no size
        by_size = SALTS if size >= UNKNOWN_BYTES else min(MOST_SALTS, max(SALTS, -(-size // SALT_BYTES)))
        salts = int(spark.conf.get("voxmill.salts", str(by_size)))
    # coordinates tell rows of a group apart; without them, any columns that can be hashed
    plain = [f.name for f in big.schema.fields if f.name not in on and f.dataType.typeName() not in ("map", "variant")]
    rest = [c for c in AXES if c in plain] or plain or list(on)
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in rest]), F.lit(salts)))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                              F.lit(salts - 1).cast("bigint"))))
    return dealt.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")


def bounded(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A settled table as a side of a join: left to Spark up to BROADCAST_ROWS rows, held to a merge join beyond.

    Spark knows a table by its files, which take one to four bytes a row where numbers repeat. Millions of rows
    then pass for a small table, and their broadcast, some 100 bytes each, comes to the driver whole. ``rows`` is
    the number of rows where it is known.
    """
    return table if (table.count() if rows is None else rows) <= BROADCAST_ROWS else table.hint("merge")


def dealt(df: DataFrame) -> DataFrame:
    """The rows over all tasks, for work that costs far more than reading a row.

    A file of a few MB is read by one task. The number of partitions is given, as adaptive execution would
    otherwise merge them by their bytes, which say nothing of the work.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *[F.col(c) for c in df.columns if c in _hashable(df)])


def numbered(df: DataFrame, count: str, out: str) -> DataFrame:
    """Repeat each row ``count`` times with ``out`` = 0..count-1.

    Large counts are cut in chunks that are dealt to different tasks before the
    rows themselves are made.
    """
    last = F.floor((F.col(count) - 1) / CHUNK)
    chunks = (
        df.filter(F.col(count) > 0)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    )
    chunks = chunks.repartition(*[F.col(c) for c in chunks.columns])
    first = F.col("_chunk") * CHUNK
    until = F.least(first + CHUNK, F.col(count).cast("bigint")) - 1
    return chunks.withColumn(out, F.explode(F.sequence(first, until))).drop("_chunk")


def grid(df: DataFrame, lo: Sequence[Column], hi: Sequence[Column]) -> DataFrame:
    """All (i, j, k) in [lo, hi) for every row; empty boxes give no rows.

    One slab (fixed i) is the unit that tasks share, never a whole volume.
    """
    def span(a: int) -> Column:
        return F.when(hi[a] > lo[a], F.sequence(lo[a].cast("int"), (hi[a] - 1).cast("int"))) \
            .otherwise(F.array().cast("array<int>"))

    slabs = df.withColumn("_j", span(1)).withColumn("_k", span(2)).withColumn("i", F.explode(span(0)))
    slabs = slabs.repartition(*[F.col(c) for c in [*df.columns, "i"] if c in _hashable(slabs)])
    return (slabs.withColumn("j", F.explode("_j")).withColumn("k", F.explode("_k"))
            .drop("_j", "_k"))


def _hashable(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if f.dataType.typeName() != "map"}


def rank_by_hash(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed,
                 digits: int = 4) -> DataFrame:
    """Adds ``rank`` (0-based, order of md5(seed|ids) within ``keys``) and ``total``.

    The same numbers as ``row_number() over (partition by keys order by md5)``, but
    a group is sorted in 16**digits pieces: the leading digits of the hash pick the
    piece, and each piece starts where the ones before it end.
    """
    keys = list(keys) or ["_all"]
    marked = df if "_all" not in keys else df.withColumn("_all", F.lit(0))
    marked = (marked.withColumn("_token", token(F.lit(seed), *[F.col(c) for c in ids]))
              .withColumn("_piece", F.substring("_token", 1, digits)))
    pieces = marked.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    starts = pieces.select(
        *keys, "_piece",
        (F.sum("_n").over(whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_start"),
        F.sum("_n").over(whole).alias("total"),
    )
    local = Window.partitionBy(*keys, "_piece").orderBy("_token", *ids)
    return (marked.withColumn("_nth", F.row_number().over(local) - 1)
            .join(starts, [*keys, "_piece"])
            .withColumn("rank", F.col("_start") + F.col("_nth"))
            .drop("_token", "_piece", "_start", "_nth", "_all"))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact, mergeable summary of a value column: one row per distinct value."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v"))
            .agg(F.count(F.lit(1)).alias("n")))


def percentiles_of_counts(counts: DataFrame, keys: Sequence[str], probs: dict[str, float],
                          buckets: int = 65536) -> DataFrame:
    """Linearly interpolated percentiles, one column per entry of ``probs``.

    ``counts`` holds (keys, v, n) and is read three times, so it should be settled.
    A histogram of at most ``buckets`` cells per key tells which cell holds a wanted
    rank; only the distinct values of these cells are put in order. The cells are
    logarithmic, so that a few extreme values do not squeeze all others into one.
    """
    keys = list(keys)

    def scale(c: Column) -> Column:
        return F.signum(c) * F.log1p(F.abs(c))

    span = counts.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    width = scale(F.col("_hi")) - scale(F.col("_lo"))
    part = F.when(width > 0, (scale(F.col("v")) - scale(F.col("_lo"))) / width).otherwise(0.0)
    celled = attach(counts, span, keys).select(
        *keys, "v", "n", F.least(F.floor(part * buckets), F.lit(buckets - 1)).cast("int").alias("_cell"))
    order = Window.partitionBy(*keys).orderBy("_cell")
    hist = celled.groupBy(*keys, "_cell").agg(F.sum("n").alias("_n"))
    hist = settle(hist.select(
        *keys, "_cell", "_n",
        F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_end"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total")))
    ends = (F.col("_end") - F.col("_n"), F.col("_end"))

    positions = [F.lit(p) * (F.col("_total") - 1) for p in probs.values()]
    ranks = F.array_distinct(F.array(*[r.cast("bigint") for p in positions for r in (F.floor(p), F.ceil(p))]))
    cells = (hist.withColumn("_ranks", F.filter(ranks, lambda r: (r >= ends[0]) & (r < ends[1])))
             .filter(F.size("_ranks") > 0)
             .select(*keys, "_cell", "_total", ends[0].alias("_base"), "_ranks"))
    members = attach(celled, cells, [*keys, "_cell"])
    inside = Window.partitionBy(*keys, "_cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ended = members.withColumn("_stop", F.col("_base") + F.sum("n").over(inside))
    hit = F.filter("_ranks", lambda r: (r >= F.col("_stop") - F.col("n")) & (r < F.col("_stop")))
    at_rank = (ended.withColumn("_rank", F.explode(hit))
               .groupBy(*keys, "_total")
               .agg(F.map_from_entries(F.collect_list(F.struct("_rank", "v"))).alias("_at")))

    def interpolated(pos: Column) -> Column:
        low = F.element_at("_at", F.floor(pos).cast("bigint"))
        high = F.element_at("_at", F.ceil(pos).cast("bigint"))
        return low + (high - low) * (pos - F.floor(pos))

    return at_rank.select(*keys, *[interpolated(pos).alias(name) for name, pos in zip(probs, positions)])


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str,
                      probs: dict[str, float]) -> DataFrame:
    """Percentiles of a raw column; see :func:`percentiles_of_counts`."""
    return percentiles_of_counts(settle(value_counts(df, keys, value)), keys, probs)
