"""Helpers the operators of this subpackage share: scratch tables, draws, running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of ids that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


#: Rows of documents that go to Python at a time: texts are long, and a batch is held on both sides.
BATCH_ROWS = 1000


def small_batches(docs: DataFrame) -> DataFrame:
    """The table itself; its session sends BATCH_ROWS rows at most to Python at a time from now on."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs


class Scratch:
    """Tables in the shared folder that belong to one run of an operator.

    ``keep`` writes a table and reads it back, which cuts lineage and survives lost
    executors; ``drop`` removes tables that later ones have made obsolete. What the
    returned DataFrame still reads stays until the shared folder is cleared.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "table")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table))[1])
            path.getFileSystem(conf).delete(path, True)


def text_key() -> Column:
    """Tells rows apart that carry the same doc_id with different texts."""
    return F.xxhash64(F.col("text"))


def same(left: str, right: str, *names: str) -> Column:
    """Null-safe equality of the named columns of two aliased tables."""
    test = F.lit(True)
    for n in names:
        test = test & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return test


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A table of keys, marked for broadcast only while it has few rows."""
    return F.broadcast(df) if rows <= limit else df


def md5_draw(*parts) -> Column:
    """Number in (0, 1) from the first 52 bits of an md5, alike in every engine."""
    head = F.conv(F.substring(md5_of(*parts), 1, 13), 16, 10).cast("bigint").cast("double")
    return (head + F.lit(0.5)) / F.lit(4503599627370496.0)


def md5_of(*parts) -> Column:
    shown = [F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws("|", *shown))


def running_sum(scratch: Scratch, df: DataFrame, keys: Sequence[str], draw: str, order: Sequence[str], value: str,
                out: str, rows_per_cell: int = 256, fan: int = 1024) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group.

    ``draw`` is a uniform number by which the group is ordered first, ``order`` the full
    order (draw first). A group may hold any share of the rows: it is cut into cells of
    about ``rows_per_cell`` rows by the draw, the sums of the cells are added up in two
    levels, and only the rows of one cell meet in a window. ``df`` is read three times,
    so it should be a kept table; ``keys`` hold no nulls.
    """
    sizes = scratch.keep(df.groupBy(*keys).agg(
        F.greatest(F.floor(F.count(F.lit(1)) / rows_per_cell), F.lit(1)).cast("bigint").alias("_cells")))
    # one row per group: Spark broadcasts it while its file is below the threshold
    cut = df.join(sizes, list(keys)).withColumn(
        "_b", F.least(F.floor(F.col(draw) * F.col("_cells")), F.col("_cells") - 1).cast("bigint")).drop("_cells")
    cells = cut.groupBy(*keys, "_b").agg(F.sum(value).alias("_v")).withColumn("_s", F.floor(F.col("_b") / fan))
    before = (Window.unboundedPreceding, -1)

    def above(column: str, *by: str) -> Column:
        return F.coalesce(F.sum(column).over(Window.partitionBy(*keys, *by[:-1]).orderBy(by[-1]).rowsBetween(*before)),
                          F.lit(0))

    supers = (cells.groupBy(*keys, "_s").agg(F.sum("_v").alias("_v"))
              .select(*keys, "_s", above("_v", "_s").alias("_above")))
    starts = (cells.join(supers, [*keys, "_s"])
              .select(*keys, "_b", (F.col("_above") + above("_v", "_s", "_b")).alias("_start")))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(*before)
    return (cut.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(starts, [*keys, "_b"])
            .withColumn(out, F.col("_start") + F.col("_in")).drop("_b", "_in", "_start"))
