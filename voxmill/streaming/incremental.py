"""Statistics of cases as they arrive.

Each micro-batch of finished cases becomes one partial table; partials add up in any
order, so the result does not depend on how the cases were batched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxmill.operators.fingerprint import merge_statistics, statistics_partial
from voxmill.session import scratch_tables, settle
from voxmill.sources.files import BUCKETS, rows_of_cases


def write_partial(cases: DataFrame, epoch: int, voxels: DataFrame, segs: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Statistics of one micro-batch. A repeated epoch replaces its own folder only.

    The batch reads the folders of its own cases, if the voxel tables are in case buckets
    (:func:`voxmill.sources.files.write_bucketed`); tables without buckets are read whole. Each is
    read once: the statistics need several passes, which go over the batch's own rows, set aside in a few files a core.
    """
    spark = voxels.sparkSession
    files = 4 * spark.sparkContext.defaultParallelism
    with scratch_tables(spark):
        cases = settle(cases)
        own, labels = (settle(rows_of_cases(table, cases, buckets).coalesce(files)) for table in (voxels, segs))
        statistics_partial(own, labels, cases).write.mode("overwrite").parquet(f"{root}/epoch={epoch}")


def stream_statistics(cases: DataFrame, voxels: DataFrame, segs: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Run over the cases that have arrived; ``cases`` is a stream, the voxel tables are not."""
    return (cases.writeStream.foreachBatch(lambda batch, epoch: write_partial(batch, epoch, voxels, segs, root, buckets))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_statistics(spark: SparkSession, root: str) -> DataFrame:
    return merge_statistics(spark.read.parquet(root).drop("epoch"))


def total_cases(partial: DataFrame) -> DataFrame:
    return partial.filter("kind = 'case'").groupBy("dataset_id").agg(F.sum("n").alias("num_cases"))
