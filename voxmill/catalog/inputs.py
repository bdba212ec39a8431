"""Test tables derived from the given ones: Spark form, and the same as SQL text.

Eight embedding vectors make one 8x8x8 case. A ball whose radius depends on the case is
the body; outside it the value is 0. Channel 1 is -2*value+1 inside the ball.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    vec = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("p", "e"))
    cells = vec.select(
        F.floor(F.col("vec_id") / 8).alias("case_id"),
        (F.col("vec_id") % 8).cast("int").alias("i"),
        F.floor(F.col("p") / 8).cast("int").alias("j"),
        (F.col("p") % 8).alias("k"),
        F.col("e").cast("double").alias("e"), F.col("label").alias("elabel"))
    radius2 = sum((F.col(a) - 3.5) * (F.col(a) - 3.5) for a in "ijk")
    return cells.withColumn("body", radius2 <= 4 + 2 * (F.col("case_id") % 5))


def one_channel(spark: SparkSession, sf: str) -> DataFrame:
    return grid_cells(spark, sf).select(
        "case_id", F.lit(0).alias("channel"), "i", "j", "k",
        F.when(F.col("body"), F.col("e")).otherwise(0.0).alias("value"))


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    second = F.when(F.col("body"), F.col("e") * -2.0 + 1.0).otherwise(0.0)
    first = F.when(F.col("body"), F.col("e")).otherwise(0.0)
    both = F.array(F.struct(F.lit(0).alias("channel"), first.alias("value")),
                   F.struct(F.lit(1).alias("channel"), second.alias("value")))
    return grid_cells(spark, sf).select("case_id", F.inline(both), "i", "j", "k") \
        .select("case_id", "channel", "i", "j", "k", "value")


def segs(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("body") & (F.col("e") > 0), 1 + F.col("elabel") % 3).otherwise(0)
    return grid_cells(spark, sf).select("case_id", "i", "j", "k", label.cast("tinyint").alias("label"))


def cases(spark: SparkSession, sf: str) -> DataFrame:
    per_case = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("case_id")) \
        .agg(F.count(F.lit(1)).cast("int").alias("nx"))
    sx = F.lit(0.5) + F.lit(0.1) * (F.col("case_id") % 7)
    sz = F.when(F.col("case_id") % 3 == 0, 4.0).otherwise(1.0)
    return per_case.select(
        "case_id", (F.col("case_id") % 3).alias("dataset_id"),
        F.array(F.col("nx"), F.lit(8), F.lit(8)).alias("shape"),
        F.array(sx, sx, sz).alias("spacing"))


# CTE texts with the same rows for the SQL oracles
GRID = """
grid AS (
  SELECT case_id, i, j, k, e, elabel,
         (i-3.5)*(i-3.5) + (j-3.5)*(j-3.5) + (k-3.5)*(k-3.5) <= 4 + 2*(case_id % 5) AS body
  FROM (SELECT vec_id // 8 AS case_id, (vec_id % 8)::INT AS i, (p // 8)::INT AS j, (p % 8)::INT AS k,
               embedding[p+1]::DOUBLE AS e, label AS elabel
        FROM embeddings, range(64) t(p))),
one_channel AS (SELECT case_id, 0 AS channel, i, j, k, CASE WHEN body THEN e ELSE 0.0::DOUBLE END AS value FROM grid),
voxels AS (SELECT * FROM one_channel UNION ALL
           SELECT case_id, 1, i, j, k, CASE WHEN body THEN e * -2.0 + 1.0 ELSE 0.0::DOUBLE END FROM grid),
segs AS (SELECT case_id, i, j, k, (CASE WHEN body AND e > 0 THEN 1 + elabel % 3 ELSE 0 END)::TINYINT AS label FROM grid),
cases AS (SELECT case_id, case_id % 3 AS dataset_id, nx, 8 AS ny, 8 AS nz,
                 0.5::DOUBLE + 0.1::DOUBLE * (case_id % 7) AS sx, 0.5::DOUBLE + 0.1::DOUBLE * (case_id % 7) AS sy,
                 CASE WHEN case_id % 3 = 0 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS sz
          FROM (SELECT vec_id // 8 AS case_id, count(*)::INT AS nx FROM embeddings GROUP BY 1)),
mask AS (SELECT case_id, i, j, k, bool_or(value <> 0) AS inside FROM voxels GROUP BY ALL),
hit AS (SELECT case_id, min(i) lo0, min(j) lo1, min(k) lo2, max(i)+1 hi0, max(j)+1 hi1, max(k)+1 hi2
        FROM mask WHERE inside GROUP BY 1),
bbox AS (SELECT c.case_id, coalesce(lo0,0) lo0, coalesce(lo1,0) lo1, coalesce(lo2,0) lo2,
                coalesce(hi0,nx) hi0, coalesce(hi1,ny) hi1, coalesce(hi2,nz) hi2
         FROM cases c LEFT JOIN hit USING (case_id)),
fhit AS (SELECT case_id, min(i) lo0, min(j) lo1, min(k) lo2, max(i)+1 hi0, max(j)+1 hi1, max(k)+1 hi2
         FROM (SELECT case_id, i, j, k FROM mask WHERE inside
               UNION ALL SELECT case_id, i, j, k FROM segs WHERE label > 0) GROUP BY 1),
fbbox AS (SELECT c.case_id, dataset_id, coalesce(lo0,0) lo0, coalesce(lo1,0) lo1, coalesce(lo2,0) lo2,
                coalesce(hi0,nx) hi0, coalesce(hi1,ny) hi1, coalesce(hi2,nz) hi2, nx, ny, nz, sx, sy, sz
          FROM cases c LEFT JOIN fhit USING (case_id)),
fcases AS (SELECT *, hi0-lo0 AS ax, hi1-lo1 AS ay, hi2-lo2 AS az,
                  ((hi0-lo0)*(hi1-lo1)*(hi2-lo2))::DOUBLE / (nx*ny*nz) AS crop_ratio FROM fbbox),
crop AS (SELECT v.case_id, channel, (i-lo0)::INT AS i, (j-lo1)::INT AS j, (k-lo2)::INT AS k, value
         FROM voxels v JOIN bbox b USING (case_id)
         WHERE i>=lo0 AND i<hi0 AND j>=lo1 AND j<hi1 AND k>=lo2 AND k<hi2)
"""


def with_grid(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([GRID, *more]) + "\n" + body


def udraw(*parts: str) -> str:
    """SQL text of the hashed uniform draw."""
    key = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({key}),1,13))::BIGINT / 4503599627370496.0::DOUBLE)"


def htoken(*parts: str) -> str:
    return "md5(" + " || '|' || ".join(f"({p})::VARCHAR" for p in parts) + ")"
