"""Cross-validation splits: ``splits(fold, role, case_id)`` with roles train and val."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.operators.spread import rank_by_hash

# fixed values: default seed, share of training cases in the fallback split
SEED = 12345
TRAIN_SHARE = 0.8


def list_case_ids(df: DataFrame, check: bool = False) -> DataFrame:
    """Sorted identifiers; with ``check`` an empty table is an error."""
    ids = df.select("case_id").distinct().orderBy("case_id")
    if check and ids.isEmpty():
        raise FileNotFoundError("no preprocessed cases found; run preprocessing first")
    return ids


def kfold_splits(case_ids: DataFrame, k: int = 5, seed: int = SEED, stored: DataFrame | None = None) -> DataFrame:
    """Shuffled k folds; the first ``n mod k`` hold one case more. Stored splits win."""
    if stored is not None:
        return stored
    ranked = rank_by_hash(case_ids.select("case_id").distinct(), [], ["case_id"], seed)
    base, extra = F.floor(F.col("total") / k), F.col("total") % k
    long_part = extra * (base + 1)
    own = F.when(F.col("rank") < long_part, F.floor(F.col("rank") / (base + 1))) \
        .otherwise(extra + F.floor((F.col("rank") - long_part) / base)).cast("int")
    return (ranked.select("case_id", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
            .select("fold", F.when(F.col("fold") == F.col("_own"), "val").otherwise("train").alias("role"), "case_id"))


def all_case_ids(splits: DataFrame) -> DataFrame:
    return splits.select("case_id").distinct().orderBy("case_id")


def complement(cases: DataFrame, taken: DataFrame) -> DataFrame:
    return cases.select("case_id").distinct().join(taken.select("case_id").distinct(), "case_id", "left_anti")


def fold_keys(splits: DataFrame, fold) -> DataFrame:
    """(role, case_id) of a fold; ``"all"`` puts every case in both roles; a fold that is
    not in the table becomes a seeded 80/20 split."""
    if fold == "all":
        both = F.explode(F.array(F.lit("train"), F.lit("val"))).alias("role")
        return splits.select("case_id").distinct().select(both, "case_id")
    own = splits.filter(F.col("fold") == int(fold)).select("role", "case_id")
    if not own.isEmpty():
        return own
    ranked = rank_by_hash(splits.select("case_id").distinct(), [], ["case_id"], SEED + int(fold))
    inside = F.col("rank") < F.floor(F.col("total") * TRAIN_SHARE)
    return ranked.select(F.when(inside, "train").otherwise("val").alias("role"), "case_id")


def limit_cases(splits: DataFrame, max_cases: int | None) -> DataFrame:
    """First validation cases of each fold; Spark drops the rest before the shuffle."""
    val = splits.filter("role = 'val'")
    if max_cases is None:
        return val.select("fold", "case_id")
    nth = F.row_number().over(Window.partitionBy("fold").orderBy("case_id"))
    return val.withColumn("_nth", nth).filter(F.col("_nth") <= max_cases).select("fold", "case_id")
