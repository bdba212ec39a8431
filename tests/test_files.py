import json

import pytest
from pyspark.sql import functions as F

from voxmill.sources import files as S


def test_meta_alias_and_missing_keys(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"modality": {"0": "CT"}, "labels": {"background": 0, "x": 1}}, indent=2))
    row = S.read_dataset_meta(spark, str(tmp_path / "a.json")).first()
    assert row["channel_names"] == {"0": "CT"} and row["labels"] == {"background": "0", "x": "1"}
    (tmp_path / "b.json").write_text(json.dumps({"channel_names": {"0": "CT"}}))
    with pytest.raises(Exception, match="labels"):
        S.read_dataset_meta(spark, str(tmp_path / "b.json")).collect()


def test_scan_reads_names_only(spark, tmp_path):
    for folder, names in (("imagesTr", ("a_0000", "a_0001", "b", ".hidden_0000")), ("labelsTr", ("a",)), ("other", ("z",))):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / f"{n}.nii.gz").write_bytes(b"x")
    (tmp_path / "imagesTr" / "notes.txt").write_text("no")
    rows = {(r["kind"], r["case_id"], r["channel"]) for r in S.scan_manifest(spark, str(tmp_path)).collect()}
    assert rows == {("image", "a", 0), ("image", "a", 1), ("image", "b", 0), ("label", "a", 0)}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("no")
    with pytest.raises(FileNotFoundError):
        S.scan_manifest(spark, str(tmp_path / "empty"))


def test_unknown_strategy_and_split(spark):
    from pyspark.sql import functions as F

    from voxmill.operators.manifest import split_manifest
    from voxmill.plans.configure import iso_spacing
    with pytest.raises(ValueError):
        iso_spacing(F.col("x"), "smallest")
    with pytest.raises(ValueError):
        split_manifest(spark.range(1), "nowhere")


def test_offenders_are_named(spark):
    from voxmill.operators.manifest import channel_mismatches, raise_if_any
    rows = [(f"c{n}", 0, f"p{n}") for n in range(8)] + [("ok", 0, "a"), ("ok", 1, "b")]
    bad = channel_mismatches(spark.createDataFrame(rows, "case_id string, channel int, path string"), 2)
    with pytest.raises(RuntimeError, match=r"wrong channels: c0, c1, c2, c3, c4 \(\+3 more\)"):
        raise_if_any(bad, "case_id", "wrong channels")
    raise_if_any(bad.limit(0), "case_id", "wrong channels")


def test_a_micro_batch_reads_the_folders_of_its_own_cases(spark, tmp_path):
    from pyspark.sql import functions as F
    voxels = spark.range(20_000).select(F.concat(F.lit("case"), (F.col("id") % 200).cast("string")).alias("case_id"), F.lit(0).alias("channel"),
                                        *[(F.floor(F.col("id") / 200 / d) % 5).cast("int").alias(a) for a, d in zip("ijk", (25, 5, 1))],
                                        F.col("id").cast("double").alias("value"))
    # a hot case: a third of all rows
    voxels = voxels.unionByName(voxels.limit(10_000).withColumn("case_id", F.lit("hot")))
    path = str(tmp_path / "voxels")
    S.write_bucketed(voxels, path, 1 << 20)
    table = spark.read.parquet(path)
    cases = [f"case{i}" for i in range(200)] + ["hot"]
    buckets = {r["case_id"]: r["b"] for r in spark.createDataFrame([(c,) for c in cases], "case_id string").select(
        "case_id", S.case_bucket(F.col("case_id"), 1 << 20).alias("b")).collect()}
    per_folder = {r["bucket"]: r["count"] for r in table.groupBy("bucket").count().collect()}
    read = 0
    for batch in range(100):
        own = cases[2 * batch:2 * batch + 2] + (["hot"] if batch == 99 else [])
        read += sum(per_folder[b] for b in {buckets[c] for c in own})
        if batch % 33 == 0:
            arrived = spark.createDataFrame([(c,) for c in own], "case_id string")
            got = S.rows_of_cases(table, arrived, 1 << 20)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
            assert got.columns == voxels.columns and {r["case_id"] for r in got.select("case_id").distinct().collect()} == set(own)
            assert got.count() == voxels.filter(F.col("case_id").isin(own)).count()
    # all batches together read the table once, up to folders that two cases share
    assert read <= 1.02 * voxels.count()
    assert S.rows_of_cases(table, spark.createDataFrame([], "case_id string"), 1 << 20).isEmpty()


def test_sketches_merge_in_any_order(spark):
    from pyspark.sql import functions as F
    from voxmill.operators import fingerprint as P
    values = spark.range(60_000).select((F.col("id") % 2).alias("channel"), F.when(F.col("id") % 3 > 0, F.pow(F.rand(1), 3) * 1000).otherwise(5.0).alias("value"),
                                        F.floor(F.col("id") / 6000).alias("batch"))
    parts = P.sketches(values, ["channel", "batch"])
    counts = P.value_counts(values, ["channel"], "value")
    whole = {r["channel"]: r for r in P.stats_of_sketches(P.sketches(values, ["channel"]), ["channel"]).collect()}
    halves = [parts.filter(f"batch % 2 = {h}").drop("batch") for h in (0, 1)]
    orders = [P.merge_sketches(parts.drop("batch"), ["channel"]),
              P.merge_sketches(P.merge_sketches(halves[1], ["channel"]).unionByName(P.merge_sketches(halves[0], ["channel"])), ["channel"])]
    for merged in orders:
        stats = P.stats_of_sketches(merged, ["channel"])
        assert all(all(v for k, v in r.asDict().items() if k.endswith("_ok")) for r in P.ranks_of(counts, stats, ["channel"]).collect())
        for r in stats.collect():
            assert all(abs(r[c] - whole[r["channel"]][c]) < 1e-9 * abs(r[c]) for c in ("mean", "std", "min", "max", "n_voxels"))


def test_pairing_repeats_no_labels(spark):
    """labels beyond what is broadcast were repeated for every salt."""
    from voxmill.operators import manifest as M
    images = spark.createDataFrame([("a", 0, "p"), ("a", 1, "q"), ("b", 0, "r"), (None, 0, "s")], "case_id string, channel int, path string")
    labels = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "case_id string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = M.pair_existing(images, labels)
        assert "_salt" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in out.select("case_id", "channel", "path").collect()) == [("a", 0, "p"), ("a", 1, "q")]
        assert out.columns == ["case_id", "channel", "path"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_a_batch_reads_its_tables_once(spark, sf, tmp_path):
    """every pass of the statistics read the case buckets anew."""
    import os
    from voxmill import session
    from voxmill.catalog import inputs
    from voxmill.operators.fingerprint import statistics_partial
    from voxmill.streaming.incremental import write_partial
    grid, labels, every = inputs.voxels(spark, sf), inputs.segs(spark, sf), inputs.cases(spark, sf)
    paths = [str(tmp_path / n) for n in ("images", "labels")]
    for table, path in zip((grid, labels), paths):
        S.write_bucketed(table, path)
    images, marks = [S.read_bucketed(spark, p) for p in paths]
    sc = spark.sparkContext
    passed = [sc.accumulator(0), sc.accumulator(0)]

    def counted(table, column, kind, total):
        def one(v):
            total.add(1)
            return v
        return table.withColumn(column, F.udf(one, kind)(column))

    batch = every.filter("case_id % 2 = 0")
    with session.scratch_tables(spark):
        before = set(os.listdir(session.shared_dir(spark).removeprefix("file:")))
        write_partial(batch, 7, counted(images, "value", "double", passed[0]), counted(marks, "label", "tinyint", passed[1]), str(tmp_path / "out"))
        assert set(os.listdir(session.shared_dir(spark).removeprefix("file:"))) == before
    assert 0 < passed[0].value <= grid.count() and 0 < passed[1].value <= labels.count()
    got = spark.read.parquet(str(tmp_path / "out" / "epoch=7"))
    half = "case_id % 2 = 0"
    want = statistics_partial(grid.filter(half), labels.filter(half), batch)
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).isEmpty()


def test_folders_are_listed_in_runs(spark, tmp_path):
    """each folder was listed by a task of its own."""
    path = str(tmp_path / "many")
    table = spark.range(150).select(F.col("id").alias("case_id"), F.lit(0).alias("i"))
    S.write_bucketed(table, path)
    sc, name = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    kept = spark.conf.get(name)
    try:
        sc.setJobGroup("listing", "listing")
        read = S.read_bucketed(spark, path)
        seen = sc.statusTracker()
        tasks = [seen.getStageInfo(s).numTasks for j in seen.getJobIdsForGroup("listing") for s in seen.getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 1 < max(tasks) <= 4 * sc.defaultParallelism < 100
    assert spark.conf.get(name) == kept
    assert read.select("case_id").distinct().count() == 150 and read.count() == 150


def test_scratch_of_a_thread_is_its_own(spark):
    """what one thread sets aside is not deleted by the block of another."""
    import threading
    from voxmill import session
    made = []
    with session.scratch_tables(spark):
        other = threading.Thread(target=lambda: made.append(session.settle(spark.range(5))))
        other.start()
        other.join()
    assert made[0].count() == 5
