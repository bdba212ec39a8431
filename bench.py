"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_ALL=1   every registered query instead of the headline ones
"""

from __future__ import annotations

import json
import os
import re
import time

from voxmill.catalog import load
from voxmill.session import build_session

HEADLINE = (
    "nonzero_mask", "nonzero_bbox", "crop_to_bbox", "crop_and_pad_image", "uncrop", "mark_outside",
    "foreground_intensity_stats", "label_class_ratios", "geometry_summary", "dataset_fingerprint",
    "sample_with_replacement", "sample_locations", "target_spacing", "configurations",
    "group_cases", "match_labels", "kfold_splits", "ready_runs", "sorted_listing",
    "cross_validation_summary", "segmentation_confusion", "surface_distance_scores", "ensemble_average",
    "normalize_ct", "normalize_zscore_masked", "resample_labels", "resample_linear", "resample_cubic",
    "fill_holes", "signed_distance", "patch_bbox", "extract_patches_image", "affine_warp", "gaussian_blur",
    "gamma", "cutmix", "preprocess_labels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds: dict[str, float] = {}
    for name in names:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
