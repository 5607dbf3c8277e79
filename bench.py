"""Time the queries: one JSON line. ``BENCH_SF_DIR`` picks the tables, ``BENCH_CPUS`` the local threads."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tagweave.plans.registry import QUERIES  # noqa: E402

HEADLINE = [
    "product_text", "product_tags", "grouped_reviews_min4", "sample_per_type", "stratified_split", "tag_pools", "tag_profile", "rewrite_tags",
    "label_vocab", "category_priors", "category_baseline", "max_pool", "prior_blend", "allow_mask", "select_tags", "predict_tags",
    "tag_replies", "rerank_apply", "micro_macro_f1", "tune_global", "tune_labels", "losses", "similar_pairs", "nearest_canonical",
    "tag_clusters", "token_windows", "token_scorer", "review_chunks", "predict_long", "reviews_csv_blocks", "evaluate", "similar_pairs_lsh", "resumed_output",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tagweave-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        # First run warms code generation and files, the second is reported.
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = Path(folder).name.removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
