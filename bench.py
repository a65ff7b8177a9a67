"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the no-op sink (the whole plan
executes, nothing is collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from winnow.plans.registry import all_queries  # noqa: E402
from winnow.session import get_spark  # noqa: E402

HEADLINE = ("scan_sources", "token_report", "classify", "merge_shards", "completed_keys", "make_blocks",
            "holdout_split", "lm_metrics", "topk_next", "history", "fewshot_prompt", "mean_pool",
            "ternary_quantize", "word_counts", "bpe_encode")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus * 2, app_name="winnow-bench")
    qs = all_queries()
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(10).write.format("noop").mode("overwrite").save()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    times, failed = {}, {}
    for name in names:
        t0 = time.time()
        try:
            qs[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as exc:  # keep measuring the others; report the failure
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus,
        "input_rows": {"documents": docs, "conversations": convs},
        **({"failed": failed} if failed else {}),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
