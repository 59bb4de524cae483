"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS
(default 8) the local cores, BENCH_QUERIES a comma-separated choice.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mediarec import build_session, queries  # noqa: E402
from mediarec.operators.staging import drop_stages  # noqa: E402

HEADLINE = (
    "static_filter filter_funnel core_filter_5 core_filter_fixpoint item_meta user_meta assign_splits "
    "prepare_dataset export_slices split_manifest build_index index_interactions als_implicit clean_texts "
    "pool_segments clip_power_normalized topk_similar per_user_metrics evaluate_slices "
    "fit_fusion_ridge ablation evaluate_content").split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        # The test tables are tiny: let them spread over the cores all the same.
        spark__sql__adaptive__coalescePartitions__minPartitionSize="64k", spark__sql__files__openCostInBytes="64k")
    spark.sparkContext.setLogLevel("ERROR")
    registry = queries.registry()
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up cost
    took = {}
    for name in names:
        start = time.perf_counter()
        registry[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    drop_stages(spark)
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
