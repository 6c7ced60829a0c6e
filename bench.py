"""Time the headline queries: one JSON line on stdout.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run to the end (all columns are computed and thrown away).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "score_message",
    "score_message_weighted",
    "score_class",
    "score_element",
    "fail_counts",
    "skip_counts",
    "info_results",
    "chk_numeric",
    "chk_negative",
    "chk_past",
    "chk_timestamp",
    "chk_element_clean",
    "chk_regex",
    "chk_external_list_joined",
    "chk_concept_active",
    "chk_concept_consistent",
    "chk_concept_two_codings",
    "chk_value_matches_type",
    "criterion_conditional",
    "criterion_prereq_chain",
    "flatten_messages",
    "message_scores",
    "message_result_counts",
    "message_path_equals_table_path",
    "lab_to_message",
    "lab_scores",
    "assessment_extract",
    "audited_message",
    "content_range",
    "run_compare",
    "results_by_status",
]


def main() -> None:
    from rubrica.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rubrica-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("rubrica.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    lab = times.get("lab_scores")
    out = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": int(cpus),
        "state": "cold plans, warm JVM",
    }
    if lab:
        rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
        out["lab_messages_per_sec"] = round(rows / lab, 1)
        out["reference_lab_rows_per_sec"] = 10.81
    print(json.dumps(out))


if __name__ == "__main__":
    main()
