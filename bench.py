"""Times headline queries on ``$BENCH_SF_DIR`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from normlake.queries import QUERIES
from normlake.session import build_session

HEADLINE = (
    "page_link_report", "u06_url_candidates", "u17_url_policy", "t01_scalar_inventory", "t05_whitespace_inventory", "t11_merge_spans",
    "n10_canonicalize_text", "n12_serialize_document", "r02_gate_status", "r07_review_audit", "r08_lineage_integrity", "v01_manifest_audit",
    "v08_canary_search", "v15_assurance_classify", "m09_revalidate", "m10_integrity_sweep", "i08_frequency_evidence", "o04_reading_order",
    "x01_elapsed_since_import", "x04_trace_ring",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.read.parquet(f"{folder}/region.parquet").count()
    timings = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": sf}))


if __name__ == "__main__":
    main()
