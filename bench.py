"""Benchmark the headline jobs on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS]; prints ONE JSON line.

Each job's result is fully computed with the ``noop`` sink (no collect to the
driver). The canonical stored tables and the XML drop folders are prepared
first (their time is reported as ``prepare_*``, not in the total), like the
reference whose reports read tables the fetchers stored beforehand.

Every job runs twice: ``queries`` holds the second (warm JVM) run, ``cold`` the
first; the headline value is the sum of the warm runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "fy_statement",
    "bills_receivable",
    "scan_voucher_xml",
    "scan_ledger_xml",
    "resolve_contains",
    "business_summary",
    "pending_report",
    "ledger_search",
    "reconcile",
    "answer_questions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["BENCH_CPUS"] = cpus
    from ledgerflow.jobs import JOBS
    from ledgerflow.session import get_spark
    from ledgerflow.sources import store

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    prep = {}
    t = time.time()
    store.canonical_paths(spark, sf_dir)
    prep["prepare_tables"] = round(time.time() - t, 3)
    t = time.time()
    store.xml_drop_folder(spark, sf_dir, "voucher")
    store.xml_drop_folder(spark, sf_dir, "ledger")
    prep["prepare_xml"] = round(time.time() - t, 3)
    t = time.time()
    store.routed_questions_path(spark, sf_dir)
    prep["prepare_questions"] = round(time.time() - t, 3)

    cold, times = {}, {}
    for k in HEADLINE:
        for store_to in (cold, times):
            t = time.time()
            JOBS[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            store_to[k] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_warm", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "cold": cold, "prepare": prep, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
