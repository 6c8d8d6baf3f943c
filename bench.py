"""Time the headline operators; prints one JSON line.

BENCH_SF_DIR: folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS: threads of the local session (default 8)
BENCH_RUNS: runs per query, of which the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import load_all, table  # noqa: E402
from snapforge.operators.integrity import fk_violations, orphan_keys  # noqa: E402
from snapforge.operators.masking import Mask, mask_table  # noqa: E402
from snapforge.session import build_session, release_scratch  # noqa: E402

# Registered queries that are timed as they are.
NAMED = [
    "page_totals", "page_number_orders", "page_rows_lineitem", "read_page_orders", "encode_cells_orders", "pk_dup_lineitem",
    "unique_dup_part_name", "unique_dup_documents_text", "fk_orphan_keys_lineitem", "violation_report", "next_sequences",
    "diff_tables", "diff_columns", "diff_foreign_keys", "diff_catalog", "evolve_lineitem_from_diff", "manifest_merge", "data_summary",
    "retention_count_and_size", "run_summary", "latest_run", "doc_checksums", "expand_archives_documents", "fk_levels",
    "snapshot_roundtrip_lineitem", "snapshot_page_orders", "snapshot_all_tables", "page_json_lineitem", "restore_all_shop",
]


def mask_lineitem(spark, d):
    columns = {"l_returnflag": None, "l_linestatus": None, "l_partkey": None}
    return mask_table(table(spark, d, "lineitem"), columns, Mask("RANDOM", "*", seed=1), ["l_orderkey", "l_linenumber"])


def mask_documents(spark, d):
    return mask_table(table(spark, d, "documents"), {"text": None}, Mask("ORIGINAL", "*"))


def fk_lineitem_rows(spark, d):
    return fk_violations(table(spark, d, "lineitem"), table(spark, d, "orders").filter("o_totalprice < 400000"), ["l_orderkey"], ["o_orderkey"])


def fk_lineitem_orders(spark, d):
    return orphan_keys(table(spark, d, "lineitem"), table(spark, d, "orders"), ["l_orderkey"], ["o_orderkey"])


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all().queries
    timed = {f.__name__: f for f in (mask_lineitem, mask_documents, fk_lineitem_orders, fk_lineitem_rows)}
    timed.update({name: registry[name] for name in NAMED})
    table(spark, folder, "lineitem").groupBy("l_returnflag").count().collect()  # start the executors
    seconds = {}
    for name, query in timed.items():
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    release_scratch(spark)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
