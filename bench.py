"""Wall-clock of the headline queries; prints one JSON line.

Each query runs twice into the no-op sink and the better time counts, so JVM
warm-up is left out.  ``$BENCH_SF_DIR``, ``$BENCH_CPUS`` and ``$BENCH_QUERIES``
(comma-separated names, or ``all``) choose what runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_site_report",
    "p1_canonical_sources",
    "p2_page_meta",
    "p3_page_links",
    "p4_text_gate",
    "p7_stream_links",
    "p10_clip_documents",
    "p11_plain_text",
    "j1_saved_lookup",
    "j5_same_site_links",
    "j7_rewrite_images",
    "j12_take_within_ttl",
    "j13_translate_segments",
    "a1_tag_counts",
    "a2_collect_quotes",
    "a3_thread_documents",
    "a7_distinct_media",
    "w1_latest_per_source",
    "w2_plan_images",
    "w5_retain_last",
    "w7_admit_by_budget",
    "u2_pending_minus_done",
    "x1_chunk_documents",
    "x3_document_units",
    "x7_table_markdown",
    "e1_with_engine",
]


def main() -> None:
    from gleanery.catalog import QUERIES
    from gleanery.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else (wanted.split(",") if wanted else HEADLINE)
    spark = build_session(
        "gleanery-bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
