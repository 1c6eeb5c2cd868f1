"""Times the headline queries and prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

from attestor import plans
from attestor.session import local_session

HEADLINE = [
    "joi_1_canon_scan", "joi_6_bm25", "joi_9_nearest_title", "rul_16_canon_match", "src_5_segments", "src_6_page_text",
    "agg_8_per_state", "str_2_request_limit", "flt_1_marked_quotations", "aln_2_best_span",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).count()  # the session's own start is not a query
    known, times = plans.queries(), {}
    for name in HEADLINE:
        t = time.perf_counter()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").split("/sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
