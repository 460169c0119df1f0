"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice, from reading the files to the last row. The second time counts, when
the code of the engine is compiled; the first is given beside it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardline.plans.queries import QUERIES  # noqa: E402
from wardline.session import local_session  # noqa: E402

HEADLINE = (
    "governed_brand_rows", "multi_user_extract", "consented_rows", "consent_as_of",
    "access_decisions", "decision_matrix_rollup", "eligibility", "token_issue",
    "token_verdicts", "classify_text", "pii_kinds", "redact_text", "govern_documents",
    "govern_rows", "injection_assess", "injection_scan_rows", "state_read", "cache_invalidate",
    "entitlements", "denial_windows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE
    first, seconds = {}, {}
    for run in (first, seconds):
        for name in names:
            start = time.perf_counter()
            # Every row of the result is computed and none is sent to the driver.
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            run[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time",
                      "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1],
                      "first_run": first}))


if __name__ == "__main__":
    main()
