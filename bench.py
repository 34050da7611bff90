"""Time the headline queries and print one line of JSON.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores.  Arguments name
other queries to time instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

from threadloom.plans.catalog import QUERIES
from threadloom.session import local_session

HEADLINE = (
    "moderated_transcript",
    "p1_sanitize_live",
    "p2_sanitize_backfill",
    "p3_postprocess_reply",
    "p6_reply_requests",
    "j2_resolve_mentions",
    "j3_thread_context",
    "j4_fuzzy_banned_match",
    "j4_documents",
    "j5_near_duplicate_reply",
    "a1_build_transcript",
    "a6_moderation_report",
    "w2_char_budget_suffix",
    "w9_negative_streak_backoff",
    "st3_cooldown_batch",
    "st4_assemble_tokens_batch",
    "st1_stream_latest_per_tick",
)


def main(names) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names or HEADLINE:
        runs = []
        for _ in range(2):  # the first run warms up code paths and caches
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
