"""Headline queries, timed; prints one JSON line.

Settings: BENCH_SF_DIR (tables), BENCH_CPUS (local cores). Every query is run
whole and written to the no-op sink, so all of its columns are computed.
"""

from __future__ import annotations

import json
import os
import time

QUERIES = (
    "production_orders", "matrix_typed_rows", "matrix_expand_rows", "template_selection", "planned_pieces", "row_plans",
    "product_matches", "row_readiness", "overlap_pairs", "union_coverage", "quality_scores", "containment_suppression",
    "axis_clusters", "free_bands", "art_slots", "product_sizes", "art_format_coverage", "pinned_fanout",
    "campaign_evidence_text", "campaign_signals", "source_excerpts", "document_roles", "page_evidence", "feed_posts",
    "recent_posts", "expired_projects", "idle_sessions", "job_states", "unseen_content", "repeated_images",
    "image_signatures", "text_identity",
)


def main() -> None:
    from artkiln.plans.registry import QUERIES as ALL
    from artkiln.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    ALL["stale_sources"](spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM and its code paths
    times = {}
    for name in QUERIES:
        t0 = time.perf_counter()
        ALL[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
