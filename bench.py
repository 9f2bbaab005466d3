"""Seconds per headline query over a data folder; prints one JSON line.

Every query runs to the end into the ``noop`` sink: all rows are produced, none are
sent to the driver.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from checks.session import local_session  # noqa: E402

HEADLINE = """
read_auth_logs bruteforce credential_stuffing compromise_pattern multi_host_access
severity_simple ip_reputation enrich_events ip_features heuristic_anomaly isolation_forest
ip_campaigns user_state_path user_profiles insider_threats risk_scores top_factor
response_actions chain_nodes chain_edges chain_summary entropy_series tamper_regions
link_sessions pivot_points ip_narrative timeline login_frequency technique_counts
geo_breakdown executive_summary export_scored_csv
""".split()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(app="bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
