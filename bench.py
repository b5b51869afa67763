"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mailsleuth.plans.catalog import QUERIES  # noqa: E402
from mailsleuth.plans.fixtures import PARTITIONS, Views  # noqa: E402
from mailsleuth.session import build_session  # noqa: E402

HEADLINE = ["a14_gateway_score", "a15_upload_score", "a07_url_risk", "j08_score_back", "a16_header_score", "c05_delivery_timeline", "w02_hop_delays",
            "a18_indicator_sets", "j05_network_lookup", "p02_history_search", "c01_threat_graph", "st4_enforcement", "f01_matching_text"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", PARTITIONS: cpus})
    spark.sparkContext.setLogLevel("ERROR")
    views, took, rates = Views(spark, sf_dir), {}, {}
    for name in HEADLINE:  # warm-up on the smallest tables, so that compiling is in no figure
        QUERIES[name](Views(spark, os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001"))).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](views).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    rates["messages_per_sec"] = round(views.base("documents").count() / took["a14_gateway_score"], 1)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": int(cpus), **rates}))


if __name__ == "__main__":
    main()
