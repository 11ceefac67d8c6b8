"""Times headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all) choose the input
and the local cores.  Every result row is produced (noop sink); nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from keelson.fixtures import load
from keelson.queries import CATALOG
from keelson.session import build_session

HEADLINE = [
    "flagship_sector_fusion", "A02_A03_A04_P11_radar_bins", "A01_vote_fusion", "J14_frame_point_matching", "J02_attitude_nearest",
    "J04_box_gate", "J06_F05_A12_association_chain", "A11_J26_waterline_contact", "A10_water_edge", "J11_A17_P37_target_table",
    "P28_P29_P30_gated_mixture", "W02_sector_confirmation", "W05_score_persistence", "H01_heading_recommendation", "A19_average_precision",
    "A21_stratified_report", "A44_conservative_regrid", "W12_activity_sessions", "W15_latest_per_key", "J15_box_scoring", "A36_condition_matrix",
    "W18_box_tracks",
]


def main() -> int:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEM", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    load(spark, sf, "lineitem").write.format("noop").mode("overwrite").save()      # warm-up
    times = {}
    for n in names:
        t = []
        for _ in range(runs):
            t0 = time.perf_counter()
            CATALOG[n].build(spark, sf).write.format("noop").mode("overwrite").save()
            t.append(time.perf_counter() - t0)
            spark.catalog.clearCache()
        times[n] = round(statistics.median(t), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").split("sf")[-1]}), flush=True)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
