"""Times the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["traj_length_km", "point_in_zone", "hillshade", "blur_k2", "rivers_fast", "quantile_mask", "fbm", "d8_direction", "flow_accumulation", "open_close", "route_zone_hits", "detour_side", "eo_tiles", "block_mean", "mercator_project", "dem_mountain", "rgb_mountain", "rivers_d8"]


def main() -> None:
    """Run every headline query once after a warm-up, into Spark's no-op sink."""
    from cartosea.plans import registry
    from cartosea.session import local_session

    cores, sf = int(os.environ.get("BENCH_CPUS", "8")), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cores=cores, partitions=cores)
    found = registry.queries()
    took = {}
    found["mercator_project"](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
