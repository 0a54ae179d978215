"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` selects the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from urbanloom.catalog.registry import queries  # noqa: E402
from urbanloom.scale import session  # noqa: E402

HEADLINE = [
    "operator_summary", "describe_numeric", "data_quality", "outliers_iqr", "crosstab", "diversity",
    "prepare_roads", "prepare_buildings", "sinuosity", "curvature",
    "spatial_join_within", "spatial_join_intersects", "overlap_area_join", "density_within", "nearest_line",
    "line_density_within", "context_buildings", "grid_morphology", "hex_grid",
    "zonal_stats", "slope_aspect", "distance_to_burned", "flood_susceptibility",
    "connected_components", "graph_summary", "stream_nodes", "flow_accumulation", "betweenness_sampled",
    "dbscan", "distribute_population", "zoning_conformity", "urban_pulse", "integrated_flood_risk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = session("bench", cpus=cpus)
    qs = queries()
    qs["stream_nodes"](spark, sf_dir).limit(1).collect()  # start the JVM workers before timing
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "urban_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
