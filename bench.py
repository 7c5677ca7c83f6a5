"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the test folder, ``BENCH_CPUS`` the number of local cores. Every query runs
to its last row (the ``noop`` sink); the first, untimed one only warms the JVM up. ``BENCH_QUERIES``
may name other queries, separated by commas.
"""

from __future__ import annotations

import json
import os
import time

from bandrisk.session import local_session
from checks.registry import QUERIES, build

HEADLINE = (
    "exposure_national",
    "exposure_by_province",
    "exposure_by_district",
    "exposure_all_levels",
    "exposure_scope_batch",
    "donut_series",
    "scope_tables",
    "panel_list",
    "boundary_children",
    "susceptibility_matrix",
    "settlement_profile",
    "aoi_settlements",
    "exposure_aoi",
    "exposure_aoi_batch",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    build(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES")
    names = tuple(QUERIES) if asked == "all" else tuple(asked.split(",")) if asked else HEADLINE
    spark = local_session(cores, "bandrisk-bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "exposure_by_province", sf_dir)
    seconds = {name: run(spark, name, sf_dir) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
