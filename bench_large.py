"""Time the main jobs on ten million made settlements: ``python bench_large.py [rows] [areas]``.

A third of the settlements lie in one province and a third in one grid cell. The tables are written
once, to a folder of the session's scratch space, and the work is timed to its last row; figures of
areas are given apart from cutting the areas into cells. Prints one JSON line.
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import functions as F

from bandrisk.functions.indexes import INDEX_KEYS
from bandrisk.operators import rollup, spatial
from bandrisk.operators.join import settlement_hazard
from bandrisk.plans import scope
from bandrisk.session import local_session
from bandrisk.sources.store import Scratch


def tables(spark, scratch: Scratch, rows: int):
    part = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    hot = F.col("id") % 3 == 0
    settlement = spark.range(rows).select(
        F.col("id").alias("vuid"),
        F.when(hot, F.lit("01")).otherwise(F.format_string("%02d", part % 34 + 1)).alias("prov_code_1"),
        F.when(hot, F.lit("P01")).otherwise(F.format_string("P%02d", part % 34 + 1)).alias("prov_na_en"),
        F.format_string("%02d%02d", part % 34 + 1, part % 12).alias("dist_code"),
        F.format_string("D%02d%02d", part % 34 + 1, part % 12).alias("dist_na_en"),
        (part % 4000 / 8).alias("vuid_population"),
        F.when(F.col("id") % 3 == 1, F.lit(66.5) + part / 1e9).otherwise(60 + part % 15000 / 1000).alias("lon"),
        F.when(F.col("id") % 3 == 1, F.lit(33.5) + part / 1e9).otherwise(29 + part * 7 % 10000 / 1000).alias("lat"),
    )
    settlement = scratch.keep(settlement)
    values = [(F.pmod(F.xxhash64("vuid", F.lit(n)), F.lit(90)) / 10).alias(i) for n, i in enumerate(INDEX_KEYS)]
    codes = F.col("prov_code_1").alias("prov_code"), "dist_code"
    return scratch.keep(settlement.select("vuid", *codes, *values)), settlement


def squares(spark, count: int):
    n = F.col("id")
    x, y = 60 + n * 37 % 130 / 10, 29 + n * 53 % 80 / 10
    corners = [(x, y), (x + 2, y + 0.1), (x + 1.7, y + 2), (x + 0.2, y + 1.8), (x, y)]
    ring = F.concat_ws(",", *[F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in corners])
    return spark.range(count).select(
        n.alias("aoi_id"), F.lit(0).alias("ord"), F.concat(F.lit("POLYGON(("), ring, F.lit("))")).alias("wkt")
    )


def main(rows: int = 10_000_000, areas: int = 200) -> None:
    spark = local_session(8, "bandrisk-bench-large")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, job):
        start = time.perf_counter()
        result = job()
        seconds[name] = round(time.perf_counter() - start, 2)
        return result

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    with Scratch(spark) as scratch:
        hazard, settlement = tables(spark, scratch, rows)
        joined = settlement_hazard(hazard, settlement)
        run(rollup.banded_sum(joined))
        timed("country total", lambda: run(rollup.banded_sum(joined)))
        timed("all levels", lambda: run(rollup.level_totals(rollup.admin_cube(joined, rollup.LEVEL_KEYS))))
        asked = squares(spark, areas)
        index = timed("areas cut into cells", lambda: spatial.index_areas(asked))
        points = settlement.select("vuid", "lon", "lat")
        timed("pairs of settlement and area", lambda: run(spatial.points_by_area(points, index)))
        timed("totals of all areas", lambda: run(scope.area_totals(scope.scope_cells(hazard, settlement, index), asked, index)))
    spark.stop()
    print(json.dumps({"rows": rows, "areas": areas, "seconds": seconds}))


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
