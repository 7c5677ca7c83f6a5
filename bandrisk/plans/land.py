"""The land-cover baseline: population and buildings by kind of land, for admin units and drawn areas.

Land cover is a table of polygons with the people and buildings on each. An admin unit has those with its
code; a drawn area has the part of each that it shares with the polygon, as if they were spread evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandrisk.functions import exact
from bandrisk.operators.overlay import shared_sums
from bandrisk.operators.rollup import finish, with_parts
from bandrisk.operators.spatial import AreaIndex
from bandrisk.sources.store import materialise

MEASURES = {"pop_total": "area_population", "building_total": "area_buildings"}


def _sums(long: DataFrame, by_kind: bool) -> DataFrame:
    """Rounded exact sums of both measures by level, code and kind, from rows of a measure with parts."""
    keys = ["scope_level", "code", *(("kind",) if by_kind else ())]
    # NULL measures leave a row of nothing, so a group of them counts as zero.
    raw = long.groupBy(*keys, "_measure", exact.BIN).agg(F.expr(f"{exact.summed()} as _sum"))
    sums = finish(raw, (*keys, "_measure"), ["_sum"], "round({})")
    wide = [F.coalesce(F.max(F.when(F.col("_measure") == m, F.col("_sum"))), F.lit(0.0)).alias(m) for m in MEASURES]
    return sums.groupBy(*keys).agg(*wide)


def land_levels(land: DataFrame, by_kind: bool = True) -> DataFrame:
    """``scope_level, code[, kind], pop_total, building_total`` of the country and every province and district.

    ``land(prov_code, dist_code, kind, area_population, area_buildings)``. Rows without a kind are a kind of their own.
    """
    level = F.array(
        *[
            F.struct(F.lit(name).alias("scope_level"), code.cast("string").alias("code"))
            for name, code in (
                ("country", F.lit(None)), ("province", F.col("prov_code")), ("district", F.col("dist_code"))
            )
        ]
    )
    listed = F.array(*[F.struct(F.lit(m).alias("_measure"), F.col(c).cast("double").alias("_value")) for m, c in MEASURES.items()])
    rows = land.select("*", F.inline(level)).select("scope_level", "code", *(("kind",) if by_kind else ()), F.inline(listed))
    return _sums(with_parts(rows, "_value"), by_kind)


def land_areas(land: DataFrame, index: AreaIndex, by_kind: bool = True) -> DataFrame:
    """The same for drawn areas, whose id is the code: each polygon's figures by the share of it that an area covers.

    Areas without land have no row. Polygons are told apart by row, so ids may be missing or repeated.
    """
    numbered = materialise(
        land.select("kind", *MEASURES.values(), "wkt").withColumn("_land", F.monotonically_increasing_id())
    )
    sums = shared_sums(numbered, index, "_land", "kind", MEASURES)
    rows = sums.withColumns({"scope_level": F.lit("area"), "code": F.col("aoi_id").cast("string")})
    return _sums(rows, by_kind)
