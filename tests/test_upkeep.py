"""Stored totals, layouts, rewrites and what the join leaves out."""

import math

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from bandrisk.functions.geometry import place_key
from bandrisk.operators import boundary, rollup, spatial
from bandrisk.operators.join import settlement_hazard
from bandrisk.plans import panels, upkeep
from bandrisk.sources import features, store
from tests.data import executed, hazard, settlement, small_country


def totals(cube):
    return sorted(map(repr, rollup.level_totals(cube).collect()))


def test_changes_add_up_to_the_full_pass(spark, tmp_path):
    h = hazard(spark, [(i, "01", f"010{i % 3}", float(i % 9)) for i in range(60)])
    values = [4e-7, 1e13, 0.1, math.nan, math.inf, None]
    s = settlement(spark, [(i, "01", "A", f"010{i % 3}", "D", values[i % 6] if i < 12 else i / 7) for i in range(60)])
    joined = settlement_hazard(h, s)
    path = str(tmp_path / "cube")
    upkeep.write_change(upkeep.change_of(joined.where("vuid < 50"), None), path, "base")
    upkeep.write_change(upkeep.change_of(joined.where("vuid >= 40"), joined.where("vuid < 12")), path, "day")
    # A change that is written again counts once.
    late = upkeep.change_of(None, joined.where("vuid >= 40 and vuid < 50"))
    upkeep.write_change(late, path, "more")
    upkeep.write_change(late, path, "more")
    expected = rollup.admin_cube(joined.where("vuid >= 12"))
    assert totals(upkeep.current_cube(spark, path)) == totals(expected)
    upkeep.compact(spark, path, str(tmp_path / "one"))
    assert totals(upkeep.current_cube(spark, str(tmp_path / "one"))) == totals(expected)
    # As many rows come to a group as go from it.
    upkeep.write_change(upkeep.change_of(joined.where("vuid < 6"), joined.where("vuid between 18 and 23")), path, "swap")
    swapped = joined.where("vuid >= 12 and vuid not between 18 and 23 or vuid < 6")
    assert totals(upkeep.current_cube(spark, path)) == totals(rollup.admin_cube(swapped))
    upkeep.write_change(upkeep.change_of(joined.where("vuid between 18 and 23"), joined.where("vuid < 6")), path, "back")
    # Groups without rows are gone.
    upkeep.write_change(upkeep.change_of(None, joined.where("vuid >= 12")), path, "end")
    assert upkeep.current_cube(spark, path).count() == 0
    with pytest.raises(ValueError):
        upkeep.change_of(None, None)


def test_what_the_join_leaves_out(spark, tmp_path):
    h = hazard(spark, [(1, "01", "0101", 2.0), (1, "01", "0101", 3.0), (2, "01", "0101", 2.0), (9, "01", "0101", 2.0),
                       (None, "01", "0101", 2.0)])
    s = settlement(spark, [(1, "01", "A", "0101", "A1", 10.0), (2, "01", "A", "0101", "A1", 5.0), (2, "01", "A", "0101", "A1", 7.0),
                           (8, "01", "A", "0101", "A1", 1.0)])
    h.write.parquet(str(tmp_path / "h"))
    s.write.parquet(str(tmp_path / "s"))
    h, s = (spark.read.parquet(str(tmp_path / name)) for name in "hs")
    losses = Observation("losses")
    counted = rollup.banded_sum(settlement_hazard(h, s, losses=losses))
    row = counted.first()
    assert losses.get == {
        "matched": 4, "hazard_only": 2, "settlement_only": 1, "repeated_hazard": 1, "repeated_settlement": 1,
    }
    assert row == rollup.banded_sum(settlement_hazard(h, s)).first()
    assert executed(counted).split("Initial Plan")[0].count("Scan parquet") == 2


def test_layout_by_place_skips_row_groups(spark, tmp_path):
    columns = ("id as vuid", "id * 7919 % 36000 / 100D - 180 as lon", "id * 104729 % 18000 / 100D - 90 as lat")
    df = spark.range(40_000).selectExpr(*columns).union(spark.sql("select 40000L, null, 1D")).repartition(16)
    plain, placed = str(tmp_path / "plain"), str(tmp_path / "placed")
    df.write.parquet(plain)
    store.write_by_place(df, placed, rows_in_file=2500)
    assert sorted(map(repr, spark.read.parquet(placed).collect())) == sorted(map(repr, df.collect()))

    def touched(path):
        count = 0
        for file in sorted((tmp_path / path.rpartition("/")[2]).glob("*.parquet")):
            meta = pq.ParquetFile(file).metadata
            for n in range(meta.num_row_groups):
                group = meta.row_group(n)
                spans = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
                lon, lat = spans["lon"], spans["lat"]
                if lon.has_min_max and lon.max >= 10 and lon.min <= 20 and lat.max >= 10 and lat.min <= 20:
                    count += 1
        return count

    assert touched(plain) == 16 and touched(placed) <= 4
    wkt = "POLYGON((10 10,20 10,20 20,10 20,10 10))"
    areas = spark.createDataFrame([(1, 0, wkt)], "aoi_id bigint, ord int, wkt string")
    index = spatial.index_areas(areas, union=True)
    found = [spatial.points_in_areas(spark.read.parquet(p), index) for p in (plain, placed)]
    assert "GreaterThanOrEqual(lon" in executed(found[1])
    assert sorted(r.vuid for r in found[0].collect()) == sorted(r.vuid for r in found[1].collect())


def test_place_keys_are_bits_in_turn(spark):
    places = [(-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (12.3, -45.6), (999.0, -999.0), (None, 1.0), (math.nan, 1.0)]
    rows = spark.createDataFrame(places, "lon double, lat double").selectExpr("*", f"{place_key('lon', 'lat')} as k").collect()

    def expected(lon, lat):
        steps = [min(max(math.floor((v - low) / (span / (1 << 20))), 0), (1 << 20) - 1) for v, low, span in ((lon, -180, 360), (lat, -90, 180))]
        return sum(((steps[axis] >> bit) & 1) << (2 * bit + axis) for bit in range(20) for axis in (0, 1))

    assert [r.k for r in rows[:5]] == [expected(*p) for p in places[:5]] and [r.k for r in rows[5:]] == [None, None]


def test_a_rewrite_replaces_one_scope(spark, tmp_path):
    h, s = small_country(spark)
    levels = panels.with_baseline(rollup.level_totals(rollup.admin_cube(settlement_hazard(h, s))), rollup.baseline_totals(s))
    cube = rollup.admin_cube(settlement_hazard(h, s))
    kids = panels.scope_children_rows(rollup.province_children(cube), rollup.district_children(cube))
    tables = panels.scope_table_rows(rollup.level_totals(cube), panels.scope_names(cube, "Country"), kids)
    documents = panels.panel_documents(levels, tables)
    path = str(tmp_path / "panels")
    charts = documents.where("panel <> 'table'")
    panels.write_panels(charts, path)
    before = spark.read.json(path).count()
    panels.write_panels(charts.where("scope_level = 'province'").limit(3), path)
    after = spark.read.json(path)
    written = charts.where("scope_level = 'province'").select("panel").distinct().count()
    assert after.where("scope_level <> 'province'").count() == charts.where("scope_level <> 'province'").count()
    assert 0 < before - after.count() and written == 2
    broken = charts.withColumn("doc", F.expr("if(scope_level = 'country', raise_error('stop'), doc)"))
    kept = sorted(map(repr, spark.read.json(path).collect()))
    with pytest.raises(Exception, match="stop"):
        panels.write_panels(broken, path)
    assert sorted(map(repr, spark.read.json(path).collect())) == kept


def test_a_request_keeps_the_features_of_others(spark, tmp_path):
    path = str(tmp_path / "features")
    some = spark.createDataFrame([("01", "one"), ("02", "two")], "code string, shape_name string")
    features.write_features(some, path, "a")
    features.write_features(some, path, "b")
    features.write_features(some.where("code = '01'"), path, "a")
    rows = spark.read.text(path).groupBy("request").count().collect()
    assert {r.request: r["count"] for r in rows} == {"a": 1, "b": 2}


def test_collated_names(spark):
    names = ["zebra", "Äpfel", "apple", "Zoo", "éclair", "Eclair", "Banana", None]
    children = spark.createDataFrame([(f"{n}", name) for n, name in enumerate(names)], "code string, na_en string")
    by_bytes = [r.na_en for r in rollup.by_name(children).collect()]
    assert by_bytes == ["Banana", "Eclair", "Zoo", "apple", "zebra", "Äpfel", "éclair", None]
    collated = [r.na_en for r in rollup.by_name(children, "UNICODE").collect()]
    assert collated == ["Äpfel", "apple", "Banana", "Eclair", "éclair", "zebra", "Zoo", None] or collated == [
        "apple", "Äpfel", "Banana", "Eclair", "éclair", "zebra", "Zoo", None,
    ]
    one = children.withColumn("code", F.lit("01")).where("na_en is not null")
    assert boundary.last_name_wins(one).first().na_en == "éclair"
    assert boundary.last_name_wins(one, "UNICODE").first().na_en == "Zoo"
