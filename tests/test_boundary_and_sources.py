import json

import pytest
from pyspark.sql import functions as F

from bandrisk.operators import boundary, rollup
from bandrisk.operators.join import settlement_hazard
from bandrisk.plans import panels
from bandrisk.sources import areas as area_source
from bandrisk.sources import features as feature_source
from bandrisk.sources import store, tables
from tests.data import executed, small_country


def children(spark, *rows):
    cells = rollup.cell_names()
    df = spark.createDataFrame(rows, "code string, na_en string, v double")
    return df.select("code", "na_en", *[F.col("v").alias(c) for c in cells])


def test_last_name_wins(spark):
    df = children(spark, ("01", "A", 1.0), ("01", "B", 2.0), ("02", "Z", 3.0), ("02", None, 4.0), (None, "N", 5.0))
    last = {r.code: (r.na_en, r.lsi_ku_low) for r in boundary.last_name_wins(df).collect()}
    assert last == {"01": ("B", 2.0), "02": (None, 4.0), None: ("N", 5.0)}


def test_unmatched_feature_keeps_its_own_properties(spark):
    features = spark.createDataFrame(
        [("01", "old", 9.0, 7.0), ("99", "old", 9.0, 7.0)], "code string, na_en string, value double, lsi_ku_low double"
    )
    rows = {r.code: r for r in boundary.with_children(features, children(spark, ("01", "A", 1.0))).collect()}
    assert (rows["01"].na_en, rows["01"].value, rows["01"].lsi_ku_low) == ("A", 0.0, 1.0)
    assert (rows["99"].na_en, rows["99"].value, rows["99"].lsi_ku_low) == ("old", 9.0, 7.0)
    assert "lsi_ku_very_low" not in rows["01"].asDict()


def geojson():
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    many = {"type": "MultiPolygon", "coordinates": [square["coordinates"]]}
    return {
        "type": "FeatureCollection",
        "features": [
            {
                "type": "Feature",
                "id": 17,
                "bbox": [0, 0, 1, 1],
                "geometry": square,
                "properties": {"code": "01", "shape_name": "x", "rank": 3, "note": None},
            },
            {
                "type": "Feature",
                "id": "b",
                "geometry": many,
                "properties": {"code": "99", "shape_name": "y", "rank": 4, "list": [1, {"a": None}], "na_en": None},
            },
        ],
    }


@pytest.mark.parametrize("properties", [None, "code string, shape_name string, rank bigint"])
@pytest.mark.parametrize("collection", [True, False])
def test_features_there_and_back(spark, tmp_path, collection, properties):
    document = geojson()
    source = tmp_path / "in.json"
    if collection:
        source.write_text(json.dumps(document, indent=1))
    else:
        source.write_text("\n".join(json.dumps(f) for f in document["features"]))
    features = feature_source.read_features(spark, str(source), properties, collection)
    enriched = boundary.with_children(features, children(spark, ("01", "A", 1.0)))
    feature_source.write_features(enriched, str(tmp_path / "out"))
    lines = [json.loads(line) for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    by_code = {f["properties"]["code"]: f for f in lines}
    assert [by_code[f["properties"]["code"]]["geometry"] for f in document["features"]] == [
        f["geometry"] for f in document["features"]
    ]
    assert by_code["01"]["properties"]["na_en"] == "A" and by_code["01"]["properties"]["rank"] == 3
    # What was read stays: ids, other members, and properties that are null or unknown here.
    assert by_code["99"] == document["features"][1]
    assert by_code["01"]["id"] == 17 and by_code["01"]["bbox"] == [0, 0, 1, 1]
    assert by_code["01"]["properties"]["note"] is None


@pytest.mark.parametrize("collection", [True, False])
def test_a_broken_document_fails(spark, tmp_path, collection):
    good = json.dumps(geojson() if collection else geojson()["features"][0])
    (tmp_path / "a.json").write_text(good)
    (tmp_path / "b.json").write_text(good[: len(good) // 2])
    with pytest.raises(Exception, match="MALFORMED|malformed|JSON"):
        feature_source.read_features(spark, str(tmp_path), "code string", collection).collect()


def test_features_made_here_keep_their_nulls(spark):
    df = spark.createDataFrame([("01", None)], "code string, note string")
    assert json.loads(feature_source.feature_lines(df).first().value) == {
        "type": "Feature",
        "properties": {"code": "01", "note": None},
    }


def test_a_broken_request_fails(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"aoi_id": 1, "spatialfilter": []}\n{"aoi_id": 2, "spatialf')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        area_source.read_requests(spark, str(tmp_path / "r.json")).collect()


def test_requests(spark, tmp_path):
    bodies = [
        {"aoi_id": 1, "spatialfilter": ["POLYGON((0 0,1 0,1 1,0 0))", "POLYGON EMPTY"], "flag": "drawArea", "code": ""},
        {"aoi_id": 2, "spatialfilter": [], "flag": "entireAfg", "code": ""},
    ]
    (tmp_path / "requests.json").write_text("\n".join(map(json.dumps, bodies)))
    requests = area_source.read_requests(spark, str(tmp_path / "requests.json"))
    assert requests.count() == 2
    rows = area_source.request_areas(requests).orderBy("ord").collect()
    assert [(r.aoi_id, r.ord) for r in rows] == [(1, 0), (1, 1)]


def test_read_tables_with_other_names_and_types(spark, tmp_path):
    h, s = small_country(spark)
    h.withColumn("id", F.col("vuid").cast("string")).drop("vuid").write.parquet(str(tmp_path / "h"))
    s.withColumn("vuid_population", F.col("vuid_population").cast("int")).write.option("header", True).csv(str(tmp_path / "s"))
    hazard = tables.read_hazard(spark, str(tmp_path / "h"), "parquet", rename={"vuid": "id"})
    settlement = tables.read_settlement(spark, str(tmp_path / "s"), "csv", header="true")
    assert dict(hazard.dtypes)["lsi_ku"] == "double" and dict(settlement.dtypes)["vuid_population"] == "double"
    assert settlement_hazard(hazard, settlement).count() == 6


def test_scan_reads_only_what_a_total_needs(spark, tmp_path):
    h, s = small_country(spark)
    h.write.parquet(str(tmp_path / "h"))
    s.write.parquet(str(tmp_path / "s"))
    hazard = tables.read_hazard(spark, str(tmp_path / "h"), "parquet")
    settlement = tables.read_settlement(spark, str(tmp_path / "s"), "parquet")
    joined = settlement_hazard(hazard, settlement.where(F.col("prov_code_1") == "01"), ("vuid_population",))
    plan = executed(rollup.banded_sum(joined))
    assert "ReadSchema: struct<vuid:bigint,prov_code_1:string,vuid_population:double>" in plan
    assert "EqualTo(prov_code_1,01)" in plan
    assert "prov_code:string" not in plan


def test_bucketed_tables_join_without_a_shuffle(spark):
    h, s = small_country(spark)
    store.write_bucketed(h, "bucketed_hazard", 4)
    store.write_bucketed(s, "bucketed_settlement", 4)
    joined = settlement_hazard(spark.table("bucketed_hazard"), spark.table("bucketed_settlement").hint("merge"))
    plan = executed(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 6


def test_regional_layout_prunes(spark, tmp_path):
    _, s = small_country(spark)
    store.write_by_region(s, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.vuid for r in back.collect()) == sorted(r.vuid for r in s.collect())
    assert "PartitionFilters: [isnotnull(prov_code_1" in executed(back.where("prov_code_1 = '01'"))


def test_materialise_uses_the_checkpoint_folder(spark):
    h, s = small_country(spark)
    cube = rollup.admin_cube(settlement_hazard(h, s))
    stored = store.materialise(cube)
    assert "Join" not in stored._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, stored.collect())) == sorted(map(str, cube.collect()))


def test_panel_documents(spark, tmp_path):
    h, s = small_country(spark)
    cube = rollup.admin_cube(settlement_hazard(h, s))
    levels = panels.with_baseline(rollup.level_totals(cube), rollup.baseline_totals(s))
    kids = panels.scope_children_rows(rollup.province_children(cube), rollup.district_children(cube))
    rows = panels.scope_table_rows(rollup.level_totals(cube), panels.scope_names(cube, "Country"), kids)
    documents = panels.panel_documents(levels, rows)
    panels.write_panels(documents, str(tmp_path / "panels"))
    back = spark.read.json(str(tmp_path / "panels"))
    assert back.count() == documents.count()
    doc = json.loads(back.where("scope_level = 'country' and panel = 'donut' and index_key = 'lsi_ku'").first().doc)
    assert [c["label"] for c in doc["child"]] == ["Low", "Moderate", "High", "Very High", "Not at Risk"]
    assert [c["value"] for c in doc["child"]] == [10, 80, 20, 41, 1271 - 151]
    table = [
        json.loads(r.doc)
        for r in back.where("scope_level = 'country' and panel = 'table' and index_key = 'lsi_ku'").collect()
    ]
    assert all({"key", "title", "name", "values"} == set(t) for t in table)
    places = [r.position for r in back.where("scope_level = 'country' and panel = 'table' and index_key = 'lsi_ku'").collect()]
    assert sorted(places) == list(range(1, len(table) + 1))
    assert sorted((t.get("name") or "", t["values"]) for t in table) == [
        ("", [0, 0, 0, 0]),
        ("A", [10, 0, 20, 0]),
        ("B", [0, 0, 0, 41]),
        ("B", [0, 80, 0, 0]),
        ("Country", [10, 80, 20, 41]),
    ]


def test_missing_baseline_stays_unknown(spark):
    h, s = small_country(spark)
    levels = rollup.level_totals(rollup.admin_cube(settlement_hazard(h, s)))
    base = rollup.baseline_totals(s).where("scope_level = 'country'")
    rows = panels.risk_summary(panels.with_baseline(levels, base)).where("index_key = 'lsi_ku'").collect()
    assert {r.scope_level: r.not_at_risk is None for r in rows} == {"country": False, "province": True, "district": True}
