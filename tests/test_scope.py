import pytest

from bandrisk.operators import rollup, spatial
from bandrisk.operators.join import settlement_hazard
from bandrisk.plans import dashboard, panels, scope
from bandrisk.plans.scope import Scope
from tests.data import small_country

ROUTES = [
    # flag, code, level, child level
    ("entireAfg", None, "country", "province"),
    ("entireAfg", "0101", "country", "province"),
    ("currentProvince", "01", "province", "district"),
    ("currentProvince", 12, "province", "district"),
    ("currentProvince", "7", "province", None),
    ("currentProvince", "0101", "district", None),
    ("drawArea", "01", "area", None),
    ("anything", "01", "area", None),
]
COUNTRY_AREA = "POLYGON((0 0,200 0,200 80,0 80,0 0))"


@pytest.mark.parametrize("flag, code, level, child", ROUTES)
def test_routing(flag, code, level, child):
    assert (Scope(flag, code).level, Scope(flag, code).child_level) == (level, child)


def test_routing_of_a_table_matches(spark):
    rows = [(f, None if c is None else str(c)) for f, c, _, _ in ROUTES]
    df = spark.createDataFrame(rows, "flag string, code string").select(
        scope.request_level(df_col("flag"), df_col("code")), scope.request_child_level(df_col("flag"), df_col("code"))
    )
    assert [tuple(r) for r in df.collect()] == [(level, child) for _, _, level, child in ROUTES]


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_totals_and_children_of_each_scope(spark):
    h, s = small_country(spark)

    def total(flag, code=None):
        rows = scope.scope_total(h, s, Scope(flag, code)).collect()
        assert len(rows) == 1
        return rows[0]

    def children(flag, code=None):
        return [(r.code, r.na_en) for r in scope.scope_children(h, s, Scope(flag, code)).collect()]

    assert total("entireAfg").lsi_ku_low == 10.0
    assert total("currentProvince", "02").lsi_ku_very_high == 41.0
    assert total("currentProvince", "0102").lsi_ku_high == 20.0
    assert total("currentProvince", "7").lsi_ku_very_low == 160.0
    assert set(total("currentProvince", "77").asDict().values()) == {0.0}
    assert children("entireAfg") == [("01", "A"), ("01", "B"), ("02", "B"), ("7", None)]
    assert children("currentProvince", "01") == [("0101", "A1"), ("0102", "A2")]
    assert children("currentProvince", "7") == []
    assert children("currentProvince", "0101") == []


def test_area_scope(spark):
    h, s = small_country(spark)
    areas = spark.createDataFrame([(1, 0, COUNTRY_AREA), (1, 1, COUNTRY_AREA)], "aoi_id bigint, ord int, wkt string")
    index = spatial.index_areas(areas, union=True)
    drawn = Scope("drawArea", areas=index)
    assert scope.scope_total(h, s, drawn).first() == scope.scope_total(h, s, Scope()).first()
    assert scope.scope_children(h, s, drawn).count() == 0
    with pytest.raises(ValueError):
        scope.scope_total(h, s, Scope("drawArea"))


def test_requests_in_one_job(spark):
    h, s = small_country(spark)
    areas = spark.createDataFrame(
        [(11, 0, COUNTRY_AREA), (12, 0, "POLYGON((-9 -9,-8 -9,-8 -8,-9 -9))")], "aoi_id bigint, ord int, wkt string"
    )
    cube = rollup.admin_cube(settlement_hazard(h, s))
    requests = spark.createDataFrame(
        [
            (1, "entireAfg", "", None),
            (2, "currentProvince", "02", None),
            (3, "currentProvince", "0102", None),
            (4, "currentProvince", "77", None),
            (5, "currentProvince", "7", None),
            (6, "drawArea", "", 11),
            (7, "other", "02", 12),
            (8, "currentProvince", None, None),
        ],
        "req_id bigint, flag string, code string, aoi_id bigint",
    )
    index = spatial.index_areas(areas)
    asked = areas.select("aoi_id").union(spark.createDataFrame([(13,)], "aoi_id bigint"))
    stored = scope.scope_cells(h, s, index, rollup.LEVEL_KEYS)
    by_area = scope.area_totals(stored, asked, index).cache()
    # An area without polygons has its zeros too, with and without the admin levels in the same pass.
    assert {r.aoi_id for r in by_area.collect()} == {11, 12, 13}
    alone = scope.area_totals(scope.scope_cells(h, s, index), asked, index)
    assert sorted(map(str, alone.collect())) == sorted(map(str, by_area.collect()))
    assert {r.aoi_id: r.pop_total for r in scope.area_baseline(s, asked, index).collect()} == {11: 1271.0, 12: 0.0, 13: 0.0}
    levels = rollup.level_totals(scope.level_cube(stored))
    assert sorted(map(str, levels.collect())) == sorted(map(str, rollup.level_totals(cube).collect()))
    rows = {r.req_id: r for r in scope.request_totals(requests, levels, by_area).collect()}
    cells = rollup.cell_names()
    for n, single in {
        1: Scope(),
        2: Scope("currentProvince", "02"),
        3: Scope("currentProvince", "0102"),
        5: Scope("currentProvince", "7"),
        6: Scope(),
    }.items():
        expected = scope.scope_total(h, s, single).first()
        assert [rows[n][c] for c in cells] == [expected[c] for c in cells], n
    for n in (4, 7, 8):
        assert {rows[n][c] for c in cells} == {0.0}
    children = scope.request_children(requests, cube).collect()
    assert sorted((r.req_id, r.code) for r in children) == [(1, "01"), (1, "01"), (1, "02"), (1, "7"), (2, "0201")]


def test_sections():
    assert dashboard.wanted("totals")
    assert dashboard.wanted("totals", includes=["totals"])
    assert not dashboard.wanted("totals", includes=[""])
    assert not dashboard.wanted("totals", excludes=["totals"])


def dashboard_inputs(spark):
    h, s = small_country(spark)
    return h, s, spark.createDataFrame([(100.0,)], "pop_total double")


def test_dashboard_of_the_country(spark):
    h, s, base = dashboard_inputs(spark)
    features = spark.createDataFrame([("01", "x"), ("99", "y")], "code string, shape string")
    parts = dashboard.dashboard(h, s, Scope(), base, "Country", features)
    donut = {(r.index_key, r.label): r.population for r in parts["donut"].collect()}
    # 10 + 80 + 20 + 41 at risk, of a baseline that is smaller: the rest is negative.
    assert donut["lsi_ku", "Not at Risk"] == 100.0 - 151.0
    assert len(donut) == 25
    table = panels.in_table_order(parts["table"]).where("index_key = 'lsi_ku'").collect()
    assert [(r.is_total, r.na_en) for r in table] == [
        (True, "Country"), (False, "A"), (False, "B"), (False, "B"), (False, None)
    ]
    enriched = {r.code: r for r in parts["features"].collect()}
    assert enriched["01"].na_en == "B" and enriched["01"].set_jenk_divider == 7
    assert enriched["99"].na_en is None and enriched["99"].value is None
    assert enriched["99"].set_jenk_divider is None


def test_features_of_children_need_no_totals(spark):
    h, s, base = dashboard_inputs(spark)
    features = spark.createDataFrame([("01", "x")], "code string, shape string")
    alone = dashboard.dashboard(h, s, Scope(), base, "Country", features, includes=("features",))
    assert set(alone) == {"features"}
    district = dashboard.dashboard(h, s, Scope(scope.ADMIN_FLAG, "0201"), base, "D", features, includes=("features",))
    assert set(district) == {"features"} and {r.na_en for r in district["features"].collect()} == {"D"}
    parts = dashboard.dashboard(h, s, Scope(), base, "Country", features, includes=("children", "features"))
    assert sorted(map(repr, alone["features"].collect())) == sorted(map(repr, parts["features"].collect()))
    assert set(parts) == {"children", "features"} and parts["features"].first().na_en == "B"


def test_dashboard_of_a_district(spark):
    h, s, base = dashboard_inputs(spark)
    features = spark.createDataFrame([("0102", "x"), ("99", "y")], "code string, shape string")
    parts = dashboard.dashboard(h, s, Scope("currentProvince", "0102"), base, "A2", features)
    rows = parts["features"].collect()
    assert [(r.code, r.na_en, r.lsi_ku_high, r.set_jenk_divider, r.value) for r in rows] == [
        ("0102", "A2", 20.0, 1, 0.0), ("99", "A2", 20.0, 1, 0.0)
    ]
    assert parts["table"].where("not is_total").count() == 0


def test_quick_overview_has_totals_only(spark):
    h, s, base = dashboard_inputs(spark)
    parts = dashboard.quick_overview(h, s, Scope(), base, "Country")
    assert set(parts) == {"baseline", "totals", "bar", "donut", "table"}
    assert parts["table"].count() == 5 and parts["table"].where("not is_total").count() == 0


def test_unit_without_a_code_answers_no_request(spark):
    h, s = small_country(spark)
    s = s.withColumn("prov_code_1", df_col("prov_code_1").substr(1, 0)).replace("", None, ["prov_code_1"])
    cube = rollup.admin_cube(settlement_hazard(h, s))
    requests = spark.createDataFrame([(1, "currentProvince", "")], "req_id bigint, flag string, code string")
    row = scope.request_totals(requests, rollup.level_totals(cube)).first()
    assert {row[c] for c in rollup.cell_names()} == {0.0}
