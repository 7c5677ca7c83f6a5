"""Every query of the library on the test tables, by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandrisk.functions.bands import AT_RISK_BANDS
from bandrisk.operators import boundary, classify, overlay, rollup, spatial
from bandrisk.operators.join import settlement_hazard
from bandrisk.plans import dashboard, land, panels, scope, upkeep
from bandrisk.sources.areas import request_areas
from bandrisk.sources.features import read_features, write_features
from bandrisk.sources.store import Scratch, materialise, write_by_place
from checks.views import derived_view

PROVINCE = "07"
DISTRICT = "0703"
DRAWN_AREA = 1
COUNTRY_LABEL = "COUNTRY"
AREA_LABEL = "AREA"
SETTLEMENT = 1234


class Inputs:
    """The derived tables of one test folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return derived_view(self.spark, self.sf_dir, name)

    def cube(self, keys: Sequence[str]) -> DataFrame:
        return rollup.admin_cube(settlement_hazard(self.hazard, self.settlement), keys)

    def stored_cube(self) -> DataFrame:
        """The full cube, stored: jobs that use it in several ways pass over the big tables once."""
        return materialise(self.cube(rollup.CUBE_KEYS))

    def levels(self) -> DataFrame:
        return rollup.level_totals(self.cube(rollup.LEVEL_KEYS))

    def provinces(self) -> DataFrame:
        return rollup.province_children(self.cube(rollup.PROVINCE_KEYS))

    def based_levels(self) -> DataFrame:
        return panels.with_baseline(self.levels(), rollup.baseline_totals(self.settlement))


def _total(t: Inputs, flag: str, code: str | None = None) -> DataFrame:
    return scope.scope_total(t.hazard, t.settlement, scope.Scope(flag, code))


def _children(t: Inputs, flag: str, code: str | None = None) -> DataFrame:
    return scope.scope_children(t.hazard, t.settlement, scope.Scope(flag, code))


def _points(t: Inputs) -> DataFrame:
    return t.settlement.select("vuid", "lon", "lat")


def aoi_settlements(t: Inputs) -> DataFrame:
    return spatial.points_by_area(_points(t), spatial.index_areas(t.aoi)).select("aoi_id", "vuid")


def aoi_settlement_shapes(t: Inputs) -> DataFrame:
    return overlay.shapes_by_area(t.shape, t.aoi, spatial.index_areas(t.aoi)).select("aoi_id", "vuid")


def exposure_aoi_shapes(t: Inputs) -> DataFrame:
    return scope.shape_totals(t.hazard, t.settlement, t.shape, t.aoi, spatial.index_areas(t.aoi))


def baseline_land_cover(t: Inputs) -> DataFrame:
    """Population and buildings by kind of land, of all admin units and the suppliers' areas."""
    areas = land.land_areas(t.land, spatial.index_areas(t.block_area))
    return land.land_levels(t.land).unionByName(areas)


def aoi_union_settlements(t: Inputs) -> DataFrame:
    return spatial.points_in_areas(_points(t), spatial.index_areas(t.aoi, union=True)).select("vuid")


def exposure_aoi(t: Inputs) -> DataFrame:
    areas = spatial.index_areas(t.aoi.where(F.col("aoi_id") == DRAWN_AREA), union=True)
    return scope.scope_total(t.hazard, t.settlement, scope.Scope(scope.AREA_FLAG, areas=areas))


def exposure_aoi_by_place(t: Inputs) -> DataFrame:
    """One drawn area over settlements that are laid out by place."""
    path = Scratch(t.spark).path()
    write_by_place(t.settlement, path, rows_in_file=2000)
    areas = spatial.index_areas(t.aoi.where(F.col("aoi_id") == DRAWN_AREA), union=True)
    return scope.scope_total(t.hazard, t.spark.read.parquet(path), scope.Scope(scope.AREA_FLAG, areas=areas))


def exposure_levels_kept(t: Inputs) -> DataFrame:
    """All levels from a stored cube and two changes: settlements that came, and some that had been counted twice."""
    path = Scratch(t.spark).path()
    keys = rollup.LEVEL_KEYS
    joined = settlement_hazard(t.hazard, t.settlement, ("vuid_population", *keys))
    old, late, twice = joined.where("vuid % 4 <> 1"), joined.where("vuid % 4 = 1"), joined.where("vuid % 4 = 2")
    upkeep.write_change(upkeep.change_of(old.unionByName(twice), None, keys), path, "base")
    upkeep.write_change(upkeep.change_of(late, twice, keys), path, "day")
    return rollup.level_totals(upkeep.current_cube(t.spark, path, keys))


def exposure_by_province_collated(t: Inputs) -> DataFrame:
    """Provinces in the order of a dictionary, numbered."""
    children = t.provinces().withColumn("na_en", F.expr("if(code = '07', lower(na_en), na_en)"))
    order = Window.orderBy(rollup.named("UNICODE_CI").asc_nulls_last(), F.col("code").asc_nulls_last(), "na_en")
    return children.select("code", "na_en", F.row_number().over(order).alias("position"), "lsi_ku_low")


def exposure_aoi_batch(t: Inputs) -> DataFrame:
    index = spatial.index_areas(t.aoi)
    return scope.area_totals(scope.scope_cells(t.hazard, t.settlement, index), t.aoi, index)


def exposure_scope_batch(t: Inputs) -> DataFrame:
    index = spatial.index_areas(t.aoi)
    cells = scope.scope_cells(t.hazard, t.settlement, index, rollup.LEVEL_KEYS)
    levels = rollup.level_totals(scope.level_cube(cells))
    return scope.request_totals(t.scope_request, levels, scope.area_totals(cells, t.aoi, index))


def baseline_aoi(t: Inputs) -> DataFrame:
    return scope.area_baseline(t.settlement, t.aoi, spatial.index_areas(t.aoi))


def aoi_panel_list(t: Inputs) -> DataFrame:
    """Panels of every drawn area, from request bodies."""
    requests = t.aoi_request
    index = spatial.index_areas(request_areas(requests))
    totals = scope.area_totals(scope.scope_cells(t.hazard, t.settlement, index), requests, index)
    based = totals.join(scope.area_baseline(t.settlement, requests, index), "aoi_id")
    return panels.area_panel_documents(based, AREA_LABEL)


def boundary_geojson(t: Inputs) -> DataFrame:
    """The provinces' features written as GeoJSON, read again and enriched."""
    path = Scratch(t.spark).path()
    write_features(t.boundary, path)
    read = read_features(t.spark, path, "code string, shape_name string")
    return boundary.with_children(read, t.provinces()).drop("feature", "geometry")


def boundary_district_children(t: Inputs) -> DataFrame:
    districts = rollup.district_children(t.cube(rollup.DISTRICT_KEYS)).drop("parent_code")
    return boundary.with_children(t.district_boundary, districts)


def table_with_total(t: Inputs) -> DataFrame:
    cube = t.cube(rollup.PROVINCE_KEYS)
    total = rollup.national_total(cube).withColumn("na_en", F.lit(COUNTRY_LABEL))
    return panels.in_table_order(panels.table_rows(total, rollup.province_children(cube)))


def scope_tables(t: Inputs, cube: DataFrame | None = None) -> DataFrame:
    cube = t.stored_cube() if cube is None else cube
    children = panels.scope_children_rows(rollup.province_children(cube), rollup.district_children(cube))
    names = panels.scope_names(cube, COUNTRY_LABEL)
    return panels.scope_table_rows(rollup.level_totals(cube), names, children)


def panel_list(t: Inputs) -> DataFrame:
    cube = t.stored_cube()
    totals = panels.with_baseline(rollup.level_totals(cube), rollup.baseline_totals(t.settlement))
    return panels.panel_documents(totals, scope_tables(t, cube))


def quick_overview(t: Inputs) -> DataFrame:
    pop_total = t.settlement.agg(F.sum("vuid_population").alias("pop_total"))
    parts = dashboard.quick_overview(t.hazard, t.settlement, scope.Scope(), pop_total, COUNTRY_LABEL)
    band_rows = F.array(
        *[
            F.struct(F.lit(n).alias("pos"), F.lit(b.label).alias("label"), F.col(b.key).alias("population"))
            for n, b in enumerate(AT_RISK_BANDS, start=1)
        ]
    )
    columns = ("index_pos", "index_key", "title", "pos", "label", "population")
    table = parts["table"].select("index_pos", "index_key", "title", F.inline(band_rows))
    named = [("donut", parts["donut"]), ("bar", parts["bar"]), ("table", table)]
    first, *rest = [df.select(F.lit(name).alias("panel"), *columns) for name, df in named]
    for df in rest:
        first = first.unionByName(df)
    return first


def boundary_parent(t: Inputs) -> DataFrame:
    total = _total(t, scope.ADMIN_FLAG, DISTRICT)
    return boundary.with_scope_total(t.boundary, total, DISTRICT)


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    "exposure_national": lambda t: _total(t, scope.COUNTRY_FLAG),
    "exposure_province": lambda t: _total(t, scope.ADMIN_FLAG, PROVINCE),
    "exposure_district": lambda t: _total(t, scope.ADMIN_FLAG, DISTRICT),
    "exposure_by_province": lambda t: _children(t, scope.COUNTRY_FLAG),
    "exposure_by_district": lambda t: _children(t, scope.ADMIN_FLAG, PROVINCE),
    "exposure_all_levels": lambda t: t.levels(),
    "exposure_long": lambda t: rollup.long_cells(t.levels(), panels.SCOPE_IDS),
    "exposure_scope_batch": exposure_scope_batch,
    "exposure_scope_children": lambda t: scope.request_children(t.scope_request, t.stored_cube()),
    "baseline_population": lambda t: rollup.baseline_totals(t.settlement),
    "at_risk_summary": lambda t: panels.risk_summary(t.based_levels()).drop("not_at_risk"),
    "not_at_risk": lambda t: panels.risk_summary(t.based_levels()).select(
        *panels.SCOPE_IDS, "index_key", "not_at_risk"
    ),
    "bar_series": lambda t: panels.bar_series(t.levels()),
    "donut_series": lambda t: panels.donut_series(t.based_levels()),
    "table_with_total": table_with_total,
    "scope_tables": scope_tables,
    "panel_list": panel_list,
    "quick_overview": quick_overview,
    "child_last_wins": lambda t: boundary.last_name_wins(t.provinces()),
    "boundary_children": lambda t: boundary.with_children(t.boundary, t.provinces()),
    "boundary_parent": boundary_parent,
    "boundary_geojson": boundary_geojson,
    "boundary_district_children": boundary_district_children,
    "susceptibility_class": lambda t: classify.susceptibility_class(t.hazard),
    "susceptibility_matrix": lambda t: classify.susceptibility_matrix(classify.susceptibility_class(t.hazard)),
    "settlement_profile": lambda t: classify.settlement_profile(t.hazard, t.settlement),
    "settlement_documents": lambda t: classify.settlement_documents(
        classify.settlement_profile(t.hazard, t.settlement)
    ),
    "settlement_record": lambda t: classify.settlement_record(
        classify.settlement_profile(t.hazard, t.settlement), SETTLEMENT
    ),
    "aoi_edges": lambda t: spatial.area_edges(t.aoi),
    "aoi_settlements": aoi_settlements,
    "aoi_settlement_shapes": aoi_settlement_shapes,
    "exposure_aoi_shapes": exposure_aoi_shapes,
    "baseline_land_cover": baseline_land_cover,
    "aoi_union_settlements": aoi_union_settlements,
    "exposure_aoi": exposure_aoi,
    "exposure_aoi_by_place": exposure_aoi_by_place,
    "exposure_levels_kept": exposure_levels_kept,
    "exposure_by_province_collated": exposure_by_province_collated,
    "exposure_aoi_batch": exposure_aoi_batch,
    "baseline_aoi": baseline_aoi,
    "aoi_panel_list": aoi_panel_list,
}


def build(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Inputs(spark, sf_dir))
