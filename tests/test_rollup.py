import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from bandrisk.functions import exact
from bandrisk.functions.bands import BANDS, Band, band_condition, band_label, band_table
from bandrisk.functions.indexes import INDEX_KEYS, index_table
from bandrisk.operators import classify, rollup
from bandrisk.operators.join import settlement_hazard
from tests.data import EDGE_LABELS, EDGE_VALUES, executed, hazard, settlement, small_country


def test_band_edges(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(EDGE_VALUES)], "i int, v double")
    hits = [F.expr(band_condition("v", b)).alias(b.key) for b in BANDS]
    rows = df.select("i", "v", band_label("v").alias("label"), *hits).orderBy("i").collect()
    assert [r.label for r in rows] == EDGE_LABELS
    for row in rows:
        inside = [b.label for b in BANDS if row[b.key]]
        if row.v is not None and math.isnan(row.v):
            assert inside == ["Very High"] and row.label == "None"
        else:
            assert inside == ([] if row.label == "None" else [row.label])


def test_cells_on_band_edges(spark):
    """Populations are distinct powers of two, so every cell tells exactly whom it counted."""
    n = range(len(EDGE_VALUES))
    h = hazard(spark, [(i, "01", "0101", EDGE_VALUES[i]) for i in n])
    s = settlement(spark, [(i, "01", "A", "0101", "A1", float(2**i)) for i in n])
    row = rollup.banded_sum(settlement_hazard(h, s)).first()
    for band in BANDS:
        # NaN, the last value, has no label but counts as above every bound.
        expected = float(sum(2**i for i in n if EDGE_LABELS[i] == band.label))
        expected += 2.0 ** n[-1] if band.key == "very_high" else 0
        assert [row[rollup.cell_name(i, band)] for i in INDEX_KEYS] == [expected] * 5


def test_sums_do_not_depend_on_their_order(spark):
    """A tenth of a person each: added as doubles the sum would depend on the partitions."""
    h = hazard(spark, [(i, "01", "0101", 3.0) for i in range(995)])
    s = settlement(spark, [(i, "01", "A", "0101", "A1", 0.1) for i in range(995)])
    found = set()
    for parts in (1, 3, 8):
        joined = settlement_hazard(h.repartition(parts), s.repartition(parts))
        found.add(rollup.banded_sum(joined).first().lsi_ku_low)
        found.add(rollup.national_total(rollup.admin_cube(joined)).first().lsi_ku_low)
        assert {r.pop_total for r in rollup.baseline_totals(s.repartition(parts)).collect()} == {99.5}
    assert found == {100.0}


def test_sums_lose_nothing(spark):
    """Sums of doubles of any size are those of exact arithmetic, in any partitions; NaN and infinities stay."""
    groups = {
        "tiny": [4e-7] * 5,
        "far apart": [1e13, 4e-7, -1e13, 4e-7],
        "cancelled": [1e308, 1e308, -1e308, 5e-324, 0.1, -1e308],
        "tenths": [0.1, 0.2, 0.3, -0.6] * 9,
        "none": [None, 0.0, -0.0, None],
        "huge": [1.7e308] * 3,
        "nan": [1.0, math.nan, math.inf],
        "infinite": [1.0, math.inf, 1e13, math.inf],
        "both": [math.inf, -math.inf],
        "mixed": [(-1) ** n * 1.1**n for n in range(-400, 400)],
    }
    rows = [(name, value) for name, values in groups.items() for value in values]
    df = spark.createDataFrame(rows, "k string, m double")
    for parts in (1, 7):
        raw = rollup.with_parts(df.repartition(parts), "m").groupBy("k", exact.BIN).agg(F.expr(f"{exact.summed()} as s"))
        got = {r.k: r.s for r in rollup.finish(rollup.merge_cells(raw, ["k"], ["s"]), ["k"], ["s"]).collect()}
        for name, values in groups.items():
            known = [v for v in values if v is not None]
            if name in ("nan", "both"):
                assert math.isnan(got[name])
            elif name in ("infinite", "huge"):
                assert got[name] == math.inf
            else:
                assert got[name] == float(sum(map(Fraction, known), Fraction(0))), name


def test_one_bad_population_spoils_only_its_sums(spark):
    values = [4e-7, 1e13, math.nan, math.inf, 2.5, None]
    h = hazard(spark, [(i, "01", f"010{i}", 3.0) for i in range(6)])
    s = settlement(spark, [(i, "01", "A", f"010{i}", f"A{i}", v) for i, v in enumerate(values)])
    levels = {r.code: r for r in rollup.level_totals(rollup.admin_cube(settlement_hazard(h, s))).collect()}
    found = [levels[f"010{i}"].lsi_ku_low for i in range(6)]
    assert found[:2] == [0.0, 1e13] and math.isnan(found[2]) and found[3:] == [math.inf, 3.0, 0.0]
    assert math.isnan(levels["01"].lsi_ku_low) and levels["01"].lsi_ku_high == 0.0
    base = {r.code: r.pop_total for r in rollup.baseline_totals(s).collect()}
    assert base["0100"] == 4e-7 and base["0101"] == 1e13 and math.isnan(base["0102"]) and base["0105"] == 0.0


def test_other_bands_and_measures(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 3.0, 7), ("b", 3.0, 11)], "k string, depth double, houses int")
    bands = (Band("wet", "Wet", 0.0, 2.0), Band("deep", "Deep", 2.0, None))
    rows = rollup.banded_sum(df, ["k"], ["depth"], "houses", bands).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [("a", 5.0, 7.0), ("b", 0.0, 11.0)]


def test_empty_input_gives_one_row_of_zeros(spark):
    joined = settlement_hazard(hazard(spark, []), settlement(spark, []))
    assert set(rollup.banded_sum(joined).first().asDict().values()) == {0.0}
    levels = rollup.level_totals(rollup.admin_cube(joined)).collect()
    assert len(levels) == 1 and levels[0].scope_level == "country" and levels[0].lsi_ku_high == 0.0
    assert rollup.province_children(rollup.admin_cube(joined)).count() == 0


def test_rounding_is_half_away_from_zero_and_last(spark):
    h = hazard(spark, [(1, "01", "0101", 2.0), (2, "01", "0102", 2.0), (3, "02", "0201", 5.0)])
    s = settlement(
        spark,
        [(1, "01", "A", "0101", "A1", 0.5), (2, "01", "A", "0102", "A2", 0.5), (3, "02", "B", "0201", "B1", 2.5)],
    )
    cube = rollup.admin_cube(settlement_hazard(h, s))
    levels = {r.code: r.lsi_ku_low for r in rollup.level_totals(cube).collect()}
    assert levels["0101"] == 1.0 and levels["0102"] == 1.0 and levels["01"] == 1.0
    assert rollup.national_total(cube).first().lsi_ku_high == 3.0


def test_levels_and_children(spark):
    h, s = small_country(spark)
    cube = rollup.admin_cube(settlement_hazard(h, s))
    levels = {(r.scope_level, r.code): r for r in rollup.level_totals(cube).collect()}
    assert set(levels) == {
        ("country", None),
        ("province", "01"),
        ("province", "02"),
        ("province", "7"),
        *[("district", c) for c in ("0101", "0102", "0201", "701")],
    }
    assert levels["province", "02"].lsi_ku_moderate == 80.0  # by the settlement's own province
    assert levels["country", None].lsi_ku_very_high == 41.0  # 99 has no settlement
    children = [(r.code, r.na_en) for r in rollup.by_name(rollup.province_children(cube)).collect()]
    assert children == [("01", "A"), ("01", "B"), ("02", "B"), ("7", None)]


def test_repeated_ids_fan_out(spark):
    h = hazard(spark, [(1, "01", "0101", 2.0), (1, "01", "0101", 2.0)])
    s = settlement(spark, [(1, "01", "A", "0101", "A1", 10.0)])
    assert rollup.banded_sum(settlement_hazard(h, s)).first().lsi_ku_low == 20.0


def test_bands_and_the_rest_add_up(spark):
    h, s = small_country(spark)
    joined = settlement_hazard(h, s)
    cells = rollup.cell_names()
    raw = rollup.finish(rollup.raw_cells(joined), (), cells).first().asDict()
    classified = sum(v for k, v in raw.items() if k.startswith("lsi_ku_"))
    rest = joined.where((F.col("lsi_ku") < 1) | F.col("lsi_ku").isNull()).agg(F.sum("vuid_population")).first()[0]
    assert classified + rest == joined.agg(F.sum("vuid_population")).first()[0]


def test_long_cells(spark):
    h, s = small_country(spark)
    total = rollup.banded_sum(settlement_hazard(h, s))
    rows = rollup.long_cells(total).collect()
    assert len(rows) == 25
    wide = total.first()
    assert all(wide[r.cell_key] == r.population for r in rows)
    assert [(r.index_pos, r.band_pos) for r in rows] == [(i, b) for i in range(1, 6) for b in range(1, 6)]


def test_dimension_tables(spark):
    assert [r.band_key for r in band_table(spark).orderBy("pos").collect()] == [b.key for b in BANDS]
    assert [r.index_key for r in index_table(spark).orderBy("pos").collect()] == list(INDEX_KEYS)


@pytest.mark.parametrize("source", ["levels", "table"])
def test_one_pass_over_the_big_join(spark, source, tmp_path):
    """Both halves of a union read the same shuffled cube: the tables are scanned once each."""
    from bandrisk.plans.panels import table_rows

    h, s = small_country(spark)
    h.write.parquet(str(tmp_path / "h"))
    s.write.parquet(str(tmp_path / "s"))
    cube = rollup.admin_cube(settlement_hazard(spark.read.parquet(str(tmp_path / "h")), spark.read.parquet(str(tmp_path / "s"))))
    if source == "levels":
        df = rollup.level_totals(cube)
    else:
        total = rollup.national_total(cube).withColumn("na_en", F.lit("x"))
        df = table_rows(total, rollup.province_children(cube))
    plan = executed(df)
    assert "isFinalPlan=true" in plan
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


def test_classes_profile_and_matrix(spark):
    n = len(EDGE_VALUES)
    h = hazard(spark, [(i, "01", "0101", EDGE_VALUES[i]) for i in range(n)])
    s = settlement(spark, [(i, "01", "A", "0101", "A1", 1234.5) for i in range(n)])
    profile = classify.settlement_profile(h, s).orderBy("vuid").collect()
    assert [r.lsi_ku_class for r in profile] == EDGE_LABELS
    assert profile[0].area_text == "2.5 km2"
    assert profile[0].vuid_population_text == "1,235" and profile[0].vuid_buildings_text == "3"
    assert not {"lon", "lat", "position"} & set(profile[0].asDict())
    matrix = classify.susceptibility_matrix(classify.susceptibility_class(h)).collect()
    assert len(matrix) == 5 * n
    titles = {"None": "no_risk"} | {b.label: b.key for b in BANDS}
    for row in matrix:
        marks = {k: row[k] for k in titles.values()}
        assert marks.pop(titles[EDGE_LABELS[row.vuid]]) == "X" and set(marks.values()) == {""}


def test_profile_fills_unknown_numbers_and_needs_a_hazard_row(spark):
    h = hazard(spark, [(1, "01", "0101", 2.0)])
    s = settlement(spark, [(1, "01", "A", "0101", "A1", None), (2, "01", "A", "0101", "A1", 5.0)])
    s = s.withColumns({"area_sqm": F.lit(None).cast("double"), "vuid_buildings": F.lit(None).cast("bigint")})
    profile = classify.settlement_profile(h, s)
    row = profile.first()
    assert (row.vuid_population, row.vuid_buildings, row.area_text, row.vuid_buildings_text) == (0.0, 0, "0.0 km2", "0")
    assert classify.settlement_record(profile, 1).count() == 1
    assert classify.settlement_record(profile, 2).count() == 0
