"""Small hand-made tables."""

HAZARD = "vuid bigint, prov_code string, dist_code string, lsi_immap double, lsi_ku double, ls_s1_wb double, ls_s2_wb double, ls_s3_wb double"
SETTLEMENT = (
    "vuid bigint, name_en string, prov_code_1 string, prov_na_en string, dist_code string, dist_na_en string,"
    " vuid_population double, area_population double, vuid_buildings bigint, area_sqm double, lon double, lat double"
)

# Index values on and around every band edge, and the label each must get.
EDGE_VALUES = [None, -1.0, 0.0, 0.99, 1.0, 1.99, 2.0, 3.99, 4.0, 4.99, 5.0, 6.99, 7.0, 9.0, 100.0, float("nan")]
EDGE_LABELS = ["None"] * 4 + ["Very Low"] * 2 + ["Low"] * 2 + ["Moderate"] * 2 + ["High"] * 2 + ["Very High"] * 3 + ["None"]


def hazard(spark, rows):
    """Rows of ``(vuid, prov, dist, value)``, the value standing for every index."""
    return spark.createDataFrame([(v, p, d, *[x] * 5) for v, p, d, x in rows], HAZARD)


def settlement(spark, rows):
    """Rows of ``(vuid, prov, prov_name, dist, dist_name, population)``."""
    full = [
        (v, f"S{v}", p, pn, d, dn, pop, pop, 3, 2.5e6, float(v), float(v)) for v, p, pn, d, dn, pop in rows
    ]
    return spark.createDataFrame(full, SETTLEMENT)


def small_country(spark):
    """Two provinces; the hazard table files settlement 4 under the other province."""
    h = hazard(
        spark,
        [
            (1, "01", "0101", 2.0),
            (2, "01", "0102", 5.0),
            (3, "02", "0201", 7.0),
            (4, "01", "0201", 4.0),
            (5, "7", "701", 1.0),
            (6, "02", "0201", None),
            (99, "02", "0201", 9.0),
        ],
    )
    s = settlement(
        spark,
        [
            (1, "01", "A", "0101", "A1", 10.25),
            (2, "01", "A", "0102", "A2", 20.25),
            (3, "02", "B", "0201", "B1", 40.5),
            (4, "02", "B", "0201", "B1", 80.0),
            (5, "7", None, "701", None, 160.0),
            (6, "02", "B", "0201", "B1", 320.0),
            (8, "02", "B", "0201", "B1", 640.0),
        ],
    )
    return h, s


def executed(df):
    """The plan a query really ran with."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
