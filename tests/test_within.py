"""Sums over areas where both sides are shuffled, and the numpy tests they are made by."""

import random
import re
from fractions import Fraction

import numpy as np

from bandrisk.functions import exact
from bandrisk.operators import spatial, within
from bandrisk.operators.rollup import finish, with_parts

AREAS = "aoi_id bigint, ord int, wkt string"
CONDITIONS = {"all": None, "odd": "vuid % 2 = 1", "none": "vuid is null"}


def test_sides_are_exact():
    r = random.Random(5)
    ends = np.array([[r.randint(-9, 9) / 10 for _ in range(4)] for _ in range(60)])
    xy = np.array([[r.randint(-90, 90) / 100 for _ in range(2)] for _ in range(300)])
    got = within.sides(list(ends.T), *xy.T)
    for p, (x, y) in enumerate(xy.tolist()):
        for e, (x1, y1, x2, y2) in enumerate(ends.tolist()):
            x1, y1, x2, y2, px, py = map(Fraction, (x1, y1, x2, y2, x, y))
            turn = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
            assert got[p, e] == (turn > 0) - (turn < 0) or (x1, y1) == (x2, y2)


def test_shuffled_sums_against_pairs_in_few_rows(spark, monkeypatch):
    """Every point of a touched cell lies in a set of areas of its own; what is stored has a row for each area and bin."""
    monkeypatch.setattr(spatial, "POINTS_IN_LOT", 300)
    monkeypatch.setattr(within, "SUMS_HELD", 50)
    wkts = [f"POLYGON((0 0,{n / 10} {n / 20},3 {n / 10},0 0))" for n in range(31, 71)]
    wkts += ["MULTIPOLYGON(((-9 -9,9 -9,9 9,-9 9,-9 -9),(-1 -1,1 -1,1 1,-1 1,-1 -1)),((0 0,2 0,2 2,0 2,0 0)))"]
    areas = spark.createDataFrame([(n, 0, w) for n, w in enumerate(wkts)], AREAS)
    rows = [(n, (n * 37 % 90) / 10 - 1, (n * 53 % 70) / 10 - 1, n / 4) for n in range(3000)] + [(None, 1.0, 1.0, None), (7, None, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "vuid bigint, lon double, lat double, vuid_population double")
    index = spatial.index_areas(areas, cell=1.0, broadcast_limit=0)
    sums = {n: exact.summed(c) for n, c in CONDITIONS.items()}
    stored = spatial.cell_sums(with_parts(points), index, sums, ("vuid",), (exact.BIN,), CONDITIONS).cache()
    bins = 8
    assert stored.where("areas is not null").count() <= bins * len(wkts)
    assert spatial.once(stored).select("vuid").distinct().count() == 3001
    names = list(CONDITIONS)
    got = finish(spatial.area_sums(stored, index, names, (exact.BIN,)), ("aoi_id",), names).collect()
    pairs = spatial.points_by_area(points, spatial.index_areas(areas)).groupBy("aoi_id")
    told = pairs.agg(*[spatial.F.expr(f"sum(if({c or 'true'}, vuid_population, 0D))").alias(n) for n, c in CONDITIONS.items()])
    assert len(got) == len(wkts) and sorted(got) == sorted(told.select("aoi_id", *names).collect())


def test_shuffled_points_meet_only_the_cells_they_lie_in(spark):
    """By size and place of the cell, not by the larger cell around it, whose other cells they would be paired with too."""
    areas = spark.createDataFrame([(n, 0, f"POLYGON((0 0,{n + 1} 0,2 3,0 0))") for n in range(3)], AREAS)
    points = spark.createDataFrame([(x * 20 + y, x / 4, y / 4) for x in range(20) for y in range(20)], "vuid int, lon double, lat double")
    told = spatial.points_by_area(points, spatial.index_areas(areas, cell=0.25))
    found = spatial.points_by_area(points, spatial.index_areas(areas, cell=0.25, broadcast_limit=0))
    keys = re.search(r"SortMergeJoin \[([^]]*)\]", found._jdf.queryExecution().executedPlan().toString())[1]
    assert len(keys.split(",")) == 3
    assert sorted(found.collect()) == sorted(told.collect())


def test_shuffled_points_come_out_with_lists_of_areas(spark, monkeypatch):
    """As those of a broadcast do, in lots and with any columns; rows of a point and an area are made by nothing but lists."""
    monkeypatch.setattr(spatial, "POINTS_IN_LOT", 20)
    monkeypatch.setattr(spatial, "AREAS_IN_ROW", 3)
    monkeypatch.setattr(within, "SUMS_OUT", 50)
    wkts = [f"POLYGON((0 0,{n / 10} {n / 20},3 {n / 10},0 0))" for n in range(31, 51)]
    wkts += ["MULTIPOLYGON(((-9 -9,9 -9,9 9,-9 9,-9 -9),(-1 -1,1 -1,1 1,-1 1,-1 -1)),((0 0,2 0,2 2,0 2,0 0)))"] * 5
    areas = spark.createDataFrame([(n if n else None, 0, w) for n, w in enumerate(wkts)], AREAS)
    rows = [(n % 90, (n * 37 % 90) / 10 - 1, (n * 53 % 70) / 10 - 1, [n]) for n in range(900)] + [(None, 1.0, 1.0, None), (7, None, 1.0, [])]
    points = spark.createDataFrame(rows, "aoi int, lon double, lat double, `a list` array<int>")
    told = spatial.points_by_area(points, spatial.index_areas(areas, cell=0.5)).collect()
    found = spatial.points_by_area(points, spatial.index_areas(areas, cell=0.5, broadcast_limit=0))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(areas") == 2 and "MapInArrow" in plan
    assert found.columns == [*points.columns, "aoi_id"]
    assert len(told) > 3000 and sorted(found.collect(), key=str) == sorted(told, key=str)
