import math
from fractions import Fraction

import pytest

from bandrisk.functions.geometry import LON_RANGE, grid_cell
from bandrisk.operators import spatial

AREAS = "aoi_id bigint, ord int, wkt string"
POINTS = "vuid bigint, lon double, lat double"
SQUARE = "POLYGON((0 0,4 0,4 4,0 4,0 0))"
WITH_HOLE = "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,3 1,3 3,1 3,1 1))"


def areas(spark, *wkts, aoi_id=1):
    return spark.createDataFrame([(aoi_id, n, w) for n, w in enumerate(wkts)], AREAS)


def points(spark, *xy):
    return spark.createDataFrame([(n, x, y) for n, (x, y) in enumerate(xy)], POINTS)


def covered(spark, wkts, xy, **how):
    """Positions of the points that the polygons cover."""
    index = spatial.index_areas(areas(spark, *wkts), union=True, **how)
    return sorted(r.vuid for r in spatial.points_in_areas(points(spark, *xy), index).collect())


@pytest.mark.parametrize("limit", [spatial.BROADCAST_LIMIT, 0])
@pytest.mark.parametrize("cell", [None, 0.5, 8.0])
def test_hole_border_vertex_and_missing_position(spark, cell, limit):
    xy = [
        (2.0, 2.0),  # in the hole
        (0.5, 0.5),
        (1.0, 2.0),  # on the hole's border
        (4.0, 2.0),  # on the outer border
        (4.0, 4.0),  # a vertex
        (2.0, 0.0),  # on a horizontal border
        (5.0, 2.0),
        (-0.5, 0.0),  # level with a horizontal border
        (None, 2.0),
        (2.0, None),
        (math.nan, 0.5),
    ]
    assert covered(spark, [WITH_HOLE], xy, cell=cell, broadcast_limit=limit) == [1, 2, 3, 4, 5]


def test_overlapping_polygons_count_once_and_do_not_cancel(spark):
    other = "POLYGON((2 2,6 2,6 6,2 6,2 2))"
    xy = [(3.0, 3.0), (1.0, 1.0), (5.0, 5.0), (7.0, 7.0)]
    assert covered(spark, [SQUARE, other], xy) == [0, 1, 2]
    index = spatial.index_areas(areas(spark, SQUARE, other, SQUARE))
    pairs = spatial.points_by_area(points(spark, *xy), index).select("aoi_id", "vuid").collect()
    assert sorted(map(tuple, pairs)) == [(1, 0), (1, 1), (1, 2)]


def test_rows_with_the_same_id_stay_apart(spark):
    both = spark.createDataFrame([(7, 1.0, 1.0), (7, 1.0, 1.0), (7, 9.0, 9.0)], POINTS)
    index = spatial.index_areas(areas(spark, SQUARE, SQUARE))
    assert spatial.points_by_area(both, index).count() == 2
    index = spatial.index_areas(areas(spark, SQUARE, SQUARE), union=True)
    assert spatial.points_in_areas(both, index).count() == 2


def test_multipolygon_and_number_formats(spark):
    wkt = " multipolygon ( ((0 0, 1e0 0, 1.0 1., 0 0)) ,((-5 -5,-4 -5,-4 -4,-5 -5)) ) "
    xy = [(0.75, 0.25), (-4.25, -4.75), (0.25, 0.75), (-2.0, -2.0)]
    assert covered(spark, [wkt], xy) == [0, 1]


@pytest.mark.parametrize("cell", [None, 0.25, 8.0])
def test_overlapping_parts_of_a_multipolygon_do_not_cancel(spark, cell):
    wkt = "MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0)),((2 2,6 2,6 6,2 6,2 2),(4.5 4.5,5 4.5,5 5,4.5 5,4.5 4.5)))"
    xy = [(3.0, 3.0), (1.0, 1.0), (5.5, 5.5), (4.75, 4.75), (7.0, 7.0), (2.0, 2.0), (5.0, 1.0)]
    assert covered(spark, [wkt], xy, cell=cell) == [0, 1, 2, 5]


def test_sums_of_many_areas_against_pairs(spark):
    """Sums from cells against sums over the pairs of point and area, in cells of every size."""
    rows = [(n, n * 37 % 1100 / 100 - 1, n * 53 % 1300 / 100 - 1) for n in range(1500)]
    pts = spark.createDataFrame(rows, POINTS)
    other = "POLYGON((3 3,12 4,7 12,3 3),(5 5,6 5,6 6,5 5))"
    many = areas(spark, SQUARE, other).unionByName(areas(spark, WITH_HOLE, aoi_id=2)).unionByName(areas(spark, other, aoi_id=3))
    for how in ({}, {"cell": 0.0625}, {"cell": 1.0, "broadcast_limit": 0}):
        index = spatial.index_areas(many, **how)
        stored = spatial.cell_sums(pts, index, {"n": "count(1)", "s": "sum(vuid)"}).cache()
        got = {r.aoi_id: (r.n, r.s) for r in spatial.area_sums(stored, index, ["n", "s"]).collect()}
        pairs = spatial.points_by_area(pts, index).groupBy("aoi_id").agg({"vuid": "sum", "*": "count"}).collect()
        assert got == {r.aoi_id: (r["count(1)"], r["sum(vuid)"]) for r in pairs} and len(got) == 3
        assert pts.where("vuid >= 0").count() > sum(n for n, _ in got.values()) / 3


def test_empty_polygons_and_no_areas_cover_nothing(spark):
    assert covered(spark, ["POLYGON EMPTY", "MULTIPOLYGON EMPTY"], [(0.0, 0.0)]) == []
    assert covered(spark, [], [(0.0, 0.0)]) == []


@pytest.mark.parametrize(
    "wkt",
    [
        "POINT(1 1)",
        "LINESTRING(0 0,1 1)",
        "POLYGON((0 0,1 0,1 1,0 1))",  # not closed
        "POLYGON((0 0,1 0,0 0))",  # too few points
        "POLYGON((0 0,1 x,1 1,0 0))",
        "POLYGON((0 0 0,1 0 0,1 1 0,0 0 0))",
        "POLYGON(())",
        "POLYGON()",
        "POLYGON((0 0,1 0,1 1,0 0)) and more",
        "MULTIPOLYGON((0 0,1 0,1 1,0 0))",
        "POLYGON(((0 0,1 0,1 1,0 0)))",
        "POLYGON(@)",
        None,
    ],
)
def test_other_text_is_refused(spark, wkt):
    with pytest.raises(Exception, match="POLYGON|closed|two numbers"):
        spatial.area_edges(areas(spark, wkt)).collect()


def test_long_polygon(spark):
    n = 20000
    ring = [(10 * math.cos(2 * math.pi * i / n), 10 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    wkt = "POLYGON((" + ",".join(f"{x!r} {y!r}" for x, y in [*ring, ring[0]]) + "))"
    xy = [(0.0, 0.0), (9.99, 0.0), (10.01, 0.0), (7.0, 7.0), (7.1, 7.1), (-7.0, 7.0)]
    assert covered(spark, [wkt], xy) == [0, 1, 3, 5]


def test_beyond_the_grid(spark):
    xy = [(500.0, 10.0), (900.0, 10.0), (0.0, 95.0), (300.0, -300.0)]
    far = "POLYGON((-400 -400,600 -400,600 100,-400 100,-400 -400))"
    assert covered(spark, [far], xy) == [0, 2, 3]
    assert covered(spark, [far], xy, cell=0.5) == [0, 2, 3]


def exact_covers(polygons, x, y):
    """Even-odd over exact fractions, any polygon, borders included."""
    x, y = Fraction(x), Fraction(y)
    for rings in polygons:
        odd = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                x1, y1, x2, y2 = map(Fraction, (x1, y1, x2, y2))
                turn = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
                if turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    return True
                if (y1 > y) != (y2 > y) and (turn > 0) == (y2 > y1):
                    odd = not odd
        if odd:
            return True
    return False


def test_against_exact_arithmetic(spark):
    """Star-shaped polygons with many vertices, against brute force over fractions."""
    polygons = []
    for k in range(3):
        ring = []
        for i in range(40):
            angle, radius = 2 * math.pi * i / 40, 1.0 + ((i * 7 + k * 3) % 11) / 4
            ring.append((round(k + radius * math.cos(angle), 3), round(k / 2 + radius * math.sin(angle), 3)))
        polygons.append([[*ring, ring[0]]])
    wkts = ["POLYGON((" + ",".join(f"{x} {y}" for x, y in p[0]) + "))" for p in polygons]
    xy = [((i * 37 % 800) / 100 - 3, (i * 61 % 700) / 100 - 3) for i in range(1500)]
    xy += [v for p in polygons for v in p[0]]
    expected = [n for n, (x, y) in enumerate(xy) if exact_covers(polygons, x, y)]
    for how in ({}, {"cell": 1.0}, {"cell": 0.25, "broadcast_limit": 0}):
        assert covered(spark, wkts, xy, **how) == expected


def test_cell_size_follows_the_areas(spark):
    def size(*wkts):
        return spatial.cell_size(spatial.area_shapes(areas(spark, *wkts)))

    small = size("POLYGON((0 0,0.1 0,0.1 0.1,0 0.1,0 0))")
    large = size("POLYGON((-170 -80,170 -80,170 80,-170 80,-170 -80))")
    assert small < 0.01 < large
    cells = spatial.area_cells(spatial.area_shapes(areas(spark, SQUARE)), size(SQUARE))
    assert cells.where("not whole").count() <= spatial.CELLS_PER_POLYGON


def test_cells_stay_fine_when_areas_are_many(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MAX_CELLS", 1)
    square = "POLYGON((0 0,1 0,1 1,0 1,0 0))"
    many = spark.createDataFrame([(n, 0, square) for n in range(50)], AREAS)
    assert spatial.cell_size(spatial.area_shapes(many)) <= 0.25


def test_diagonal_edges_touch_only_the_cells_they_cross(spark):
    triangle = spatial.area_shapes(areas(spark, "POLYGON((0.1 0.1,8.1 0.3,8.3 8.2,0.1 0.1))"))
    cells = spatial.area_cells(triangle, 0.125).where("not whole").count()
    assert cells < 3 * 3 * 64 and spatial.area_cells(triangle, 0.125).where("whole and step > 0").count() > 0


def test_inner_cells_carry_no_edges(spark):
    cells = spatial.area_cells(spatial.area_shapes(areas(spark, SQUARE)), 0.5)
    whole = cells.where("whole")
    assert whole.count() == 49  # the outer ring of cells touches the border
    assert whole.where("parts is not null").count() == 0


def test_grid_never_decreases(spark):
    values = [(-1e9,), (-180.0,), (-0.5,), (-0.0,), (0.0,), (0.49999999999999994,), (0.5,), (180.0,), (1e300,)]
    df = spark.createDataFrame(values, "v double").selectExpr("v", f"{grid_cell('v', 0.5, LON_RANGE)} as c")
    cells = [r.c for r in df.collect()]
    assert cells == sorted(cells) and cells[0] == -360 and cells[-1] == 360


def test_broadcast_only_when_measured_small(spark):
    pts = points(spark, (1.0, 1.0))
    small = spatial.points_by_area(pts, spatial.index_areas(areas(spark, SQUARE)))
    large = spatial.points_by_area(pts, spatial.index_areas(areas(spark, SQUARE), broadcast_limit=0))
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("cell", [None, 0.25])
def test_one_step_beside_slanted_edges(spark, cell):
    """Points as near to an edge as doubles go, on either side, and points on it."""
    ring = [(0.1, 0.1), (3.3, 0.7), (2.9, 3.1), (0.3, 2.3), (0.1, 0.1)]
    wkt = "POLYGON((" + ",".join(f"{x!r} {y!r}" for x, y in ring) + "))"
    xy = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        for k in range(1, 40):
            x, y = x1 + (x2 - x1) * k / 40, y1 + (y2 - y1) * k / 40
            xy += [(a, b) for a in (math.nextafter(x, -9), x, math.nextafter(x, 9)) for b in (math.nextafter(y, -9), y)]
    expected = [n for n, (x, y) in enumerate(xy) if exact_covers([[ring]], x, y)]
    assert 100 < len(expected) < len(xy) - 100
    assert covered(spark, [wkt], xy, cell=cell) == expected


def test_a_union_of_many_areas_has_no_row_for_all(spark):
    """Squares side by side and on top of each other; each point counts once, nothing is collected over areas."""
    many = spark.sql("""select id as aoi_id, 0 as ord, concat('POLYGON((', x, ' ', y, ',', x + 0.75, ' ', y, ',', x + 0.75,
        ' ', y + 0.75, ',', x, ' ', y + 0.75, ',', x, ' ', y, '))') as wkt
        from (select id, double(id % 100) - 50 as x, double(floor(id / 100) % 50) - 25 as y from range(0, 20000, 1, 16))""")
    pts = spark.sql("select id as vuid, (id * 37 % 12000) / 100D - 60 as lon, (id * 61 % 6000) / 100D - 30 as lat from range(6000)")
    shapes = spatial.area_shapes(many, union=True)
    assert shapes.rdd.getNumPartitions() > 1
    plan = spatial.area_cells(shapes, 0.5, union=True)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        # Edges are only collected by polygon and cell.
        assert "collect_list" not in line or "polygon" in line
    index = spatial.index_areas(many, union=True)
    found = sorted(r.vuid for r in spatial.points_in_areas(pts, index).collect())

    def inside(x, y):
        return -50 <= x < 50 and -25 <= y < 25 and x - math.floor(x) <= 0.75 and y - math.floor(y) <= 0.75

    assert found == [r.vuid for r in pts.orderBy("vuid").collect() if inside(r.lon, r.lat)]
    assert index.cells.groupBy("step", "cx", "cy").agg({"whole": "max"}).where("`max(whole)`").count() > 5000


def test_edges_of_one_polygon_are_spread(spark):
    n = 200_000
    wkt = "POLYGON((" + ",".join(
        f"{(10 + math.sin(40 * a)) * math.cos(a)!r} {(10 + math.sin(40 * a)) * math.sin(a)!r}"
        for a in (2 * math.pi * (i % n) / n for i in range(n + 1))
    ) + "))"
    shapes = spatial.materialise(spatial.area_shapes(areas(spark, wkt)))
    per_task = [r["count"] for r in shapes.groupBy(spatial.F.spark_partition_id()).count().collect()]
    assert sum(per_task) == n and max(per_task) < n / 4
    xy = [(r * math.cos(a), r * math.sin(a)) for a in (i / 7 for i in range(44)) for r in (0.1, 8.9, 9.9, 10.1, 10.9, 11.1)]
    expected = [k for k, (x, y) in enumerate(xy) if math.hypot(x, y) < 10 + math.sin(40 * math.atan2(y, x))]
    assert covered(spark, [wkt], xy) == expected


def test_more_areas_in_a_cell_than_a_row_holds(spark, monkeypatch):
    monkeypatch.setattr(spatial, "AREAS_IN_ROW", 3)
    many = spark.createDataFrame([(n, 0, f"POLYGON((0 0,{2 + n / 8} 0,2 3,0 0))") for n in range(20)], AREAS)
    pts = points(spark, *[(x / 7, y / 7) for x in range(35) for y in range(21)])
    index = spatial.index_areas(many, cell=1.0)
    stored = spatial.cell_sums(pts, index, {"n": "count(1)"}, keys=("vuid",)).cache()
    assert spatial.once(stored).agg({"n": "sum"}).first()[0] == 35 * 21
    got = {r.aoi_id: r.n for r in spatial.area_sums(stored, index, ["n"]).collect()}
    pairs = spatial.points_by_area(pts, index).groupBy("aoi_id").count().collect()
    assert len(got) == 20 and got == {r.aoi_id: r["count"] for r in pairs}
