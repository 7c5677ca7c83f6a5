import random
from fractions import Fraction

import pytest

from bandrisk.operators import overlay, spatial
from bandrisk.plans import land, panels

AREAS = "aoi_id bigint, ord int, wkt string"
SHAPES = "vuid bigint, wkt string"
HOLED = "POLYGON((0 0,8 0,8 8,0 8,0 0),(2 2,6 2,6 6,2 6,2 2))"


def text(rings):
    return ",".join("(" + ",".join(f"{x} {y}" for x, y in [*r, r[0]]) + ")" for r in rings)


def wkt(*polygons):
    return f"MULTIPOLYGON({','.join(f'({text(p)})' for p in polygons)})"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def edges(rings):
    return [(r[i - 1], r[i]) for r in rings for i in range(len(r))]


def turn(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def on(a, b, p):
    return turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def inside(rings, p):
    odd = False
    for a, b in edges(rings):
        if on(a, b, p):
            return True
        if (a[1] > p[1]) != (b[1] > p[1]) and (turn(a, b, p) > 0) == (b[1] > a[1]):
            odd = not odd
    return odd


def cross(e, f):
    (a, b), (c, d) = e, f
    if any(on(*e, p) for p in f) or any(on(*f, p) for p in e):
        return True
    return (turn(a, b, c) > 0) != (turn(a, b, d) > 0) and (turn(c, d, a) > 0) != (turn(c, d, b) > 0)


def meet(one, other):
    """By every pair of edges and every corner."""
    return any(
        any(cross(e, f) for e in edges(p) for f in edges(q))
        or any(inside(q, v) for r in p for v in r)
        or any(inside(p, v) for r in q for v in r)
        for p in one
        for q in other
    )


def polygon(rng):
    x, y = rng.randrange(0, 30), rng.randrange(0, 30)
    kind = rng.randrange(4)
    if kind == 0:
        while True:
            corners = [(x + rng.randrange(6), y + rng.randrange(6)) for _ in range(3)]
            if turn(*corners) != 0:
                return [corners]
    if kind == 1:
        return [box(x, y, 8, 7), box(x + 2, y + 2, 4, 3)]
    if kind == 2:
        return [[(x, y), (x + 9, y + 1), (x + 4, y + 3), (x + 3, y + 9)]]
    return [box(x, y, rng.choice([1, 3, 20]), rng.choice([1, 2, 15]))]


def found(spark, shapes, wkts, **how):
    areas = spark.createDataFrame([(n, 0, w) for n, w in enumerate(wkts)], AREAS)
    texts = spark.createDataFrame(list(enumerate(shapes)), SHAPES)
    pairs = overlay.shapes_by_area(texts, areas, spatial.index_areas(areas, **how)).collect()
    assert len(pairs) == len(set(pairs))
    return {(r.aoi_id, r.vuid) for r in pairs}


@pytest.mark.parametrize("how", [{}, {"cell": 0.5}, {"cell": 8.0}, {"broadcast_limit": 0}])
def test_every_pair_against_brute_force(spark, how):
    rng = random.Random(5)
    shapes = [[polygon(rng) for _ in range(rng.choice([1, 1, 2]))] for _ in range(60)]
    areas = [[polygon(rng) for _ in range(rng.choice([1, 2]))] for _ in range(25)]
    expected = {(a, s) for a, area in enumerate(areas) for s, shape in enumerate(shapes) if meet(shape, area)}
    assert 100 < len(expected) < 60 * 25 - 100
    assert found(spark, [wkt(*s) for s in shapes], [wkt(*a) for a in areas], **how) == expected


def test_one_within_the_other_holes_and_touching_borders(spark):
    shapes = [
        wkt([box(3, 3, 1, 1)]),  # in the hole
        wkt([box(2, 3, 1, 1)]),  # in the hole, along its border
        wkt([box(0.5, 0.5, 0.25, 0.25)]),
        wkt([box(-50, -50, 100, 100)]),  # around all
        wkt([box(-50, -50, 100, 100), box(-1, -1, 10, 10)]),  # around, with a hole that holds the area
        wkt([box(8, 8, 1, 1)]),  # a corner touches a corner
        wkt([box(8.0000001, 8, 1, 1)]),
        "POLYGON EMPTY",
        None,
        wkt([box(-1000000, -1000000, 2000000, 2000000)]),  # beyond the globe
        wkt([box(-1, 3, 20, 1)]),  # across
    ]
    assert found(spark, shapes, [HOLED]) == {(0, n) for n in (1, 2, 3, 5, 9, 10)}
    assert found(spark, shapes, ["POLYGON EMPTY"]) == set()
    assert found(spark, [None], [HOLED]) == set()


def test_texts_of_one_id_and_missing_ids(spark):
    areas = spark.createDataFrame([(1, 0, HOLED)], AREAS)
    rows = [(7, wkt([box(1, 1, 0.5, 0.5)])), (7, wkt([box(20, 1, 1, 1)])), (None, wkt([box(7, 7, 3, 3)]))]
    pairs = overlay.shapes_by_area(spark.createDataFrame(rows, SHAPES), areas, spatial.index_areas(areas)).collect()
    assert sorted(map(tuple, pairs), key=str) == [(1, 7), (1, None)]


def clipped(ring, by):
    """A ring within a convex one that runs to the left."""
    for a, b in edges([by]):
        kept = []
        for p, q in edges([ring]):
            s, t = turn(a, b, p), turn(a, b, q)
            if (s > 0) != (t > 0) and s != t:
                kept.append(tuple(p[i] + (q[i] - p[i]) * Fraction(s) / (s - t) for i in (0, 1)))
            if t > 0:
                kept.append(q)
        ring = kept
        if not ring:
            return []
    return ring


def surface(ring):
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in edges([ring]))) / Fraction(2) if ring else Fraction(0)


def shared(one, other):
    """Of polygons with holes: rings all convex, so areas with and without holes add up."""
    sign = lambda n: 1 if n == 0 else -1
    return sum(
        sign(i) * sign(j) * surface(clipped(r, q)) for i, r in enumerate(one) for j, q in enumerate(other)
    )


def convex(rng):
    x, y = rng.randrange(0, 20), rng.randrange(0, 20)
    kind = rng.randrange(3)
    if kind == 0:
        return [[(x, y), (x + 7, y + 1), (x + 3, y + 6)]]
    if kind == 1:
        return [box(x, y, 8, 7), [(x + 2, y + 2), (x + 6, y + 3), (x + 3, y + 5)]]
    return [box(x, y, rng.choice([1, 3, 18]), rng.choice([1, 2, 15]))]


def shares(spark, shapes, rows, **how):
    areas = spark.createDataFrame(rows, AREAS)
    texts = spark.createDataFrame(list(enumerate(shapes)), SHAPES)
    found = overlay.shared_areas(texts, spatial.index_areas(areas, **how), "vuid").collect()
    assert len(found) == len({(r.aoi_id, r.vuid) for r in found})
    return {(r.aoi_id, r.vuid): r.share for r in found}


@pytest.mark.parametrize("cell", [None, 0.25, 1.0, 8.0])
def test_shares_against_clipping(spark, cell):
    rng = random.Random(8)
    shapes, areas = [convex(rng) for _ in range(20)], [convex(rng) for _ in range(8)]
    expected = {
        (a, s): float(shared(shape, area) / shared(shape, shape))
        for a, area in enumerate(areas)
        for s, shape in enumerate(shapes)
        if shared(shape, area) > 0
    }
    got = shares(spark, [wkt(s) for s in shapes], [(n, 0, wkt(a)) for n, a in enumerate(areas)], cell=cell)
    assert {k for k, v in got.items() if v > 1e-12} == set(expected)
    assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in expected.items())


def test_shares_of_overlapping_polygons_count_once(spark):
    rows = [(1, 0, wkt([box(0, 0, 4, 4)])), (1, 1, wkt([box(2, 0, 4, 4)])), (1, 2, wkt([box(0, 0, 4, 4)])), (2, 0, HOLED)]
    shapes = [
        wkt([box(0, 0, 12, 4)]),
        wkt([box(3, 3, 1, 1)]),
        wkt([box(0, 0, 2, 2)], [box(1, 0, 2, 2)], [box(10, 0, 3, 2)]),
        None,
        "POLYGON EMPTY",
        "POLYGON((1 1,2 2,1 1,1 1))",
    ]
    got = shares(spark, shapes, rows)
    assert got == pytest.approx({(1, 0): 0.5, (1, 1): 1.0, (1, 2): 0.5, (2, 0): (32 - 8) / 48, (2, 2): 0.5})


LAND = "prov_code string, dist_code string, kind string, area_population double, area_buildings bigint, wkt string"


def land_rows(spark):
    rows = [
        ("01", "0101", "field", 100.0, 10, wkt([box(0, 0, 4, 4)])),
        ("01", "0102", "town", 50.0, 40, wkt([box(4, 0, 4, 4)])),
        ("02", "0201", "field", 10.0, None, wkt([box(0, 4, 8, 4)])),
        (None, None, None, None, 3, None),
    ]
    return spark.createDataFrame(rows, LAND)


def test_land_levels(spark):
    got = {tuple(r)[:3]: tuple(r)[3:] for r in land.land_levels(land_rows(spark)).collect()}
    assert got[("country", None, "field")] == (110.0, 10.0)
    assert got[("province", "01", "town")] == (50.0, 40.0)
    assert got[("country", None, None)] == (0.0, 3.0)
    assert got[("district", "0201", "field")] == (10.0, 0.0)
    total = {tuple(r)[:2]: tuple(r)[2:] for r in land.land_levels(land_rows(spark), by_kind=False).collect()}
    assert total[("country", None)] == (160.0, 53.0)
    assert total[("province", "01")] == (150.0, 50.0)


def test_land_of_drawn_areas_and_the_charts_baseline(spark):
    areas = spark.createDataFrame([(5, 0, wkt([box(2, 0, 4, 2)])), (6, 0, wkt([box(50, 50, 1, 1)]))], AREAS)
    index = spatial.index_areas(areas)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in land.land_areas(land_rows(spark), index).collect()}
    assert got == {("area", "5", "field"): (25.0, 3.0), ("area", "5", "town"): (13.0, 10.0)}
    base = land.land_areas(land_rows(spark), index, by_kind=False)
    assert [tuple(r) for r in base.collect()] == [("area", "5", 38.0, 13.0)]
    totals = spark.createDataFrame([("area", "5")], "scope_level string, code string")
    assert panels.with_baseline(totals, base).collect()[0].pop_total == 38.0


def test_no_land(spark):
    nothing = spark.createDataFrame([], LAND)
    areas = spark.createDataFrame([(5, 0, HOLED)], AREAS)
    assert land.land_levels(nothing).count() == 0
    assert land.land_areas(nothing, spatial.index_areas(areas)).count() == 0
