"""Shares of shapes by tile: figures of areas without pairs, and the surfaces they are made of."""

import math
import random

import numpy as np
import pytest

from bandrisk.functions import exact
from bandrisk.operators import overlay, sharing, spatial
from bandrisk.operators.rollup import finish
from tests.test_overlay import AREAS, convex, wkt

LAND = "id bigint, kind string, people double, houses bigint, wkt string"


def tables(spark, seed, shapes):
    rng = random.Random(seed)
    rows = [(n, rng.choice(["field", "town", None]), rng.choice([None, 0.1, 3e9, 7.25]), rng.randrange(9), wkt(convex(rng))) for n in range(shapes)]
    rows += [(shapes, "odd", math.nan, None, wkt(convex(rng))), (shapes + 1, "odd", math.inf, 1, wkt(convex(rng))), (shapes + 2, "none", 1.0, 1, None)]
    areas = [(n, k, wkt(convex(rng))) for n in range(6) for k in range(1 + n % 2)]
    return spark.createDataFrame(rows, LAND), spark.createDataFrame(areas, AREAS)


@pytest.mark.parametrize("most", [512, 3])
def test_figures_by_share_without_pairs(spark, monkeypatch, most):
    """What a task gives out is a row for each area, kind, measure and bin, however many polygons there are."""
    monkeypatch.setattr(overlay, "EDGES_IN_SHAPE", most)
    land, areas = tables(spark, 3, 600 if most == 512 else 60)
    index = spatial.index_areas(areas, cell=4.0 if most == 512 else 1.0)
    sums = overlay.shared_sums(land, index, "id", "kind", {"p": "people", "h": "houses"}).cache()
    if most == 512:
        assert sums.count() < 400 < 800 < overlay.shared_areas(land, index, "id").count()
    raw = sums.groupBy("aoi_id", "kind", "_measure", exact.BIN).agg(spatial.F.expr(f"{exact.summed()} as total"))
    got = {tuple(r)[:3]: r.total for r in finish(raw, ("aoi_id", "kind", "_measure"), ["total"]).collect()}
    monkeypatch.setattr(overlay, "EDGES_IN_SHAPE", 0)
    pairs = overlay.shared_areas(land, index, "id").where("share > 1e-9").join(land, "id")
    told = {}
    for r in pairs.collect():
        for measure, value in (("p", r.people), ("h", r.houses)):
            key = (r.aoi_id, r.kind, measure)
            told[key] = told.get(key, 0.0) + (value or 0) * r.share
    assert got == pytest.approx(told, rel=1e-9, nan_ok=True)


def test_borders_that_touch_share_nothing_and_whole_ones_all(spark):
    halves = ["POLYGON((0.1 0.1,0.9 0.3,0.3 0.9,0.1 0.1))", "POLYGON((0.1 0.1,0.9 0.3,0.7 -0.9,0.1 0.1))"]
    areas = spark.createDataFrame([(n, 0, w) for n, w in enumerate(halves)] + [(2, n, w) for n, w in enumerate(halves)], AREAS)
    texts = spark.createDataFrame(list(enumerate(halves)), "id bigint, wkt string")
    for cell in (0.0625, 2.0):
        found = overlay.shared_areas(texts, spatial.index_areas(areas, cell=cell), "id").collect()
        assert {(r.id, r.aoi_id): r.share for r in found} == {(0, 0): 1.0, (1, 1): 1.0, (0, 2): 1.0, (1, 2): 1.0}


def test_surface_left_of_both_edges():
    one = [np.array([v]) for v in (0.0, 4.0, 0.0, 4.0, 1)]
    other = [np.array(v) for v in ([0.0, 0.0, 2.0], [4.0, 4.0, 9.0], [4.0, 1.0, 9.0], [0.0, 1.0, 9.0], [1, -1, 1])]
    assert sharing._left_of_both(one, other)[0] == pytest.approx([4.0, -3.5, 6.0])


def test_bins_are_those_of_the_sql(spark):
    values = [0.0, -1.5, 2.0**-1074, 1e300, -7.1e-9, 4.0, 0.1, math.nan, math.inf, -math.inf]
    bins, parts = sharing.binned(np.array(values))
    steps = spark.createDataFrame([(v,) for v in values], "v double")
    for columns in exact.split("v"):
        steps = steps.withColumns({n: spatial.F.expr(e) for n, e in columns.items()})
    for bin_, top, middle, low, row in zip(bins, *parts, steps.collect()):
        number = (top * 2**20 + middle) * 2**20 + low
        told = (row._top * 2**20 + row._middle) * 2**20 + row._low
        assert int(number) * 16 ** int(bin_ + 300) == told * 16 ** (row._bin + 300)


def test_tiles_get_packed_cells_once(spark, monkeypatch):
    """A row for each area and coarse cell that shapes of a tile reach, its whole cells in one number; points of rings, no edges."""
    monkeypatch.setattr(overlay, "SHAPES_IN_LOT", 4)
    areas = spark.createDataFrame([(1, 0, wkt([[(0, 0), (15, 1), (8, 15)]])), (2, 0, wkt([[(1, 1), (15, 1), (3, 15)]]))], AREAS)
    texts = spark.createDataFrame([(n, wkt([[(n % 8 + 0.5, 3), (n % 8 + 1, 3), (n % 8 + 1, 9)]])) for n in range(40)], "id bigint, wkt string")
    index = spatial.index_areas(areas, cell=1.0)
    near, sizes, others = overlay._in_tiles(texts, index, "id")
    assert others is None and "struct" not in near.schema["polygons"].simpleString()
    rows = overlay._streamed(near, sizes, None, index).collect()
    cells = [(r.bits, r.tx, r.ty, r.aoi_id, r.cx, r.cy) for r in rows if r.side == 0]
    assert len(cells) == len(set(cells)) <= 2 * 4 * len({(r.bits, r.tx, r.ty) for r in rows})
    assert {r.lot for r in rows} == {0}
    shapes = [r for r in rows if r.side == 2]
    assert len(shapes) == 40 and all((len(r.points), list(r.starts), list(r.polygons)) == (6, [0], [3]) for r in shapes)
    # The reach is three lines of cells of the coarse cells above, and all lines below.
    whole = {(r.cx, r.cy, r.aoi_id): r.whole_cells for r in rows if r.side == 0 and r.whole_cells}
    told = {}
    for c in index.cells.where("whole").collect():
        size = 8 if c.step else 1
        for x in range(c.cx * size, c.cx * size + size):
            for y in range(c.cy * size, c.cy * size + size):
                if 0 <= x <= 8 and 3 <= y <= 9:
                    told.setdefault((x >> 3, y >> 3, c.aoi_id), set()).add((y & 7) * 8 + (x & 7))
    assert {k: {b for b in range(64) if v >> b & 1} for k, v in whole.items()} == told
