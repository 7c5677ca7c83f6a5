"""Settlements within drawn areas.

A drawn area is a list of polygon texts and covers what any of their polygons covers. Polygons are cut
into the cells of a grid edge by edge, so one of millions of edges is spread over all tasks like many
small ones: each edge walks the cells it touches, and tells which of their lower borders it crosses. In
a row of cells the crossings to the right of a cell's lower right corner say whether that corner is
inside; cells between touched ones are wholly inside or outside like it. This is done on two grids:
coarse cells that no edge touches are kept whole, in the others the fine cells are looked at.

Touched fine cells keep the edges that touch them, which is all a point in them has to be tested
against. The cells of an area do not overlap, so a settlement meets at most one of them and nothing has
to be made distinct. A union of areas is cut polygon by polygon too: where cells cover each other only
the largest is kept, and no row holds more than one polygon's edges in one cell.

Figures of areas are sums of cells: settlements are summed up per finest cell and set of areas that
cover them, in one pass; whole cells of any size take the sums of what lies in them, and only
settlements in touched cells are tested against edges. No pair of a settlement and an area it lies well
inside of is ever made.

The cell size follows the areas: the finest one that keeps the number of touched cells low. The
settlement side is the big one. It is not moved when the cells have been measured to fit a
broadcast; beyond that both sides are shuffled on the cell, and the adaptive planner splits a cell
with a large share of all settlements by its measured size. Exact sums are then made by the tasks
that test the settlements (``operators.within``), which get such a cell in lots.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from bandrisk.functions import exact
from bandrisk.functions.geometry import EDGE, LAT_RANGE, LON_RANGE, covers, grid_cell, sides, test_edge, wkt_parts
from bandrisk.operators.within import lists_within, sums_within
from bandrisk.sources.store import materialise

# Candidate cell sizes in degrees, coarse to fine; powers of two keep the cell arithmetic exact.
CELL_SIZES = tuple(2.0**-k for k in range(-3, 11))
# A coarse cell is so many fine ones wide and high; sizes of cells are counted in steps from the finest.
FANOUT_BITS = 3
STEPS = 1
# Touched cells to aim for: many per polygon while there are few polygons, not too few when there are many.
CELLS_PER_POLYGON = 2048
MIN_CELLS_PER_POLYGON = 128
MAX_CELLS = 1 << 16
# Measured bytes up to which cells are broadcast.
BROADCAST_LIMIT = 64 * 1024 * 1024
# Areas that touch one cell and are tested together; more are tested apart, so no row grows with them.
AREAS_IN_ROW = 1000
# Points of one cell that a task tests; more are dealt out to several.
POINTS_IN_LOT = 1 << 18

_PARTS = f"array<struct<odd:int,edges:array<{EDGE}>>>"


def area_edges(areas: DataFrame) -> DataFrame:
    """Every edge of every polygon of ``areas(aoi_id, ord, wkt)``, one row each; ``part`` numbers a text's polygons."""
    parts = areas.select("aoi_id", "ord", F.posexplode(F.expr(wkt_parts("wkt"))).alias("part", "edges"))
    return parts.select("aoi_id", "ord", "part", F.inline("edges"))


def tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def area_shapes(areas: DataFrame, union: bool = False) -> DataFrame:
    """``aoi_id, polygon, edge``: the test edges of every polygon of ``areas(aoi_id, ord, wkt)``, spread over all tasks.

    ``polygon`` numbers the polygons of all texts. ``union`` makes one area of all.
    """
    texts = areas.select(F.lit(0).alias("aoi_id") if union else F.col("aoi_id"), F.expr(wkt_parts("wkt")).alias("parts"))
    polygons = texts.select("aoi_id", F.explode("parts").alias("edges")).withColumn("polygon", F.monotonically_increasing_id())
    edges = polygons.select("aoi_id", "polygon", F.explode("edges").alias("e"))
    # One text is parsed by one task; a number is given because the planner would merge partitions by their bytes.
    spread = edges.repartition(tasks_of(areas), "polygon", "e.x1", "e.y1", "e.x2", "e.y2")
    return spread.selectExpr("aoi_id", "polygon", f"{test_edge('e')} as edge")


def cell_size(shapes: DataFrame) -> float:
    """The finest cell size that keeps the cells touched by edges within the allowed number.

    One small job over the shapes; counts for all candidate sizes, one row, come to the driver.
    """
    spans = {
        size: F.sum(F.expr(f"least((edge.east - edge.west + edge.y2 - edge.y1) / {size}D, {540 / size}D)"))
        for size in CELL_SIZES
    }
    polygons, *counts = shapes.agg(F.count_distinct("polygon"), *spans.values()).first()
    allowed = min(CELLS_PER_POLYGON * polygons, max(MAX_CELLS, MIN_CELLS_PER_POLYGON * polygons))
    # A border of that length enters so many cells, beside the few in which a polygon begins, whatever the number of its edges.
    fitting = [size for size, cells in zip(CELL_SIZES, counts) if cells is not None and cells + 4 * polygons <= allowed]
    return min(fitting, default=CELL_SIZES[0])


def cell_line(position: str, cell: float, bounds: tuple[float, float], upper: bool) -> str:
    """The coordinate of a cell's upper or lower border, as SQL; NULL where the outermost cells are open."""
    low, high = (int(b // cell) for b in bounds)
    outer = f"{position} >= {high}" if upper else f"{position} <= {low}"
    return f"if({outer}, cast(null as double), ({position} + {int(upper)}) * {cell}D)"


def walked(edges: DataFrame, cell: float) -> DataFrame:
    """Every cell an edge touches: ``cx, cy`` beside the columns of ``edges``, and ``odd``, 1 if its lower border is crossed.

    Cells within a hair of a slanted edge count as touched too.
    """
    bottom, top = (cell_line("cy", cell, LAT_RANGE, upper) for upper in (False, True))

    def at(line: str, end: str) -> str:
        """Where the edge meets a border of the row, or the end of the edge that lies within it."""
        meets = f"edge.x1 + (edge.x2 - edge.x1) * (({line} - edge.y1) / (edge.y2 - edge.y1))"
        within = f"edge.y1 < {line} and edge.y2 > {line}"
        return f"if({line} is not null and {within}, least(greatest({meets}, edge.west), edge.east), edge.x{end})"

    # Where an edge meets a row is rounded; upright ones need no slack.
    slack = "if(edge.west = edge.east, 0D, 1e-9D + 1e-12D * (abs(edge.west) + abs(edge.east)))"
    rows = edges.selectExpr(
        "*",
        f"explode(sequence({grid_cell('edge.y1', cell, LAT_RANGE)}, {grid_cell('edge.y2', cell, LAT_RANGE)})) as cy",
    )
    ends = rows.selectExpr("*", f"{at(bottom, '1')} as _a", f"{at(top, '2')} as _b")
    across = [
        grid_cell(f"(least(_a, _b) - {slack})", cell, LON_RANGE),
        grid_cell(f"(greatest(_a, _b) + {slack})", cell, LON_RANGE),
    ]
    cells = ends.selectExpr("*", f"explode(sequence({', '.join(across)})) as cx").drop("_a", "_b")
    left, right = (cell_line(position, cell, LON_RANGE, True) for position in ("(cx - 1)", "cx"))
    low = int(LON_RANGE[0] // cell)
    # A corner on an edge's line counts as left of it, as it does for points.
    before, after = f"(cx > {low} and f[0] < 0)", f"({right} is null or f[1] < 0)"
    between = f"transform(array({sides('edge', (left, bottom), (right, bottom))}), f -> if({before} <> {after}, 1, 0))[0]"
    crosses = f"{bottom} is not null and edge.y1 <= {bottom} and edge.y2 > {bottom}"
    return cells.selectExpr("*", f"if({crosses}, {between}, 0) as odd")


_BY_ROW = ("aoi_id", "polygon", "cy")


def _with_corners(touched: DataFrame) -> DataFrame:
    """Touched cells with ``corner`` (1 if the lower right one is inside), ``inner`` (the same for the cells to the left of
    this one) and ``left``, the column of the next one there."""
    along = Window.partitionBy(*_BY_ROW).orderBy(F.col("cx").desc())
    beyond = F.coalesce(F.sum("odd").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = touched.withColumns({"corner": beyond % 2, "left": F.lead("cx").over(along)})
    return placed.withColumn("inner", (F.col("corner") + F.col("odd")) % 2)


def area_cells(shapes: DataFrame, cell: float, union: bool = False) -> DataFrame:
    """Cells of ``area_shapes``: ``aoi_id, step, cx, cy, whole, parts``.

    ``step`` is 0 for cells of ``cell`` degrees and grows by one for each size above. ``whole`` cells
    are covered entirely and have no parts; the others are all of step 0, and their parts have the
    edges of a polygon that touch the cell and whether its lower right corner is inside. No two cells of
    an area overlap, but with ``union`` touched ones have a row for each polygon.
    """
    spread = 1 << FANOUT_BITS
    tasks = tasks_of(shapes)
    # Dealt by row of cells once, for cells and rows alike.
    dealt = walked(shapes, cell * spread).select(*_BY_ROW, "cx", "odd").repartition(tasks, *_BY_ROW)
    coarse = materialise(_with_corners(dealt.groupBy(*_BY_ROW, "cx").agg((F.sum("odd") % 2).alias("odd"))))
    columns = ("aoi_id", "step", "cx", "cy", "whole", "part")
    nothing = f"cast(null as struct<odd:int,edges:array<{EDGE}>>)"
    large = coarse.where("inner = 1 and left < cx - 1").selectExpr(
        "aoi_id", "1 as step", "explode(sequence(left + 1, cx - 1)) as cx", "cy", "true as whole", f"{nothing} as part"
    )
    # In each row of a touched coarse cell its last fine cell starts what is known of the others.
    starts = coarse.selectExpr(
        "aoi_id", "polygon", f"cx * {spread} + {spread - 1} as cx",
        f"explode(sequence(cy * {spread}, cy * {spread} + {spread - 1})) as cy", "0 as odd",
    )
    fine = (
        walked(shapes, cell)
        .unionByName(starts, allowMissingColumns=True)
        .repartition(tasks, *_BY_ROW)
        .groupBy(*_BY_ROW, "cx")
        .agg((F.sum("odd") % 2).alias("odd"), F.collect_list("edge").alias("edges"))
    )
    fine = _with_corners(fine).withColumn("touched", F.size("edges") > 0)
    touched = fine.where("touched").selectExpr(
        "aoi_id", "0 as step", "cx", "cy", "false as whole",
        "named_struct('odd', cast(corner as int), 'edges', edges) as part",
    )
    first = f"greatest(coalesce(left + 1, -2147483648), shiftleft(shiftright(cx, {FANOUT_BITS}), {FANOUT_BITS}))"
    small = (
        fine.where("inner = 1")
        .selectExpr("aoi_id", "cy", f"{first} as first", "if(touched, cx - 1, cx) as last")
        .where("first <= last")
        .selectExpr(
            "aoi_id", "0 as step", "explode(sequence(first, last)) as cx", "cy", "true as whole", f"{nothing} as part"
        )
    )
    every = touched.select(*columns).unionByName(small.select(*columns)).unionByName(large.select(*columns))
    shift = f"if(step = 1, 0, {FANOUT_BITS})"
    every = every.selectExpr("*", f"shiftright(cx, {shift}) as _x", f"shiftright(cy, {shift}) as _y")
    every = every.repartition(tasks, "aoi_id", "_x", "_y")
    here = Window.partitionBy("aoi_id", "_x", "_y")
    same = Window.partitionBy("aoi_id", "_x", "_y", "step", "cx", "cy")
    marked = every.withColumns(
        {
            "_over": F.max(F.expr("step = 1")).over(here),
            "_whole": F.max("whole").over(same),
            "_n": F.row_number().over(same.orderBy(F.col("whole").desc())),
        }
    ).where("(step = 1 or not _over) and (not _whole or _n = 1)")
    if union:
        return marked.selectExpr("aoi_id", "step", "cx", "cy", "whole", "if(whole, null, array(part)) as parts")
    grouped = marked.groupBy("aoi_id", "_x", "_y", "step", "cx", "cy").agg(
        F.max("whole").alias("whole"), F.collect_list("part").alias("parts")
    )
    return grouped.selectExpr("aoi_id", "step", "cx", "cy", "whole", "if(whole, null, parts) as parts")


@dataclass(frozen=True)
class AreaIndex:
    """Cells of the areas with what was measured about them."""

    cells: DataFrame
    small: bool
    box: tuple[float, float, float, float] | None
    cell: float


def index_areas(
    areas: DataFrame, cell: float | None = None, broadcast_limit: int = BROADCAST_LIMIT, union: bool = False
) -> AreaIndex:
    """Cut areas into cells, store those and measure them; a row of figures comes to the driver.

    The texts are parsed once and stored. The measured bytes decide between broadcast and shuffle.
    The box around the cells becomes a range filter on the settlement scan, which can skip whole
    files and row groups. ``union`` makes one area of all, for what any of them covers.
    """
    shapes = materialise(area_shapes(areas, union))
    if cell is None:
        cell = cell_size(shapes)
    cells = materialise(area_cells(shapes, cell, union))
    edges = F.coalesce(F.size(F.flatten("parts.edges")), F.lit(0))
    row_bytes = F.lit(64) + F.lit(88) * edges
    ends = [
        f"{pick}({c} * shiftleft(1, {FANOUT_BITS} * step) {far})"
        for c in ("cx", "cy")
        for pick, far in (("min", ""), ("max", f"+ shiftleft(1, {FANOUT_BITS} * step) - 1"))
    ]
    total = F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0))
    size, west, east, south, north = cells.agg(total, *map(F.expr, ends)).first()
    box = None
    if west is not None:
        # The outermost cells are open: they also hold what lies beyond the grid.
        def bound(position: int, limits: tuple[float, float], upper: bool) -> float:
            low, high = (int(b // cell) for b in limits)
            if upper:
                return float("inf") if position >= high else (position + 1) * cell
            return float("-inf") if position <= low else position * cell

        box = (
            bound(west, LON_RANGE, False),
            bound(east, LON_RANGE, True),
            bound(south, LAT_RANGE, False),
            bound(north, LAT_RANGE, True),
        )
    return AreaIndex(cells, size <= broadcast_limit, box, cell)


def _in_box(index: AreaIndex) -> str:
    """Whether a point can lie in any cell, as SQL."""
    if index.box is None:
        return "false"
    west, east, south, north = (f"double('{b}')" for b in index.box)
    # A hair wider than the cells, so that rounding in the cell arithmetic cannot matter.
    slack = f"{index.cell / 1024}D"
    return (
        f"lon >= {west} - {slack} and lon <= {east} + {slack} and lat >= {south} - {slack} and lat <= {north} + {slack}"
    )


def in_box(points: DataFrame, index: AreaIndex) -> DataFrame:
    """The points that can lie in any cell; a range filter that reaches the scan."""
    return points.where(_in_box(index))


def _located(points: DataFrame, index: AreaIndex) -> DataFrame:
    """Points with their finest cell, its right and its lower border."""
    return points.selectExpr(
        "*", f"{grid_cell('lon', index.cell, LON_RANGE)} as _cx", f"{grid_cell('lat', index.cell, LAT_RANGE)} as _cy"
    ).selectExpr(
        "*",
        f"{cell_line('_cx', index.cell, LON_RANGE, True)} as _right",
        f"{cell_line('_cy', index.cell, LAT_RANGE, False)} as _bottom",
    )


def side_to_join(cells: DataFrame, index: AreaIndex) -> DataFrame:
    return F.broadcast(cells) if index.small else cells.hint("merge")


# A point is looked up once per size of cells, so that it meets the cells it lies in and no others.
_LOOKED_UP = ", ".join(
    f"named_struct('step', {s}, 'cx', shiftright(_cx, {FANOUT_BITS * s}), 'cy', shiftright(_cy, {FANOUT_BITS * s}))"
    for s in range(STEPS + 1)
)
# Whether a located point is within the area of the touched cell it was joined to.
_TESTED = f"exists(parts, p -> {covers('p', 'lon', 'lat', '_right', '_bottom')})"


def _matched(points: DataFrame, index: AreaIndex, how: str) -> DataFrame:
    """Points that can lie in any cell joined to the cells that cover them."""
    located = _located(points.where(_in_box(index)), index)
    inside = f"whole or {_TESTED}"
    at = located.selectExpr("*", f"inline(array({_LOOKED_UP})) as (_step, _atx, _aty)")
    cells = index.cells
    same = (F.col("_step") == cells["step"]) & (F.col("_atx") == cells["cx"]) & (F.col("_aty") == cells["cy"])
    return at.join(side_to_join(cells, index), same & F.expr(inside), how)


def points_by_area(points: DataFrame, index: AreaIndex) -> DataFrame:
    """``points(lon, lat, ...)`` rows with the ``aoi_id`` of each area that covers them.

    A row comes out once per area, since the cells of an area do not overlap. Points on a border
    count as covered; points without a position are dropped.

    Where both sides are shuffled a point meets the areas that cover its cell entirely as one list, and the tasks that
    test it against the others give out a list too (``operators.within``), so rows of pairs are made at the very end.
    """
    if not index.small:
        return _listed(points, index)
    return _matched(points, index, "inner").select(*[f"`{c}`" for c in points.columns], "aoi_id")


def _listed(points: DataFrame, index: AreaIndex) -> DataFrame:
    """``points_by_area`` where both sides are shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_point")
    located = _located(points.where(_in_box(index)), index).select(row, "lon", "lat", "_cx", "_cy")
    kept = materialise(located.where("_cx is not null and _cy is not null"))
    near = Window.partitionBy("step", "cx", "cy").orderBy("aoi_id")
    whole = materialise(
        index.cells.where("whole")
        .withColumn("_lot", F.floor((F.row_number().over(near) - 1) / AREAS_IN_ROW))
        .groupBy("step", "cx", "cy", "_lot")
        .agg(F.expr("transform(collect_list(struct(aoi_id)), a -> a.aoi_id) as areas"))
    )
    at = kept.selectExpr("_point", f"inline(array({_LOOKED_UP})) as (_step, _atx, _aty)")
    same = (F.col("_step") == F.col("step")) & (F.col("_atx") == F.col("cx")) & (F.col("_aty") == F.col("cy"))
    held = at.join(whole.hint("merge"), same).select("_point", F.explode("areas").alias("aoi_id"))
    area = index.cells.schema["aoi_id"].dataType
    schema = StructType([kept.schema["_point"], StructField("areas", ArrayType(area))])
    rows = _streamed(index, kept, ("lon", "lat", "_point"), ("lon", "lat"), "not whole", True)
    tested = rows.mapInArrow(lists_within(to_arrow_schema(schema), borders_of(index.cell)), schema)
    found = held.unionByName(tested.select("_point", F.explode("areas").alias("aoi_id")))
    return found.select("_point.*", "aoi_id")


def points_in_areas(points: DataFrame, index: AreaIndex) -> DataFrame:
    """Rows of ``points`` that an index made with ``union`` covers, each once."""
    return _matched(points, index, "leftsemi").select(*[f"`{c}`" for c in points.columns])


def _streamed(index: AreaIndex, points: DataFrame, columns: Sequence[str], spread: Sequence[str], which: str = "true", ranged: bool = False) -> DataFrame:
    """Areas (``side`` 0) and then points (1) of every cell, by cell; ``points`` have a cell and ``columns``.

    Cells with very many points are dealt out in lots by the columns ``spread``, each with all areas of the cell. Cells of
    areas are those that fulfil ``which``. Cells are dealt by hash, or in ranges of about as many rows each.
    """
    crowded = points.groupBy(F.col("_cx").alias("cx"), F.col("_cy").alias("cy")).count()
    crowded = materialise(crowded.where(F.col("count") > POINTS_IN_LOT).selectExpr("cx", "cy", f"int(ceil(count / {POINTS_IN_LOT})) as _lots"))
    areas = index.cells.where(f"step = 0 and {which}").selectExpr(
        "cx", "cy", "0 as side", "aoi_id", f"coalesce(parts, cast(array() as {_PARTS})) as parts"
    )
    placed = points.select(F.col("_cx").alias("cx"), F.col("_cy").alias("cy"), F.lit(1).alias("side"), *columns)
    if crowded.isEmpty():
        areas, placed = (side.withColumns({"_lots": F.lit(1), "_lot": F.lit(0)}) for side in (areas, placed))
    else:
        areas, placed = (side.join(F.broadcast(crowded), ["cx", "cy"], "left") for side in (areas, placed))
        areas = areas.selectExpr("*", "explode(sequence(0, coalesce(_lots, 1) - 1)) as _lot")
        placed = placed.selectExpr(
            "*", f"cast(pmod(xxhash64({', '.join(spread)}, monotonically_increasing_id()), coalesce(_lots, 1)) as int) as _lot"
        )
    rows = areas.drop("_lots").unionByName(placed.drop("_lots"), allowMissingColumns=True)
    rows = rows.selectExpr("*", f"shiftright(cx, {FANOUT_BITS}) as _x", f"shiftright(cy, {FANOUT_BITS}) as _y")
    by = ("_x", "_y", "_lot")
    deal = rows.repartitionByRange if ranged else rows.repartition
    dealt = deal(tasks_of(rows), *by).sortWithinPartitions(*by, "cx", "cy", "side")
    return dealt.select("cx", "cy", "side", "aoi_id", F.coalesce("parts", F.expr(f"cast(array() as {_PARTS})")).alias("parts"), *columns)


def borders_of(cell: float) -> Callable[[int, int], tuple]:
    """The right and the lower border of a cell, None where it has none: ``cell_line`` for numpy."""
    last, first = int(LON_RANGE[1] // cell), int(LAT_RANGE[0] // cell)

    def borders(cx: int, cy: int) -> tuple:
        return None if cx >= last else (cx + 1) * cell, None if cy <= first else cy * cell

    return borders


def _shuffled_sums(
    points: DataFrame, index: AreaIndex, conditions: Mapping[str, str | None], keys: Sequence[str]
) -> DataFrame:
    """``cell_sums`` of exact sums where both sides are shuffled: areas' sums come ready from the tasks that test points.

    Rows of ``lot`` 0 hold every point once. Those that have ``cx, cy`` are of the larger cells; ``areas`` of the others is one.
    """
    inside = _in_box(index)
    bits = [f"if({c or 'true'}, {1 << n}L, 0L)" for n, c in enumerate(conditions.values())]
    located = _located(points if keys else points.where(inside), index).select(
        *keys, exact.BIN, *exact.PARTS, F.expr(" | ".join(bits)).alias("_mask"), "lon", "lat",
        *[F.expr(f"case when {inside} then {c} end").alias(c) for c in ("_cx", "_cy")],
    )
    kept = materialise(located)
    added = [
        F.expr(f"sum(if(_mask & {1 << n}L <> 0, {part}, null))").alias(column)
        for n, name in enumerate(conditions)
        for part, column in zip(exact.PARTS, exact.apart(name))
    ]
    number, area = kept.schema["_cx"].dataType, index.cells.schema["aoi_id"].dataType
    nowhere = {"cx": F.lit(None).cast(number), "cy": F.lit(None).cast(number)}
    none = F.lit(None).cast(ArrayType(area))
    placed = kept.where("_cx is not null and _cy is not null")
    up = [F.expr(f"shiftright(_{c}, {FANOUT_BITS * STEPS})").alias(c) for c in ("cx", "cy")]
    grid = placed.groupBy(exact.BIN, *up).agg(*added)
    stored = grid.withColumns({"lot": F.lit(-1 if keys else 0), "areas": none})
    if keys:
        whole = kept.groupBy(*keys, exact.BIN).agg(*added).withColumns(nowhere | {"lot": F.lit(0), "areas": none})
        stored = whole.unionByName(stored, allowMissingColumns=True)
    columns = {"bin": exact.BIN, "top": "_top", "middle": "_middle", "low": "_low", "mask": "_mask"}
    names = ("lon", "lat", *columns)
    rows = _streamed(index, placed.withColumnsRenamed({old: new for new, old in columns.items()}), names, names)
    # The first parts of all sums, then the second ones.
    names = [column for part in zip(*map(exact.apart, conditions)) for column in part]
    schema = StructType(
        [StructField("aoi_id", area), StructField(exact.BIN, IntegerType()), *[StructField(n, LongType()) for n in names]]
    )
    found = rows.mapInArrow(sums_within(to_arrow_schema(schema), len(conditions), borders_of(index.cell)), schema)
    found = found.groupBy("aoi_id", exact.BIN).agg(*[F.sum(n).alias(n) for n in names])
    found = found.withColumns(nowhere | {"lot": F.lit(1), "areas": F.array("aoi_id")}).drop("aoi_id")
    return stored.unionByName(found, allowMissingColumns=True)


def _sums_apart(stored: DataFrame) -> list[str]:
    """Names of the sums that ``stored`` has in parts."""
    first = exact.PARTS[0]
    return [c.removesuffix(first) for c in stored.columns if c.endswith(first)]


def _together(df: DataFrame) -> DataFrame:
    names = _sums_apart(df)
    apart = {c for name in names for c in exact.apart(name)}
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in apart], *[F.expr(exact.together(n)).alias(n) for n in names]
    )


def cell_sums(
    points: DataFrame,
    index: AreaIndex,
    sums: Mapping[str, str],
    keys: Sequence[str] = (),
    bins: Sequence[str] = (),
    conditions: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """The one pass over the points: ``sums`` by finest cell, the areas of touched cells that cover a point, and ``keys``.

    ``areas`` lists those areas; beyond AREAS_IN_ROW of them in a cell the others follow in rows of
    further ``lot`` numbers, which repeat the points. Points without a position or beyond the areas
    have no cell and are only read if there are keys. ``bins`` are keys that area sums keep too.

    ``conditions`` are those of sums that are all ``exact.summed``, of points with parts: these are made by matrix
    products, one for a block of points and all areas of a cell, unless the cells fit a broadcast.
    """
    if conditions is not None and not index.small and len(conditions) < 63:
        return _shuffled_sums(points, index, conditions, keys)
    inside = _in_box(index)
    located = _located(points if keys else points.where(inside), index).withColumns(
        {c: F.expr(f"case when {inside} then {c} end") for c in ("_cx", "_cy")}
    )
    near = Window.partitionBy("cx", "cy").orderBy("aoi_id")
    touched = (
        index.cells.where("not whole")
        .withColumn("lot", F.floor((F.row_number().over(near) - 1) / AREAS_IN_ROW).cast("int"))
        .groupBy("cx", "cy", "lot")
        .agg(F.collect_list(F.struct("aoi_id", "parts")).alias("near"))
    )
    # Points without a cell meet none; where both sides are shuffled they are spread.
    looked_up = "_cx" if index.small else "coalesce(_cx, -1000000 - cast(pmod(xxhash64(lon, lat), 4096) as int))"
    joined = located.withColumn("_x", F.expr(looked_up)).join(
        side_to_join(touched, index), (F.col("_x") == F.col("cx")) & (F.col("_cy") == F.col("cy")), "left"
    )
    tested = _TESTED.replace("parts", "n.parts")
    areas = F.expr(f"transform(filter(near, n -> {tested}), n -> n.aoi_id)").alias("areas")
    found = joined.select(*[F.col(f"`{c}`") for c in points.columns], "_cx", "_cy", "lot", areas)
    by = [*keys, *bins, F.col("_cx").alias("cx"), F.col("_cy").alias("cy"), "lot", "areas"]
    return found.groupBy(*by).agg(*[F.expr(f"{e} as `{n}`") for n, e in sums.items()])


def once(stored: DataFrame) -> DataFrame:
    """Rows of ``cell_sums`` that hold every point once."""
    return _together(stored.where("coalesce(lot, 0) = 0"))


def area_sums(stored: DataFrame, index: AreaIndex, names: Sequence[str], bins: Sequence[str] = ()) -> DataFrame:
    """``aoi_id`` (and ``bins``) with its sums, from stored ``cell_sums``: tested points, and what lies in whole cells.

    Cell sums are rolled up to the larger cells first, so this joins two small tables.
    """
    if _sums_apart(stored):
        parts = [c for n in names for c in exact.apart(n)]
        grid = stored.where("cx is not null").select("cx", "cy", *bins, *parts)
        large = index.cells.where("step > 0").select("aoi_id", "cx", "cy").join(grid, ["cx", "cy"])
        found = stored.select(F.explode("areas").alias("aoi_id"), *bins, *parts)
        every = large.select("aoi_id", *bins, *parts).unionByName(found)
        return _together(every.groupBy("aoi_id", *bins).agg(*[F.sum(c).alias(c) for c in parts]))
    added = [F.expr(f"sum(`{n}`) as `{n}`") for n in names]
    steps = F.explode(F.sequence(F.lit(0), F.lit(STEPS)))
    grid = (
        once(stored)
        .where("cx is not null and cy is not null")
        .select(steps.alias("step"), "cx", "cy", *bins, *names)
        .groupBy(
            "step",
            *bins,
            *[F.expr(f"shiftright({c}, {FANOUT_BITS} * step)").alias(c) for c in ("cx", "cy")],
        )
        .agg(*added)
    )
    whole = index.cells.where("whole").select("aoi_id", "step", "cx", "cy").join(grid, ["step", "cx", "cy"])
    tested = stored.select(F.explode("areas").alias("aoi_id"), *bins, *names)
    return whole.select("aoi_id", *bins, *names).unionByName(tested).groupBy("aoi_id", *bins).agg(*added)
