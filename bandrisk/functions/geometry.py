"""Polygons as arrays of edges, and point-in-polygon tests on them.

The functions give SQL expressions over higher-order functions, so everything stays in the JVM and
in the plan. Their arguments are SQL expressions too.
"""

from __future__ import annotations

from collections.abc import Callable

# Degrees. Coordinates beyond belong to the outermost cells, so the number of cells is bounded.
LON_RANGE = (-180.0, 180.0)
LAT_RANGE = (-90.0, 90.0)


def _is_polygon(wkt: str) -> str:
    """Whether a text has the outline of a POLYGON or MULTIPOLYGON, not looking into its rings.

    Rings shrink to a mark and lists of marks to one mark, by patterns that need no stack however
    long the text is.
    """

    def shrink(text: str, unit: str) -> str:
        return rf"regexp_replace(regexp_replace({text}, r'{unit}', '@'), r'\s*,\s*@', '')"

    one = shrink(wkt, r"\([^()]*\)")
    many = shrink(one, r"\(\s*@\s*\)")
    return rf"""coalesce(not contains({wkt}, '@') and (
        {wkt} rlike r'(?i)^\s*(MULTI)?POLYGON\s*EMPTY\s*$'
        or {one} rlike r'(?i)^\s*POLYGON\s*\(\s*@\s*\)\s*$'
        or {many} rlike r'(?i)^\s*MULTIPOLYGON\s*\(\s*@\s*\)\s*$'), false)"""


def wkt_parts(wkt: str) -> str:
    """The polygons of a POLYGON or MULTIPOLYGON text, each an array of its ring edges.

    Edges are ``struct<ring,pos,x1,y1,x2,y2>``; rings are numbered within their polygon. Text of
    another kind, points that are not two numbers, and rings that are not closed fail the query.
    """
    # Polygons are parted by ")),((", rings by "),("; what is left of a ring's brackets is trimmed.
    rings = r"""
        transform(split(part, r'\)\s*,\s*\('), text ->
            transform(split(regexp_replace(text, r'(?i)^\s*(multi)?polygon[\s(]*|^[\s(]+|[\s)]+$', ''), ','), pair ->
                transform(split(trim(pair), r'\s+'), number -> try_cast(number as double))))"""
    edges = f"""
        flatten(transform({rings}, (points, ring) -> case
            when exists(points, p -> size(p) <> 2 or p[0] is null or p[1] is null) then
                raise_error('polygon point is not two numbers')
            when size(points) < 4 or points[0] <> points[size(points) - 1] then
                raise_error('polygon ring is not closed')
            else transform(slice(points, 2, size(points) - 1), (next, pos) ->
                named_struct('ring', ring, 'pos', pos, 'x1', points[pos][0], 'y1', points[pos][1],
                             'x2', next[0], 'y2', next[1])) end))"""
    return rf"""
        case when not {_is_polygon(wkt)} then
            raise_error(concat('not a POLYGON or MULTIPOLYGON: ', coalesce({wkt}, 'NULL')))
        when {wkt} rlike r'(?i)EMPTY\s*$' then array()
        else transform(split({wkt}, r'\)\s*\)\s*,\s*\(\s*\('), part -> {edges}) end"""


def test_edge(edge: str, reach: float = 16.0) -> str:
    """The parts of an edge that ``side`` and ``covers`` need: its lower end first, its extent, and its slop.

    The slop is beyond the largest error of plain arithmetic for points up to ``reach`` from the edge; for upright and
    level edges there is none.
    """
    low = f"({edge}.y1 < {edge}.y2 or {edge}.y1 = {edge}.y2 and {edge}.x1 <= {edge}.x2)"
    ends = ", ".join(
        f"'{c}{n}', if({low}, {edge}.{c}{n}, {edge}.{c}{3 - n})" for n in (1, 2) for c in ("x", "y")
    )
    run, rise = f"abs({edge}.x2 - {edge}.x1)", f"abs({edge}.y2 - {edge}.y1)"
    return f"""named_struct({ends},
        'west', least({edge}.x1, {edge}.x2), 'east', greatest({edge}.x1, {edge}.x2),
        'slop', if({run} = 0D or {rise} = 0D, 0D,
            4e-16D * ({run} * ({rise} + {reach}D) + ({run} + {reach}D) * {rise})))"""


EDGE = "struct<x1:double,y1:double,x2:double,y2:double,west:double,east:double,slop:double>"
test_edge.__test__ = False


def _difference(a: str, b: str) -> str:
    """``a - b`` as two doubles that add up to it exactly."""
    back = f"({a} - ({a} - {b}))"
    lost = f"({a} - (({a} - {b}) + {back})) + ({back} - {b})"
    return f"array({a} - {b}, {lost})"


# Of the struct ``t`` with the factors ``a`` and ``b``: the product as two doubles that add up to it, by halves of the factors.
_HALVES = [f"(134217729D * t.{v} - (134217729D * t.{v} - t.{v}))" for v in "ab"]
_LOST = "((({0} * {1} - t.a * t.b) + {0} * (t.b - {1})) + (t.a - {0}) * {1}) + (t.a - {0}) * (t.b - {1})".format(*_HALVES)
_PRODUCT = f"array(t.a * t.b, {_LOST})"


def _exact_side(edge: str, x: str, y: str) -> str:
    """``side`` by sums of doubles that lose nothing."""
    differences = [
        _difference(f"{edge}.x2", f"{edge}.x1"),
        _difference(y, f"{edge}.y1"),
        _difference(f"{edge}.y2", f"{edge}.y1"),
        _difference(x, f"{edge}.x1"),
    ]
    factors = ", ".join(
        f"struct({'-' if a else ''}d[{a}][{i}] as a, d[{a + 1}][{j}] as b)" for a in (0, 2) for i in (0, 1) for j in (0, 1)
    )
    # Each term is added to a list of doubles, smallest first, no two of which overlap.
    lost = "(s.q - ((s.q + h) - ((s.q + h) - s.q))) + (h - ((s.q + h) - s.q))"
    grown = f"""aggregate(sums, named_struct('q', t, 'h', cast(array() as array<double>)),
        (s, h) -> named_struct('q', s.q + h, 'h', concat(s.h, array({lost}))), s -> concat(s.h, array(s.q)))"""
    terms = f"transform(array(array({', '.join(differences)})), d -> flatten(transform(array({factors}), t -> {_PRODUCT})))[0]"
    return f"""cast(sign(aggregate({terms}, cast(array() as array<double>), (sums, t) -> {grown},
        sums -> aggregate(sums, 0D, (last, h) -> if(h <> 0, h, last)))) as int)"""


def side(edge: str, x: str, y: str) -> str:
    """1 left of the line of a ``test_edge``, -1 right of it, 0 on it; for a level edge above is its left.

    Plain arithmetic decides where its result is beyond its largest error, exact sums elsewhere.
    Exact for coordinates whose products neither overflow nor vanish.
    """
    left = f"({edge}.x2 - {edge}.x1) * ({y} - {edge}.y1)"
    right = f"({x} - {edge}.x1) * ({edge}.y2 - {edge}.y1)"
    return f"""case when {edge}.x1 = {edge}.x2 then cast(sign({edge}.x1 - {x}) as int)
        when {edge}.y1 = {edge}.y2 then cast(sign({y} - {edge}.y1) as int)
        when abs({left} - {right}) > 4e-16D * (abs({left}) + abs({right})) then cast(sign({left} - {right}) as int)
        else {_exact_side(edge, x, y)} end"""


def sides(edge: str, *points: tuple[str, str]) -> str:
    """``side`` of several points, as an array."""
    listed = ", ".join(f"struct({x} as x, {y} as y)" for x, y in points)
    return f"transform(array({listed}), c -> {side(edge, 'c.x', 'c.y')})"


def _crossed(part: str, x: str, y: str, right: str, bottom: str) -> str:
    """``covers`` by plain arithmetic: crossings modulo two, -1 for a point on an edge, -2 where it can't tell."""

    def turn(px: str, py: str) -> str:
        return f"((e.x2 - e.x1) * ({py} - e.y1) - ({px} - e.x1) * (e.y2 - e.y1))"

    here, beside, corner = turn(x, y), turn(right, y), turn(right, bottom)
    # An edge that does not meet the border: only the level way can cross it.
    level = f"""case when {y} > e.y2 then state when {x} = e.x1 and {x} = e.x2 then -1 when {here} > e.slop then if({y} < e.y2 and ({right} is null or {right} > e.east),
        1 - state, state) when {here} < -e.slop then state else -2 end"""
    # An edge below the level that meets the border: only the way down can cross it.
    down = f"""case when {bottom} is null or {bottom} < e.y1 then 1 - state when {bottom} > e.y2 then state
        when abs({corner}) > e.slop then if(({corner} < 0) = (e.x2 > e.x1), 1 - state, state) else -2 end"""
    start = f"if({bottom} is null or {bottom} < e.y1, e.x2 > e.x1, {corner} < 0)"
    sure = f"""abs({here}) > e.slop and abs({beside}) > e.slop
        and ({bottom} is null or {bottom} < e.y1 or abs({corner}) > e.slop)"""
    both = f"""case when {sure} then (state + if({here} > 0 and {y} < e.y2 and {beside} < 0, 1, 0)
        + if(({beside} < 0) <> {start}, 1, 0)) % 2 else -2 end"""
    # A level edge at the height of the point.
    along = f"""if({x} >= e.west and {x} <= e.east, -1, if({right} > e.west and {right} <= e.east
        and ({bottom} is null or {bottom} < {y}), 1 - state, state))"""
    return f"""aggregate({part}.edges, {part}.odd, (state, e) -> case when state < 0 or {y} < e.y1 then state
        when {y} = e.y1 and {y} = e.y2 then {along}
        when {right} is null or {right} <= e.west or {right} > e.east then {level}
        when {y} > e.y2 then {down} else {both} end)"""


def covers(part: str, x: str, y: str, right: str, bottom: str) -> str:
    """True where a point of a cell is inside a polygon by the even-odd rule, or on one of its edges.

    ``part`` has the test ``edges`` that touch the cell, and ``odd``, whether the cell's lower right
    corner is inside. The way from the point level to the cell's ``right`` border, and down along it to
    the corner, crosses only these edges; every crossing changes sides. The way is taken a hair left of
    the border and a hair higher, so that it meets no end of an edge: there a point on an edge's line
    counts as left of it. ``right`` is NULL for a cell without a right border, ``bottom`` for one without
    a lower one. Plain arithmetic tells most points; exact sides tell those near an edge or beyond the grid.
    """
    # Sides of the point, of the border level with it, and of the corner.
    known = sides("e", (x, y), (right, y), (right, bottom))
    on = f"f[0] = 0 and {y} >= e.y1 and {y} <= e.y2 and {x} >= e.west and {x} <= e.east"
    level = f"""f[0] > 0 and {y} >= e.y1 and {y} < e.y2
        and ({right} is null or {right} > e.east or ({right} > e.west and f[1] < 0))"""
    # Without a lower border the corner is below every edge: right of one that leans right, left of others.
    start = f"if({bottom} is null, e.x2 > e.x1, f[2] < 0)"
    down = f"{right} > e.west and {right} <= e.east and (f[1] < 0) <> {start}"
    step = f"if({on}, -1, (state + if({level}, 1, 0) + if({down}, 1, 0)) % 2)"
    exactly = f"""aggregate({part}.edges, {part}.odd, (state, e) ->
        if(state < 0, state, transform(array({known}), f -> {step})[0])) <> 0"""
    (west, east), (south, north) = LON_RANGE, LAT_RANGE
    beyond = f"{x} < {west}D or {x} > {east}D or {y} < {south}D or {y} > {north}D"
    plainly = f"if({beyond}, -2, {_crossed(part, x, y, right, bottom)})"
    return f"transform(array({plainly}), found -> if(found = -2, {exactly}, found <> 0))[0]"


def meets(edge: str, other: str) -> str:
    """Whether two ``test_edge``s have a point in common, ends included; exact, as ``side`` is."""

    def astride(line: str, ends: str) -> str:
        known = sides(line, (f"{ends}.x1", f"{ends}.y1"), (f"{ends}.x2", f"{ends}.y2"))
        return f"transform(array({known}), f -> f[0] * f[1] <= 0)[0]"

    near = f"""{edge}.west <= {other}.east and {other}.west <= {edge}.east
        and {edge}.y1 <= {other}.y2 and {other}.y1 <= {edge}.y2"""
    return f"({near} and {astride(edge, other)} and {astride(other, edge)})"


def _at_height(edge: str, y: str) -> str:
    """Where a slanted or upright edge is at a height."""
    return f"({edge}.x1 + ({edge}.x2 - {edge}.x1) * (({y} - {edge}.y1) / ({edge}.y2 - {edge}.y1)))"


def area_within(edges: str, inside: Callable[[str, str], str], west: str, east: str, south: str, north: str) -> str:
    """The area of a region in a box, in square units of the coordinates.

    ``edges`` are the test edges of its outlines that touch the box, ``inside`` the test of a point. The box is cut
    level at every height where an edge begins, ends, meets another or leaves the box: between two of them edges
    neither meet nor end, so what lies inside is as wide half-way up as it is on average.
    """

    def height(x: str) -> str:
        return f"if(e.x1 <> e.x2 and {x} > e.west and {x} < e.east, e.y1 + (e.y2 - e.y1) * (({x} - e.x1) / (e.x2 - e.x1)), null)"

    turn = "((e.x2 - e.x1) * (o.y2 - o.y1) - (e.y2 - e.y1) * (o.x2 - o.x1))"
    way = f"(((o.x1 - e.x1) * (o.y2 - o.y1) - (o.y1 - e.y1) * (o.x2 - o.x1)) / {turn})"
    meeting = f"""if({turn} = 0D or e.west > o.east or o.west > e.east or e.y1 > o.y2 or o.y1 > e.y2, null,
        e.y1 + (e.y2 - e.y1) * {way})"""
    others = "slice(edges, i + 2, size(edges))"
    heights = f"""flatten(transform(edges, (e, i) ->
        concat(array(e.y1, e.y2, {height(west)}, {height(east)}), transform({others}, o -> {meeting}))))"""
    levels = f"""array_sort(array_distinct(concat(array({south}, {north}),
        filter({heights}, y -> y > {south} and y < {north}))))"""
    marks = f"""array_sort(concat(array({west}, {east}), transform(filter(edges, e -> e.y1 < level and e.y2 > level),
        e -> least(greatest({_at_height('e', 'level')}, {west}), {east}))))"""
    middle = "((marks[n] + marks[n + 1]) / 2)"
    width = f"""aggregate(sequence(0, size(marks) - 2), 0D, (sum, n) ->
        if(marks[n + 1] > marks[n] and {inside(middle, 'level')}, sum + (marks[n + 1] - marks[n]), sum))"""
    slab = f"""transform(array((levels[k] + levels[k + 1]) / 2), level ->
        transform(array({marks}), marks -> {width})[0])[0] * (levels[k + 1] - levels[k])"""
    return f"""transform(array({edges}), edges -> transform(array({levels}), levels ->
        aggregate(sequence(0, size(levels) - 2), 0D, (total, k) -> total + {slab}))[0])[0]"""


# Bits of each coordinate in a place key: steps of 20 to 40 metres.
PLACE_BITS = 20


def place_key(lon: str, lat: str) -> str:
    """A number that is near for near places: the bits of both coordinates in turn (Morton order). NULL without a place."""

    def spread(coordinate: str, bounds: tuple[float, float]) -> str:
        low, high = bounds
        step = f"floor(({coordinate} - {low}) / {(high - low) / (1 << PLACE_BITS)!r}D)"
        value = f"cast(least(greatest({step}, 0), {(1 << PLACE_BITS) - 1}) as bigint)"
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                            (2, 0x3333333333333333), (1, 0x5555555555555555)):
            value = f"transform(array({value}), v -> (v | shiftleft(v, {shift})) & {mask}L)[0]"
        return value

    there = f"{lon} is not null and {lat} is not null and not isnan({lon}) and not isnan({lat})"
    return f"case when {there} then {spread(lon, LON_RANGE)} | shiftleft({spread(lat, LAT_RANGE)}, 1) end"


def grid_cell(coordinate: str, size: float, bounds: tuple[float, float]) -> str:
    """Grid position of a coordinate. Never decreases as the coordinate grows; NULL for NULL or NaN."""
    low, high = (int(b // size) for b in bounds)
    # least() and greatest() skip NULLs, so keep the NULL apart.
    return f"""
        case when not isnan({coordinate}) and {coordinate} is not null then
            cast(least(greatest(floor({coordinate} / {float(size)!r}D), {low}), {high}) as int) end"""
