"""Surfaces that shapes and areas share, tile by tile: the part of ``operators.overlay`` that numpy measures.

What a polygon covers is cut level into slabs, between whose heights its edges neither end nor meet. In a slab edges
follow each other from the right, so each is told to begin or to end the inside, and what is covered is the sum of what
lies left of the ones that begin it less that of those that end it. Two such sums are multiplied edge by edge: what
lies left of two edges is a surface with a formula. So a cell costs a few operations for each pair of edges in it,
whatever polygons they are of, and cells that one side covers entirely are matrix products.

Tasks get the rows of ``operators.meeting``, without points of rings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from bandrisk.functions import exact
from bandrisk.operators.meeting import Window, Shapes, blocks, cell_of, firsts_of, grouped, cell_key, listed, lots_of, spans
from bandrisk.operators.within import as_numbers, exact_sides

# Edges cut into slabs at once, and numbers of a matrix.
EDGES = 1 << 15
PAIRS = 1 << 18
MATRIX = 1 << 21
BLOCK = 1024
# Of the height of a shape: the width in degrees of a strip that counts as nothing, beyond what rounding leaves of one.
_NOTHING = 2.0**-44
_ALL = 1 - 2.0**-40
# A number for every bin.
_BINS, _LEAST = 4096, -2048


def _crossings(item, firsts, ends, west, east):
    """Items and heights where edges of one item can meet."""
    x1, y1, x2, y2 = ends
    following = firsts[item + 1] - np.arange(len(item)) - 1
    for a, b in lots_of(following, PAIRS):
        other, one = spans(np.arange(a, b) + 1, following[a:b])
        one = one + a
        near = (west[one] <= east[other]) & (west[other] <= east[one]) & (y1[one] <= y2[other]) & (y1[other] <= y2[one])
        one, other = one[near], other[near]
        dx, dy, ox, oy = x2[one] - x1[one], y2[one] - y1[one], x2[other] - x1[other], y2[other] - y1[other]
        turn = dx * oy - dy * ox
        at = ((x1[other] - x1[one]) * oy - (y1[other] - y1[one]) * ox) / turn
        some = turn != 0
        yield item[one[some]], (y1[one] + dy * at)[some]


def _at(ends, y):
    """Where edges are at heights that they reach."""
    x1, y1, x2, y2 = ends
    return np.where(y >= y2, x2, np.where(y <= y1, x1, x1 + (x2 - x1) * ((y - y1) / (y2 - y1))))


def slabs(item_of_part, odd, sizes, edges, box, open_right, open_bottom):
    """Edges that begin or end the inside of items, by slab and from the right: item, lower and upper height, where the
    edge is there, and 1 or -1.

    An item is the union of parts, ``sizes`` edges each, that follow the even-odd rule, within a box (``west, east,
    south, north`` by item). As in ``geometry.covers`` edges are those that touch the box, and ``odd`` tells whether its
    lower right corner is inside. Items with an open right side have all their edges, and what is right of the box is
    not left out.
    """
    *ends, west, east = edges
    x1, y1, x2, y2 = ends
    left_side, right_side, south, north = box
    items = len(south)
    part = np.repeat(np.arange(len(sizes)), sizes)
    item = item_of_part[part]
    firsts = np.searchsorted(item, np.arange(items + 1))
    right, bottom = right_side[item], south[item]
    # Edges that meet the right border, and whether the corner is below them; there "on" counts as left of an edge.
    meets_right = ~open_right[item] & (west < right) & (right <= east)
    at_right = np.flatnonzero(meets_right)
    turned = exact_sides([v[at_right] for v in ends], right[at_right], bottom[at_right])
    leans = (x2 > x1)[at_right] | (y1 == y2)[at_right]
    corner_below = np.where(leans, turned < 0, turned >= 0) | open_bottom[item[at_right]]

    def height(x, some):
        """Where slanted edges are at an upright line that they meet."""
        level = y1[some] == y2[some]
        found = y1[some] + (y2[some] - y1[some]) * ((x - x1[some]) / np.where(x1[some] == x2[some], 1.0, x2[some] - x1[some]))
        return np.where(level, y1[some], found)

    hit = np.where(corner_below, height(right[at_right], at_right), bottom[at_right])
    at_left = np.flatnonzero((west < left_side[item]) & (left_side[item] < east))
    also = [*_crossings(item, firsts, ends, west, east)]
    owners = [np.arange(items), np.arange(items), item, item, item[at_right], item[at_left], *(a for a, _ in also)]
    owner = np.concatenate(owners)
    y = np.concatenate([south, north, y1, y2, hit, height(left_side[item[at_left]], at_left), *(h for _, h in also)])
    y = np.clip(y, south[owner], north[owner])
    # Heights of an item without repeats; a slab has the number of its lower one.
    order = np.lexsort((y, owner))
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (y[order][1:] != y[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    level, level_item = y[order][new], owner[order][new]
    at = np.cumsum([len(o) for o in owners])
    low, high, hit = rank[at[1] : at[2]], rank[at[2] : at[3]], rank[at[3] : at[4]]
    first_level = np.searchsorted(level_item, np.arange(items + 1))
    # Whether the right border is inside a part, by part and slab.
    levels = (first_level[1:] - first_level[:-1])[item_of_part]
    offset = firsts_of(levels)
    flips = np.zeros(offset[-1] + 1, np.int64)
    place = offset[:-1] - first_level[item_of_part]
    np.add.at(flips, (place[part[at_right]] + hit)[corner_below], 1)
    flips = np.concatenate([[0], np.cumsum(flips)])
    base = flips[1:-1] - np.repeat(flips[offset[:-1]], levels)
    base = (base + np.repeat(odd.astype(np.int64), levels)) & 1
    # Edges within the box, slab by slab.
    begin, stop = low.copy(), high.copy()
    leaning = x2[at_right] > x1[at_right]
    stop[at_right] = np.where(leaning, np.minimum(stop[at_right], hit), stop[at_right])
    begin[at_right] = np.where(leaning, begin[at_right], np.maximum(begin[at_right], hit))
    beyond = ~open_right[item] & (west >= right)
    slab, edge = spans(begin, np.where(beyond, 0, np.maximum(stop - begin, 0)))
    own = [v[edge] for v in ends]
    x = [np.clip(_at(own, level[slab + up]), left_side[item[edge]], right_side[item[edge]]) for up in (0, 1)]
    middle = -(x[0] + x[1])
    of_part = place[part[edge]] + slab
    order = np.lexsort((middle, of_part))
    sorted_part = of_part[order]
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order)) - np.searchsorted(sorted_part, sorted_part)
    change = 1 - 2 * ((base[of_part] + turn) & 1)
    if len(sizes) > items:
        order = np.lexsort((middle, slab))
    slab, edge, change, x = slab[order], edge[order], change[order], [v[order] for v in x]
    # Parts that hold what lies left of an edge, of those that hold the right border and the edges before.
    inside = np.bincount(np.arange(offset[-1]) - np.repeat(place, levels), base, len(level)).astype(np.int64)
    after = np.cumsum(change)
    starts = np.searchsorted(slab, slab)
    after = after - after[starts] + change[starts] + inside[slab]
    before = after - change
    sign = (after > 0).astype(np.int64) - (before > 0)
    told = np.flatnonzero(sign)
    slab, sign, x = slab[told], sign[told], [v[told] for v in x]
    along = np.flatnonzero(inside[:-1] * (level_item[1:] == level_item[:-1]) > 0)
    border = right_side[level_item[along]]
    slab = np.concatenate([along, slab])
    order = np.argsort(slab, kind="stable")
    sign = np.concatenate([np.ones(len(along), np.int64), sign])[order]
    x = [np.concatenate([border, v])[order] for v in x]
    slab = slab[order]
    return level_item[slab], level[slab], level[slab + 1], *x, sign


def _surfaces(y1, y2, t1, t2, sign):
    return sign * (y2 - y1) * (t1 + t2) / 2


def _in_lots(item_of_part, sizes) -> Iterator[tuple[slice, slice]]:
    """Parts and edges of lots of whole items."""
    first_edge = firsts_of(sizes)
    starts = np.flatnonzero(np.diff(item_of_part, prepend=-1))
    bounds = np.append(starts, len(sizes))
    for a, b in lots_of(first_edge[bounds[1:]] - first_edge[bounds[:-1]], EDGES):
        parts = slice(bounds[a], bounds[b])
        yield parts, slice(first_edge[parts.start], first_edge[parts.stop])


class _Covered(Window):
    """The areas in and beside one tile, and what they cover of cells that they touch."""

    def __init__(self, grid):
        super().__init__(grid.fanout)
        self.grid = grid

    def build(self):
        if self.built:
            return
        super().build()
        area, key, odd, sizes, edges = self.parts
        item = np.cumsum((np.diff(key, prepend=-1) != 0) | (np.diff(area, prepend=-1) != 0)) - 1
        cell, found = self.grid.cell, []
        for parts, some in _in_lots(item, sizes):
            own = item[parts] - item[parts.start]
            first = np.flatnonzero(np.diff(own, prepend=-1)) + parts.start
            cx, cy = cell_of(key[first])
            box = [cx * cell, (cx + 1) * cell, cy * cell, (cy + 1) * cell]
            of, y1, y2, x1, x2, sign = slabs(
                own, odd[parts], sizes[parts], [v[some] for v in edges], box, cx >= self.grid.x[1], cy <= self.grid.y[0]
            )
            west, south = box[0][of], box[2][of]
            piece = (key[first][of], area[first][of], y1 - south, y2 - south, x1 - west, x2 - west, sign)
            left = (piece[3] > piece[2]) & ((piece[4] > 0) | (piece[5] > 0))
            found.append([v[left] for v in piece])
        self.pieces = {}
        if found:
            key, area, *pieces = (np.concatenate(v) for v in zip(*found))
            for k, a, b in grouped(key):
                firsts = np.flatnonzero(np.diff(area[a:b], prepend=-1))
                here = [v[a:b] for v in pieces]
                self.pieces[k] = (area[a:b][firsts], firsts, here, np.add.reduceat(_surfaces(*here), firsts))


class _Cut:
    """What shapes cover of cells: surfaces of shapes and cells, and edges in the cells that a shape covers in part."""

    def __init__(self, shapes: Shapes, cell: float):
        count = shapes.count
        item = shapes.polygon_shape
        far, nowhere = np.full(count, np.inf), np.zeros(count, bool)
        west, east, south, north = shapes.box
        found = []
        for parts, some in _in_lots(item, shapes.sizes):
            first = item[parts.start]
            own = slice(first, item[parts.stop - 1] + 1)
            edges = [v[some] for v in (*shapes.ends, shapes.west, shapes.east)]
            box = (-far[own], far[own], south[own], north[own])
            of, *rest = slabs(
                item[parts] - first, np.zeros(parts.stop - parts.start, bool), shapes.sizes[parts], edges, box, ~nowhere[own], nowhere[own]
            )
            found.append((of + first, *rest))
        of, y1, y2, x1, x2, sign = (np.concatenate(v) for v in zip(*found)) if found else [np.empty(0)] * 6
        self.height = north - south
        # From the right an edge that begins the inside is followed by the one that ends it.
        row, right, left = self._rows(of[::2].astype(np.int64), y1[::2], y2[::2], [(x1[n::2], x2[n::2]) for n in (0, 1)], cell)
        shape, cy, low, high = row
        begin = np.floor(np.minimum(*left) / cell).astype(np.int64)
        end = np.maximum(begin, np.ceil(np.maximum(*right) / cell).astype(np.int64) - 1)
        cx, at = spans(begin, end - begin + 1)
        shape, cy, low, high = (v[at] for v in (shape, cy, low, high))
        right, left = ([v[at] - cx * cell for v in side] for side in (right, left))
        key = cell_key(cx, cy)
        pieces = [
            (shape, key, *piece, np.full(len(key), s)) for side, s in ((right, 1), (left, -1)) for piece in self._within(low, high, *side, cell)
        ]
        shape, key, *pieces = (np.concatenate(v) for v in zip(*pieces))
        some = np.flatnonzero(pieces[1] > pieces[0])
        some = some[np.lexsort((shape[some], key[some]))]
        shape, key, pieces = shape[some], key[some], [v[some] for v in pieces]
        new = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(shape, prepend=-1) != 0))
        surface = np.add.reduceat(_surfaces(*pieces), new) if len(new) else np.empty(0)
        self.whole = surface >= cell * cell * _ALL
        self.shape, self.key = shape[new], key[new]
        self.surface = np.where(self.whole, cell * cell, surface)
        self.total = np.bincount(self.shape, self.surface, count)
        # Edges of the cells that are covered in part.
        sizes = np.diff(np.append(new, len(shape)))
        kept = np.repeat(~self.whole, sizes)
        self.pieces = [v[kept] for v in pieces]
        self.part_key, self.part_shape, self.part_first = self.key[~self.whole], self.shape[~self.whole], firsts_of(sizes[~self.whole])

    @staticmethod
    def _rows(shape, y1, y2, sides, cell):
        """Pieces between two edges, cut by rows of cells; heights are from the row's lower border."""
        begin = np.floor(y1 / cell).astype(np.int64)
        cy, at = spans(begin, np.maximum(begin, np.ceil(y2 / cell).astype(np.int64) - 1) - begin + 1)
        y1, y2 = y1[at], y2[at]
        low, high = np.maximum(y1, cy * cell), np.minimum(y2, (cy + 1) * cell)
        cut = []
        for x1, x2 in sides:
            x1, x2 = x1[at], x2[at]
            ends = (x1, y1, x2, y2)
            cut.append((_at(ends, low), _at(ends, high)))
        return (shape[at], cy, low - cy * cell, high - cy * cell), *cut

    @staticmethod
    def _within(low, high, a, b, cell):
        """The parts of an edge (``a`` to ``b`` from the cell's left border) in a cell, and beyond its right border."""
        run = b - a
        upright = run == 0
        run = np.where(upright, 1.0, run)
        begin, end = (np.clip((line - a) / run, 0.0, 1.0) for line in (0.0, cell))
        rises = b > a
        y0, y1 = (np.where(v <= 0, low, np.where(v >= 1, high, low + (high - low) * v)) for v in (begin, end))
        x0, x1 = (np.clip(np.where(v <= 0, a, np.where(v >= 1, b, line)), 0.0, cell) for v, line in ((begin, 0.0), (end, cell)))
        inside = upright & (a > 0) & (a < cell)
        yield (
            np.where(upright, low, np.where(rises, y0, y1)),
            np.where(upright, np.where(inside, high, low), np.where(rises, y1, y0)),
            np.where(upright, a, np.where(rises, x0, x1)),
            np.where(upright, a, np.where(rises, x1, x0)),
        )
        full = np.full(len(a), cell)
        yield (
            np.where(upright | ~rises, low, y1),
            np.where(upright, np.where(a >= cell, high, low), np.where(rises, high, y1)),
            full,
            full,
        )


def _left_of_both(one, other):
    """Surfaces left of pieces of edges, every one of ``one`` (a row) with every one of ``other``, with their signs."""
    (a1, a2, s1, s2, sign), (b1, b2, t1, t2, turn) = one, other
    a_run = (s2 - s1) / (a2 - a1)
    b_run = (t2 - t1) / (b2 - b1)
    low, high = np.maximum(a1[:, None], b1), np.minimum(a2[:, None], b2)
    ends = []
    for y in (low, high):
        s = np.clip(s1[:, None] + a_run[:, None] * (y - a1[:, None]), np.minimum(s1, s2)[:, None], np.maximum(s1, s2)[:, None])
        t = np.clip(t1 + b_run * (y - b1), np.minimum(t1, t2), np.maximum(t1, t2))
        ends.append((np.minimum(s, t), s - t))
    (m, d), (n, e) = ends
    apart = np.maximum(-d * e, 0.0)
    apart /= np.maximum(np.abs(d) + np.abs(e), 1e-300)
    return sign[:, None] * turn * np.maximum(high - low, 0.0) * (m + n + apart) / 2


def _shared(cut: _Cut, window: _Covered, count: int):
    """The surface that every shape (a row) shares with every area."""
    shared = np.zeros((count, len(window.names)))
    # Cells that the area or the shape covers entirely.
    keys, column = np.unique(cut.key, return_inverse=True)
    order = np.argsort(column, kind="stable")
    bounds = np.searchsorted(column[order], np.arange(len(keys) + 1))
    most = max(1, MATRIX // max(len(window.names), count))
    cx, cy = cell_of(keys)
    for at in range(0, len(keys), most):
        end = min(len(keys), at + most)
        some = order[bounds[at] : bounds[end]]
        place = cut.shape[some], column[some] - at
        mine = np.zeros((count, end - at))
        mine[place] = cut.surface[some]
        theirs = np.stack([window.mask(x, y) for x, y in zip(cx[at:end].tolist(), cy[at:end].tolist())])
        used = np.flatnonzero(theirs.any(axis=0))
        if len(used):
            shared[:, used] += mine @ theirs[:, used].astype(np.float64)
        mine[place] = cut.whole[some]
        if cut.whole[some].any():
            touched = np.zeros((end - at, len(window.names)))
            for n, k in enumerate(keys[at:end].tolist()):
                if k in window.pieces:
                    areas, _, _, surfaces = window.pieces[k]
                    touched[n, areas] = surfaces
            shared += mine @ touched
    # Cells where both have edges.
    for k, a, b in grouped(cut.part_key):
        if k not in window.pieces:
            continue
        areas, firsts, other, _ = window.pieces[k]
        first = cut.part_first[a : b + 1]
        for c, d in lots_of((first[1:] - first[:-1]) * len(other[0]), PAIRS):
            here = slice(first[c], first[d])
            both = _left_of_both([v[here] for v in cut.pieces], other)
            both = np.add.reduceat(np.add.reduceat(both, firsts, axis=1), first[c:d] - first[c], axis=0)
            shared[np.ix_(cut.part_shape[a + c : a + d], areas)] += both
    return shared


def binned(value):
    """Bins and parts of doubles, as ``exact.split`` makes them."""
    finite = np.isfinite(value)
    x = np.where(finite, value, 0.0)
    _, exponent = np.frexp(np.where(x == 0, 1.0, x))
    bins = (exponent.astype(np.int64) - 1 - 54) // exact.STEP
    times = np.ldexp(x, (-exact.STEP * bins).astype(np.int32)).astype(np.int64)
    special = np.where(np.isnan(value), exact.NAN, np.where(value > 0, exact.PLUS, exact.MINUS))
    bins, times = np.where(finite, bins, special), np.where(finite, times, 1)
    mask = (1 << exact.PART) - 1
    return bins, (times >> 2 * exact.PART, (times >> exact.PART) & mask, times & mask)


def _added(names, shape, area, share, kinds, values, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Figures of shapes by their shares, added up by area, kind, measure and bin."""
    coded = kinds.dictionary_encode(null_encoding="encode")
    kind = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[shape]
    group = (area.astype(np.int64) * max(1, len(coded.dictionary)) + kind) * _BINS - _LEAST
    for n, (measure, value) in enumerate(values.items()):
        bins, parts = binned(value[shape] * share)
        found, at = np.unique(group + bins, return_inverse=True)
        sums = [np.bincount(at, p, len(found)).astype(np.int64) for p in parts]
        bins, group_of = found % _BINS + _LEAST, found // _BINS
        which = len(coded.dictionary) or 1
        columns = [
            names.take(pa.array(group_of // which)),
            coded.dictionary.take(pa.array(group_of % which)),
            pa.array([measure] * len(found)),
            pa.array(bins.astype(np.int32)),
            *map(pa.array, sums),
        ]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def sharing(
    schema: pa.Schema, grid, measures: Sequence[str] | None = None
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task: rows of areas and shapes, as for ``meeting``, to rows of ``schema``.

    Without ``measures`` these are ``_id`` and the list of areas with shares, with them an area, a kind, a measure, a bin
    and sums of three parts; shapes have ``kind`` and the measures then.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for window, batch, shapes in blocks(batches, lambda: _Covered(grid), BLOCK, MATRIX):
                cut = _Cut(shapes, grid.cell)
                shared = _shared(cut, window, shapes.count)
                least = (cut.height * _NOTHING)[:, None]
                of, area = np.nonzero((shared > least) & (cut.total[:, None] > least))
                share = shared[of, area] / cut.total[of]
                share = np.where(share >= _ALL, 1.0, share)
                if measures is None:
                    yield from listed(batch.column("_id"), window.names, of, area, schema, share)
                elif len(of):
                    values = {m: as_numbers(batch.column(m)) for m in measures}
                    yield from _added(window.names, of, area, share, batch.column("kind"), values, schema)

    return run
