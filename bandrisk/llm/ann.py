"""Approximate nearest neighbours by small-world graphs, one per shard.

Equal vectors are one point, so thousands of copies do not clog a graph. Points are dealt into shards
of bounded size by a hash of the vector. Each shard's points are linked in a hierarchy of small-world
graphs, kept as flat arrays of neighbours. Blocks of queries visit every shard, and the shards'
nearest points are merged. Distances that are reported are computed from the original vectors.
"""

from __future__ import annotations

import heapq
import io
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandrisk.sources.store import Scratch

NEAREST = 10
# Points in a shard, on average, and query points that visit a shard together.
SHARD_POINTS = 8192
BLOCK_QUERIES = 16384
# Links of a point above the ground and on it, and points kept in view while building and searching.
LINKS = 12
GROUND_LINKS = 24
BUILD_VIEW = 64
SEARCH_VIEW = 160


def _power(value: float) -> float:
    """The power of two below a number, by which to divide exactly; one for zero."""
    return math.ldexp(1.0, math.frexp(value)[1] - 1) if value else 1.0


class Frame:
    """Where the points of a shard lie: graphs are walked in coordinates of about one around zero.

    Squares then neither overflow nor vanish, and points that are near each other far from zero stay apart.
    """

    def __init__(self, originals: np.ndarray):
        self.size = _power(float(np.abs(originals).max(initial=0)))
        inside = originals / self.size
        self.middle = (inside.min(axis=0) + inside.max(axis=0)) / 2 if len(inside) else np.zeros(originals.shape[1])
        self.spread = _power(float(np.abs(inside - self.middle).max(initial=0)))

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            # What lies far beyond all points is as far from each.
            return np.clip((vectors / self.size - self.middle) / self.spread, -1e100, 1e100)


def distances(points: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, also where squares overflow or vanish."""
    with np.errstate(over="ignore"):
        gaps = points - vector
        plain = np.sqrt((gaps**2).sum(axis=1))
        largest = np.abs(gaps).max(axis=1, initial=0)
        odd = (largest > 1e150) | ((largest < 1e-150) & (largest > 0))
        if odd.any():
            few, top = gaps[odd], largest[odd]
            plain[odd] = np.where(np.isinf(top), top, top * np.sqrt(((few / top[:, None]) ** 2).sum(axis=1)))
    return plain


@dataclass
class Graph:
    """Points with flat arrays of neighbours, -1 for none. ``floors`` counts from the ground up."""

    vectors: np.ndarray
    floors: list[np.ndarray]
    entry: int

    def search(self, query: np.ndarray, view: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and numbers of the nearest points found, nearest first."""
        start = [(self._distance(query, self.entry), self.entry)]
        for floor in range(len(self.floors) - 1, 0, -1):
            start = self.walk(query, start, 1, floor)
        found = self.walk(query, start, view, 0)
        return np.array([d for d, _ in found]), np.array([p for _, p in found], np.int64)

    def _distance(self, query: np.ndarray, point: int) -> float:
        gap = self.vectors[point] - query
        return float(gap @ gap)

    def walk(self, query: np.ndarray, start: list[tuple[float, int]], view: int, floor: int) -> list[tuple[float, int]]:
        """The nearest ``view`` points that a best-first walk over one floor sees, nearest first."""
        links, vectors = self.floors[floor], self.vectors
        seen = np.zeros(len(vectors), bool)
        seen[[p for _, p in start]] = True
        ahead = list(start)
        heapq.heapify(ahead)
        best = [(-d, p) for d, p in start]
        heapq.heapify(best)
        while ahead:
            distance, point = heapq.heappop(ahead)
            if len(best) >= view and distance > -best[0][0]:
                break
            near = links[point]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            gaps = vectors[near] - query
            for d, p in zip(np.einsum("ij,ij->i", gaps, gaps).tolist(), near.tolist()):
                if len(best) < view:
                    heapq.heappush(best, (-d, p))
                    heapq.heappush(ahead, (d, p))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, p))
                    heapq.heappush(ahead, (d, p))
        return sorted((-d, p) for d, p in best)


def _spread(vectors: np.ndarray, found: list[tuple[float, int]], links: int) -> list[tuple[float, int]]:
    """Neighbours in different directions: each nearer to the point than to those taken before; then the nearest others."""
    if len(found) <= links:
        return found
    points = vectors[[p for _, p in found]]
    squares = np.einsum("ij,ij->i", points, points)
    between = squares[:, None] + squares[None, :] - 2 * points @ points.T
    taken: list[int] = []
    closest = np.full(len(found), np.inf)
    for n, (d, _) in enumerate(found):
        if d < closest[n]:
            taken.append(n)
            if len(taken) == links:
                break
            np.minimum(closest, between[n], out=closest)
    chosen = set(taken)
    rest = (n for n in range(len(found)) if n not in chosen)
    for n in rest:
        if len(taken) == links:
            break
        taken.append(n)
    return [found[n] for n in taken]


def build(vectors: np.ndarray, seed: int) -> Graph:
    """A graph of all points, added one after the other."""
    count = len(vectors)
    rng = np.random.default_rng(seed)
    tops = np.minimum((-np.log(1 - rng.random(count)) / np.log(LINKS)).astype(int), 8)
    floors = [np.full((count, GROUND_LINKS if f == 0 else LINKS), -1, np.int32) for f in range(int(tops.max()) + 1)]
    lengths = [np.full(f.shape, np.inf) for f in floors]
    graph = Graph(vectors, floors, 0)
    height = int(tops[0])
    for point in range(1, count):
        query, top = vectors[point], int(tops[point])
        start = [(graph._distance(query, graph.entry), graph.entry)]
        for floor in range(height, top, -1):
            start = graph.walk(query, start, 1, floor)
        for floor in range(min(top, height), -1, -1):
            start = graph.walk(query, start, BUILD_VIEW, floor)
            links, length = floors[floor], lengths[floor]
            chosen = _spread(vectors, start, LINKS)
            links[point, : len(chosen)] = [p for _, p in chosen]
            length[point, : len(chosen)] = [d for d, _ in chosen]
            for d, p in chosen:
                # The far end takes the link in place of its longest one, or of none.
                worst = int(length[p].argmax())
                if d < length[p, worst]:
                    links[p, worst], length[p, worst] = point, d
        if top > height:
            graph.entry, height = point, top
    return graph


def _packed(graph: Graph, names: np.ndarray, firsts: np.ndarray, originals: np.ndarray) -> bytes:
    """A graph as bytes; floors above the ground keep only the points that have links there."""
    arrays = {"names": names, "firsts": firsts, "originals": originals, "entry": np.array([graph.entry])}
    for n, floor in enumerate(graph.floors):
        used = np.flatnonzero((floor >= 0).any(axis=1))
        arrays[f"points{n}"], arrays[f"links{n}"] = used.astype(np.int32), floor[used]
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(body: bytes) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, Frame]:
    arrays = np.load(io.BytesIO(body))
    originals = arrays["originals"]
    floors = []
    while f"points{len(floors)}" in arrays:
        n = len(floors)
        links = arrays[f"links{n}"]
        floor = np.full((len(originals), links.shape[1]), -1, np.int32)
        floor[arrays[f"points{n}"]] = links
        floors.append(floor)
    frame = Frame(originals)
    graph = Graph(frame(originals), floors, int(arrays["entry"][0]))
    return graph, arrays["names"], arrays["firsts"], originals, frame


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def _build_shard(keys: tuple, table: pa.Table) -> pa.Table:
    order = np.argsort(table["point"].to_numpy())
    originals = _matrix(table["vector"])[order]
    names, firsts = (table[name].to_numpy()[order] for name in ("point", "first"))
    body = _packed(build(Frame(originals)(originals), keys[0].as_py()), names, firsts, originals)
    columns = [pa.array([keys[n].as_py()], pa.int32()) for n in (0, 1)]
    return pa.table([*columns, pa.array([body], pa.binary())], ["shard", "width", "graph"])


def _search_shard(keys: tuple, graphs: pa.Table, queries: pa.Table, nearest: int, view: int) -> pa.Table:
    names = ["query", "point", "first", "score"]
    asked, points, smallest, scores = [], [], [], []
    if graphs.num_rows and queries.num_rows:
        graph, numbers, firsts, originals, frame = _unpacked(graphs["graph"][0].as_py())
        vectors = _matrix(queries["vector"])
        for query, vector, placed in zip(queries["query"].to_pylist(), vectors, frame(vectors)):
            _, found = graph.search(placed, view)
            exact = distances(originals[found], vector)
            best = np.lexsort((numbers[found], firsts[found], exact))[:nearest]
            asked += [query] * len(best)
            points += numbers[found][best].tolist()
            smallest += firsts[found][best].tolist()
            scores += exact[best].tolist()
    whole = [pa.array(column, pa.int64()) for column in (asked, points, smallest)]
    return pa.table([*whole, pa.array(scores, pa.float64())], names)


def nearest_neighbours(
    vectors: DataFrame,
    scratch: Scratch,
    every: int = 100,
    nearest: int = NEAREST,
    shard_points: int = SHARD_POINTS,
    view: int = SEARCH_VIEW,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``nearest`` rows found for each row whose id ``every`` divides.

    ``vectors(vec_id, embedding)`` are compared by Euclidean distance in double precision; ties among
    the points that the graphs find go to the smaller id, and a row is no neighbour of its own id. NULL and empty vectors, zero vectors and
    those with a NULL or non-finite component take no part, nor do rows without an id. Repeated rows
    count once. Vectors meet only those of their own length. Where there are fewer candidates, all
    come out, given that the graph finds them. Other columns are left out; no rows give no rows.
    """
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    usable = vectors.where(f"vec_id IS NOT NULL AND {finite} AND exists(embedding, x -> x <> 0)").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    # Of equal vectors only the smallest ids can be among the nearest: one more than asked for, as a
    # query may be one of them.
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    members = scratch.keep(
        usable.withColumn("_place", place)
        .where(F.col("_place") <= nearest + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
        .withColumn("point", F.monotonically_increasing_id())
    )
    points = members.count()
    shards = max(1, -(-points // shard_points))
    dealt = members.select(
        F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"),
        F.size("vector").alias("width"),
        "point",
        F.col("ids")[0].alias("first"),
        "vector",
    )
    # A number of tasks is given, because the planner would merge shards by their bytes, which take long to build.
    dealt = dealt.repartition(4 * shards, "shard", "width")
    graphs = scratch.keep(
        dealt.groupBy("shard", "width").applyInArrow(_build_shard, "shard int, width int, graph binary")
    )
    asked = scratch.keep(
        usable.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    )
    queries = scratch.keep(asked.select("vector").distinct().withColumn("query", F.monotonically_increasing_id()))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    blocked = queries.select(
        F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), F.size("vector").alias("width"), "*"
    )
    each_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    keys = ["shard", "width", "block"]
    left = graphs.select("*", each_block.alias("block")).groupBy(*keys)
    right = blocked.select(each_shard.alias("shard"), "*").groupBy(*keys)

    def search(group: tuple, graph: pa.Table, block: pa.Table) -> pa.Table:
        return _search_shard(group, graph, block, nearest + 1, view)

    found = left.cogroup(right).applyInArrow(search, "query bigint, point bigint, first bigint, score double")
    by_query = Window.partitionBy("query").orderBy("score", "first", "point")
    merged = found.withColumn("_place", F.row_number().over(by_query)).where(F.col("_place") <= 2 * (nearest + 1))
    expanded = (
        merged.join(members.select("point", F.explode("ids").alias("vec_id")), "point")
        .join(queries, "query")
        .join(asked, "vector")
        .where("vec_id <> query_id")
        .select("query_id", "vec_id", "score")
        .groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return expanded.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
