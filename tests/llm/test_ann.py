import math

import numpy as np
import pytest

from bandrisk.llm import ann
from bandrisk.sources.store import Scratch

VECTORS = "vec_id long, embedding array<float>, rank string"


def search(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS).repartition(3)
    with Scratch(spark) as scratch:
        got = ann.nearest_neighbours(frame, scratch, **options).collect()
    result = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        result.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(result[r.query_id])
    return result


def exact(rows, query, nearest):
    own = np.array(dict(rows)[query], np.float32).astype(float)
    found = {i: float(np.sqrt(((np.array(v, np.float32).astype(float) - own) ** 2).sum())) for i, v in rows if i != query}
    return sorted(found.items(), key=lambda p: (p[1], p[0]))[:nearest]


def test_recall_over_shards(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (12, 24))
    rows = [(n, (centres[n % 12] + rng.normal(0, 0.7, 24)).tolist()) for n in range(3000)]
    got = search(spark, rows, shard_points=700)
    hits = total = 0
    for query in range(0, 3000, 100):
        best = exact(rows, query, 10)
        hits += len({i for i, _ in best} & {i for i, _ in got[query]})
        total += len(best)
        for i, score in got[query]:
            own = dict(exact(rows, query, 3000))
            assert abs(own[i] - score) < 1e-12
    assert hits / total >= 0.95


def test_copies_ties_and_rows_that_take_no_part(spark):
    same, far = [1.0, 0.0, 0.0], [0.0, 5.0, 0.0]
    rows = [(n, same) for n in range(1, 40)] + [(100, same), (200, far), (200, far), (300, [2.0, 0.0, 0.0])]
    rows += [(400, None), (500, [0.0, 0.0, 0.0]), (600, [float("nan"), 1.0, 1.0]), (700, [1.0, None, 1.0]), (800, [])]
    rows += [(900, [float("inf"), 1.0, 1.0]), (None, same), (1000, [1.0, 1.0])]
    got = search(spark, rows)
    assert [i for i, _ in got[100]] == list(range(1, 11)) and {s for _, s in got[100]} == {0.0}
    assert [i for i, _ in got[300]] == list(range(1, 11)) and {s for _, s in got[300]} == {1.0}
    assert [i for i, _ in got[200]] == list(range(1, 11))
    assert set(got) == {100, 200, 300}


def test_many_vectors_at_one_distance(spark):
    # A grid of 27 points, asked for from its middle: 6, 12 and 8 lie at one distance each; ids are in no order.
    grid = [[x, y, z] for x in (1.0, 2.0, 3.0) for y in (1.0, 2.0, 3.0) for z in (1.0, 2.0, 3.0)]
    for seed in range(3):
        ids = np.random.default_rng(seed).permutation(np.arange(1, 28)).tolist()
        rows = [(100 if v == [2.0, 2.0, 2.0] else i, v) for i, v in zip(ids, grid)]
        assert search(spark, rows)[100] == exact(rows, 100, 10)
        assert search(spark, rows, shard_points=14)[100] == exact(rows, 100, 10)


@pytest.mark.parametrize(
    "kind,make",
    [
        ("float", lambda rng: 1e25 + 1e24 * rng.normal(0, 1, 8)),
        ("double", lambda rng: 1e200 * rng.normal(0, 1, 8)),
        ("double", lambda rng: 1e-200 * rng.normal(0, 1, 8)),
        ("double", lambda rng: 1000 + 1e-6 * rng.normal(0, 1, 8)),
        ("double", lambda rng: rng.choice((1e308, -1e308, 1.0), 8)),
    ],
)
def test_numbers_of_any_size(spark, kind, make):
    rng = np.random.default_rng(5)
    rows = [(n, make(rng).tolist()) for n in range(300)]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    known = {r.vec_id: np.array(r.embedding) for r in frame.collect()}
    with Scratch(spark) as scratch:
        got = {}
        for r in ann.nearest_neighbours(frame, scratch, shard_points=100).collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for query in (0, 100, 200):
        with np.errstate(over="ignore"):
            far = {n: math.hypot(*(v - known[query])) for n, v in known.items() if n != query}
        best = sorted(far.items(), key=lambda p: (p[1], p[0]))[:10]
        assert len(got[query]) == 10
        assert all(math.isclose(s, far[n], rel_tol=1e-12) for n, s in got[query])
        hits += sum(s <= best[-1][1] * (1 + 1e-12) for _, s in got[query])
    assert hits >= 27


def test_fewer_candidates_than_asked_for_and_none(spark):
    got = search(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (7, [4.0, 2.0])])
    assert [i for i, _ in got[0]] == [1, 7]
    assert search(spark, [(0, [1.0, 2.0])]) == {} and search(spark, []) == {}
