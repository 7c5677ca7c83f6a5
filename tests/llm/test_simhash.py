import numpy as np
import xxhash
from pyspark.sql import functions as F

from bandrisk.llm import simhash
from bandrisk.llm.components import connected_components
from bandrisk.sources.store import Scratch
from tests.llm.data import clashing, documents, odd_rows, text


def slow_fingerprint(value):
    tokens = (value or "").encode().lower().split()
    parts = [b" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] or ([b" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(nodes))]


def test_fingerprint_in_pieces(monkeypatch):
    value = text(5, 500).encode()
    whole = simhash.fingerprint(value)
    monkeypatch.setattr(simhash, "WORDS_AT_ONCE", 7)
    assert simhash.fingerprint(value) == whole == slow_fingerprint(value.decode())


def test_every_link_up_to_three_bits(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    fps = set(centres.tolist())
    for centre in centres.tolist():
        for _ in range(12):
            value = centre
            for bit in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                value ^= 1 << bit
            fps.add(value)
    nodes = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    expected = slow_components(nodes, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    frame = spark.createDataFrame([(n,) for n in nodes], "fp long").repartition(7)
    for limit in (simhash.HALF_LIMIT, 5):
        links = simhash.near_links(frame, half_limit=limit)
        pairs = {tuple(r) for r in links.collect()}
        assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 6 for u, v in pairs)
        with Scratch(spark) as scratch:
            found = {r.node: r.component for r in connected_components(links, scratch).collect()}
        assert [found.get(n, n) for n in nodes] == [nodes[e] for e in expected]


def test_near_duplicates_against_brute_force(spark):
    rows = odd_rows()
    docs = clashing(documents(spark, rows))
    with Scratch(spark) as scratch:
        got = simhash.near_duplicates(docs, scratch).collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    roots = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    ids = [min((rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or 0)
    expected = sorted(((r[0], f, i) for r, f, i in zip(rows, fps, ids)), key=key)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=key) == expected


def test_one_document_of_each_group_stays(spark):
    docs = clashing(documents(spark, odd_rows()))
    with Scratch(spark) as scratch:
        kept = simhash.drop_near_duplicates(docs, scratch).cache()
        rows = kept.collect()
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in rows]
    assert ids.count(1) == 1 and not {2, 12} & set(ids)
    # NULL, empty and blank texts have fingerprint zero: one of them stays, one with an id.
    assert sum(r.text is None or not r.text.strip() for r in rows) == 1 and 4 in ids
    assert {7, 8, 9, 10, 11} <= set(ids) and ids.count(7) == 2


def test_repeated_rows_stay_once(spark):
    docs = documents(spark, [(5, "a b c", "en", "a", 1)] * 3 + [(6, "x y z", "en", "a", 1)])
    with Scratch(spark) as scratch:
        assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs, scratch).collect()) == [5, 6]


def test_no_rows(spark):
    docs = documents(spark, [])
    with Scratch(spark) as scratch:
        assert simhash.near_duplicates(docs, scratch).count() == 0
        assert simhash.drop_near_duplicates(docs, scratch).count() == 0


def test_components(spark):
    chain = [(n, n + 1) for n in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 100), (300, 300)]
    edges = spark.createDataFrame(chain + [(None, 5), (5, None)], "u long, v long")
    with Scratch(spark) as scratch:
        found = {r.node: r.component for r in connected_components(edges, scratch).collect()}
        assert found == {**{n: 0 for n in range(61)}, 100: 100, 101: 100, 200: 100}
        star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
        assert connected_components(star, scratch).where("component <> 0").count() == 0
        assert connected_components(edges.where("u > 1000"), scratch).count() == 0
