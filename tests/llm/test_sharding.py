from collections import defaultdict

import pytest

from bandrisk.llm import sharding
from bandrisk.sources.store import Scratch
from tests.llm.data import clashing, documents, odd_rows, text


def laws(rows, shards, slack):
    sizes, slots = [0] * shards, defaultdict(list)
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 1
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(sizes) / shards
    assert all(abs(s - mean) <= slack for s in sizes), sizes


def test_bytes_are_even_and_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BYTES", 3000)
    rows = odd_rows() + [(100 + n, text(n, 20 + n % 90), "en", "a", 1) for n in range(1500)]
    hot = text(7, 60)
    rows += [(5000 + n, hot, "en", "a", 1) for n in range(900)]
    docs = clashing(documents(spark, rows)).repartition(5)
    with Scratch(spark) as scratch:
        placed = sharding.shard_documents(docs, scratch)
        got = placed.collect()
    assert len(got) == len(rows) and set(docs.columns) <= set(placed.columns)
    longest = len(text(3, 5000).encode())
    laws(got, 8, longest + 600)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_a_repeated_row_that_is_a_third_of_all(spark, monkeypatch, doc_id):
    monkeypatch.setattr(sharding, "PART_BYTES", 3000)
    rows = [(n, text(n, 60), "en", "a", 1) for n in range(2000)] + [(doc_id, text(3, 60), "en", "a", 1)] * 1000
    with Scratch(spark) as scratch:
        placed = sharding.shard_documents(documents(spark, rows).repartition(5), scratch)
        got = placed.collect()
    kept = ((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got)
    assert sorted(map(repr, kept)) == sorted(map(repr, rows))
    laws(got, 8, 1000)


def test_few_rows_and_none(spark):
    with Scratch(spark) as scratch:
        three = documents(spark, [(1, "a", None, None, None), (2, None, None, None, None), (2, None, None, None, None)])
        got = sharding.shard_documents(three, scratch).collect()
        assert len(got) == 3 and all(0 <= r.shard < 8 for r in got)
        assert sharding.shard_documents(documents(spark, []), scratch).count() == 0


def test_splitters_cut_a_run_of_equal_hashes(spark):
    rows = [(5, tie, 10) for tie in range(1000)] + [(9, 0, 1)]
    keys = spark.createDataFrame(rows, "_hash long, _tie long, size long").repartition(3)
    bounds = sharding.splitters(keys, 4)
    counts = [sum((h, t) < b for h, t, _ in rows) for b in bounds]
    assert [abs(c - n) <= 2 for c, n in zip(counts, (250, 500, 750))] == [True] * 3
