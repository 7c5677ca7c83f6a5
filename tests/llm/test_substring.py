from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandrisk.llm import substring
from tests.llm.data import clashing, documents, odd_rows, text


def brute_force(rows, window):
    docs = [(r[1] or "").encode().split() for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    result = []
    for row, tokens in zip(rows, docs):
        covered = [False] * len(tokens)
        for i in range(len(tokens) - window + 1):
            if seen[tuple(tokens[i : i + window])] > 1:
                covered[i : i + window] = [True] * window
        kept = b" ".join(t for t, c in zip(tokens, covered) if not c)
        result.append((row[0], len(tokens), sum(covered), kept))
    return sorted(result, key=repr)


def got(docs, **options):
    rows = substring.remove_repeated(docs, **options).collect()
    return sorted(((r.doc_id, r._n_words, r._n_removed, bytes(r._kept)) for r in rows), key=repr)


@pytest.mark.parametrize("window,bits", [(35, 12), (35, 22), (3, 16), (9, 14)])
def test_against_brute_force(spark, window, bits):
    rows = odd_rows()
    shared = text(50, 45)
    rows += [(100 + n, f"{text(n, 20)} {shared} {text(n + 500, 7)}", "en", "a", 1) for n in range(30)]
    rows += [(200, "a " * 400, "en", "a", 1), (201, f"{text(9, 40)} {text(9, 40)}", "en", "a", 1)]
    docs = clashing(documents(spark, rows)).repartition(5)
    assert got(docs, window=window, sketch_bits=bits) == brute_force(rows, window)


def test_chunks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_WORDS", 30)
    rows = odd_rows()
    docs = documents(spark, rows).coalesce(1)
    assert got(docs, sketch_bits=16) == brute_force(rows, 35)


def test_equal_windows_share_an_anchor_and_every_anchor_counts():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 5, 400).astype(np.uint64)
    lowest, places = substring.anchors(hashes, 12, 4)
    assert set(lowest.tolist()) == set(places.tolist())
    windows = Counter(tuple(hashes[i : i + 12].tolist()) for i in range(len(hashes) - 11))
    times = Counter(places.tolist())
    assert all(times[int(low)] >= windows[tuple(hashes[i : i + 12].tolist())] for i, low in enumerate(lowest))


def test_stage_keeps_rows_and_columns(spark):
    docs = clashing(documents(spark, odd_rows()))
    cut = substring.drop_repeated(docs)
    assert cut.dtypes == docs.dtypes and cut.count() == docs.count()
    rows = {r.doc_id: r for r in cut.where("doc_id in (1, 4, 6, 9)").collect()}
    assert rows[1].text == "" and rows[1].n_chars == 0
    assert rows[4].text is None and rows[6].text == " \t\n " and rows[9].text == "12 34 !!"
    assert substring.drop_repeated(docs.where(F.lit(False))).count() == 0
