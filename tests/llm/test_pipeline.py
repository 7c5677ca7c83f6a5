"""The whole chain on small rows against plain versions of its stages, one after the other."""

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from bandrisk.llm import packing
from tests.llm import test_decontaminate, test_simhash, test_substring
from tests.llm.data import documents, text


def rows_to_clean():
    """Documents with a copy, near copies, a shared passage, benchmark items, no letters and no text."""
    rng = random.Random(11)
    rows = [(n, text(n, rng.randrange(5, 200)), rng.choice(("en", "de", None)), "a", 1) for n in range(40)]
    rows += [(50, rows[3][1], "en", "a", 1), (51, rows[4][1].upper(), None, "b", 1), (52, rows[5][1] + " more", "de", "a", 1)]
    passage = text(900, 60)
    rows += [(60 + n, f"{text(600 + n, 30)} {passage} {text(700 + n, 30)}", "en", "a", 1) for n in range(4)]
    rows += [(70, None, "en", "a", None), (71, "", "en", "a", 0), (72, "12 34 !!", None, "a", 8), (73, "ok", "en", "a", 2)]
    rows += [(80, f"{text(801, 40)} {text(5, 24)} {text(802, 9)}", "en", "a", 1)]
    return rows, [(1, text(5, 24)), (2, text(999, 12)), (3, "never seen words stand here now")]


def test_chain_against_plain_stages(spark, tmp_path):
    rows, items = rows_to_clean()
    documents(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    fingerprints = [test_simhash.slow_fingerprint(r[1]) for r in kept]
    roots = test_simhash.slow_components(fingerprints, lambda a, b: (a ^ b).bit_count() <= 3)
    first = {root: min(kept[n][0] for n in range(len(kept)) if roots[n] == root) for root in roots}
    kept = [r for r in kept if r[0] in first.values()]
    cut = {doc: words for doc, _, removed, words in test_substring.brute_force(kept, 35) if removed}
    kept = [(r[0], cut[r[0]].decode() if r[0] in cut else r[1], *r[2:]) for r in kept]
    held = {doc for doc, *_ in test_decontaminate.expected(kept, items)}
    kept = [r for r in kept if r[0] not in held]
    assert len(cut) >= 3 and held and len(kept) < len(rows) - 6

    tokenizer = Tokenizer.from_file(packing.tokenizer_paths()[0])
    ids = {r[0]: tokenizer.encode(r[1], add_special_tokens=False).ids + [1] for r in kept}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(own) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for found, size in [(pieces[doc], len(tokens)) for doc, tokens in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == size or size is None and (at == packing.SEQUENCE or at & (at - 1) == 0)


def test_stages_keep_the_columns_and_missing_languages_are_filled(spark, tmp_path):
    rows, items = rows_to_clean()
    docs = documents(spark, rows)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)["language ID"]
    found = {r.doc_id: r.lang for r in stage(spark, docs, str(tmp_path)).collect()}
    given = {r[0]: r[2] for r in rows}
    assert all(lang == given[doc] if given[doc] else lang in ("en", "de") for doc, lang in found.items())
    assert set(given) - set(found) == {70, 71, 72}
