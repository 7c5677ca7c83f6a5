import random
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from bandrisk.llm import packing
from tests.llm.data import clashing, documents, odd_rows, text


def check_pieces(rows, tokens, capacity):
    """Every id in one piece, sequences full or a power of two, offsets without gaps."""
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        parts[r.doc_id].append((r.doc_tokens, r.start, ids.tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    for doc_id, expected in tokens.items():
        starts = [(t, s, ids) for t, s, ids in parts[doc_id]]
        assert sum(len(ids) for _, _, ids in starts) == sum(map(len, expected))
        if len(expected) == 1:
            assert [i for _, _, ids in sorted(starts) for i in ids] == expected[0]
    assert set(parts) == set(tokens)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_paths()[0])


def test_encoder_agrees_with_the_tokenizer(tokenizer):
    encode = packing.Encoder(*packing.tokenizer_paths())
    rng = random.Random(4)
    alphabet = ["a", "Z", "é", " ", "  ", "\n", "\t", "1", "'s", "!", "中", "😀", " ", " ", "\x1c", "\x85", "ñ", "ɐ", "<|endoftext|>"]
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n b", "it's  'll x", "  a"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    for value in texts:
        assert np.frombuffer(encode(value), "<u2").tolist() == tokenizer.encode(value, add_special_tokens=False).ids


@pytest.mark.parametrize("group_bytes", [1 << 20, 2000])
def test_round_trip(spark, tokenizer, group_bytes):
    rows = odd_rows() + [(50 + n, text(n, 30 * n), "en", "a", 1) for n in range(40)]
    docs = clashing(documents(spark, rows)).repartition(4)
    tokens = defaultdict(list)
    for row in rows:
        tokens[row[0]].append(tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [1])
    got = packing.pack_documents(docs, capacity=256, group_bytes=group_bytes).collect()
    check_pieces(got, tokens, 256)


def test_repeated_rows_of_one_task_spread_over_the_groups(spark):
    rows = [(7, text(1, 50), None, None, None)] * 300 + [(n, text(n, 50), None, None, None) for n in range(10, 310)]
    docs = documents(spark, rows).coalesce(1)
    got = packing.pack_documents(docs, capacity=256, group_bytes=10_000).select("doc_id", "doc_tokens", "sequence_id").collect()
    tokens = defaultdict(int)
    for r in got:
        tokens[r.sequence_id >> 32] += r.doc_tokens
    assert len(tokens) >= 15 and max(tokens.values()) < 4 * sum(tokens.values()) / len(tokens)


def test_no_rows(spark):
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 101) for _ in range(400)]
    bins: list[list[int]] = []
    room: list[int] = []
    for position in sorted(range(len(sizes)), key=lambda p: (-sizes[p], p)):
        for n, free in enumerate(room):
            if free >= sizes[position]:
                break
        else:
            n = len(room)
            room.append(100)
            bins.append([])
        room[n] -= sizes[position]
        bins[n].append(position)
    assert packing.first_fit_decreasing(sizes, 100) == bins
    assert packing.first_fit_decreasing([], 100) == []


def test_pack_leaves_no_padding():
    lengths = [1, 5000, 2048, 3, 2047, 700, 700, 700, 1]
    packed = packing.pack(lengths, 2048)
    sizes = [sum(p[2] for p in s) for s in packed]
    assert sum(sizes) == sum(lengths) and all(n == 2048 or n & (n - 1) == 0 for n in sizes)
    for document, length in enumerate(lengths):
        spans = sorted((s, n) for sequence in packed for d, s, n in sequence if d == document)
        assert spans[0][0] == 0 and sum(n for _, n in spans) == length
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
