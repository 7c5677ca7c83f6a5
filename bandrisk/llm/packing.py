"""Packing of tokenised documents into sequences of one length.

Documents are dealt into random groups, and each group is packed on its own. Whole sequences are cut
from long documents first; what is left of each document is packed by first-fit decreasing: the
largest piece first, each into the first sequence that has room. A tournament tree over the room of
the sequences finds that one in logarithmic time. At the end the emptiest sequences are taken apart
and cut to fill the gaps in the others, and the last, unfilled one is cut to powers of two, which
need no padding.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandrisk.llm.text import text_key
from bandrisk.llm.workers import give_back, tidy

SEQUENCE = 2048
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END = 1
# UTF-8 bytes of text in a group; a token has one byte at least, so this bounds a group's tokens.
GROUP_BYTES = 8 << 20
# Beyond these the tokenizer libraries may not agree on what letters and numbers are.
_BEYOND = re.compile("[^\0-\u024f]")
_BREAK = re.compile(r"(?<=\S) ")


def tokenizer_paths(name: str = TOKENIZER, ranks: str = RANKS) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.path(ranks)


class Encoder:
    """Ids of a byte-level BPE vocabulary of up to 65,536 tokens, as little-endian 16-bit numbers.

    Plain texts are encoded whole by the faster of the two libraries. A text with other characters is
    cut at spaces after a character that is no white space, where no token reaches across, and only
    the words with such characters go through the tokenizer itself; whole texts do that hold the name
    of a special token. The tokenizer is read when the first word needs it.
    """

    def __init__(self, path: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken

        self.path = path
        with open(ranks, "rb") as file:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.plain = tiktoken.Encoding(
            "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        if len(described["model"]["vocab"]) > 1 << 16:
            raise ValueError("the vocabulary needs more than 16 bits")
        self.special = [token["content"] for token in described.get("added_tokens", [])]

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, text: str) -> list[int]:
        if any(token in text for token in self.special):
            return self._whole(text)
        if not _BEYOND.search(text):
            return self.plain.encode_ordinary(text)
        ids: list[int] = []
        plain: list[str] = []
        for number, word in enumerate(_BREAK.split(text)):
            piece = f" {word}" if number else word
            if _BEYOND.search(word):
                ids += self.plain.encode_ordinary("".join(plain))
                ids += self._whole(piece)
                plain.clear()
            else:
                plain.append(piece)
        return ids + self.plain.encode_ordinary("".join(plain))

    def __call__(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u2").tobytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(paths: tuple[str, str]) -> Encoder:
    """One encoder per worker process."""
    if paths not in _ENCODERS:
        _ENCODERS[paths] = Encoder(*paths)
    return _ENCODERS[paths]


@tidy
def _encode(batches, paths: tuple[str, str], groups: int) -> Iterator[pa.RecordBatch]:
    """Ids of the texts of a task, dealt into groups; equal rows go to one group after the other."""
    encode = encoder(paths)
    end = np.array([END], "<u2").tobytes()
    seen: Counter[int] = Counter()
    for batch in batches:
        ids = pa.array([encode(text) + end for text in batch.column("text").to_pylist()], pa.binary())
        dealt = []
        for key in batch.column("key").to_pylist():
            dealt.append((key + seen[key]) % groups)
            seen[key] += 1
        yield pa.record_batch([batch.column("doc_id"), pa.array(dealt, pa.int64()), ids], ["doc_id", "group", "ids"])


class TournamentTree:
    """The room of numbered bins; finds the first bin with room for a size."""

    def __init__(self, bins: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.room = [0] * (2 * self.leaves)

    def set(self, number: int, room: int) -> None:
        at, rooms = number + self.leaves, self.room
        rooms[at] = room
        at //= 2
        while at:
            left, right = rooms[2 * at], rooms[2 * at + 1]
            rooms[at] = left if left >= right else right
            at //= 2

    def first(self, size: int) -> int | None:
        rooms, at = self.room, 1
        if rooms[1] < size:
            return None
        while at < self.leaves:
            at *= 2
            if rooms[at] < size:
                at += 1
        return at - self.leaves


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes``, by bin; ties keep their order. No size is above ``capacity``."""
    bins: list[list[int]] = []
    tree = TournamentTree(len(sizes))
    for position in sorted(range(len(sizes)), key=lambda p: (-sizes[p], p)):
        size = sizes[position]
        number = tree.first(size)
        if number is None:
            number = len(bins)
            bins.append([])
            tree.set(number, capacity - size)
        else:
            tree.set(number, tree.room[number + tree.leaves] - size)
        bins[number].append(position)
    return bins


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` that hold every token of documents of these lengths."""
    full, rest = [], []
    for document, length in enumerate(lengths):
        whole = length - length % capacity
        full += [[(document, start, capacity)] for start in range(0, whole, capacity)]
        if length > whole:
            rest.append((document, whole, length - whole))
    bins = [[rest[p] for p in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    fill = [sum(piece[2] for piece in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    gaps = [capacity - fill[b] for b in order]
    # The emptiest sequences fill the gaps of those before them, as far as they last.
    low, high = 0, len(order) - 1
    while low < high:
        if gaps[low] == 0:
            low += 1
            continue
        donor = bins[order[high]]
        if not donor:
            high -= 1
            continue
        document, start, length = donor.pop()
        part = min(length, gaps[low])
        bins[order[low]].append((document, start, part))
        gaps[low] -= part
        gaps[high] += part
        if length > part:
            donor.append((document, start + part, length - part))
    packed = full + [b for b in bins if b and sum(p[2] for p in b) == capacity]
    for b in bins:
        left = sum(p[2] for p in b)
        if left == capacity:
            continue
        pieces = b[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            sequence = []
            while size:
                document, start, length = pieces.pop()
                part = min(length, size)
                sequence.append((document, start, part))
                size -= part
                if length > part:
                    pieces.append((document, start + part, length - part))
            packed.append(sequence)
    return packed


def _pack_group(keys: tuple, table: pa.Table, capacity: int) -> pa.Table:
    ids = [np.frombuffer(v.as_py(), "<u2") for v in table["ids"]]
    lengths = [len(v) for v in ids]
    names = table["doc_id"].to_pylist()
    first_id = keys[0].as_py() << 32
    rows: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
    for number, sequence in enumerate(pack(lengths, capacity)):
        offset = 0
        for document, start, length in sequence:
            rows["doc_id"].append(names[document])
            rows["start"].append(start)
            rows["length"].append(length)
            rows["ids"].append(ids[document][start : start + length].astype("<u4").tobytes())
            rows["doc_tokens"].append(lengths[document])
            rows["sequence_id"].append(first_id + number)
            rows["offset"].append(offset)
            offset += length
    types = [table.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns, pieces = list(rows), [pa.array(rows.pop(name), kind) for name, kind in zip(list(rows), types)]
    give_back()
    return pa.table(pieces, names=columns)


def pack_documents(
    docs: DataFrame,
    capacity: int = SEQUENCE,
    paths: tuple[str, str] | None = None,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Pieces of the documents of ``docs(doc_id, text)`` by sequence and offset.

    Columns are ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ``ids`` are the
    piece's token ids as little-endian 32-bit numbers. Every document ends with the id 1, which is
    all there is to a NULL or empty text. Ids lie in exactly one piece each. Sequences are full, but
    for those whose length is a smaller power of two, at most eleven per group.

    Groups are dealt by a hash of id, text and task, and rows of a task that are equal in both go to
    one group after the other, so copies and repeated rows spread out and a retried task deals alike;
    their number follows the bytes of the input. Documents with equal or NULL ids are packed as the
    rows they are. Other columns are left out; no rows give no rows.
    """
    paths = paths or tokenizer_paths()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    key = F.xxhash64("doc_id", text_key(F.col("text")), F.spark_partition_id()).alias("key")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    encoded = rows.select("doc_id", key, "text").mapInArrow(
        partial(_encode, paths=paths, groups=groups), f"doc_id {id_type}, group bigint, ids binary"
    )

    def packed(keys: tuple, table: pa.Table) -> pa.Table:
        return _pack_group(keys, table, capacity)

    return encoded.groupBy("group").applyInArrow(
        packed,
        f"doc_id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )

