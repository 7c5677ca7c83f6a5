"""Removal of long passages that occur more than once, found behind a count-min prefilter.

A window is a run of consecutive words of one document. Each window has an anchor: the short run of
words in it with the smallest hash. Equal windows have equal anchors, so the number of times an
anchor occurs is never below the number of times a window does, and there are far fewer anchors than
windows.

The first pass counts anchors in one count-min sketch per partition. The sketches are sent as sorted
cells or as bitmaps, whatever is smaller, and merged block by block; of the merged sketch only one
bit per cell is kept, whether it was hit more than once. Its size is fixed, so it can be broadcast.
The second pass hashes the windows whose anchor is estimated to be repeated, and groups them
exactly, by 96 bits of their words. Nearly all of them are repeated indeed, so the answer names the
others, and each document is cut by its own estimates without those. A full sketch lets more windows
through, but loses none.

A window that a task sees several times is known to be repeated there and is sent once, so that a
window in a third of all documents puts few rows into the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandrisk.llm.text import as_bytes, text_key
from bandrisk.llm.workers import tidy

WINDOW = 35
ANCHOR = 8
# Cells per row of the sketch, and rows. Two bitmaps of 2**27 bits: 32 MB at every executor.
SKETCH_BITS = 27
SKETCH_ROWS = 2
BLOCK_BITS = 20
# Words of whole documents a task works on at a time.
CHUNK_WORDS = 1 << 19

_ROLL = np.uint64(0x9E3779B97F4A7C15)
_ROLL_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; independent for different seeds."""
    with np.errstate(over="ignore"):
        x = values + np.uint64(seed) * _ROLL
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """A hash of every word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def _runs(hashes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of every ``width`` consecutive hashes, by doubling: log(width) steps."""
    n = len(hashes) - width + 1
    result, done, block, size = None, 0, hashes, 1
    power = base
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                result = block if result is None else _mixed(result[: len(block) - done] * power + block[done:], size)
                done += size
            if done == width:
                return result[:n]
            block = _mixed(block[:-size] * power + block[size:], size + 1)
            size *= 2


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The minimum or maximum of every ``width`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one document: the hash of each window's anchor, and the hashes of all places that are an anchor."""
    if len(hashes) < window:
        return hashes[:0], hashes[:0]
    grams = _runs(hashes, anchor, _ROLL)
    span = window - anchor + 1
    lowest = _sliding(grams, span, np.minimum)
    # A place is an anchor if it is the lowest of some window that holds it.
    padded = np.concatenate([np.zeros(span - 1, np.uint64), lowest, np.zeros(span - 1, np.uint64)])
    return lowest, grams[_sliding(padded, span, np.maximum) == grams]


def _cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return _mixed(values, 101 + row) >> np.uint64(64 - bits)


@tidy
def _sketch(batches, window: int, anchor: int, bits: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The sketch of one partition: for every block, the cells hit once and those hit more often."""
    once = [np.zeros(0, np.uint64) for _ in range(rows)]
    twice = [np.zeros(0, np.uint64) for _ in range(rows)]
    waiting: list[np.ndarray] = []
    size = 0

    def absorb() -> None:
        values = np.concatenate(waiting)
        for row in range(rows):
            cells, counts = np.unique(_cells(values, row, bits), return_counts=True)
            known = np.isin(cells, once[row], assume_unique=True)
            twice[row] = np.union1d(twice[row], cells[known | (counts > 1)])
            once[row] = np.union1d(once[row], cells)
        waiting.clear()

    for batch in batches:
        for text in batch.column("text"):
            _, found = anchors(word_hashes(text.as_py().split()), window, anchor)
            waiting.append(found)
            size += len(found)
            if size > CHUNK_WORDS // 2:
                absorb()
                size = 0
    if waiting:
        absorb()
    block_bits = min(BLOCK_BITS, bits)
    for row in range(rows):
        often = np.isin(once[row], twice[row], assume_unique=True)
        cells = once[row]
        blocks = (cells >> np.uint64(block_bits)).astype(np.int32)
        offsets = (cells & np.uint64((1 << block_bits) - 1)).astype(np.uint32)
        starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else np.zeros(0, int)
        for begin, end in zip(starts, np.r_[starts[1:], len(blocks)]):
            # The lowest bit says whether the cell was hit more than once.
            packed = (offsets[begin:end] << np.uint32(1)) | often[begin:end].astype(np.uint32)
            dense = len(packed) * 4 > (1 << block_bits) // 4
            if dense:
                bitmaps = np.zeros((2, 1 << block_bits), bool)
                bitmaps[0, packed >> np.uint32(1)] = True
                bitmaps[1, packed[packed & np.uint32(1) == 1] >> np.uint32(1)] = True
                body = np.packbits(bitmaps, axis=1).tobytes()
            else:
                body = packed.tobytes()
            columns = [pa.array([row], pa.int32()), pa.array([blocks[begin]], pa.int32())]
            yield pa.record_batch([*columns, pa.array([dense]), pa.array([body])], ["row", "block", "dense", "body"])


@tidy
def _merge(batches, bits: int) -> Iterator[pa.RecordBatch]:
    """Merged blocks as bitmaps of the cells hit more than once; rows come sorted by row and block."""
    block_bits = min(BLOCK_BITS, bits)
    place, seen, often = None, None, None

    def result() -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()), pa.array([np.packbits(often).tobytes()])],
            ["row", "block", "often"],
        )

    for batch in batches:
        for part in batch.to_pylist():
            if place != (part["row"], part["block"]):
                if place is not None:
                    yield result()
                place = (part["row"], part["block"])
                seen, often = np.zeros(1 << block_bits, bool), np.zeros(1 << block_bits, bool)
            if part["dense"]:
                both = np.unpackbits(np.frombuffer(part["body"], np.uint8).reshape(2, -1), axis=1).astype(bool)
                often |= both[1] | (seen & both[0])
                seen |= both[0]
            else:
                packed = np.frombuffer(part["body"], np.uint32)
                cells = packed >> np.uint32(1)
                often[cells] |= seen[cells] | ((packed & np.uint32(1)) == 1)
                seen[cells] = True
    if place is not None:
        yield result()


class Repeated:
    """Tells which anchors the merged sketch estimates to be repeated."""

    def __init__(self, blocks: list, bits: int, rows: int):
        block_bytes = (1 << min(BLOCK_BITS, bits)) // 8
        self.bits = bits
        self.bitmaps = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(rows)]
        for row, block, often in blocks:
            self.bitmaps[row][block * block_bytes : (block + 1) * block_bytes] = np.frombuffer(often, np.uint8)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        result = np.ones(len(values), bool)
        for row, bitmap in enumerate(self.bitmaps):
            cells = _cells(values, row, self.bits)
            byte = bitmap[cells >> np.uint64(3)]
            result &= (byte >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8))) & 1 == 1
        return result


def _places(hashes: np.ndarray, sketch: Repeated, window: int, anchor: int) -> np.ndarray:
    """Starts of the windows of one document that are estimated to be repeated."""
    lowest, _ = anchors(hashes, window, anchor)
    return np.flatnonzero(sketch(lowest))


@tidy
def _candidates(batches, repeated, window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Windows to be grouped, each once per chunk; without a place if the chunk alone shows it to be repeated."""
    names = ["high", "low", "sure", "doc_id", "key", "start"]
    sketch = repeated.value
    ids, keys, starts, highs, lows = [], [], [], [], []
    size = 0

    def flush(id_type) -> pa.RecordBatch:
        high, low = np.concatenate(highs), np.concatenate(lows)
        start = np.concatenate(starts)
        doc = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
        order = np.lexsort((low, high))
        first = np.r_[True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])]
        counts = np.diff(np.r_[np.flatnonzero(first), len(order)])
        # In the order of the documents, so that their ids compress.
        sent = order[first]
        back = np.argsort(sent)
        sent, sure = sent[back], counts[back] > 1
        owners = doc[sent]
        return pa.record_batch(
            [
                pa.array(high[sent].view(np.int64)),
                pa.array(low[sent].view(np.int32)),
                pa.array(sure),
                pa.array([None if s else ids[d] for s, d in zip(sure.tolist(), owners.tolist())], id_type),
                pa.array(np.array(keys, np.int64)[owners], mask=sure),
                pa.array(start[sent].astype(np.int32), mask=sure),
            ],
            names,
        )

    for batch in batches:
        id_type = batch.column("doc_id").type
        for doc_id, key, text in zip(batch.column("doc_id"), batch.column("key"), batch.column("text")):
            hashes = word_hashes(text.as_py().split())
            places = _places(hashes, sketch, window, anchor)
            if not len(places):
                continue
            ids.append(doc_id.as_py())
            keys.append(key.as_py())
            starts.append(places)
            highs.append(_runs(hashes, window, _ROLL)[places])
            lows.append((_runs(hashes, window, _ROLL_2)[places] >> np.uint64(32)).astype(np.uint32))
            size += len(hashes)
            if size > CHUNK_WORDS:
                yield flush(id_type)
                for kept in (ids, keys, starts, highs, lows):
                    kept.clear()
                size = 0
    if ids:
        yield flush(id_type)


@tidy
def _single_places(batches) -> Iterator[pa.RecordBatch]:
    """Places of windows that no other row has; rows come sorted by window."""
    names = ["doc_id", "key", "start"]
    held, held_known = None, False  # the last row of the batch before, and whether it was found repeated
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        high, low = (batch.column(name).to_numpy() for name in ("high", "low"))
        hit = batch.column("sure").to_numpy(zero_copy_only=False).copy()
        same = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
        hit[1:] |= same
        hit[:-1] |= same
        hit[0] |= held_known
        held, held_known = batch.slice(batch.num_rows - 1), bool(hit[-1])
        if not hit[:-1].all():
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(~hit[:-1])).select(names)
    if held is not None and not held_known:
        yield held.select(names)


@tidy
def _by_document(batches) -> Iterator[pa.RecordBatch]:
    """One row per document with its places; rows come sorted by document and start."""
    names = ["single_id", "single_key", "single"]
    ids, keys, places = [], [], []

    def rows(id_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(ids, id_type), pa.array(keys, pa.int64()), pa.array(places, pa.list_(pa.int32()))]
        return pa.record_batch(columns, names)

    for batch in batches:
        id_type = batch.column("doc_id").type
        for doc_id, key, start in zip(*(batch.column(name).to_pylist() for name in ("doc_id", "key", "start"))):
            if not ids or ids[-1] != doc_id or keys[-1] != key:
                if len(ids) >= 1000:
                    yield rows(id_type)
                    ids, keys, places = [], [], []
                ids.append(doc_id)
                keys.append(key)
                places.append([])
            places[-1].append(start)
    if ids:
        yield rows(id_type)


def merged_sketch(docs: DataFrame, window: int, sketch_bits: int) -> Repeated:
    """The merged sketch of all documents: never more than SKETCH_ROWS * 2**sketch_bits bits, whatever the input."""
    parts = docs.select(as_bytes(F.col("text")).alias("text")).mapInArrow(
        partial(_sketch, window=window, anchor=min(ANCHOR, window), bits=sketch_bits, rows=SKETCH_ROWS),
        "row int, block int, dense boolean, body binary",
    )
    merged = (
        parts.repartition("row", "block")
        .sortWithinPartitions("row", "block")
        .mapInArrow(partial(_merge, bits=sketch_bits), "row int, block int, often binary")
    )
    return Repeated([tuple(r) for r in merged.collect()], sketch_bits, SKETCH_ROWS)


@tidy
def _cut(batches, names: list[str], repeated, window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Every text without the words of its repeated windows."""
    sketch = repeated.value
    for batch in batches:
        texts, n_words, n_removed = [], [], []
        for text, single in zip(batch.column("_bytes"), batch.column("_single")):
            tokens = text.as_py().split()
            places = _places(word_hashes(tokens), sketch, window, anchor)
            if single.is_valid:
                places = np.setdiff1d(places, single.values.to_numpy(), assume_unique=True)
            n_words.append(len(tokens))
            if len(places):
                edges = np.zeros(len(tokens) + 1, np.int32)
                np.add.at(edges, places, 1)
                np.add.at(edges, places + window, -1)
                kept = list(compress(tokens, (np.cumsum(edges[:-1]) == 0).tolist()))
            else:
                kept = tokens
            texts.append(b" ".join(kept))
            n_removed.append(len(tokens) - len(kept))
        columns = [batch.column(name) for name in names]
        columns += [pa.array(texts, pa.binary()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        yield pa.record_batch(columns, [*names, "_kept", "_n_words", "_n_removed"])


def remove_repeated(docs: DataFrame, window: int = WINDOW, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with ``_kept``, ``_n_words`` and ``_n_removed`` beside them.

    ``_kept`` is the text without each word that lies in a window of ``window`` words whose sequence
    of words also starts anywhere else; its words are joined by one space. A NULL text has no words;
    texts shorter than a window keep all theirs. Repeated rows count as different places, so all
    their windows go. NULL ids are an id like any other. Other columns pass through unchanged.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    anchor = min(ANCHOR, window)
    shared = docs.sparkSession.sparkContext.broadcast(merged_sketch(docs, window, sketch_bits))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), as_bytes(F.col("text")).alias("text"))
    single = (
        rows.mapInArrow(
            partial(_candidates, repeated=shared, window=window, anchor=anchor),
            f"high bigint, low int, sure boolean, doc_id {id_type}, key bigint, start int",
        )
        .repartition("high", "low")
        .sortWithinPartitions("high", "low")
        .mapInArrow(_single_places, f"doc_id {id_type}, key bigint, start int")
        .repartition("doc_id", "key")
        .sortWithinPartitions("doc_id", "key", "start")
        .mapInArrow(_by_document, f"single_id {id_type}, single_key bigint, single array<int>")
    )
    keyed = docs.withColumn("_text_key", text_key(F.col("text")))
    same = keyed["doc_id"].eqNullSafe(single["single_id"]) & (keyed["_text_key"] == single["single_key"])
    joined = keyed.join(single, same, "left").withColumnRenamed("single", "_single")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, as_bytes(F.col("text")).alias("_bytes"), "_single").mapInArrow(
        partial(_cut, names=docs.columns, repeated=shared, window=window, anchor=anchor),
        f"{schema}, _kept binary, _n_words bigint, _n_removed bigint",
    )


def drop_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut from the texts.

    A text nothing was cut from stays as it is, white space and NULL included. A text that was cut
    has its kept words joined by one space; it stays even if no word is left. ``n_chars`` follows.
    """
    cut = remove_repeated(docs, window)
    changed = F.col("_n_removed") > 0
    text = F.when(changed, F.col("_kept").cast("string")).otherwise(F.col("text"))
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(F.col("_kept").cast("string"))).otherwise(F.col("n_chars"))
    return cut.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])

