"""Near duplicates by 64-bit SimHash fingerprints that differ in few bits.

Pairs at up to three bits are found by meeting in the middle. Every fingerprint emits the variants
within half the radius, one bit, and variants are shuffled: fingerprints that share one differ in at
most two bits, and any two such fingerprints share one. At three bits one of the two has to emit
variants of two bits. The two fingerprints then differ in parity, so the even ones do; and since of
three bits two lie in the same half of the fingerprint, only pairs of bits of one half are needed.
Such a variant leaves the other half alone, so even fingerprints travel once per half and their
variants are made in the task that meets them, instead of going through the shuffle.

All members of a shared variant are near each other, so they are linked to the smallest one: the
links grow with the number of fingerprints, not with the square of a group. A bucket holds at most
the fingerprints near one variant; a half that very many fingerprints share is split by variant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandrisk.llm.components import connected_components
from bandrisk.llm.text import as_bytes, text_key
from bandrisk.llm.workers import tidy
from bandrisk.sources.store import Scratch

SHINGLE = 3
SEED = 42
# Distinct fingerprints around one half value that one task takes; more are split by variant.
HALF_LIMIT = 100_000
# Words of a text hashed at a time, so that memory does not follow the longest text.
WORDS_AT_ONCE = 1 << 16

_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_LOW, _HIGH = 0, 1
_HALF = {_LOW: np.uint64(0xFFFFFFFF), _HIGH: np.uint64(0xFFFFFFFF00000000)}


def _two_bits(bits: range) -> np.ndarray:
    return np.array([(1 << i) | (1 << j) for i in bits for j in bits if i < j], dtype=np.uint64)


# By the half that stays: the pairs of bits of the other one.
_FLIPS = {_LOW: _two_bits(range(32, 64)), _HIGH: _two_bits(range(32))}


def fingerprint(text: bytes) -> int:
    """SimHash of a text: a bit is set if it is set in over half the hashes of the word shingles."""
    tokens = text.lower().split()  # bytes: A-Z only, and the six ASCII white space characters
    if not tokens:
        return 0
    counts, total = np.zeros(64, dtype=np.int64), 0
    width = min(SHINGLE, len(tokens))
    for start in range(0, len(tokens) - width + 1, WORDS_AT_ONCE):
        part = tokens[start : start + WORDS_AT_ONCE + width - 1]
        joined = b" ".join(part)
        lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[: len(part) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[b:e], SEED) for b, e in zip(begins, ends[width - 1 :].tolist())], dtype="<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int((_BIT[2 * counts > total]).sum(dtype=np.uint64))


@tidy
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(text.as_py()) for text in batch.column("text")]
        signed = pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), signed], ["doc_id", "key", "fp"])


def simhash(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, fp)`` for every row of ``docs(doc_id, text)``; ``key`` hashes the text."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), as_bytes(F.col("text")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"doc_id {id_type}, key bigint, fp bigint")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


@tidy
def _one_bit_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint itself and with each bit turned."""
    masks = np.concatenate([np.zeros(1, np.uint64), _BIT])
    for batch in batches:
        fp = _column(batch, "fp").view(np.uint64)
        variants = (fp[:, None] ^ masks[None, :]).ravel()
        owners = np.repeat(fp, len(masks))
        yield pa.record_batch(
            [pa.array(variants.view(np.int64)), pa.array(owners.view(np.int64))], ["variant", "fp"]
        )


@tidy
def _shared_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from each member of a variant to its smallest; rows come sorted by variant and fingerprint."""
    last_variant, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        variant, fp = _column(batch, "variant"), _column(batch, "fp")
        starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
        if last_variant is not None and variant[0] == last_variant:
            firsts = np.r_[first, fp[starts[1:]]]
        else:
            firsts = fp[starts]
        smallest = np.repeat(firsts, np.diff(np.r_[starts, len(fp)]))
        last_variant, first = variant[-1], firsts[-1]
        differs = smallest != fp
        if differs.any():
            links = np.unique(np.stack([fp[differs], smallest[differs]], axis=1), axis=0)
            yield _pairs(links[:, 0].copy(), links[:, 1].copy())


@tidy
def _half_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a fingerprint sends to the holders of a half: an even one its own half, an odd one also its neighbours."""
    for batch in batches:
        fp = _column(batch, "fp").view(np.uint64)
        odd = (np.bitwise_count(fp) & 1).astype(bool)
        for side, mask in _HALF.items():
            own_bits = _BIT[(_BIT & mask) != 0]
            turned = (fp[odd][:, None] ^ own_bits[None, :]).ravel()
            half = np.concatenate([fp & mask, turned & mask])
            owner = np.concatenate([fp, np.repeat(fp[odd], len(own_bits))])
            yield pa.record_batch(
                [pa.array(np.full(len(half), side, np.int8)), pa.array(half.view(np.int64)), pa.array(owner.view(np.int64))],
                ["side", "half", "fp"],
            )


def _mixed(values: np.ndarray) -> np.ndarray:
    """A hash of variants that is independent of the shuffle's own."""
    mixed = values * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(32))


def _meet(side: int, half: np.ndarray, fp: np.ndarray, parts: int, part: int) -> Iterator[pa.RecordBatch]:
    """Links of even to odd fingerprints over variants that keep ``half``, for one part of the variants."""
    mask, flips = _HALF[side], _FLIPS[side]
    odd = (np.bitwise_count(fp) & 1).astype(bool)
    same = (fp & mask) == half
    within = _BIT[(_BIT & ~mask) != 0]
    near, beside = fp[odd & same], odd & ~same
    points = np.concatenate([(near[:, None] ^ within[None, :]).ravel(), half[beside] | (fp[beside] & ~mask)])
    owners = np.concatenate([np.repeat(near, len(within)), fp[beside]])
    if parts > 1:
        mine = _mixed(points) % np.uint64(parts) == part
        points, owners = points[mine], owners[mine]
    if not len(points):
        return
    order = np.lexsort((owners, points))
    points, owners = points[order], owners[order]
    first = np.r_[True, points[1:] != points[:-1]]
    points, owners = points[first], owners[first]
    even = fp[~odd]
    for start in range(0, len(even), 2048):
        block = even[start : start + 2048]
        variants = block[:, None] ^ flips[None, :]
        place = np.searchsorted(points, variants)
        place[place == len(points)] = 0
        row, column = np.nonzero(points[place] == variants)
        if len(row):
            links = np.unique(np.stack([block[row], owners[place[row, column]]], axis=1), axis=0)
            yield _pairs(links[:, 0].copy(), links[:, 1].copy())


@tidy
def _meet_in_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's messages, group after group; they come sorted by side, number of parts and part."""
    pending: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(pending)
        parts, part = table["parts"][0].as_py(), table["part"][0].as_py()
        half, fp = (table[name].to_numpy().view(np.uint64) for name in ("half", "fp"))
        yield from _meet(table["side"][0].as_py(), half, fp, parts, part)

    for batch in batches:
        if not batch.num_rows:
            continue
        side, parts, part = (_column(batch, name) for name in ("side", "parts", "part"))
        changed = (parts[1:] != parts[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])
        bounds = np.r_[0, np.flatnonzero(changed) + 1, len(parts)]
        for begin, end in zip(bounds[:-1], bounds[1:]):
            if pending:
                head = pending[0]
                group = (head["side"][0].as_py(), head["parts"][0].as_py(), head["part"][0].as_py())
                if group != (side[begin], parts[begin], part[begin]):
                    yield from flush()
                    pending = []
            pending.append(batch.slice(begin, end - begin))
    if pending:
        yield from flush()


def near_links(fingerprints: DataFrame, half_limit: int = HALF_LIMIT) -> DataFrame:
    """Links ``(u, v)`` that join every two distinct fingerprints ``fp`` at up to three bits, maybe over others."""
    variants = fingerprints.mapInArrow(_one_bit_variants, "variant bigint, fp bigint")
    shared = (
        variants.repartition("variant")
        .sortWithinPartitions("variant", "fp")
        .mapInArrow(_shared_variants, "u bigint, v bigint")
    )
    messages = fingerprints.mapInArrow(_half_messages, "side tinyint, half bigint, fp bigint")
    # Few halves are this frequent: at most one in half_limit messages.
    crowded = (
        messages.groupBy("side", "half")
        .count()
        .where(F.col("count") > half_limit)
        .select("side", "half", F.ceil(F.col("count") / half_limit).cast("int").alias("parts"))
    )
    parted = messages.join(crowded, ["side", "half"], "left").select(
        "side", "half", "fp", F.coalesce("parts", F.lit(1)).alias("parts")
    )
    met = (
        parted.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .repartition("side", "half", "part")
        .sortWithinPartitions("side", "parts", "part")
        .mapInArrow(_meet_in_halves, "u bigint, v bigint")
    )
    return shared.unionByName(met)


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, key, fp, root, component_id)`` for every row of ``docs(doc_id, text)``.

    Documents are linked when their fingerprints differ in at most three bits; ``component_id`` is
    the smallest ``doc_id`` that can be reached, the document's own included. A NULL text is empty;
    a text without words has fingerprint zero and is linked like any other. A NULL ``doc_id`` takes
    part and is nobody's component unless all ids there are NULL. Repeated rows come out as often as
    they go in; other columns are left out; an empty table gives no rows.
    """
    stored = scratch.keep(simhash(docs.select("doc_id", "text")))
    classes = scratch.keep(stored.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    links = near_links(classes.select("fp"))
    roots = connected_components(links, scratch)
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "smallest", F.coalesce("component", "fp").alias("root")
    )
    component = placed.groupBy("root").agg(F.min("smallest").alias("component_id"))
    labels = scratch.keep(placed.join(component, "root").select("fp", "root", "component_id"))
    return stored.join(labels, "fp").select("doc_id", "key", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` with one document kept of each component: the one with the smallest id.

    Of rows that share this id, the one with the smallest text hash stays, once. All columns stay.
    """
    found = near_duplicates(docs, scratch)
    # NULL ids come last; a component then keeps a document with an id if it has one.
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    first = found.groupBy("root").agg(F.min(rank).alias("first")).select("first.*")
    times = found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("times"))
    chosen = scratch.keep(
        first.join(times, first["doc_id"].eqNullSafe(times["doc_id"]) & (first["key"] == times["key"])).select(
            first["doc_id"].alias("_id"), first["key"].alias("_key"), "times"
        )
    )

    def rows(picked: DataFrame) -> DataFrame:
        keyed = docs.withColumn("_text_key", text_key(F.col("text")))
        same = keyed["doc_id"].eqNullSafe(picked["_id"]) & (keyed["_text_key"] == picked["_key"])
        return keyed.join(picked, same, "left_semi")

    repeated = chosen.where("times > 1")
    if repeated.isEmpty():
        return rows(chosen).drop("_text_key")
    kept = rows(repeated).dropDuplicates(["doc_id", "_text_key"])
    return rows(chosen.where("times = 1")).unionByName(kept).drop("_text_key")
