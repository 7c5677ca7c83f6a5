"""Shards of nearly equal size by histogram sort.

Rows are ordered by a hash of their text, then of their id, then by a number of their own, so that
shards are a random mix and equal texts lie side by side. The order is cut by exact counting: every round sums the bytes below several
candidate boundaries around each cut in one pass, and the candidates close in until each cut is
within tolerance. Then the rows are exchanged once, straight to their shards. A text that very many
rows share is cut between its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandrisk.llm.text import text_key
from bandrisk.sources.store import Scratch

SHARDS = 8
# Candidate boundaries per cut and round.
PROBES = 16
# Bytes a cut may be off, as a share of one shard.
TOLERANCE = 0.001
# Bytes of a shard that are exchanged to, sorted and numbered by one task.
PART_BYTES = 16 << 20
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1
KEY = ("_hash", "_tie", "_copy")
Key = tuple[int, ...]


def _below(key: Key) -> Column:
    """Whether a row's key is smaller."""
    result = F.lit(False)
    for name, value in reversed(list(zip(KEY, key))):
        result = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & result)
    return result


@dataclass
class _Cut:
    """A boundary to find: ``low`` has too few bytes below it, ``high`` has enough."""

    target: int
    low: Key
    high: Key
    below_low: int = 0
    below_high: int = 0
    done: bool = False

    def probes(self) -> list[Key]:
        """Keys from above ``low`` up to ``high``, at even steps of the first part of the key that differs."""
        place = next((n for n, (a, b) in enumerate(zip(self.low, self.high)) if a != b), len(self.low) - 1)
        first, last = self.low[place], self.high[place]
        steps = max(1, min(PROBES, last - first))
        values = sorted({first + (last - first) * n // steps for n in range(1, steps + 1)})
        rest = (_LOWEST,) * (len(self.low) - place - 1)
        return [p for v in values if self.low < (p := (*self.low[:place], v, *rest)) < self.high] + [self.high]

    def best(self) -> tuple[Key, int]:
        """The nearer end and how far it is off."""
        off_low, off_high = self.target - self.below_low, self.below_high - self.target
        return (self.low, off_low) if off_low < off_high else (self.high, off_high)


def _buckets(probes: list[Key], keys: list[np.ndarray]) -> np.ndarray:
    """For each key how many of the sorted probes are not above it."""
    firsts = np.array([p[0] for p in probes], np.int64)
    if len(keys) == 1:
        return np.searchsorted(firsts, keys[0], side="right")
    found = np.searchsorted(firsts, keys[0], side="left")
    for value in np.unique(firsts[np.isin(firsts, keys[0])]).tolist():
        rows = keys[0] == value
        found[rows] += _buckets([p[1:] for p in probes if p[0] == value], [part[rows] for part in keys[1:]])
    return found


def _histogram(batches, probes: list[Key], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Bytes and the smallest and largest key between probes, over one partition."""
    sums: dict[int, list] = {}
    for batch in batches:
        *keys, sizes = (batch.column(name).to_numpy() for name in (*names, "size"))
        bucket = _buckets(probes, keys)
        order = np.lexsort(keys[::-1])
        bucket, keys, sizes = bucket[order], [part[order] for part in keys], sizes[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
        for begin, end in zip(starts, np.r_[starts[1:], len(bucket)] if len(bucket) else []):
            smallest = tuple(int(part[begin]) for part in keys)
            largest = tuple(int(part[end - 1]) for part in keys)
            size = int(sizes[begin:end].sum())
            known = sums.setdefault(int(bucket[begin]), [0, smallest, largest])
            known[:] = known[0] + size, min(known[1], smallest), max(known[2], largest)
    rows = [
        {"bucket": k, "size": s, "smallest": dict(zip(names, a)), "largest": dict(zip(names, b))}
        for k, (s, a, b) in sums.items()
    ]
    key = pa.struct([(name, pa.int64()) for name in names])
    schema = pa.schema([("bucket", pa.int32()), ("size", pa.int64()), ("smallest", key), ("largest", key)])
    yield pa.RecordBatch.from_pylist(rows, schema)


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[Key]:
    """Boundaries that cut ``keys`` (parts of the key, ``size``) into ``shards`` runs of nearly equal bytes.

    One pass per round; a few numbers per probe come to the driver. Between two probes the bracket
    is drawn in to the smallest and largest key there, so a run of equal hashes is passed in one
    round and a single key ends the search.
    """
    names = [name for name in KEY if name in keys.columns]
    key = ", ".join(f"{name}: bigint" for name in names)
    total = keys.agg(F.sum("size")).first()[0] or 0
    allowed = total / shards * tolerance
    ends = (_LOWEST,) * len(names), (_HIGHEST,) * len(names)
    cuts = [_Cut(total * n // shards, *ends, below_high=total) for n in range(1, shards)]
    while any(not cut.done for cut in cuts) and total:
        probes = sorted({p for cut in cuts if not cut.done for p in cut.probes()})
        counted = keys.mapInArrow(
            partial(_histogram, probes=probes, names=names),
            f"bucket int, size bigint, smallest struct<{key}>, largest struct<{key}>",
        )
        rows = counted.groupBy("bucket").agg(F.sum("size"), F.min("smallest"), F.max("largest")).collect()
        found = {r[0]: (r[1], tuple(r[2]), tuple(r[3])) for r in rows}
        below, before = [], 0
        for bucket in range(len(probes) + 1):
            below.append(before)
            before += found[bucket][0] if bucket in found else 0
        # Bytes below the n-th probe are those of the buckets up to n.
        upto = [*below[1:], total]
        for cut in cuts:
            if cut.done:
                continue
            bucket = next(n for n in range(len(upto)) if upto[n] >= cut.target)
            size, smallest, largest = found.get(bucket, (0, cut.low, cut.low))
            cut.low, cut.below_low = smallest, below[bucket]
            cut.high, cut.below_high = (*largest[:-1], largest[-1] + 1), upto[bucket]
            cut.done = cut.best()[1] <= allowed or smallest == largest or not size
    return [cut.best()[0] for cut in cuts]


def shard_documents(docs: DataFrame, scratch: Scratch, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with ``size``, ``shard`` and ``slot``.

    ``size`` is the UTF-8 bytes of the text plus one, so a NULL or empty text has size one. Shards
    are numbered from 0 and nearly equal in bytes: no cut is off by more than a thousandth of a
    shard or the row it falls on. ``slot`` numbers a shard's rows without gaps from 0. Copies of a
    text may be cut apart, rows equal in all columns too: every row has a number of its own, stored with
    it once, which is the last part of its key. NULL ids are an id like any other. Columns with the names
    of the new ones are replaced; all others pass through. No rows give no rows.
    """
    given = docs.drop("size", "shard", "slot").withColumns(
        {
            "size": (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long"),
            "_hash": text_key(F.col("text")),
            "_tie": F.xxhash64("doc_id"),
            "_copy": F.monotonically_increasing_id(),
        }
    )
    rows = scratch.keep(given)
    keys = rows.select(*KEY, "size")
    bounds = splitters(keys, shards)
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // (shards * PART_BYTES)))
    # How many of the boundaries are at or below the row.
    shard = sum((F.when(_below(bound), 0).otherwise(1) for bound in bounds), F.lit(0)).cast("int")
    place = {"shard": shard, "_part": F.pmod(F.xxhash64(*KEY), F.lit(parts))}
    counts = keys.withColumns(place).groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*KEY))
    numbered = rows.withColumns(place).withColumn("_within", within)
    return (
        numbered.join(offsets, ["shard", "_part"])
        .withColumn("slot", (F.col("_before") + F.col("_within") - 1).cast("long"))
        .drop(*KEY, "_part", "_before", "_within")
    )
