"""Toxicity categories by a classifier chain.

Categories are predicted one after the other, each by a linear model over the words of a text and the
probabilities of the categories before it. While training, those probabilities come from models that
did not see the document (out of fold), so a later model learns how far it can trust an earlier one;
then every model is fitted once more on the whole sample.

A text's features are the hashes of its different words and of their beginnings. Only features that
are frequent enough in the training sample and tell the categories apart get a weight, so the models
are small, and the texts are scored where they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandrisk.llm.text import as_bytes, text_key

# Labelled documents in the training sample, and features that get a weight per category.
TRAIN_DOCUMENTS = 6_000
FEATURES = 2048
MIN_DOCUMENTS = 4
HASH_BITS = 22
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 5
STEPS = 100
RIDGE = 1e-4
THRESHOLD = 0.5
# Letters, digits, the apostrophe and all bytes beyond ASCII.
_WORD = re.compile(rb"[a-z0-9'\x80-\xff]+")


def features(text: bytes) -> np.ndarray:
    """Sorted different feature numbers of a text."""
    tokens = set(_WORD.findall(text.lower()))
    digest, mask = xxhash.xxh3_64_intdigest, (1 << HASH_BITS) - 1
    found = {digest(token) & mask for token in tokens}
    for token in tokens:
        letters = token.decode("utf-8", "ignore")
        for n in BEGINNINGS:
            if len(letters) > n:
                found.add(digest(letters[:n].encode(), 1) & mask)
    return np.fromiter(found, np.int32, len(found))


@dataclass
class Linear:
    """A logistic model: weights of known features, of the categories before, and a bias."""

    known: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def __call__(self, rows: np.ndarray, columns: np.ndarray, count: int, before: np.ndarray) -> np.ndarray:
        """Probabilities of ``count`` texts whose features are given as (row, feature number) pairs."""
        place = np.minimum(np.searchsorted(self.known, columns), max(0, len(self.known) - 1))
        score = np.full(count, self.bias)
        if len(self.known):
            mine = self.known[place] == columns
            score += np.bincount(rows[mine], self.weights[place[mine]], count)
        if before.shape[1]:
            score += _logit(before) @ self.earlier
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.001, 0.999)
    return np.log(p / (1 - p))


def _select(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The features whose presence differs most between the labels, by the signed root of the likelihood ratio."""
    numbers, inverse = np.unique(columns, return_inverse=True)
    total, positive = len(labels), labels.sum()
    seen = np.bincount(inverse).astype(float)
    hit = np.bincount(inverse, labels[rows])
    expected = seen * positive / max(total, 1)
    spread = np.sqrt(np.maximum(expected * (1 - positive / max(total, 1)), 1e-9))
    strength = np.where(seen >= MIN_DOCUMENTS, np.abs(hit - expected) / spread, -1.0)
    best = np.argsort(-strength, kind="stable")[:FEATURES]
    return np.sort(numbers[best[strength[best] > 2]])


def fit(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, before: np.ndarray) -> Linear:
    """Ridge logistic regression, by accelerated steps under a bound on the curvature."""
    known = _select(rows, columns, labels)
    count, width = len(labels), len(known)
    place = np.minimum(np.searchsorted(known, columns), max(0, width - 1))
    mine = known[place] == columns if width else np.zeros(len(columns), bool)
    at, feature = rows[mine], place[mine]
    extra = _logit(before) if before.shape[1] else np.zeros((count, 0))
    rate = np.clip(labels.mean(), 1e-4, 1 - 1e-4)
    weights, earlier, bias = np.zeros(width), np.zeros(extra.shape[1]), float(np.log(rate / (1 - rate)))
    # A bound on the curvature along each weight, from how many others act with it.
    load = np.bincount(at, minlength=count) + np.abs(extra).sum(axis=1) + 1
    bound = np.bincount(feature, load[at], width) / (4 * count) + RIDGE
    bound_extra = (np.abs(extra) * load[:, None]).sum(axis=0) / (4 * count) + RIDGE
    bound_bias = load.mean() / 4
    ahead, momentum = [weights.copy(), earlier.copy(), bias], 1.0
    for _ in range(STEPS):
        w, e, b = ahead
        score = np.bincount(at, w[feature], count) + extra @ e + b
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels
        new_w = w - (np.bincount(feature, error[at], width) / count + RIDGE * w) / bound
        new_e = e - (extra.T @ error / count + RIDGE * e) / bound_extra
        new_b = b - error.mean() / bound_bias
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        push = (momentum - 1) / following
        ahead = [new_w + push * (new_w - weights), new_e + push * (new_e - earlier), new_b + push * (new_b - bias)]
        weights, earlier, bias, momentum = new_w, new_e, new_b, following
    return Linear(known, weights, earlier, float(bias))


def train_chain(texts: Sequence[np.ndarray], labels: np.ndarray, seed: int = 3) -> list[Linear]:
    """One model per column of ``labels``, in order, trained with out-of-fold probabilities of those before."""
    count, categories = labels.shape
    rows = np.repeat(np.arange(count, dtype=np.int32), [len(t) for t in texts])
    columns = np.concatenate(texts) if count else np.zeros(0, np.int32)
    # Features too rare for any fold go first; this looks at no label.
    often = np.bincount(columns, minlength=1 << HASH_BITS)[columns] >= MIN_DOCUMENTS
    rows, columns = rows[often], columns[often]
    fold = np.random.default_rng(seed).permutation(count) % FOLDS
    before = np.zeros((count, 0))
    chain = []
    for category in range(categories):
        target = labels[:, category].astype(float)
        unseen = np.zeros(count)
        for n in range(FOLDS if category < categories - 1 else 0):
            inside, outside = np.flatnonzero(fold != n), np.flatnonzero(fold == n)
            renumber = np.full(count, -1, np.int32)
            renumber[inside] = np.arange(len(inside))
            used = renumber[rows] >= 0
            model = fit(renumber[rows[used]], columns[used], target[inside], before[inside])
            renumber[:] = -1
            renumber[outside] = np.arange(len(outside))
            used = renumber[rows] >= 0
            unseen[outside] = model(renumber[rows[used]], columns[used], len(outside), before[outside])
        chain.append(fit(rows, columns, target, before))
        before = np.column_stack([before, unseen])
    return chain


def _featured(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(text.as_py()) for text in batch.column("_bytes")]
        kept = [batch.column(c) for c in batch.schema.names if c != "_bytes"]
        names = [c for c in batch.schema.names if c != "_bytes"]
        yield pa.record_batch([*kept, pa.array(found, pa.list_(pa.int32()))], [*names, "_features"])


def _score(batches, shared) -> Iterator[pa.RecordBatch]:
    chain = shared.value
    for batch in batches:
        found = [features(text.as_py()) for text in batch.column("_bytes")]
        count = len(found)
        rows = np.repeat(np.arange(count), [len(f) for f in found])
        columns = np.concatenate(found) if found else np.zeros(0, np.int32)
        before = np.zeros((count, 0))
        for model in chain:
            before = np.column_stack([before, model(rows, columns, count, before)])
        kept = [batch.column(c) for c in batch.schema.names if c != "_bytes"]
        names = [c for c in batch.schema.names if c != "_bytes"]
        scores = [pa.array(before[:, n]) for n in range(len(chain))]
        yield pa.record_batch([*kept, *scores], [*names, *(f"_p{n}" for n in range(len(chain)))])


def train_on(docs: DataFrame, labels: DataFrame, categories: Sequence[str], documents: int = TRAIN_DOCUMENTS) -> list[Linear]:
    """A chain for ``categories``, columns of 0 and 1 of ``labels(doc_id, ...)``.

    The sample holds the documents of at most ``documents`` labels, the first by a hash of the id.
    Only the numbers of their features come to the driver. Labels that are NULL and documents without
    an id or label are left out.
    """
    known = labels.select("doc_id", *categories).dropna()
    named = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", *categories).limit(documents)
    # Never more than `documents` short rows, so the texts stay where they are.
    found = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id")
    texts = found.select(
        F.xxhash64("doc_id", text_key(F.col("text"))).alias("_order"), *categories, as_bytes(F.col("text")).alias("_bytes")
    )
    schema = "_order bigint, " + ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in categories)
    # Texts become numbers where they lie; only those are sorted.
    sample = texts.mapInArrow(_featured, f"{schema}, _features array<int>").orderBy("_order", *categories).limit(documents)
    rows = sample.toArrow()
    if not rows.num_rows:
        return []
    found = rows["_features"].combine_chunks()
    ends = np.asarray(found.offsets)
    texts = np.split(found.values.to_numpy(), ends[1:-1])
    return train_chain(texts, np.column_stack([rows[c].to_numpy() for c in categories]).astype(float))


def predict(docs: DataFrame, chain: list[Linear], categories: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs(text, ...)`` with ``<category>_prob`` and ``is_<category>`` for each category.

    A NULL or empty text has no features and gets what the models say of none. Without a trained
    chain all probabilities are 0. Columns with the names of the new ones are replaced; all others
    pass through, repeated rows too.
    """
    new = [name for c in categories for name in (f"{c}_prob", f"is_{c}")]
    rows = docs.drop(*new)
    if not chain:
        scored = rows.withColumns({f"_p{n}": F.lit(0.0) for n in range(len(categories))})
    else:
        shared = docs.sparkSession.sparkContext.broadcast(chain)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        probabilities = ", ".join(f"_p{n} double" for n in range(len(categories)))
        scored = rows.withColumn("_bytes", as_bytes(F.col("text"))).mapInArrow(
            partial(_score, shared=shared), f"{schema}, {probabilities}"
        )
    results = [
        c
        for n, name in enumerate(categories)
        for c in (F.col(f"_p{n}").alias(f"{name}_prob"), (F.col(f"_p{n}") >= threshold).alias(f"is_{name}"))
    ]
    return scored.select(*[F.col(f"`{c}`") for c in rows.columns], *results)
