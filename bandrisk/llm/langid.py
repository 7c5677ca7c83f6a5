"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network labels every byte of a text; the probabilities of all bytes are averaged to those of the
text. Texts are cut into segments of one length that are run side by side, so that a long text costs
no more memory than a short one and no byte is left out. Training is backpropagation through time in
numpy, on segments of a bounded sample of labelled documents; nothing but their bytes and languages
enters the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandrisk.llm.text import as_bytes
from bandrisk.llm.workers import tidy

UNDETERMINED = "und"
HIDDEN = 8
# Labelled documents in the training sample, segments taken from each, and their bytes.
TRAIN_DOCUMENTS = 4000
TRAIN_SEGMENTS = 2
TRAIN_LENGTH = 64
STEPS = 260
BATCH = 192
RATE = 0.02
# Segments of a text are this long; so many are run side by side.
LENGTH = 128
WIDTH = 2048
PAD = 0

# A-Z lower-cased, digits as one digit, white space and control characters as a space.
_FOLD = bytes(
    ord("0") if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 if b < 32 or b == 127 else b for b in range(256)
)


@dataclass
class Direction:
    """One gated recurrent unit: a row of inputs per byte, and the weights of the state. Gates: update, reset, new."""

    inputs: np.ndarray
    states: np.ndarray


@dataclass
class Model:
    """Weights and the languages they were trained for."""

    languages: list[str]
    forward: Direction
    backward: Direction
    output: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        ends = (self.forward, self.backward)
        return [a for d in ends for a in (d.inputs, d.states)] + [self.output, self.bias]


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign, in place of the dearer tanh; its slope is the square of one minus its magnitude."""
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    """From 0 to 1; the slope follows from that of softsign."""
    return 0.5 + 0.5 * _squash(x)


def _gate_slope(gate: np.ndarray) -> np.ndarray:
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


def _run(direction: Direction, codes: np.ndarray) -> tuple[np.ndarray, list]:
    """States over time for codes (time, batch), and what the way back needs."""
    hidden = direction.states.shape[0]
    h = np.zeros((codes.shape[1], hidden), np.float32)
    states, trace = [], []
    for row in codes:
        x, a = direction.inputs[row], h @ direction.states
        gates = _gate(x[:, : 2 * hidden] + a[:, : 2 * hidden])
        update, reset = gates[:, :hidden], gates[:, hidden:]
        new = _squash(x[:, 2 * hidden :] + reset * a[:, 2 * hidden :])
        trace.append((h, update, reset, new, a[:, 2 * hidden :]))
        h = new + update * (h - new)
        states.append(h)
    return np.stack(states), trace


def _run_back(direction: Direction, codes: np.ndarray, trace: list, wanted: np.ndarray) -> list[np.ndarray]:
    """Gradients of inputs and states, through time."""
    hidden = direction.states.shape[0]
    at_states = np.zeros_like(direction.states)
    carried = np.zeros_like(wanted[0])
    at_inputs = np.empty((*codes.shape, 3 * hidden), np.float32)
    for t in range(len(codes) - 1, -1, -1):
        h, update, reset, new, a_new = trace[t]
        d = wanted[t] + carried
        d_new = d * (1 - update) * (1 - np.abs(new)) ** 2
        d_update = d * (h - new) * _gate_slope(update)
        d_reset = d_new * a_new * _gate_slope(reset)
        d_a = np.concatenate([d_update, d_reset, d_new * reset], axis=1)
        at_inputs[t] = np.concatenate([d_update, d_reset, d_new], axis=1)
        at_states += h.T @ d_a
        carried = d * update + d_a @ direction.states.T
    flat, values = codes.ravel(), at_inputs.reshape(-1, 3 * hidden)
    order = np.argsort(flat, kind="stable")
    codes_there, starts = np.unique(flat[order], return_index=True)
    of_inputs = np.zeros_like(direction.inputs)
    of_inputs[codes_there] = np.add.reduceat(values[order], starts, axis=0)
    return [of_inputs, at_states]


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _gradients(model: Model, codes: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over all positions that are no padding."""
    hidden = model.forward.states.shape[0]
    ahead, trace_ahead = _run(model.forward, codes)
    behind, trace_behind = _run(model.backward, codes[::-1])
    both = np.concatenate([ahead, behind[::-1]], axis=2)
    d = _softmax(both @ model.output + model.bias)
    d[:, np.arange(codes.shape[1]), labels] -= 1
    there = codes != PAD
    d *= (there / there.sum())[:, :, None].astype(np.float32)
    back = d @ model.output.T
    of_forward = _run_back(model.forward, codes, trace_ahead, back[:, :, :hidden])
    of_backward = _run_back(model.backward, codes[::-1], trace_behind, back[::-1, :, hidden:])
    of_output = np.tensordot(both, d, axes=([0, 1], [0, 1]))
    return [*of_forward, *of_backward, of_output, d.sum(axis=(0, 1))]


def _coded(segments: list[bytes], length: int) -> np.ndarray:
    """Folded bytes as codes (time, batch), padded at the end."""
    rows = b"".join(s.translate(_FOLD).ljust(length, bytes([PAD])) for s in segments)
    return np.frombuffer(rows, np.uint8).reshape(len(segments), length).T


def train(segments: list[bytes], languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
    """A model from text segments and their languages, by Adam on random batches."""
    names = sorted(set(languages))
    labels = np.array([names.index(n) for n in languages])
    rng = np.random.default_rng(seed)

    def direction() -> Direction:
        inputs = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        inputs[:, :hidden] += 1  # at first, remember
        return Direction(inputs, rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32))

    ends = direction(), direction()
    output = rng.normal(0, 0.3, (2 * hidden, len(names))).astype(np.float32)
    model = Model(names, *ends, output, np.zeros(len(names), np.float32))
    codes = _coded(segments, TRAIN_LENGTH)
    first = [np.zeros_like(a) for a in model.arrays()]
    second = [np.zeros_like(a) for a in model.arrays()]
    order = np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, *(rng.permutation(len(labels)) for _ in range(-(-BATCH // len(labels))))])
        pick, order = order[:BATCH], order[BATCH:]
        rate = RATE * (1 - (step - 1) / STEPS) + 1e-4
        gradients = _gradients(model, codes[:, pick], labels[pick])
        norm = float(np.sqrt(sum((g * g).sum() for g in gradients)))
        for a, g, m, v in zip(model.arrays(), gradients, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


class Labeller:
    """Runs a model over many segments at once. Features go before segments, so every gate is one block."""

    def __init__(self, model: Model):
        self.languages = model.languages
        hidden = model.forward.states.shape[0]
        self.hidden = hidden
        self.output = np.ascontiguousarray(model.output.T)
        self.bias = model.bias[:, None]
        self.ends = [
            (np.ascontiguousarray(d.inputs.T), np.ascontiguousarray(d.states.T)) for d in (model.forward, model.backward)
        ]

    def _states(self, end: int, codes: np.ndarray) -> np.ndarray:
        hidden, width = self.hidden, codes.shape[1]
        inputs, weights = self.ends[end]
        states = np.empty((len(codes), hidden, width), np.float32)
        x, a, size = (np.empty((3 * hidden, width), np.float32) for _ in range(3))
        gates, update, reset, new = x[: 2 * hidden], x[:hidden], x[hidden : 2 * hidden], x[2 * hidden :]
        h = np.zeros((hidden, width), np.float32)
        for t in range(len(codes)) if end == 0 else range(len(codes) - 1, -1, -1):
            np.take(inputs, codes[t], axis=1, out=x, mode="clip")
            np.matmul(weights, h, out=a)
            gates += a[: 2 * hidden]
            np.abs(gates, out=size[: 2 * hidden])
            size[: 2 * hidden] += 1
            gates /= size[: 2 * hidden]
            gates += 1
            gates *= np.float32(0.5)
            reset *= a[2 * hidden :]
            new += reset
            np.abs(new, out=size[2 * hidden :])
            size[2 * hidden :] += 1
            new /= size[2 * hidden :]
            out = states[t]
            np.subtract(h, new, out=out)
            out *= update
            out += new
            h = out
        return states

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Sums of the probabilities of all positions of each segment (batch, language)."""
        hidden = self.hidden
        logits = self.output[:, :hidden] @ self._states(0, codes)
        logits += self.output[:, hidden:] @ self._states(1, codes)
        logits += self.bias
        np.exp(logits, out=logits)
        logits *= ((codes != PAD) / logits.sum(axis=1))[:, None, :]
        return logits.sum(axis=0).T


@tidy
def _predict(batches, shared) -> Iterator[pa.RecordBatch]:
    """Language and score of every row, block by block of segments."""
    label = Labeller(shared.value)
    for batch in batches:
        texts = batch.column("_bytes")
        sums = np.zeros((batch.num_rows, len(label.languages)))
        segments: list[bytes] = []
        owners: list[int] = []

        def flush() -> None:
            np.add.at(sums, owners, label(_coded(segments, LENGTH)))
            segments.clear()
            owners.clear()

        for n in range(batch.num_rows):
            text = texts[n].as_py()
            for start in range(0, len(text), LENGTH):
                segments.append(text[start : start + LENGTH])
                owners.append(n)
                if len(segments) == WIDTH:
                    flush()
        if segments:
            flush()
        totals = sums.sum(axis=1)
        best = sums.argmax(axis=1)
        scores = np.where(totals > 0, sums[np.arange(len(best)), best] / np.maximum(totals, 1e-9), 0.0)
        names = pa.array([label.languages[b] for b in best], pa.string())
        kept = [batch.column(c) for c in batch.schema.names if c != "_bytes"]
        columns = [c for c in batch.schema.names if c != "_bytes"]
        yield pa.record_batch([*kept, names, pa.array(np.clip(scores, 0, 1))], [*columns, "_guess", "_score"])


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_segments(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """``(segment, lang)`` of a bounded sample: the first ``documents`` by a hash of their id, places by hashes too."""
    text = F.col("text").cast("binary")
    span = F.greatest(F.octet_length("text") - TRAIN_LENGTH + 1, F.lit(1))
    pieces = [
        F.substring(text, (F.pmod(F.xxhash64("doc_id", F.lit(n)), span) + 1).cast("int"), F.lit(TRAIN_LENGTH))
        for n in range(TRAIN_SEGMENTS)
    ]
    usable = F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")
    return (
        docs.where(usable)
        .select("lang", F.xxhash64("doc_id").alias("order"), F.array(*pieces).alias("pieces"))
        .orderBy("order", "lang", "pieces")
        .limit(documents)
        .select("lang", F.explode("pieces").alias("segment"))
    )


def train_on(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Model | None:
    """A model from ``docs(doc_id, text, lang)``, or None if nothing there can be learned from."""
    rows = training_segments(docs, documents).collect()
    return train([bytes(r.segment) for r in rows], [r.lang for r in rows]) if rows else None


def _labelled(docs: DataFrame, model: Model | None) -> DataFrame:
    """``predict`` with one more column ``_letters``: whether the text has a letter."""
    rows = docs.drop("lang_pred", "score")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return rows.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "_letters": letters})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    bare = F.when(letters, as_bytes(F.col("text"))).otherwise(F.lit(b""))
    labelled = rows.withColumns({"_letters": letters, "_bytes": bare}).mapInArrow(
        partial(_predict, shared=shared),
        f"{schema}, _letters boolean, _guess string, _score double",
    )
    return labelled.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.when(F.col("_letters"), F.col("_guess")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("_letters"), F.col("_score")).otherwise(0.0).alias("score"),
        "_letters",
    )


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs(text, ...)`` with ``lang_pred`` and ``score``.

    A NULL text and one without a letter is ``und`` with score 0, and so is every text where there
    was nothing to learn from. All other texts get a learned language and the mean probability of
    that language over all bytes. Columns with the names of the new ones are replaced; all others
    pass through, repeated rows too.
    """
    return _labelled(docs, model).drop("_letters")


def drop_undetermined(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is NULL or has no letter, whether or not a language could be learned.

    The model learns from the rows themselves, and a NULL ``lang`` of a row that stays becomes the
    language it predicts. A text with a letter stays also where there is nothing to learn from (a NULL
    stays NULL then), or where a learned language is named ``und``.
    """
    # Columns of the input that have the names of the new ones are set aside meanwhile.
    aside = {"lang_pred": "_input_lang_pred", "score": "_input_score"}
    model = train_on(docs)
    found = _labelled(docs.withColumnsRenamed(aside), model).where("_letters")
    values = {c: F.col(f"`{aside.get(c, c)}`") for c in docs.columns}
    if model is not None:
        values["lang"] = F.coalesce(values["lang"], F.col("lang_pred"))
    return found.select(*[value.alias(c) for c, value in values.items()])
