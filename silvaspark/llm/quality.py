"""Text quality by support vectors on naive-Bayes features.

Indicators of byte n-grams (hashed), and of n-grams over the marks "this word repeats the one before", are scaled by the
log ratio of their counts in the two classes; a linear model of hinge loss is fitted to these by dual coordinate descent. The model is small and fixed in size; scoring is one pass
over the texts without a shuffle.

Training reads at most ``SAMPLE`` labelled rows, those with the smallest hashes of their ids; all others and all of
the held-out third serve only for measuring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvaspark.llm.common import discard, stored
from silvaspark.llm.parity_join import word_hashes

BITS = 18
REPEATS = 4  # longest n-gram of repeat marks
SAMPLE = 6000
COST = 1.0
ROUNDS = 20


def grams(text: bytes, flags: np.ndarray) -> np.ndarray:
    """Indices of the 2-, 3- and 4-grams of a text and of its runs of repeats, each once; ``flags`` is a zeroed scratch array, left zeroed."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 2:
        return np.zeros(0, np.int64)
    code = b[:-1] << np.uint32(8) | b[1:]
    for n in (2, 3, 4):
        if n > 2:
            code = code[:-1] << np.uint32(8) | b[n - 1 :]
        if not len(code):
            break
        flags[(code + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(32 - BITS)] = True
    words = word_hashes(text)
    again = words[1:] == words[:-1]
    for n in range(REPEATS):
        if not again.any():
            break
        flags[n] = True
        again = again[1:] & again[:-1]
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


@dataclass
class Model:
    """``score = 1 / (1 + exp(-(slope * margin + shift)))``, margin = sum(weight) / sqrt(sum(square)) over indicators."""

    weight: np.ndarray
    square: np.ndarray
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weight[found].sum() / np.sqrt(self.square[found].sum() + 1e-12))

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -50, 50))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = COST, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Fit to indicator rows. Without both classes the score is the smoothed share of label 1."""
    size = 1 << BITS
    ones, n = int(labels.sum()), len(labels)
    if not 0 < ones < n:
        p = (ones + 1) / (n + 2)
        return Model(np.zeros(size), np.zeros(size), 0.0, float(np.log(p / (1 - p))))
    counts = np.ones((2, size))
    for found, y in zip(rows, labels, strict=True):
        counts[int(y), found] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    square = ratio**2
    # rows are scaled to length one; held as weight times ratio, so that nothing but the indicators is kept of a row
    scale = 1 / np.sqrt(np.array([square[f].sum() for f in rows]) + 1e-12)
    sign = np.where(labels > 0, 1.0, -1.0)
    w, bias, alpha, rng = np.zeros(size), 0.0, np.zeros(n), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(n):
            f = rows[i]
            gradient = sign[i] * (w[f].sum() * scale[i] + bias) - 1
            own = square[f]
            new = min(max(alpha[i] - gradient / (own.sum() * scale[i] ** 2 + 1), 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[f] += step * scale[i] * own
                bias += step
                alpha[i] = new
    model = Model(w, square, 1.0, 0.0)
    model.slope, model.shift = calibrate(np.array([model.margin(f) for f in rows]) + bias, labels)
    model.shift += model.slope * bias
    return model


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic scale and shift of margins by Newton's method, targets smoothed by the class sizes."""
    ones, n = labels.sum(), len(labels)
    t = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (n - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        d, q = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * margins**2).sum() + 1e-6, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(d * margins).sum(), d.sum()]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    """The third that training never sees: crc32 of the id's text is 1 modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out third.

    Labels that are null, or whose doc_id is null or in no document, are left out; of repeated labels the larger
    counts; of repeated documents each row counts.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    texts = texts.groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITS, bool)
        for batch in batches:
            found = [grams((t.as_py() or "").encode(), flags).astype("<u4").tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "quality", "found"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        ids, labels = (np.concatenate([np.zeros(0, np.int64), *(batch.column(k).to_numpy() for batch in held)]).astype(np.int64) for k in (0, 1))
        found = [np.frombuffer(x.as_buffer(), "<u4") for batch in held for x in batch.column(2)]  # as they came, without a copy
        order = np.lexsort((labels, ids))
        m = fit([found[i] for i in order], labels[order])
        yield pa.record_batch([pa.array([m.weight.tobytes()], pa.binary()), pa.array([m.square.tobytes()], pa.binary()), pa.array([m.slope]), pa.array([m.shift])], names=["weight", "square", "slope", "shift"])

    # one task of an executor fits, on few rows in small batches: the driver gets the model alone, whose size is fixed
    rows = texts.mapInArrow(run, "doc_id long, quality int, found binary").repartition(1)
    model = stored(rows.mapInArrow(fitted, "weight binary, square binary, slope double, shift double"), "quality-model")
    got = model.first()
    discard(model)
    if got is None:  # Spark runs no task on a table that it knows to be empty
        return fit([], np.zeros(0, np.int64))
    return Model(np.frombuffer(got.weight), np.frombuffer(got.square), got.slope, got.shift)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``score`` and ``predicted`` for every row of ``docs``, beside ``doc_id`` or the columns ``keep``.

    Null texts count as empty; an empty text has no indicator and gets the score of margin 0. Columns to keep must have
    other names than the two new ones (ValueError).
    """
    if clash := {"score", "predicted"}.intersection(keep or ()):
        raise ValueError(f"{sorted(clash)} cannot be kept beside the new columns")
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, model = np.zeros(1 << BITS, bool), shared.value
        for batch in batches:
            scores = [model.score(grams(t.as_buffer(), flags)) for t in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.record_batch(columns, names=[*keep, "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1]]
    return read.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more under a model trained on them, all columns as they are.

    Null texts score as empty ones; repeated rows stay or go alike; without labels of both classes all score the smoothed
    share of label 1, 0.5 without any, and so stay.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, model = np.zeros(1 << BITS, bool), shared.value
        for batch in batches:
            yield batch.filter(pa.array([model.score(grams((t.as_py() or "").encode(), flags)) >= 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``; scores depend on the text alone."""
    scored = score(docs, train(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
