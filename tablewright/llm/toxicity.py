"""Toxic texts: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text is the set of hashes of its n-grams of four and five bytes, lower-cased.  From a
bounded sample of labelled texts (:data:`SAMPLE`), counted where the texts are, comes the
log ratio of each n-gram between toxic and other texts.  A logistic regression over all
n-grams that a sampled text holds, each scaled by its ratio, gives the weights; its gradients are summed over the sample where it lies, so no row of it goes to
the driver.  All texts are then scored whole, by one look-up per n-gram.

Results of odd input: null and empty texts have no n-grams and get the score of the
intercept; without labelled rows, or with one label only, every score is the mean label
(0 without rows); repeated rows are scored one by one; an empty table gives an empty
table; columns other than id and text are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import bounded_batches, checkpointed, col, held_out, map_batches, pick, tree_sum
from tablewright.llm.samples import labelled, with_text

#: Labelled rows the weights are fitted to, at most; hash buckets.
SAMPLE, BUCKETS = 40_000, 1 << 20
SIZES = (4, 5)
MODULUS, REST, THRESHOLD = 3, 1, 0.7
#: Passes over the sample, at most; share of the first gradient at which they end; steps remembered; sampled rows to a task.
PASSES, ENOUGH, MEMORY, TASK_ROWS = 50, 1e-3, 6, 4096
RIDGE = 2.0

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def grams(text: str) -> np.ndarray:
    """Bucket of every n-gram of the text between blanks, in order."""
    raw = _LOWER[np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)]
    out = []
    for size in SIZES:
        n = len(raw) - size + 1
        if n <= 0:
            continue
        code = np.full(n, size, np.uint32)
        for i in range(size):
            code *= np.uint32(0x01000193)
            code ^= raw[i : i + n]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        code ^= code >> np.uint32(13)
        out.append(code & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Linear:
    """Buckets with a weight, their weights, and intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        """Weight of every bucket."""
        out = np.zeros(BUCKETS)
        out[self.buckets] = self.weights
        return out

    def score(self, text: str, table: np.ndarray) -> float:
        z = self.intercept + float(table[np.unique(grams(text))].sum())
        return float(1.0 / (1.0 + np.exp(-max(-40.0, min(40.0, z)))))


def _counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Texts by label, and texts holding each bucket by label: of fixed size whatever the data."""
    counts = np.zeros((2, BUCKETS + 1), np.int32)  # the sample is bounded, so are they
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label")):
            row = counts[int(label.as_py() >= 0.5)]
            row[np.unique(grams(text.as_py()))] += 1
            row[BUCKETS] += 1
    return counts


_PLACES = pa.schema([("low", pa.binary()), ("high", pa.binary()), ("label", pa.float64())])
_HIGH = BUCKETS >> 16


def _packed(places: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted places as their low 16 bits, and how many there are of each of the values above."""
    return places.astype(np.uint16).tobytes(), np.bincount(places >> 16, minlength=_HIGH).astype(np.int32).tobytes()


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all rows of a batch, the row of each, and the labels (0 or 1)."""
    parts = {n: np.frombuffer(b"".join(v.as_buffer() for v in batch.column(n)), t) for n, t in (("low", np.uint16), ("high", np.int32))}
    high = parts["high"].reshape(-1, _HIGH)
    places = np.repeat(np.tile(np.arange(_HIGH, dtype=np.int32) << 16, len(high)), high.ravel())
    places |= parts["low"]
    owner = np.repeat(np.arange(len(high), dtype=np.int32), high.sum(axis=1))
    return places, owner, (batch.column("label").to_numpy() >= 0.5).astype(float)


def _slope(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float, unit: int) -> tuple[int, int, np.ndarray]:
    """Log loss of the rows and its slopes by bias and weights, in whole ``unit``-ths, so that sums have no order."""
    loss, by_bias, by_weight = 0, 0, np.zeros(len(weights))
    for batch in batches:
        places, owner, y = _unpacked(batch)
        z = np.bincount(owner, weights[places], len(y)) + bias
        loss += int(np.rint((np.logaddexp(0, z) - y * z) * unit).sum())
        error = np.rint((1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y) * unit)
        by_bias += int(error.sum())
        by_weight += np.bincount(places, error[owner], len(weights))
    return loss, by_bias, by_weight.astype(np.int32)


def _regress(rows: DataFrame, n: int, mean: float, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on scaled presences, by limited-memory quasi-Newton steps; one pass over the rows per step.

    Only sums of one number per n-gram come to the driver.
    """
    context = rows.sparkSession.sparkContext
    unit = (1 << 30) // n  # sums of n errors stay within 32 bits

    def loss_at(at: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast((scale * at[:-1]).astype(np.float32))
        bias = float(at[-1])
        loss, by_bias, by_weight = tree_sum(
            rows, lambda batches: _slope(batches, shared.value, bias, unit), lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]), None
        )
        shared.destroy()
        return loss / unit + RIDGE / 2 * float(at[:-1] @ at[:-1]), np.append(scale * by_weight / unit + RIDGE * at[:-1], by_bias / unit)

    at = np.append(np.zeros(len(scale)), np.log(mean / (1 - mean)))
    loss, slope = loss_at(at)
    first, steps = float(np.linalg.norm(slope)), []  # of each step: its way, the change of the slope
    length = 1.0 / max(first, 1e-9)
    for _ in range(PASSES - 1):
        if np.linalg.norm(slope) <= ENOUGH * first:
            break
        way, pulls = -slope, []
        for s, g in reversed(steps):
            pulls.append(float(s @ way) / float(s @ g))
            way = way - pulls[-1] * g
        if steps:
            s, g = steps[-1]
            way = way * (float(s @ g) / float(g @ g))
        for (s, g), pull in zip(steps, reversed(pulls)):
            way = way + s * (pull - float(g @ way) / float(s @ g))
        new = at + length * way
        new_loss, new_slope = loss_at(new)
        if new_loss > loss + 1e-4 * length * float(slope @ way) + 1e-6 * abs(loss):
            length /= 4  # too far: again from the same place
            continue
        s, g = new - at, new_slope - slope
        if float(s @ g) > 1e-12 * float(g @ g):
            steps = [*steps[1 - MEMORY :], (s, g)]
        at, loss, slope, length = new, new_loss, new_slope, 1.0
    return at[:-1], float(at[-1])


def fit(df: DataFrame, labels: DataFrame, label_col: str = "toxic", bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Linear:
    """Weights from at most ``bound`` labelled texts."""
    sample = checkpointed(with_text(df, labelled(labels, label_col, bound, MODULUS, REST), id_col, text_col))
    # A bounded table in a bounded number of tasks: as many sums go through the tree, however many files the texts had.
    sample = sample.coalesce(max(1, math.ceil(sample.count() / TASK_ROWS)))
    counts = tree_sum(sample, _counts, lambda a, b: np.add(a, b, out=a), np.zeros((2, BUCKETS + 1), np.int32))
    texts, counts = counts[:, BUCKETS], counts[:, :BUCKETS]
    if texts.min() == 0:
        mean = min(max(texts[1] / max(1, texts.sum()), 1e-9), 1 - 1e-9)
        return Linear(np.zeros(0, np.int32), np.zeros(0), float(np.log(mean / (1 - mean))))
    kept = np.flatnonzero(counts.sum(axis=0) > 0).astype(np.int32)
    other, toxic = counts[:, kept] + 1.0
    ratio = np.log(toxic / (texts[1] + 2)) - np.log(other / (texts[0] + 2))
    shared = df.sparkSession.sparkContext.broadcast(kept)

    def places(batch: pa.RecordBatch) -> dict:
        place = np.full(BUCKETS, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value), dtype=np.int32)
        found = [place[np.unique(grams(t.as_py()))] for t in batch.column("text")]
        low, high = zip(*[_packed(f[f >= 0]) for f in found])
        return {"low": low, "high": high, "label": batch.column("label")}

    rows = checkpointed(map_batches(sample, _PLACES, places))
    weights, bias = _regress(rows, int(texts.sum()), texts[1] / texts.sum(), ratio)
    return Linear(kept, weights * ratio, bias)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(df: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        table = shared.value.table()
        scores = np.array([shared.value.score(t.as_py() or "", table) for t in batch.column("text")])
        return {"doc_id": batch.column("doc_id"), "score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32)}

    rows = map_batches(pick(df, doc_id=(id_col, "bigint"), text=(text_col, "string")), SCHEMA, run)
    return rows.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score", "predicted")


def keep_clean(df: DataFrame, model: Linear, text_col: str = "text") -> DataFrame:
    """The rows not predicted toxic, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        table = shared.value.table()
        return pd.Series([shared.value.score(t or "", table) < THRESHOLD for t in texts], dtype=bool)

    return bounded_batches(df).where(clean(col(text_col).cast("string")))
