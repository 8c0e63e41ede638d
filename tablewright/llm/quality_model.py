"""Quality of texts: histogram gradient-boosted trees over statistics of the text.

The statistics of every text are made where the text is; trees are grown on one machine
from the statistics of a bounded sample of labelled rows (:data:`SAMPLE`), and laid out
as arrays, so that numpy walks all trees for all rows of a batch at once.

Results of odd input: null and empty texts have zero for every statistic and are scored
like any other; without labelled rows, or with one label only, every score is the mean
label (0.5 without rows); repeated rows are scored one by one; an empty table gives an
empty table; columns other than id and text are never read.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import held_out, map_batches, pick
from tablewright.llm.samples import labelled, with_text

#: Labelled rows the trees are grown from, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH = 80, 4, 64, 0.15, 5.0
MODULUS, REST, THRESHOLD = 4, 2, 0.7

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9), "newline": (10,), "stop": b".,;:?",
    "bang": b"!", "hash": b"#", "star": b"*", "dollar": b"$", "percent": b"%", "amp": b"&", "pipe": b"|", "angle": b"<>",
    "bracket": b"()[]{}", "quote": b"\"'`", "other": b"+-/=@\\^_~", "control": [*range(9), *range(11, 32), 127], "high": range(128, 256),
}
_KIND_OF = np.zeros((256, len(_KINDS)))
for _i, _signs in enumerate(_KINDS.values()):
    _KIND_OF[list(_signs), _i] = 1.0
NAMES = (
    *_KINDS, "log_bytes", "log_words", "mean_word", "distinct_words", "same_as_next", "distinct_pairs", "caps_words", "signed_words",
    "word_lines", "distinct_lines",
)


def statistics(raw: bytes) -> np.ndarray:
    """Shares of kinds of bytes, lengths, and how far words, pairs of words and lines repeat."""
    out = np.zeros(len(NAMES))
    if not raw:
        return out
    out[: len(_KINDS)] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KIND_OF / len(raw)
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if n:
        out[len(_KINDS) :] = (
            np.log1p(len(raw)), np.log1p(n), sum(map(len, words)) / n, len(set(words)) / n,
            sum(map(operator.eq, words, words[1:])) / n, len(set(zip(words, words[1:]))) / n,
            sum(map(bytes.isupper, words)) / n, 1.0 - sum(map(bytes.isalpha, words)) / n,
            len(lines) / n, len(set(lines)) / max(1, len(lines)),
        )
    return out


@dataclass
class Trees:
    """Complete trees as arrays: inner nodes by tree and place, leaves by tree and place."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of every row; each step moves all rows one level down in all trees."""
        total = np.full(len(x), self.base)
        if len(self.feature):
            trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
            place = np.zeros((len(x), len(trees)), np.int64)
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                place = 2 * place + 1 + (x[rows, self.feature[trees, place]] > self.threshold[trees, place])
            total += self.leaf[trees, place - self.feature.shape[1]].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees by gradients of the logistic loss, splits found in histograms of binned values."""
    mean = float(y.mean()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        mean = min(max(mean, 1e-3), 1 - 1e-3)
        return Trees(float(np.log(mean / (1 - mean))), np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    base = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), base)
    inner, n_leaves = (1 << depth) - 1, 1 << depth
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, n_leaves))
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        place = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            at = (place - first) * BINS
            best, gain_of = np.zeros(n, np.int64), np.full(n, 1e-6)
            cut = np.full(n, BINS, np.int64)
            for f in range(width):
                key = at + binned[:, f]
                left_g = np.bincount(key, g, n * BINS).reshape(n, BINS).cumsum(axis=1)
                left_h = np.bincount(key, h, n * BINS).reshape(n, BINS).cumsum(axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + SMOOTH) + right_g**2 / (right_h + SMOOTH) - all_g**2 / (all_h + SMOOTH)
                gain[(left_h < 1) | (right_h < 1)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(n), top] > gain_of
                best[better], cut[better] = f, top[better]
                gain_of = np.maximum(gain_of, gain[np.arange(n), top])
            feature[t, first : first + n] = best
            for i in range(n):
                if cut[i] < len(edges[best[i]]):
                    threshold[t, first + i] = edges[best[i]][cut[i]]
            place = 2 * place + 1 + (binned[np.arange(len(y)), best[place - first]] > cut[place - first])
        place -= inner
        sum_g, sum_h = np.bincount(place, g, n_leaves), np.bincount(place, h, n_leaves)
        leaf[t] = -RATE * sum_g / (sum_h + SMOOTH)
        total += leaf[t][place]
    return Trees(base, feature, threshold, leaf)


def _statistics(texts: pa.Array) -> np.ndarray:
    rows = [statistics(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in texts]
    return np.stack(rows) if rows else np.zeros((0, len(NAMES)))


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from the statistics of at most ``bound`` labelled texts."""
    sample = with_text(df, labelled(labels, label_col, bound, MODULUS, REST), id_col, text_col)
    schema = pa.schema([("x", pa.list_(pa.float64())), ("label", pa.float64())])
    rows = map_batches(sample, schema, lambda b: {"x": list(_statistics(b.column("text"))), "label": b.column("label")}).toPandas()
    # Rows come in any order; trees must not depend on it.
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(NAMES))
    y = rows["label"].to_numpy(dtype=float)
    order = np.lexsort([*x.T, y])
    return grow(x[order], y[order])


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def run(batch: pa.RecordBatch) -> dict:
        found = []
        for at in range(0, batch.num_rows, 1024):
            found.append(shared.value.scores(_statistics(batch.column("text").slice(at, 1024))))
        scores = np.concatenate(found)
        return {"doc_id": batch.column("doc_id"), "score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32)}

    rows = map_batches(pick(df, doc_id=(id_col, "bigint"), text=(text_col, "string")), SCHEMA, run)
    return rows.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score", "predicted")
