"""Masked pseudo-likelihood of texts: every word predicted from the two words on either side.

A word's chance is that of its class, given the four words around it, times the word's
share of its class.  The most frequent words are classes of their own; the others are
classed by their last two bytes.

* Words are counted over all texts, so shares, classes and the room left for unknown
  words come from the whole corpus.
* The class network (position tables of the four neighbours, one hidden layer, softmax)
  is trained in numpy on every word of every text, once: in each of a few rounds, every
  partition takes gradient steps on its share of its own words, then the parameters are
  averaged in a tree.  What is gathered grows with the corpus; each message has a fixed size.
* All words of all texts are then scored.

Words: A-Z lower-cased, runs of letters, digits and signs beyond ASCII.  Results of odd
input: null and empty texts have no words and a score of 0; a corpus without words gives
equal classes; texts of any length are scored whole; repeated rows are scored one by one
(and counted); an empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import checkpointed, map_arrow, map_batches, pick, tree_sum
from tablewright.llm.contamination import words

#: Most words with a share of their own (broadcast, some MB); classes of one word; classes by ending.
VOCABULARY, SINGLE, ENDINGS = 50_000, 191, 64
CLASSES = SINGLE + ENDINGS
PAD = CLASSES  # what lies outside the text
HIDDEN, ROUNDS, STEP = 32, 3, 0.01
#: Words to a step at first and at most; after so many steps of a task they double.
BATCH, LARGEST, GROW = 512, 4096, 128
_FLUSH, _CHUNK = 300_000, 2048
_AROUND = (0, 1, 3, 4)  # of a window of five
_WINDOW = np.arange(-2, 3)


def ending(word: bytes) -> int:
    return SINGLE + zlib.crc32(word[-2:]) % ENDINGS


def word_counts(rows: DataFrame) -> DataFrame:
    """``(word, ending, n)`` over all texts, added up in each partition before the shuffle."""
    schema = pa.schema([("word", pa.binary()), ("ending", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                if text.is_valid:
                    counts.update(words(text.as_buffer().to_pybytes()))
                    if len(counts) > _FLUSH:
                        yield out(counts)
                        counts = Counter()
        if counts:
            yield out(counts)

    def out(counts: Counter) -> pa.RecordBatch:
        columns = list(counts), [ending(w) for w in counts], list(counts.values())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    parts = map_arrow(rows.select("text"), run, schema)
    return parts.groupBy("word", "ending").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` words of the greatest counts, or all if fewer; among words of one count a hash decides.

    Steps of the count's logarithm, then counts, then slices of the hash are taken whole as long as they
    fit, so that only the words of one slice are sorted.  The driver sees numbers of words alone.
    """
    place = F.xxhash64("word")
    rest, room, taken = counts, size, counts.limit(0)
    for key in (F.floor(F.log2("n") * 64), F.col("n"), F.shiftright(place, 48).cast("long")):
        kinds = {r.key: r.kinds for r in rest.groupBy(key.alias("key")).agg(F.count("*").alias("kinds")).collect()}
        least = over = None
        for at in sorted(kinds, reverse=True):
            if kinds[at] > room:
                over = at
                break
            least, room = at, room - kinds[at]
        if least is not None:
            taken = taken.union(rest.where(key >= least))
        if over is None:
            return taken
        rest = rest.where(key == over)
    return taken.union(rest.orderBy(place.desc(), "word").limit(room))


@dataclass
class Vocabulary:
    """Known words, and by number (known words, then one unknown word per ending) class and log share of the class."""

    known: list[bytes]
    classes: np.ndarray
    shares: np.ndarray
    prior: np.ndarray  # log share of each class in the corpus

    @staticmethod
    def of(counts: DataFrame, size: int = VOCABULARY) -> Vocabulary:
        top = sorted(most_frequent(counts, size).collect(), key=lambda r: (-r.n, bytes(r.word)))
        per_class = {r.ending: (r.n, r.kinds) for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
        known = [bytes(r.word) for r in top]
        n = np.array([r.n for r in top], float)
        classes = np.array([i if i < SINGLE else r.ending for i, r in enumerate(top)], np.int64).reshape(-1)
        own = np.array([r.ending for r in top], np.int64)
        total, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        for c, (m, k) in per_class.items():
            total[c], kinds[c] = m, k
        unknown, unknown_kinds = total.copy(), kinds.copy()
        np.subtract.at(unknown, own, n)
        np.subtract.at(unknown_kinds, own, 1)
        mass = unknown + 1.0  # one more for words never seen
        np.add.at(mass, classes, n)
        mass[: min(SINGLE, len(n))] = n[:SINGLE]
        shares = np.log(n) - np.log(mass[classes])
        left = np.log((unknown[SINGLE:] + 1.0) / mass[SINGLE:]) - np.log(unknown_kinds[SINGLE:] + 1.0)
        return Vocabulary(
            known, np.concatenate([classes, np.arange(SINGLE, CLASSES)]), np.concatenate([shares, left]), np.log(mass / mass.sum())
        )

    def numbers(self) -> _Numbers:
        return _Numbers(self.known)


class _Numbers(dict):
    """Numbers of words; unknown words have the number of their ending."""

    def __init__(self, known: list[bytes]):
        super().__init__(zip(known, range(len(known))))
        self.first_ending = len(known) - SINGLE

    def __missing__(self, word: bytes) -> int:
        return self.first_ending + ending(word)


@dataclass
class Network:
    tables: np.ndarray  # (4, CLASSES + 1, HIDDEN), one per place around the word
    bias: np.ndarray
    out: np.ndarray  # (HIDDEN, CLASSES)
    out_bias: np.ndarray

    @staticmethod
    def start(prior: np.ndarray) -> Network:
        random = np.random.Generator(np.random.Philox(key=5))
        draw = lambda *shape: (0.1 * random.standard_normal(shape)).astype(np.float32)
        return Network(draw(4, CLASSES + 1, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, CLASSES), prior.astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.out, self.out_bias]

    def hidden(self, around: list[np.ndarray]) -> np.ndarray:
        total = self.tables[0][around[0]]
        for table, classes in zip(self.tables[1:], around[1:]):
            total += table[classes]
        total += self.bias
        return np.tanh(total, out=total)

    def log_chances(self, around: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        """Log chance of each target class, given the classes around it."""
        scores = self.hidden(around) @ self.out
        scores += self.out_bias
        chosen = scores[np.arange(len(target)), target]
        # Scores are sums of HIDDEN values in -1 to 1 by bounded weights, far from overflow.
        return chosen - np.log(np.exp(scores, out=scores).sum(axis=1))


class _Adam:
    """Steps along gradients, evened out per parameter."""

    def __init__(self, network: Network):
        self.means = [np.zeros_like(p) for p in network.parts()]
        self.squares = [np.zeros_like(p) for p in network.parts()]
        self.n = 0

    def step(self, network: Network, gradients: list[np.ndarray]) -> None:
        self.n += 1
        rate = STEP * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for p, g, m, s in zip(network.parts(), gradients, self.means, self.squares):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
            np.clip(p, -8, 8, out=p)


def _gradients(network: Network, window: np.ndarray) -> list[np.ndarray]:
    """Of the mean negative log chance of the middle classes of windows ``(n, 5)``."""
    n = len(window)
    around, target = [window[:, i] for i in _AROUND], window[:, 2]
    hidden = network.hidden(around)
    error = hidden @ network.out
    error += network.out_bias
    np.exp(error, out=error)
    error /= error.sum(axis=1, keepdims=True)
    error[np.arange(n), target] -= 1
    error /= n
    back = (error @ network.out.T) * (1 - hidden * hidden)
    tables = np.zeros_like(network.tables)
    for table, classes in zip(tables, around):
        order = np.argsort(classes, kind="stable")
        present, first = np.unique(classes[order], return_index=True)
        table[present] = np.add.reduceat(back[order], first, axis=0)
    return [tables, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]


def train(samples: DataFrame, prior: np.ndarray, rounds: int = ROUNDS) -> Network:
    """Rounds of local steps on each partition's words, each word in one round, and averages weighted by their number."""
    network = Network.start(prior)
    for turn in range(rounds):
        shared = samples.sparkSession.sparkContext.broadcast(network)

        def local(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> tuple[int, list[np.ndarray]]:
            own = Network(*[p.copy() for p in shared.value.parts()])
            steps, random, seen = _Adam(own), np.random.Generator(np.random.Philox(key=turn)), 0
            for batch in batches:
                padded = _padded(batch)
                middles, at = random.permutation(middles_of(padded, turn, rounds)), 0
                while at < len(middles):
                    part = middles[at : at + min(LARGEST, BATCH << (steps.n // GROW))]
                    steps.step(own, _gradients(own, padded[part[:, None] + _WINDOW]))
                    at += len(part)
                seen += at
            return seen, [p.astype(np.float64) * seen for p in own.parts()]

        n, sums = tree_sum(samples, local, lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]), (0, []))
        if not n:
            break
        network = Network(*[(s / n).astype(np.float32) for s in sums])
    return network


def windows(numbers: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    """Classes of texts in a row, with two pads before each text and behind the last."""
    pads = np.full(2, PAD, np.uint8)
    return np.concatenate([x for n in numbers for x in (pads, classes[n].astype(np.uint8))] + [pads])


def _coded(batch: pa.RecordBatch, numbers: _Numbers) -> list[np.ndarray]:
    found = [words(t.as_buffer().to_pybytes()) if t.is_valid else [] for t in batch.column("text")]
    return [np.fromiter(map(numbers.__getitem__, f), np.int64, len(f)) for f in found]


def middles_of(padded: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Places of the words that a round trains on; the rounds share out all words."""
    return np.flatnonzero(padded != PAD)[turn::rounds]


CODED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64()), ("classes", pa.binary())])


def coded_texts(rows: DataFrame, vocabulary) -> DataFrame:
    """Of every text its words, the sum of their log shares, and their classes, one byte each between pads."""

    def run(batch: pa.RecordBatch) -> dict:
        known, numbers = vocabulary.value, _numbers_of(vocabulary)
        lengths, shares, classes = [], [], []
        for at in range(0, batch.num_rows, 64):
            for n in _coded(batch.slice(at, 64), numbers):
                lengths.append(len(n))
                shares.append(float(known.shares[n].sum()))
                classes.append(windows([n], known.classes).tobytes())
        return {"doc_id": batch.column("doc_id"), "n_words": lengths, "share": shares, "classes": classes}

    return map_batches(rows, CODED, run)


def _padded(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer() for v in batch.column("classes")), np.uint8)


@lru_cache(maxsize=1)
def _numbers_of(vocabulary) -> _Numbers:
    return vocabulary.value.numbers()


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_chance", pa.float64()), ("per_word", pa.float64())])


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = VOCABULARY) -> DataFrame:
    """``(doc_id, n_words, log_chance, per_word)`` of every row: the sum of all words' log chances, and its mean."""
    rows = pick(df, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    context = df.sparkSession.sparkContext
    vocabulary = context.broadcast(Vocabulary.of(checkpointed(word_counts(rows)), size))
    coded = checkpointed(coded_texts(rows, vocabulary))
    network = context.broadcast(train(coded.select("classes"), vocabulary.value.prior))

    def run(batch: pa.RecordBatch) -> dict:
        net, padded = network.value, _padded(batch)
        middles = np.flatnonzero(padded != PAD)
        chances = np.zeros(len(middles) + 1)
        for i in range(0, len(middles), _CHUNK):
            here = middles[i : i + _CHUNK]
            chances[i + 1 : i + 1 + len(here)] = net.log_chances([padded[here + k - 2] for k in _AROUND], padded[here])
        lengths, total = batch.column("n_words").to_numpy(), np.cumsum(chances)
        ends = np.cumsum(lengths)
        sums = total[ends] - total[ends - lengths] + batch.column("share").to_numpy()
        per_word = np.where(lengths > 0, sums / np.maximum(lengths, 1), 0.0)
        return {"doc_id": batch.column("doc_id"), "n_words": lengths, "log_chance": sums, "per_word": per_word}

    return map_batches(coded, SCHEMA, run)
