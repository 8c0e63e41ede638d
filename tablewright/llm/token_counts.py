"""Token counts of whole texts, without shuffling a single pre-token.

Two tiers answer each pre-token: a compact broadcast table with the lengths of the
most frequent ones, then a cache of each worker, whose misses go to the tokenizer.
The frequent ones are found by bounded frequency sketches, one per partition, merged
in a tree; they decide speed alone, never a count.

Results of odd input: null and empty texts have no bytes and no tokens; repeated rows
are counted one by one; an empty table gives an empty table; columns other than id and
text are not read; a null id stays null.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import map_batches, pick, tree_sum

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

# Characters for which lower-casing and composition work one by one in any Unicode version.
_PLAIN = "\t\n\r\x20-\x7e\xa1-įı-ɏ"
_LETTERS = "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "N")
_ODD = re.compile(f"[^{_PLAIN}]")
#: The pre-tokenizer's pattern (a fixed value of the vocabulary file), spelled out for plain characters.
_PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_BLANKS = re.compile("[ \t\n\r]+")
_LONGEST = 64


class _Lengths(dict):
    """Lengths by pre-token: the broadcast table, then a bounded cache, then the tokenizer."""

    def __init__(self, tokenizer, frequent: dict[str, int], cache: int):
        super().__init__(frequent)
        self.tokenizer, self.frequent, self.room = tokenizer, frequent, cache

    def __missing__(self, word: str) -> int:
        n = len(self.tokenizer.encode(word, add_special_tokens=False))
        if len(word) <= _LONGEST:
            if len(self) >= len(self.frequent) + self.room:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


def _parts(text: str, specials: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Pre-tokens of the plain words, and the words only the tokenizer itself should cut.

    Blanks are never part of a token, so texts may be cut there.
    """
    if not _ODD.search(text) and not any(s in text for s in specials):
        return _PRE_TOKENS.findall(text.lower()), []
    plain, odd = [], []
    for word in _BLANKS.split(text):
        if _ODD.search(word) or any(s in word for s in specials):
            odd.append(word)
        else:
            plain.append(word)
    return _PRE_TOKENS.findall(" ".join(plain).lower()), odd


def frequent_pre_tokens(df: DataFrame, path: str, entries: int) -> dict[str, int]:
    """Lengths of about the ``entries`` most frequent pre-tokens of all texts.

    Each sketch keeps at most ``4 * entries`` counters while it reads and hands on
    ``entries`` of them, so its size never depends on the data.
    """

    def cut(counts: Counter, n: int) -> Counter:
        return counts if len(counts) <= n else Counter(dict(counts.most_common(n)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Counter:
        counts: Counter = Counter()
        specials = _specials(path)
        for batch in batches:
            for text in batch.column("text"):
                if text.is_valid:
                    counts.update(_parts(text.as_py(), specials)[0])
                    if len(counts) > 4 * entries:
                        counts = cut(counts, 2 * entries)
        return cut(Counter({w: n for w, n in counts.items() if len(w) <= _LONGEST}), entries)

    found = tree_sum(df.select("text"), partial, lambda a, b: cut(a + b, entries), Counter())
    tokenizer, words = _tokenizer(path), list(found)
    return {w: len(tokenizer.encode(w, add_special_tokens=False)) for w in words}


def token_counts(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", entries: int = 32768, cache: int = 300_000
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every row, as the tokenizer file at ``path`` counts.

    ``entries`` bounds the broadcast table and ``cache`` the words each worker remembers;
    words past 64 characters are in neither.
    """
    rows = pick(df, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    table = frequent_pre_tokens(rows, path, entries)
    # Words in one string, lengths in one byte each where they fit: at most some megabytes.
    words = [w for w, n in table.items() if n < 256]
    shared = df.sparkSession.sparkContext.broadcast((" ".join(words), bytes(table[w] for w in words)))
    key = f"{path}:{id(shared)}:{entries}:{cache}"

    def count(batch: pa.RecordBatch) -> dict:
        lengths, specials = _worker_lengths(key, path, shared, cache), _specials(path)
        of, tokenizer = lengths.__getitem__, _tokenizer(path)
        n_bytes, n_tokens = [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            plain, odd = _parts(text, specials)
            n_bytes.append(len(text.encode()))
            n_tokens.append(sum(map(of, plain)) + sum(len(tokenizer.encode(w, add_special_tokens=False)) for w in odd if w))
        return {"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": n_tokens}

    return map_batches(rows, SCHEMA, count)


_KEPT: dict[str, _Lengths] = {}


def _worker_lengths(key: str, path: str, shared, cache: int) -> _Lengths:
    """The worker's table, built once per broadcast and kept between its tasks."""
    kept = sys.modules[__name__]._KEPT
    if key not in kept:
        kept.clear()
        words, lengths = shared.value
        kept[key] = _Lengths(_tokenizer(path), dict(zip(words.split(" "), lengths)) if words else {}, cache)
    return kept[key]


def with_limit(counts: DataFrame, limit: int) -> DataFrame:
    """Marks the rows of more than ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
