"""Rules that reject junk texts: counts of words, repeats and lines, then bands of compression ratios.

A text is compressed whole and in chunks of fixed size.  Text that shrinks too well
repeats itself; text that hardly shrinks is noise.  What is usual depends on the length,
so each length has limits of its own (:data:`WHOLE`, :data:`CHUNK`).

Words are maximal runs without blanks (x20, x09 to x0D).  Results of odd input: a null
text has no words, symbols or lines, like an empty one, and fails for want of words;
texts are read whole at any length; repeated rows are judged one by one; an empty table
gives an empty table; columns other than id and text are not read by
:func:`quality_rules`, and :func:`keep_good` hands all columns on unchanged.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import bounded_batches, col, map_batches, pick

LEVEL, CHUNK_BYTES = 3, 4096
#: Per length in bytes up to which they hold: least and greatest ratio of a whole text.
WHOLE = ((64, 0.0, 3.0), (256, 0.8, 3.5), (1024, 1.15, 4.5), (4096, 1.4, 5.0), (16384, 1.55, 5.5), (None, 1.7, 6.0))
#: Least and greatest ratio of one chunk, and the share of chunks outside them that rejects a text.
CHUNK, CHUNK_SHARE = (1.4, 6.0), 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
_SYMBOLS = tuple(b"#*$%&|<>"[i : i + 1] for i in range(8))

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
        ("whole_ratio", pa.float64()), ("bad_chunks", pa.int64()), ("n_chunks", pa.int64()),
    ]
)


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)


def _ratio(raw: bytes) -> float:
    return len(raw) / len(_compressor().compress(raw)) if raw else 0.0


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = reach = 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + WINDOW - max(at, reach)
            reach = at + WINDOW
    return covered


def compression(raw: bytes) -> tuple[bool, float, int, int]:
    """Verdict of the bands, ratio of the whole text, chunks outside their band, chunks.

    A rest shorter than a chunk is judged with what is before it, as the text's last full chunk; a text
    shorter than a chunk is one chunk, judged by the limits of its length.
    """
    ratio = _ratio(raw)
    low, high = next((low, high) for upto, low, high in WHOLE if upto is None or len(raw) <= upto)
    good = low <= ratio <= high
    if len(raw) < CHUNK_BYTES:
        return good, ratio, int(not good), 1
    starts = list(range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES))
    if len(raw) % CHUNK_BYTES:
        starts.append(len(raw) - CHUNK_BYTES)
    chunks = [raw[i : i + CHUNK_BYTES] for i in starts]
    bad = sum(not CHUNK[0] <= _ratio(chunk) <= CHUNK[1] for chunk in chunks)
    return good and bad <= CHUNK_SHARE * len(chunks), ratio, bad, len(chunks)


def measure(raw: bytes) -> tuple:
    """All results of one text in UTF-8, in the order of :data:`SCHEMA` after the id."""
    words = raw.split()  # bytes are split at exactly the six blanks
    joined = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    good, ratio, bad, chunks = compression(raw)
    return (
        len(words), len(joined.decode()), sum(map(joined.count, _SYMBOLS)), len(lines) - len(set(lines)), repeats,
        failed, not failed and good, ratio, bad, chunks,
    )


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every row; see :data:`SCHEMA`."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = [measure(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in batch.column("text")]
        return {"doc_id": batch.column("doc_id")} | dict(zip(SCHEMA.names[1:], zip(*rows)))

    return map_batches(pick(df, doc_id=(id_col, "bigint"), text=(text_col, "string")), SCHEMA, run)


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, with all their columns."""

    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        return pd.Series([measure((t or "").encode())[6] for t in texts], dtype=bool)

    return bounded_batches(df).where(kept(col(text_col).cast("string")))
