"""Languages of texts by hyperdimensional profiles of letter trigrams.

Each letter has a random vector of +1 and -1, made from its code point alone.  A trigram
is bound by multiplying its letters' vectors, rotated by their place; a text is the sum
of its trigrams.  A language's prototype is the sum over its learned texts, and a text
belongs to the prototype with the greatest cosine.

Prototypes are integer sums of fixed size per language, added up in every partition and
merged in a tree, so all learned texts count and the result depends on no order.

Results of odd input: texts that are null or have no letter are ``und`` with score 0, as
is every text if nothing was learned; ties go to the smaller language name; repeated rows
are predicted one by one; an empty table gives an empty table; columns other than id,
text and (for learning) language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import held_out, map_batches, pick, tree_sum

WIDTH = 1024
MODULUS, REST, UNKNOWN = 4, 2, "und"
#: Texts whose trigrams are bound together, and most languages that are learned (8 KB each).
GROUP, LANGUAGES = 256, 5000
_BITS = 21
_MASK = np.uint64((1 << _BITS) - 1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=20_000)
def _letter(code: int) -> np.ndarray:
    """The vector of a letter, the same on every machine."""
    bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 256, WIDTH // 8, dtype=np.uint8)
    return (np.unpackbits(bits).astype(np.int8) << 1) - 1


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the text's words, a blank before and after each, and their counts."""
    code = np.frombuffer(("  " + text.lower() + "  ").encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[code]
    kept = is_letter | np.append(False, is_letter[:-1]) | np.append(is_letter[1:], False)
    code = np.where(is_letter, code, 32)[kept].astype(np.uint64)
    middle = is_letter[kept][1:-1]
    grams = ((code[:-2] << np.uint64(2 * _BITS)) | (code[1:-1] << np.uint64(_BITS)) | code[2:])[middle] if len(code) > 2 else code[:0]
    return np.unique(grams, return_counts=True)


def bind(grams: np.ndarray) -> np.ndarray:
    """Vectors of trigrams, one row each."""
    parts = [(grams >> np.uint64(2 * _BITS)) & _MASK, (grams >> np.uint64(_BITS)) & _MASK, grams & _MASK]
    codes = np.unique(np.concatenate(parts))
    vectors = np.stack([_letter(int(c)) for c in codes]) if len(codes) else np.zeros((0, WIDTH), np.int8)
    first, second, third = (np.searchsorted(codes, p) for p in parts)
    out = np.roll(vectors, 2, axis=1)[first]
    out *= np.roll(vectors, 1, axis=1)[second]
    out *= vectors[third]
    return out


def _bundles(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of each text's trigram vectors."""
    known = np.unique(np.concatenate([g for g, _ in texts]))
    counts = np.zeros((len(texts), len(known)), np.float32)
    for row, (grams, times) in zip(counts, texts):
        row[np.searchsorted(known, grams)] = times
    out = np.zeros((len(texts), WIDTH), np.float32)
    for at in range(0, len(known), 16384):
        out += counts[:, at : at + 16384] @ bind(known[at : at + 16384]).astype(np.float32)
    return out


def _learn(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        by: dict[str, list] = {}
        for text, lang in zip(batch.column("text"), batch.column("lang")):
            by.setdefault(lang.as_py(), []).append(trigrams(text.as_py()))
        for lang, found in by.items():
            grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            times = np.zeros(len(grams), np.int64)
            np.add.at(times, place, np.concatenate([t for _, t in found]))
            total = sums.setdefault(lang, np.zeros(WIDTH, np.int64))
            for at in range(0, len(grams), 8192):
                # Sums below 2**53 are exact in double precision.
                total += (times[at : at + 8192].astype(float) @ bind(grams[at : at + 8192]).astype(float)).astype(np.int64)
    return _few(sums)


def _few(sums: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    if len(sums) > LANGUAGES:
        raise ValueError(f"More than {LANGUAGES} languages to learn")
    return sums


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototype of each language, from all texts that are not held out."""
    rows = pick(df, doc_id=(id_col, "bigint"), text=(text_col, "string"), lang=(lang_col, "string"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id"), MODULUS, REST))

    def merge(a: dict, b: dict) -> dict:
        return _few({k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()})

    sums = tree_sum(rows.select("text", "lang"), _learn, merge, {})
    return {k: v / np.linalg.norm(v) for k, v in sorted(sums.items()) if v.any()}


SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row; the score is the cosine, 0 if negative."""
    names = sorted(prototypes)
    shared = df.sparkSession.sparkContext.broadcast(np.array([prototypes[n] for n in names], np.float32).reshape(len(names), WIDTH))

    def run(batch: pa.RecordBatch) -> dict:
        found, scores = [], []
        for at in range(0, batch.num_rows, GROUP):
            texts = [trigrams(t.as_py() or "") for t in batch.column("text").slice(at, GROUP)]
            sums = _bundles(texts)
            norms = np.linalg.norm(sums, axis=1)
            cosines = sums @ shared.value.T / np.maximum(norms, 1e-9)[:, None]
            for row, norm in zip(cosines, norms):
                best = int(row.argmax()) if norm and len(names) else -1
                found.append(names[best] if best >= 0 else UNKNOWN)
                scores.append(min(1.0, max(0.0, float(row[best]))) if best >= 0 else 0.0)
        return {"doc_id": batch.column("doc_id"), "lang_pred": found, "score": scores}

    rows = map_batches(pick(df, doc_id=(id_col, "bigint"), text=(text_col, "string")), SCHEMA, run)
    return rows.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "lang_pred", "score")
