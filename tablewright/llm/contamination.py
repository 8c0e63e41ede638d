"""Where test texts occur in training texts: a positional inverted index, searched from the rarest terms.

:func:`build_index` cuts the training table into blocks of some megabytes of text and
stores, for each block, the postings (document, position) of its terms: one row per
block, so that a search needs nothing but that row, no shuffle, and memory for one block.
:func:`search` finds phrases in every block: lists of the phrase's terms are shifted by
the term's place in the phrase and intersected, beginning with the rarest term of the
block, so most phrases end at the first, empty list.  A wider tolerance gives proximity
matches, the exact ones among them.

Test items are searched in blocks of bounded size, each broadcast by itself.

Words: A-Z lower-cased, then maximal runs of signs that are neither ASCII punctuation,
blank nor control sign.  Results of odd input: null and empty texts have no words, so no
hits and no contamination; items without words have no windows; equal items are found as
often as they are listed; items without id are searched and their hits count, but they
are in no list or number of items; texts of any length are indexed whole (a long one is a block of
its own); repeated rows are counted one by one; empty tables give an empty table or no
hits; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import checkpointed, map_arrow, pick

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: Test words searched at once; their windows and terms are what is broadcast (at most some tens of MB).
ITEM_WORDS = 500_000

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_FAR = np.int64(1) << 33  # keys of two documents lie further apart than any position

INDEX = pa.schema(
    [
        ("doc_ids", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int32())),
        ("terms", pa.list_(pa.binary())),
        ("starts", pa.list_(pa.int32())),  # of each term's postings, and their end
        ("docs", pa.list_(pa.int32())),
        ("positions", pa.list_(pa.int32())),
    ]
)
FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.list_(pa.int32()))),
        ("items", pa.list_(pa.int64())),
        ("near_items", pa.list_(pa.int64())),
        ("row", pa.int32()),
    ]
)


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def build_index(df: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index rows of all texts, written to the shared checkpoint folder.

    ``terms`` (one binary column, bounded) leaves out postings of terms that no search will ask for.
    """
    wanted = None
    if terms is not None:
        wanted = df.sparkSession.sparkContext.broadcast(frozenset(bytes(r[0]) for r in terms.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raws, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ids.append(doc_id.as_py())
                raws.append(raw)
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield _block(ids, raws, wanted.value if wanted else None)
                    ids, raws, size = [], [], 0
        if ids:
            yield _block(ids, raws, wanted.value if wanted else None)

    rows = pick(df, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    return checkpointed(map_arrow(rows, run, INDEX))


def _block(ids: list, raws: list[bytes], wanted: frozenset[bytes] | None) -> pa.RecordBatch:
    number: dict[bytes, int] = {} if wanted is None else {w: i for i, w in enumerate(wanted)}
    codes, lengths = [], []
    for raw in raws:
        found = words(raw)
        if wanted is None:
            codes.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
        else:
            get = number.get
            codes.append(np.fromiter((get(w, -1) for w in found), np.int32, len(found)))
        lengths.append(len(found))
    code = np.concatenate(codes)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    position = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
    kept = np.flatnonzero(code >= 0)
    kept = kept[np.argsort(code[kept], kind="stable")]
    present, first = np.unique(code[kept], return_index=True)
    names = list(number)
    columns = [
        ids, lengths, [names[c] for c in present], np.append(first, len(kept)).astype(np.int32), doc[kept], position[kept],
    ]
    arrays = [pa.array(c, type=t.value_type) for c, t in zip(columns, INDEX.types)]
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays], schema=INDEX
    )


class _Phrases:
    """Windows of some items, as rows of term numbers (-1 past the end of a short one)."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        numbers: dict[bytes, int] = {}
        of: dict[tuple[int, ...], list[int]] = {}
        for item, found in items:
            coded = [numbers.setdefault(w, len(numbers)) for w in found]
            for i in range(max(1, len(coded) - window + 1)):
                of.setdefault(tuple(coded[i : i + window]), []).append(item)
        self.terms = list(numbers)
        self.items = [sorted(set(x) - {None}) for x in of.values()]  # items without id hit words, but have no id to list
        self.lengths = np.array([len(w) for w in of], np.int32)
        self.codes = np.full((len(of), window), -1, np.int32)
        for i, w in enumerate(of):
            self.codes[i, : len(w)] = w


def _matches(keys: list[np.ndarray], codes: np.ndarray, sizes: np.ndarray, slop: int) -> np.ndarray:
    """Places of the phrase's first word, from the rarest term's list on; each other term lies within ``slop`` of its place."""
    order = np.argsort(sizes[codes], kind="stable")
    places = keys[codes[order[0]]] - order[0]
    for at in order[1:]:
        if not len(places):
            break
        there = keys[codes[at]]
        i = np.searchsorted(there, places + (at - slop))
        ok = i < len(there)
        ok[ok] = there[i[ok]] <= places[ok] + (at + slop)
        places = places[ok]
    return places


def _search_block(row: dict, phrases: _Phrases, slop: int) -> dict[str, list]:
    """Rows of :data:`FOUND` for one index row."""
    number = {w: i for i, w in enumerate(row["terms"])}
    starts, keys = row["starts"], (row["docs"].astype(np.int64) + 1) * _FAR + row["positions"]
    here = np.array([number.get(w, -1) for w in phrases.terms] or [-1])
    lists = [keys[starts[h] : starts[h + 1]] if h >= 0 else keys[:0] for h in here]
    sizes = np.array([len(x) for x in lists] + [1])  # the last one stands for places past the end of a short phrase
    out = {n: [] for n in FOUND.names} | {"doc_id": list(row["doc_ids"]), "n_words": list(row["n_words"])}
    n = len(out["doc_id"])
    spans, items, near = [[] for _ in range(n)], [set() for _ in range(n)], [set() for _ in range(n)]
    for w in np.flatnonzero((sizes[phrases.codes] > 0).all(axis=1)):
        length = phrases.lengths[w]
        codes = phrases.codes[w, :length]
        places = _matches(lists, codes, sizes, slop)
        if slop and len(places):
            for d in np.unique(places // _FAR - 1):
                near[d].update(phrases.items[w])
            places = _matches(lists, codes, sizes, 0)
        for key in places:
            d, at = int(key // _FAR - 1), int(key % _FAR)
            spans[d].append((at, at + int(length)))
            items[d].update(phrases.items[w])
            near[d].update(phrases.items[w])
    out["spans"] = [_union(s) for s in spans]
    out["items"], out["near_items"] = [sorted(x) for x in items], [sorted(x) for x in near]
    out["row"] = list(range(n))
    return out


def _union(spans: list) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def search(index: DataFrame, items: list[tuple[int, list[bytes]]], window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Occurrences of the items' windows, one row per indexed document; see :data:`FOUND`.

    ``spans`` are the word places inside exact occurrences, joined; ``items`` have one,
    ``near_items`` have all words of a window within ``slop`` of their places.  ``block`` of
    the index, where it has one, and the document's ``row`` in it tell equal ids apart.
    """
    marked = "block" in index.columns
    schema = FOUND.append(pa.field("block", pa.int64())) if marked else FOUND
    shared = index.sparkSession.sparkContext.broadcast(_Phrases(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("n_words", "starts", "docs", "positions")}
                found = _search_block(row | {n: batch.column(n)[i].as_py() for n in ("terms", "doc_ids")}, shared.value, slop)
                if marked:
                    found["block"] = [batch.column("block")[i].as_py()] * len(found["row"])
                yield pa.RecordBatch.from_arrays([pa.array(found[n], schema.field(n).type) for n in schema.names], schema=schema)

    return map_arrow(index, run, schema)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items with words, a bounded number of words at a time; partitions of the test table come to the driver one by one."""
    block, size = [], 0
    for r in pick(benchmark, item_id=(id_col, "bigint"), text=(text_col, "string")).toLocalIterator():
        found = words((r.text or "").encode())
        if found:
            block.append((r.item_id, found))
            size += len(found)
            if size >= block_words:
                yield block
                block, size = [], 0
    yield block


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slop: int = 2,
    block_words: int = ITEM_WORDS,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, n_near_items, contaminated)`` of every row.

    A word is hit inside any exact occurrence of a window; a document is contaminated if
    at least one in twenty words is hit.
    """
    spark = df.sparkSession
    blocks = item_blocks(benchmark, item_col, item_text_col, block_words)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        # All items fit one block: only their terms need postings.
        terms = spark.createDataFrame([(bytearray(w),) for w in sorted({w for _, found in first for w in found})], "term binary")
        found = search(build_index(df, terms, id_col, text_col), first, window, slop)
        joined = found.select(F.col("spans"), "items", "near_items", "doc_id", "n_words")
    else:
        index = checkpointed(build_index(df, None, id_col, text_col).withColumn("block", F.monotonically_increasing_id()))
        joined = _join_blocks(index, chain([first, second], blocks), window, slop)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s[1] - s[0]))
    digest = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256)
    out = joined.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        digest.alias("items_sha256"), F.size("near_items").cast("bigint").alias("n_near_items"),
    )
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def _join_blocks(index: DataFrame, blocks: Iterable, window: int, slop: int) -> DataFrame:
    """Searches of several item blocks, brought together per document.

    Each search is written before the next block comes to the driver, as one small row per
    document with a match; lists per document grow with its own matches alone.
    """
    found = None
    for items in blocks:
        one = search(index, items, window, slop).where(F.size("spans") + F.size("near_items") + F.size("items") > 0)
        one = checkpointed(one.select("block", "row", "spans", "items", "near_items"))
        found = one if found is None else found.unionByName(one)
    grouped = found.groupBy("block", "row").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"),
    )
    none, last = F.array().cast("array<array<int>>"), lambda done: F.try_element_at(done, F.lit(-1))
    # Spans in order: each is joined to the last one if it begins within it.
    spans = F.aggregate(
        "spans",
        none,
        lambda done, s: F.when(
            s[0] <= last(done)[1],
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last(done)[0], F.greatest(last(done)[1], s[1])))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    documents = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("row", "doc"))
    no_items = F.array().cast("array<bigint>")
    return documents.join(grouped, ["block", "row"], "left").select(
        F.col("doc.doc_ids").alias("doc_id"),
        F.col("doc.n_words").cast("bigint").alias("n_words"),
        F.coalesce(spans, none).alias("spans"),
        F.coalesce("items", no_items).alias("items"),
        F.coalesce("near_items", no_items).alias("near_items"),
    )
