"""Counts of text values without moving the texts.

A text of more than ``SHORT`` characters is counted under its digest, with its first characters beside it
for the order.  Only the texts that a result shows are read again, by their digests.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import checkpointed, col

SHORT = 64  # characters of a text that may move as they are
FEW = 8  # columns that are worth a scan each
_MARK = "sha-256 "  # makes a digest longer than any text that stands for itself

_COUNTS = "column string, value string, count long"


def _key(text: Column) -> Column:
    return F.when(F.length(text) > SHORT, F.concat(F.lit(_MARK), F.sha2(text, 256))).otherwise(text)


def _cells(df: DataFrame, columns: Sequence[str], seen: int = 0) -> DataFrame:
    """``(column, key, part)`` of every cell, nulls too; ``part`` are the characters behind the first ``seen``."""
    cells = []
    for c in columns:
        text = col(c).cast("string")
        cells.append(F.struct(F.lit(c).alias("column"), _key(text).alias("key"), F.substring(text, seen + 1, SHORT).alias("part")))
    return df.select(F.inline(F.array(*cells)))


def text_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of each different text: ``(column, key, part, count)``; a null is a value, too."""
    return _cells(df, columns).groupBy("column", "key", "part").agg(F.count("*").alias("count"))


def top_texts(df: DataFrame, columns: Sequence[str], top: int, counts: DataFrame | None = None) -> DataFrame:
    """The most frequent texts of each column, the smaller one first on a tie: ``(column, value, count)``."""
    if not columns:
        return df.sparkSession.createDataFrame([], _COUNTS)
    if counts is None and len(columns) <= FEW:
        # Each column by itself: one task keeps `top` rows of each task's counts.
        order = [F.desc("count"), "part", "key"]
        best = [text_counts(df, [c]).where("key IS NOT NULL").orderBy(*order).limit(top + 1) for c in columns]
        rows = reduce(DataFrame.unionByName, best).collect()
        rows.sort(key=lambda r: (-r["count"], r["part"].encode(), r["key"].encode()))
    else:
        counts = (text_counts(df, columns) if counts is None else counts).where("key IS NOT NULL")
        order = Window.partitionBy("column").orderBy(F.desc("count"), "part", "key")
        # The rank filter is applied before the shuffle too, so one task sees `top` rows per map task.
        best = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top + 1)
        rows = best.orderBy("column", "place").collect()  # top + 1 short rows a column
    picked: list[tuple[str, str, int]] = []
    for c in columns:
        mine = [r for r in rows if r["column"] == c]
        kept, cut = mine[:top], mine[top:]
        if cut and cut[0]["count"] == kept[-1]["count"] and cut[0]["part"] == kept[-1]["part"]:
            # Texts that begin alike are cut by what follows.
            last = kept[-1]
            kept = [r for r in kept if (r["count"], r["part"]) != (last["count"], last["part"])]
            picked += [(c, k, last["count"]) for k in _tied(df, c, last["part"], last["count"], top - len(kept))]
        picked += [(c, r["key"], r["count"]) for r in kept]
    return _with_texts(df, columns, picked, [r["part"] for r in rows])


def _tied(df: DataFrame, column: str, begin: str, count: int, wanted: int) -> list[str]:
    """Keys of the smallest texts that begin so and have so many rows, by more and more of their characters."""
    found: list[str] = []
    while True:
        alike = df.where(F.startswith(col(column).cast("string"), F.lit(begin)))
        parts = _cells(alike, [column], len(begin)).groupBy("key", "part").agg(F.count("*").alias("count")).where(F.col("count") == count)
        rows = parts.orderBy("part", "key").limit(wanted + 1).collect()
        kept, cut = rows[:wanted], rows[wanted:]
        if not cut or cut[0]["part"] != kept[-1]["part"] or len(cut[0]["part"]) < SHORT:
            return found + [r["key"] for r in kept]
        last = kept[-1]["part"]
        sure = [r["key"] for r in kept if r["part"] != last]
        found, wanted, begin = found + sure, wanted - len(sure), begin + last


def _with_texts(df: DataFrame, columns: Sequence[str], picked: list[tuple[str, str, int]], begins: list[str]) -> DataFrame:
    """The picked keys with their texts; only rows whose text begins like a picked one are looked at."""
    session = df.sparkSession
    short = [p for p in picked if len(p[1]) <= SHORT]
    out = session.createDataFrame(short, _COUNTS)
    parts = []
    for c in columns:
        long = {k: n for name, k, n in picked if name == c and len(k) > SHORT}
        if not long:
            continue
        text = col(c).cast("string")
        rows = df.where((F.length(text) > SHORT) & F.substring(text, 1, SHORT).isin(sorted(set(begins)))).select(text.alias("value"))
        rows = rows.withColumn("key", _key(F.col("value"))).where(F.col("key").isin(sorted(long)))
        # As many texts a task as were picked.
        texts = rows.groupBy("key").agg(F.any_value("value").alias("value"))
        count = F.element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in long]), F.array(*[F.lit(n).cast("long") for n in long.values()])), F.col("key"))
        parts.append(texts.select(F.lit(c).alias("column"), "value", count.alias("count")))
    return reduce(DataFrame.unionByName, parts, out)


def kept_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """:func:`text_counts`, written once where several results need it."""
    return checkpointed(text_counts(df, columns))
