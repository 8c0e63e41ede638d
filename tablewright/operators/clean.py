"""Missing values and duplicate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import (
    as_double,
    col,
    is_missing,
    nan_to_null,
    numeric_columns,
    one_row,
    text_columns,
)
from tablewright.functions.ranks import quantiles
from tablewright.functions.texts import top_texts

UNKNOWN = "Unknown"


def incomplete_columns(df: DataFrame) -> list[str]:
    """Columns with at least one missing cell, found in one pass without a shuffle of rows."""
    row = df.agg(*[F.max(is_missing(f)).alias(f"m{i}") for i, f in enumerate(df.schema.fields)]).first()
    return [f.name for i, f in enumerate(df.schema.fields) if row[f"m{i}"]]


def column_modes(df: DataFrame) -> DataFrame:
    """Most frequent value of every column, the smallest one on a tie: one row, one column each.

    Columns of one type are counted together in long form, so that counting is
    spread by (column, value) and no task holds all values of a column.  Texts are counted by digest.
    """
    df = nan_to_null(df)
    by_type: dict[str, list[str]] = {}
    texts = text_columns(df)
    for f in df.schema.fields:
        if f.name in texts:
            continue
        by_type.setdefault(f.dataType.simpleString(), []).append(f.name)
    picked: list[Column] = []
    if texts:
        best = top_texts(df, texts, 1)
        wide = best.agg(F.struct(*[F.max(F.when(F.col("column") == n, F.col("value"))).alias(f"m{i}") for i, n in enumerate(texts)])).scalar()
        picked += [wide.getField(f"m{i}").alias(n) for i, n in enumerate(texts)]
    for names in by_type.values():
        long = df.select(*[col(n) for n in names]).unpivot([], [col(n) for n in names], "column", "value")
        counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("c"))
        best = counts.groupBy("column").agg(F.min(F.struct((-F.col("c")).alias("c"), "value"))["value"].alias("value"))
        wide = best.agg(
            F.struct(*[F.max(F.when(F.col("column") == n, F.col("value"))).alias(f"m{i}") for i, n in enumerate(names)])
        ).scalar()
        picked += [wide.getField(f"m{i}").alias(n) for i, n in enumerate(names)]
    return df.sparkSession.range(1).select(*picked).select(*[col(c) for c in df.columns])


def fill_values(df: DataFrame, strategy: str) -> dict[str, Column]:
    """Replacement per column under a strategy, as scalar subqueries (no rows are moved).

    Medians and modes are worked out only for columns that miss a cell.
    """
    numbers = numeric_columns(df)
    if strategy in ("median", "mode"):
        gaps = set(incomplete_columns(df))
        numbers = [n for n in numbers if n in gaps]
    if strategy == "mean" and numbers:
        stats = one_row(df, {f"v{i}": F.avg(as_double(df, n)) for i, n in enumerate(numbers)})
        return {n: stats.getField(f"v{i}") for i, n in enumerate(numbers)}
    if strategy == "median" and numbers:
        q = quantiles(df, numbers, [0.5], names=["median"])
        stats = one_row(
            q, {f"v{i}": F.max(F.when(F.col("column") == n, F.col("median"))) for i, n in enumerate(numbers)}
        )
        return {n: stats.getField(f"v{i}") for i, n in enumerate(numbers)}
    if strategy == "mode":
        countable = [f.name for f in df.schema.fields if f.name in gaps and not isinstance(f.dataType, T.MapType)]
        if not countable:
            return {}
        modes = column_modes(df.select(*[col(n) for n in countable]))
        stats = one_row(modes, {f"v{i}": F.any_value(col(n)) for i, n in enumerate(countable)})
        return {n: stats.getField(f"v{i}") for i, n in enumerate(countable)}
    if strategy == "zero":
        return {n: F.lit(0).cast(df.schema[n].dataType) for n in numbers}
    return {}


def fill_missing(df: DataFrame, strategy: str | None) -> DataFrame:
    """Fills or drops missing cells.

    ``drop`` removes rows with any missing cell; ``mean`` and ``median`` fill
    numeric columns, which become double; ``mode`` fills every column; ``zero``
    fills numeric columns.  After any strategy, also an unknown one, missing
    strings become ``Unknown``; dates and booleans stay null, and so does a
    column without any value.
    """
    df = nan_to_null(df)
    if not strategy:
        return df
    if strategy == "drop":
        return df.na.drop("any")
    fills = fill_values(df, strategy)
    texts, numbers = set(text_columns(df)), set(numeric_columns(df))
    out = []
    for name in df.columns:
        c = col(name)
        if strategy in ("mean", "median") and name in numbers:
            c = as_double(df, name)
        if name in fills:
            c = F.coalesce(c, fills[name])
        if name in texts:
            c = F.coalesce(c, F.lit(UNKNOWN))
        out.append(c.alias(name))
    return df.select(*out)


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row distinct; nulls are equal to each other.  Copies are merged before the shuffle."""
    if any(isinstance(f.dataType, T.MapType) for f in df.schema.fields):
        # Maps can be grouped by, whatever the order of their entries, but not deduplicated as such.
        columns = [col(c) for c in df.columns]
        return df.groupBy(*columns).agg(F.count("*").alias("_copies")).select(*columns)
    return df.dropDuplicates()


def clean(df: DataFrame, strategy: str | None = "mean", dedupe: bool = True) -> DataFrame:
    """Fill or drop missing cells, then remove duplicate rows."""
    filled = fill_missing(df, strategy)
    return remove_duplicates(filled) if dedupe else filled


def cleaning_report(df: DataFrame, strategy: str | None = "mean", dedupe: bool = True) -> DataFrame:
    """What ``clean`` does: ``(step, column, detail, count)``.

    Steps: ``fill`` per column with missing cells (detail = the fill value),
    ``drop_rows`` and ``remove_duplicates`` for the table.
    """
    df = nan_to_null(df)
    fills = {} if strategy == "drop" or not strategy else fill_values(df, strategy)
    if strategy and strategy != "drop":
        for n in text_columns(df):
            fills[n] = F.coalesce(fills[n], F.lit(UNKNOWN)) if n in fills else F.lit(UNKNOWN)
    missing = [F.count_if(is_missing(f)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)]
    any_missing = F.greatest(*[is_missing(f) for f in df.schema.fields], F.lit(False))
    counts = df.agg(F.count_if(any_missing).alias("incomplete"), *missing)
    entries = [
        F.struct(
            F.lit("fill").alias("step"),
            F.lit(n).alias("column"),
            fills[n].cast("string").alias("detail"),
            F.when(fills[n].isNotNull(), F.col(f"n{i}")).otherwise(F.lit(0)).cast("long").alias("count"),
        )
        for i, n in enumerate(df.columns)
        if n in fills
    ]
    none = F.lit(None).cast("string")
    if strategy == "drop":
        entries.append(
            F.struct(
                F.lit("drop_rows").alias("step"),
                none.alias("column"),
                none.alias("detail"),
                F.col("incomplete").cast("long").alias("count"),
            )
        )
    schema = "step string, column string, detail string, count long"
    if entries:
        report = counts.select(F.inline(F.array(*entries))).where("step <> 'fill' OR count > 0")
    else:
        report = df.sparkSession.createDataFrame([], schema)
    if dedupe:
        filled = fill_missing(df, strategy)
        copies = filled.groupBy(*[col(c) for c in filled.columns]).agg(F.count("*").alias("copies_of_row"))
        removed = copies.agg((F.sum("copies_of_row") - F.count("*")).alias("count"))
        report = report.unionByName(
            removed.select(
                F.lit("remove_duplicates").alias("step"),
                none.alias("column"),
                none.alias("detail"),
                F.coalesce("count", F.lit(0)).cast("long").alias("count"),
            )
        )
    return report
