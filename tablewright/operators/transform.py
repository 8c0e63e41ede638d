"""Column transforms: normalise, scale, clean text, clip, one-hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double, check_columns, col, one_row
from tablewright.functions.ranks import quantiles


def normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min-max scaling to [0, 1]; a constant column becomes 0, missing cells stay null."""
    check_columns(df, columns)
    stats = one_row(
        df,
        {
            k: v
            for i, c in enumerate(columns)
            for k, v in ((f"lo{i}", F.min(as_double(df, c))), (f"hi{i}", F.max(as_double(df, c))))
        },
    )
    out = {}
    for i, c in enumerate(columns):
        v, lo, hi = as_double(df, c), stats.getField(f"lo{i}"), stats.getField(f"hi{i}")
        out[c] = F.when(v.isNotNull(), F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0)))
    return df.withColumns(out)


def scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Z-score with the sample standard deviation; a constant column becomes 0."""
    check_columns(df, columns)
    stats = one_row(
        df,
        {
            k: v
            for i, c in enumerate(columns)
            for k, v in ((f"mean{i}", F.avg(as_double(df, c))), (f"std{i}", F.stddev_samp(as_double(df, c))))
        },
    )
    out = {}
    for i, c in enumerate(columns):
        v = as_double(df, c)
        z = F.try_divide(v - stats.getField(f"mean{i}"), stats.getField(f"std{i}"))
        out[c] = F.when(v.isNotNull(), F.coalesce(z, F.lit(0.0)))
    return df.withColumns(out)


def clean_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trims, turns runs of whitespace into one blank, and makes an empty text null."""
    check_columns(df, columns)
    return df.withColumns(
        {c: F.nullif(F.trim(F.regexp_replace(col(c), r"\s+", " ")), F.lit("")) for c in columns}
    )


def clip_outliers(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Clips to ``[Q1 - reach * IQR, Q3 + reach * IQR]`` with exact quartiles."""
    check_columns(df, columns)
    q = quantiles(df, columns, [0.25, 0.75], names=["q1", "q3"])
    width = F.col("q3") - F.col("q1")
    picks = {}
    for i, c in enumerate(columns):
        picks[f"lo{i}"] = F.max(F.when(F.col("column") == c, F.col("q1") - width * reach))
        picks[f"hi{i}"] = F.max(F.when(F.col("column") == c, F.col("q3") + width * reach))
    stats = one_row(q, picks)
    out = {}
    for i, c in enumerate(columns):
        v = as_double(df, c)
        clipped = F.greatest(F.least(v, stats.getField(f"hi{i}")), stats.getField(f"lo{i}"))
        out[c] = F.when(v.isNotNull(), clipped)
    return df.withColumns(out)


def one_hot(df: DataFrame, column: str, values: Sequence[str] | None = None, max_values: int = 1000) -> DataFrame:
    """Replaces a column by 0/1 columns ``<column>_<value>``, in value order.

    Without ``values`` the distinct values are looked up; more than
    ``max_values`` of them is an error, as the table would get too wide.
    """
    check_columns(df, [column])
    if values is None:
        found = df.select(col(column).cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(max_values + 1)
        values = sorted(r["v"] for r in found.collect())
        if len(values) > max_values:
            raise ValueError(f"Column {column} has more than {max_values} distinct values")
    kept = [col(c) for c in df.columns if c != column]
    text = col(column).cast("string")
    return df.select(
        *kept, *[F.coalesce((text == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values]
    )
