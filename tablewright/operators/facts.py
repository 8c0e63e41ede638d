"""Grouped facts about a measure, a dimension and a date column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double, check_columns, col, safe_corr
from tablewright.functions.ranks import quantiles


def measure_by(df: DataFrame, measure: str, dimension: str, median: bool = True) -> DataFrame:
    """count, mean, median, min and max of a measure per group; null groups are left out."""
    check_columns(df, [measure, dimension])
    known = df.where(col(dimension).isNotNull())
    v = as_double(df, measure)
    groups = known.groupBy(col(dimension)).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    if not median:
        return groups
    middle = quantiles(known, [measure], [0.5], by=[dimension], names=["median"]).select(col(dimension), "median")
    return groups.join(middle, [dimension], "left").select(
        col(dimension), "count", "mean", "median", "min", "max"
    )


def group_share(df: DataFrame, dimension: str) -> DataFrame:
    """Rows per group and their share of all rows with a group, most frequent first."""
    check_columns(df, [dimension])
    known = df.where(col(dimension).isNotNull())
    total = known.agg(F.count("*").cast("double").alias("total")).scalar()
    return (
        known.groupBy(col(dimension))
        .agg(F.count("*").alias("count"))
        .withColumn("share", F.try_divide(F.col("count").cast("double"), total))
        .orderBy(F.desc("count"), col(dimension))
    )


def group_gap(df: DataFrame, measure: str, dimension: str) -> DataFrame:
    """Groups with the highest and lowest mean, their gap in percent of the lower, and the overall mean."""
    means = measure_by(df, measure, dimension, median=False).where("mean IS NOT NULL").select(
        col(dimension).alias("name"), "mean"
    )
    overall = df.agg(F.avg(as_double(df, measure)).alias("overall")).scalar()
    # Ties between groups go to the smaller name.
    high = F.min(F.struct((-F.col("mean")).alias("key"), "name"))
    low = F.min(F.struct(F.col("mean").alias("key"), F.col("name")))
    ends = means.agg(high.alias("high"), low.alias("low"))
    top, bottom = -F.col("high.key"), F.col("low.key")
    return ends.select(
        F.col("high.name").alias("highest"),
        top.alias("highest_mean"),
        F.col("low.name").alias("lowest"),
        bottom.alias("lowest_mean"),
        (F.try_divide(top - bottom, bottom) * 100).alias("gap_percent"),
        overall.alias("overall_mean"),
    )


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of two measures and the rows it rests on."""
    check_columns(df, [x, y])
    a, b = as_double(df, x), as_double(df, y)
    return df.agg(F.count_if(a.isNotNull() & b.isNotNull()).alias("rows"), safe_corr(a, b).alias("corr"))


def tenure_split(df: DataFrame, measure: str, start: str, as_of: str, years: float = 5) -> DataFrame:
    """Mean of a measure above and up to a tenure, and their difference in percent of the lower tenure's mean."""
    check_columns(df, [measure, start])
    v = as_double(df, measure)
    months = F.months_between(F.lit(as_of).cast("date"), col(start).cast("date"), False)
    long, short = months > years * 12, months <= years * 12
    out = df.agg(
        F.count_if(long & v.isNotNull()).alias("n_above"),
        F.count_if(short & v.isNotNull()).alias("n_up_to"),
        F.avg(F.when(long, v)).alias("mean_above"),
        F.avg(F.when(short, v)).alias("mean_up_to"),
    )
    return out.withColumn(
        "difference_percent", F.try_divide(F.col("mean_above") - F.col("mean_up_to"), F.col("mean_up_to")) * 100
    )


def rows_by_year(df: DataFrame, date: str, dimension: str | None = None) -> DataFrame:
    """Rows per year of a date column, optionally per group and year."""
    check_columns(df, [date] + ([dimension] if dimension else []))
    known = df.where(col(date).isNotNull())
    keys = [F.year(col(date).cast("date")).alias("year")]
    if dimension:
        known = known.where(col(dimension).isNotNull())
        keys.append(col(dimension))
    return known.groupBy(*keys).agg(F.count("*").alias("count"))


def top_per_category(df: DataFrame, category: str, order: Sequence[Column], limit: int = 5) -> DataFrame:
    """At most ``limit`` rows per category.  The rank filter also runs before the shuffle."""
    place = F.row_number().over(Window.partitionBy(col(category)).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= limit)
