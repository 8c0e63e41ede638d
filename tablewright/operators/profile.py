"""Column listings, missing cells, descriptive statistics and value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    CATEGORICAL,
    DATE,
    NUMERIC,
    as_double,
    categorical_columns,
    col,
    column_class,
    columns_of_class,
    is_missing,
    nan_to_null,
    numeric_columns,
    text_columns,
)
from tablewright.functions.ranks import quantiles
from tablewright.functions.texts import kept_counts, text_counts, top_texts


def _table(df: DataFrame, aggregates: Sequence[Column], entries: Sequence[Column], schema: str) -> DataFrame:
    """One aggregation over the table, its numbers laid out as rows."""
    if not entries:
        return df.sparkSession.createDataFrame([], schema)
    return df.agg(F.count("*").alias("rows"), *aggregates).select(F.inline(F.array(*entries)))


def _column_counts(df: DataFrame) -> DataFrame:
    """Type, class, present and missing cells of every column."""
    fields = df.schema.fields
    present = [F.col(f"n{i}") for i in range(len(fields))]
    return _table(
        df,
        [F.count_if(~is_missing(f)).alias(f"n{i}") for i, f in enumerate(fields)],
        [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(column_class(f.dataType)).alias("class"),
                present[i].alias("present"),
                (F.col("rows") - present[i]).alias("missing"),
                F.try_divide((F.col("rows") - present[i]).cast("double"), F.col("rows").cast("double")).alias("share"),
            )
            for i, f in enumerate(fields)
        ],
        "position int, column string, type string, class string, present long, missing long, share double",
    )


def column_listing(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, class and number of present cells."""
    return _column_counts(df).select("position", "column", "type", "class", "present")


def missing(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Missing cells per column and their share of the rows."""
    out = _column_counts(df).select("column", "missing", "share")
    return out.where("missing > 0") if only_missing else out


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows, rows without any missing cell, and their share."""
    full = ~F.greatest(*[is_missing(f) for f in df.schema.fields], F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.count_if(full).alias("complete_rows")).select(
        "rows",
        "complete_rows",
        F.try_divide(F.col("complete_rows").cast("double"), F.col("rows").cast("double")).alias("share"),
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of numeric columns, one row per column."""
    columns = list(columns if columns is not None else numeric_columns(df))
    aggregates, entries = [], []
    for i, c in enumerate(columns):
        v = as_double(df, c)
        aggregates += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"a{i}"),
            F.stddev_samp(v).alias(f"s{i}"),
            F.min(v).alias(f"l{i}"),
            F.max(v).alias(f"h{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("count"),
                F.col(f"a{i}").alias("mean"),
                F.col(f"s{i}").alias("std"),
                F.col(f"l{i}").alias("min"),
                F.col(f"h{i}").alias("max"),
            )
        )
    basic = _table(
        df, aggregates, entries, "column string, count long, mean double, std double, min double, max double"
    )
    names = ["q25", "q50", "q75"]
    if not columns:
        return basic.select("column", "count", "mean", "std", "min", *[F.lit(None).cast("double").alias(n) for n in names], "max")
    q = quantiles(df, columns, [0.25, 0.5, 0.75], names=names, exact=exact).drop("n")
    # One row per column of the schema: a fixed bound.
    return basic.join(F.broadcast(q), "column", "left").select(
        "column", "count", "mean", "std", "min", *names, "max"
    )


def _text_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per ``(column, value)``; nulls are counted as a value."""
    long = df.select(*[col(c) for c in columns]).unpivot([], [col(c) for c in columns], "column", "value")
    return long.groupBy("column", "value").agg(F.count("*").alias("count"))


def describe_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, distinct values, most frequent value and its count, per text column."""
    columns = list(columns if columns is not None else text_columns(df))
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, count long, unique long, top string, freq long")
    counts = kept_counts(df, columns)
    best = top_texts(df, columns, 1, counts).select("column", F.col("value").alias("top"), F.col("count").alias("freq"))
    totals = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("count"))), F.lit(0)).alias("count"),
        F.count("key").alias("unique"),
    )
    # One row per column of the schema.
    return totals.join(F.broadcast(best), "column", "left")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct values per column, a null counting as one: ``(column, distinct_values)``.

    Counted in long form, so that no task holds all values of a column;
    ``exact=False`` uses a bounded sketch and moves no values at all.
    """
    df = nan_to_null(df)
    columns = list(columns if columns is not None else df.columns)
    schema = "column string, distinct_values long"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    if exact:
        return text_counts(df, columns).groupBy("column").agg(F.count("*").alias("distinct_values"))
    sketches = [
        (F.approx_count_distinct(col(c)) + F.coalesce(F.max(col(c).isNull().cast("long")), F.lit(0))).alias(f"d{i}")
        for i, c in enumerate(columns)
    ]
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(columns)]
    return _table(df, sketches, entries, schema)


def value_counts(df: DataFrame, top: int = 10, below: int = 20, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent values of the text columns with fewer than ``below`` distinct values.

    A null counts as a distinct value but is not listed.  Columns of long or
    unique texts are set aside by a distinct-count sketch before anything is
    shuffled: up to 19 values can never look like more than 25 to the sketch,
    so no column that belongs in the result is lost, and the rest is decided
    by the exact counts.
    """
    columns = list(columns if columns is not None else text_columns(df))
    schema = "column string, value string, count long"
    if columns:
        seen = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
        columns = [c for i, c in enumerate(columns) if seen[f"d{i}"] <= 2 * below]
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    counts = _text_values(df, columns)
    per_column = Window.partitionBy("column")
    # Few values per column are left here, so these windows are small.
    return (
        counts.withColumn("distinct_values", F.count("*").over(per_column))
        .where((F.col("distinct_values") < below) & F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(per_column.orderBy(F.desc("count"), "value")))
        .where(F.col("place") <= top)
        .select("column", "value", "count")
    )


def summary(
    df: DataFrame, path: str | None = None, size_bytes: Column | None = None, with_stats: bool = False
) -> DataFrame:
    """One-row record of a table: shape, missing cells, column lists and, on request, the numeric statistics."""
    total = sum((F.col(f"n{i}") for i in range(len(df.columns))), F.lit(0))
    counts = df.agg(
        F.count("*").alias("rows"), *[F.count_if(is_missing(f)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)]
    )
    cells = F.col("rows") * F.lit(len(df.columns))
    kinds = {k: columns_of_class(df, k) for k in (NUMERIC, CATEGORICAL, DATE)}

    def names(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    lead = []
    if path is not None:
        lead = [
            F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("file_name"),
            F.lit(path).alias("file_path"),
            F.bround((size_bytes if size_bytes is not None else F.lit(None).cast("long")) / 1024, 2).alias(
                "file_size_kb"
            ),
        ]
    stats = []
    if with_stats:
        figures = describe(df)
        # One entry per column of the schema.
        packed = F.sort_array(F.collect_list(F.struct(*figures.columns)))
        stats = [figures.agg(packed).scalar().alias("stats")]
    return counts.select(
        *lead,
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        names(df.columns).alias("column_list"),
        total.cast("long").alias("missing_values"),
        F.bround(F.try_divide(total.cast("double"), cells.cast("double")) * 100, 2).alias("missing_percentage"),
        *[names(v).alias(f"{k}_columns") for k, v in kinds.items()],
        *[F.lit(len(v)).alias(f"n_{k}") for k, v in kinds.items()],
        *stats,
    )


def column_details(df: DataFrame, top: int = 10) -> DataFrame:
    """One row per column: type, missing cells; numbers with range, mean, median and std; texts with top values."""
    numbers = describe(df).select("column", "min", "max", "mean", F.col("q50").alias("median"), "std")
    texts = text_columns(df)
    # All sides hold one row per column of the schema.
    out = _column_counts(df).join(F.broadcast(numbers), "column", "left")
    if texts:
        counts = kept_counts(df, texts)
        best = top_texts(df, texts, top, counts)
        place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
        best = best.withColumn("place", place).groupBy("column")
        best = best.agg(F.sort_array(F.collect_list(F.struct("place", "value", "count"))).alias("top_values"))
        some = F.count_if(F.col("key").isNotNull())
        unique = counts.groupBy("column").agg(F.when(some > 0, some).alias("unique_values"))
        out = out.join(F.broadcast(unique), "column", "left").join(F.broadcast(best), "column", "left")
    else:
        out = out.withColumns(
            {
                "unique_values": F.lit(None).cast("long"),
                "top_values": F.lit(None).cast("array<struct<place:int,value:string,count:bigint>>"),
            }
        )
    return out.select(
        "position",
        "column",
        "type",
        "class",
        "missing",
        (F.col("share") * 100).alias("missing_percentage"),
        "min",
        "max",
        "mean",
        "median",
        "std",
        "unique_values",
        F.transform(
            "top_values", lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count"))
        ).alias("top_values"),
    )


def description_lines(df: DataFrame) -> DataFrame:
    """A readable description of the table as ``(line_no, line)``, to be sorted by ``line_no``.

    Sections in order: shape, column names, types, numeric statistics, missing
    cells, and value counts of the text columns with few values.
    """
    df = nan_to_null(df)
    place = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])[F.col("column")]

    def section(number: int, rows: DataFrame, position: Column, line: Column) -> DataFrame:
        return rows.select(F.lit(number).alias("section"), position.alias("position"), line.alias("line"))

    heads = [(1, 0, f"Columns: {', '.join(df.columns)}"), (2, -1, "Column data types:")]
    heads += [(2, i, f"  - {f.name}: {f.dataType.simpleString()}") for i, f in enumerate(df.schema.fields)]
    heads += [(3, -1, "Numeric column statistics:"), (4, -1, "Missing values by column:")]
    if categorical_columns(df):
        heads.append((5, -1, "Categorical column distributions:"))
    out = df.sparkSession.createDataFrame(heads, "section int, position int, line string")

    shape = F.format_string("DataFrame shape: %d rows, %d columns", "rows", F.lit(len(df.columns)))
    out = out.unionByName(section(0, df.agg(F.count("*").alias("rows")), F.lit(0), shape))

    names = ("mean", "std", "min", "q25", "q50", "q75", "max")
    figures = [
        F.when(F.col(n).isNotNull(), F.format_string(f"{n} %.6f", n)).otherwise(F.lit(f"{n} null")) for n in names
    ]
    lead = F.format_string("  - %s: count %d, ", "column", "count")
    out = out.unionByName(section(3, describe(df), place, F.concat(lead, F.concat_ws(", ", *figures))))

    gap = F.format_string("  - %s: %d missing values (%.2f%%)", "column", "missing", F.col("share") * 100)
    out = out.unionByName(section(4, missing(df, only_missing=True), place, gap))

    if text_columns(df):
        ranked = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "value")))
        items = F.transform(ranked, lambda v: F.format_string("'%s': %d", v["value"], -v["c"]))
        listed = value_counts(df).groupBy("column").agg(F.array_join(items, ", ").alias("items"))
        out = out.unionByName(section(5, listed, place, F.format_string("  - %s: {%s}", "column", "items")))
    # A few lines per column of the schema: small enough for one ordered numbering.
    return out.select(F.row_number().over(Window.orderBy("section", "position")).alias("line_no"), "line")
