"""Structure checks of a loaded table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import is_missing


def validate(df: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """One row ``(valid, errors)``: empty table, missing required columns, all-null columns.

    An empty table reports only that.  All checks share one aggregation.
    """
    absent = [r for r in required if r not in df.columns]
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(~is_missing(f)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)],
    )
    blank = F.filter(
        F.array(*[F.when(F.col(f"n{i}") == 0, F.lit(name)) for i, name in enumerate(df.columns)]),
        lambda c: c.isNotNull(),
    )
    found = [
        F.lit(f"Missing required columns: {', '.join(absent)}") if absent else F.lit(None).cast("string"),
        F.when(F.size(blank) > 0, F.concat(F.lit("Columns with all null values: "), F.array_join(blank, ", "))),
    ]
    errors = F.when(F.col("rows") == 0, F.array(F.lit("DataFrame is empty"))).otherwise(
        F.filter(F.array(*found), lambda e: e.isNotNull())
    )
    return counts.select(errors.alias("errors")).select((F.size("errors") == 0).alias("valid"), "errors")
