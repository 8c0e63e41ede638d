"""Column classes, missing values and other per-column expressions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, CATEGORICAL, DATE, BOOLEAN, OTHER = "numeric", "categorical", "date", "boolean", "other"


def col(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def column_class(data_type: T.DataType) -> str:
    """Class of a type: decimals are numeric, booleans are a class of their own."""
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType, T.ArrayType, T.StructType, T.MapType)):
        return CATEGORICAL
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    return OTHER


def columns_of_class(df: DataFrame, *classes: str) -> list[str]:
    return [f.name for f in df.schema.fields if column_class(f.dataType) in classes]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_class(df, NUMERIC)


def categorical_columns(df: DataFrame) -> list[str]:
    return columns_of_class(df, CATEGORICAL)


def date_columns(df: DataFrame) -> list[str]:
    return columns_of_class(df, DATE)


def text_columns(df: DataFrame) -> list[str]:
    """Categorical columns holding plain strings (no nested types)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]


def _is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def is_missing(field: T.StructField) -> Column:
    """True where the cell is null, or NaN in a floating column."""
    c = col(field.name)
    return (c.isNull() | F.isnan(c)) if _is_floating(field.dataType) else c.isNull()


def present(field: T.StructField) -> Column:
    """The cell, with NaN turned into null."""
    c = col(field.name)
    return F.when(~F.isnan(c), c) if _is_floating(field.dataType) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value here, so it becomes null before any operator sees it."""
    if not any(_is_floating(f.dataType) for f in df.schema.fields):
        return df
    return df.select(*[present(f).alias(f.name) for f in df.schema.fields])


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric column as double, NaN as null."""
    value = present(df.schema[name]).cast("double")
    return value


def check_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")


def melt(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form ``(by…, column, value double)`` of numeric columns without missing cells."""
    wide = df.select(*[col(b) for b in by], *[as_double(df, c).alias(c) for c in columns])
    return wide.unpivot([col(b) for b in by], [col(c) for c in columns], "column", "value").where(
        F.col("value").isNotNull()
    )


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are present; null when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))


def one_row(df: DataFrame, stats: dict[str, Column]) -> Column:
    """All statistics of one aggregate as a struct-valued scalar subquery.

    The subquery yields one row by construction, so joining it back needs
    neither a join nor a driver round trip.
    """
    return df.agg(F.struct(*[c.alias(n) for n, c in stats.items()]).alias("stats")).scalar()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where the setting is absent (a local test session) a fresh local
    folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        import tempfile

        folder = tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared folder as Parquet and read again: later scans read only the columns they use."""
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        return checkpointed(df)  # a column without a type has no place in a file
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to the shared checkpoint folder, so later stages read it and never recompute it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
