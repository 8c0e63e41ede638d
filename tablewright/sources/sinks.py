"""Writers for tables, insight documents and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import is_missing


def processed_path(folder: str, source: str, suffix: str = "processed") -> str:
    """``<folder>/<base>_processed`` for a source path."""
    name = source.rstrip("/").rsplit("/", 1)[-1]
    base = name.rsplit(".", 1)[0] if "." in name[1:] else name
    return f"{folder.rstrip('/')}/{base}_{suffix}"


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """A folder of Parquet, CSV (with header) or JSON files, written in parallel."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        # As the reader here and others take it: quotes doubled, blanks and empty texts as they are.
        writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_table(df: DataFrame, table: str, mode: str = "append") -> None:
    """Catalog table, made if absent; ``replace`` puts the new content in place of the old."""
    if mode not in ("append", "replace"):
        raise ValueError(f"Unknown write mode: {mode}")
    df.write.mode("overwrite" if mode == "replace" else "append").saveAsTable(table)


def insights_document(df: DataFrame, file_name: str, insights: Column, use_cases: Column) -> DataFrame:
    """One row: file name, insights map, use cases and a summary of the table."""
    missing = F.struct(*[F.count_if(is_missing(f)).alias(f.name) for f in df.schema.fields])
    summary = F.struct(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        missing.alias("missing_values"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("generation_time"),
    )
    return df.agg(summary.alias("data_summary")).select(
        F.lit(file_name).alias("file_name"), insights.alias("insights"), use_cases.alias("use_cases"), "data_summary"
    )


def forecast_documents(forecast: DataFrame, by: list[str]) -> DataFrame:
    """One nested row per series: model, forecast values and intervals in step order.

    Bounded by the number of periods.  ``documents.write_forecasts`` writes files with the whole history, too.
    """
    point = F.struct("step", "ts", "value", "lower", "upper")
    rows = forecast.groupBy(*by, "model", "frequency", "window_size", "error").agg(
        F.sort_array(F.collect_list(F.when(F.col("step").isNotNull(), point))).alias("points")
    )
    return rows.select(
        *by,
        "model",
        F.struct("frequency", "window_size").alias("model_params"),
        F.struct(F.col("points.ts").cast("array<string>").alias("dates"), F.col("points.value").alias("values")).alias(
            "forecast"
        ),
        F.struct(F.col("points.lower").alias("lower"), F.col("points.upper").alias("upper")).alias(
            "confidence_intervals"
        ),
        "error",
    )
