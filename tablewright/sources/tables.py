"""Catalog tables, pass-through SQL and JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load_table(spark: SparkSession, name: str, limit: int | None = None) -> DataFrame:
    """All columns of a table, the first ``limit`` rows only if a limit is given."""
    df = spark.table(name)
    return df if limit is None else df.limit(limit)


def query(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """A SELECT over catalog tables and the given DataFrames (``{name}`` in the text)."""
    return spark.sql(sql, **views)


def execute(spark: SparkSession, statement: str) -> DataFrame:
    """DDL or DML; the result is empty where the statement returns no rows."""
    return spark.sql(statement)


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    sql: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """Warehouse table or query over JDBC; filters, limits and column pruning are pushed down.

    A partition column with bounds makes the read parallel; without one JDBC
    reads through a single task.
    """
    if (table is None) == (sql is None):
        raise ValueError("Give either a table or a query")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
        )
        return reader.option("dbtable", table or f"({sql}) q").load()
    return (reader.option("dbtable", table) if table else reader.option("query", sql)).load()
