"""Which files are new, and which have been processed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.files import base_name, is_supported

FAN_IN = 16  # segments of one size that become one of the next
LEDGER_SCHEMA = (
    "base_name string, file_path string, processed_at timestamp, status string, message string, output_path string"
)


class LedgerError(Exception):
    """A place that holds something else than a ledger."""


def new_files(files: DataFrame, processed: DataFrame, path: str = "path") -> DataFrame:
    """Files of a supported type whose base name is not among the processed ones."""
    known = processed.select("base_name").where("base_name IS NOT NULL").distinct()
    named = files.where(is_supported(F.col(path))).withColumn("base_name", base_name(F.col(path)))
    return named.join(known, "base_name", "left_anti")


def _segments(spark: SparkSession, path: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Numbers (first, last) of the complete segments that make up the ledger, and of all others there.

    A segment is complete once Spark has marked it so; one that a larger complete one covers is superseded.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        return [], []
    if not system.getFileStatus(place).isDirectory():
        raise LedgerError(f"Not a ledger: {path}")
    complete, rest = [], []
    for status in system.listStatus(place):
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            numbers = re.fullmatch(r"results-(\d{12})-(\d{12})", name)
            if numbers is None:
                raise LedgerError(f"Not a ledger: {path} holds {name}")
            done = system.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
            (complete if done else rest).append((int(numbers[1]), int(numbers[2])))
    valid: list[tuple[int, int]] = []
    for low, high in sorted(complete, key=lambda x: (x[0], -x[1])):
        if valid and high <= valid[-1][1]:
            rest.append((low, high))
        else:
            valid.append((low, high))
    return valid, rest


def _segment(path: str, numbers: tuple[int, int]) -> str:
    return f"{path.rstrip('/')}/results-{numbers[0]:012d}-{numbers[1]:012d}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger written so far; empty before the first file.  A ledger that cannot be read is an error."""
    segments, _ = _segments(spark, path)
    if not segments:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(*[_segment(path, s) for s in segments])


def append_results(spark: SparkSession, path: str, results: list[dict]) -> DataFrame:
    """Adds one row per handled file; only successes keep a file from being picked up again.

    Each call writes a segment of its own, which counts once it is complete, so a call cut short leaves the ledger as it
    was.  ``FAN_IN`` segments of one size are merged into the next size, so their number grows with the
    logarithm of the calls.  What a merge has replaced goes with the next call, when its readers are done.
    One writer at a time.
    """
    rows = [(r["file_path"], r["status"], r.get("message"), r.get("output_path")) for r in results]
    df = spark.createDataFrame(rows, "file_path string, status string, message string, output_path string")
    out = df.select(
        base_name(F.col("file_path")).alias("base_name"),
        "file_path",
        F.current_timestamp().alias("processed_at"),
        "status",
        "message",
        "output_path",
    )
    segments, rest = _segments(spark, path)
    jvm = spark.sparkContext._jvm
    for old in rest:
        place = jvm.org.apache.hadoop.fs.Path(_segment(path, old))
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    number = segments[-1][1] + 1 if segments else 0
    out.coalesce(1).write.parquet(_segment(path, (number, number)))
    segments.append((number, number))
    while len(tail := segments[-FAN_IN:]) == FAN_IN and len({high - low for low, high in tail}) == 1:
        merged = (tail[0][0], tail[-1][1])
        parts = spark.read.schema(LEDGER_SCHEMA).parquet(*[_segment(path, s) for s in tail])
        files = max(1, (merged[1] - merged[0] + 1) // FAN_IN**3)
        parts.coalesce(files).write.parquet(_segment(path, merged))
        segments[-FAN_IN:] = [merged]
    return out


def batch_summary(results: DataFrame) -> DataFrame:
    """Files handled, successes and failures."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "success").alias("successes"),
        F.count_if(F.col("status") == "error").alias("failures"),
    )


def file_results(results: DataFrame) -> DataFrame:
    """One line per file: name, status and details."""
    return results.select(
        F.regexp_extract("file_path", r"([^/]*)/*$", 1).alias("file"),
        "status",
        F.coalesce("message", F.when(F.col("status") == "success", "Processed successfully")).alias("details"),
    )
