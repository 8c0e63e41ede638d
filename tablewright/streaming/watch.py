"""Files handled as they arrive, and scheduled batches over new files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.sources.files import is_loadable, is_supported, list_files
from tablewright.streaming.ledger import append_results, new_files, read_ledger

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
POLL_SECONDS = 5  # pause between looks at the folder


def file_stream(spark: SparkSession, folder: str, glob: str = "*.*", files_per_batch: int = 1000) -> DataFrame:
    """Stream of the files of a folder (path, modificationTime, length); contents are not read.

    Files of any age are taken; the source remembers every path for that.
    """
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", "36500d")
        .load(folder)
        .select("path", "modificationTime", "length")
    )


def _present(spark: SparkSession, folder: str, glob: str, state: str, start: dt.datetime | None) -> DataFrame:
    """Paths that were there when the watch was first started, remembered beside the stream's checkpoint."""
    place = f"{state}/present"
    try:
        return spark.read.parquet(place)
    except AnalysisException as error:
        # A folder without a schema is what a first start leaves that was lost while it wrote.
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        there = list_files(spark, folder, glob)
        if start is not None:
            there = there.where(F.col("modificationTime") <= F.lit(start))
        there.select("path").write.mode("overwrite").parquet(place)
        return spark.read.parquet(place)


def _handle(path: str, on_file: Callable[[str], dict | None]) -> dict:
    try:
        return {"file_path": path, "status": "success", **(on_file(path) or {})}
    except Exception as e:  # a failing file is reported and must not stop the others
        return {"file_path": path, "status": "error", "message": str(e)}


def _handle_all(paths: Iterable[str], on_file: Callable, parallel: int, chunk: int = 256) -> Iterator[list[dict]]:
    """Results in chunks; ``parallel`` files are worked on at a time, each by Spark jobs of its own."""
    source = iter(paths)
    with ThreadPoolExecutor(parallel) as pool:
        while batch := list(islice(source, chunk)):
            yield list(pool.map(lambda p: _handle(p, on_file), batch))


def watch(
    spark: SparkSession,
    folder: str,
    state: str,
    on_file: Callable[[str], dict | None],
    glob: str = "*.*",
    start: dt.datetime | None = None,
    poll_seconds: int | None = POLL_SECONDS,
    files_per_batch: int = 1000,
    parallel: int = 4,
) -> StreamingQuery:
    """Calls ``on_file(path)`` once for each supported file that arrives after the first start.

    Files are told apart by path: those there at the first start are left out, all
    others are new, whatever their times.  With ``start``, only files there whose time is
    not after it are left out.  ``state`` is a folder on shared storage: it holds the
    stream's checkpoint, the paths left out and the ledger, so a restart goes on where it was.  A
    failing file gets an error row and is not tried again.  With
    ``poll_seconds=None`` everything present is handled and the query ends.
    """
    present = _present(spark, folder, glob, state, start)
    ledger = f"{state}/ledger"
    arrived = file_stream(spark, folder, glob, files_per_batch).where(is_supported(F.col("path")))

    def handle(batch: DataFrame, _: int) -> None:
        # A batch that is run again after a failure skips what the ledger already has.
        done = read_ledger(spark, ledger).select(F.col("file_path").alias("path")).distinct()
        todo = batch.select("path").distinct().join(present, "path", "left_anti").join(done, "path", "left_anti")
        # Bounded by files_per_batch.
        for results in _handle_all((r["path"] for r in todo.toLocalIterator()), on_file, parallel):
            append_results(spark, ledger, results)

    writer = arrived.writeStream.foreachBatch(handle).option("checkpointLocation", f"{state}/checkpoint")
    if poll_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{poll_seconds} seconds").start()


def run_batch(
    spark: SparkSession, folder: str, ledger: str, on_file: Callable[[str], dict | None], glob: str = "*.*", parallel: int = 4
) -> DataFrame:
    """Handles every new file of a folder once; a failure does not stop the others and is tried again next time.

    Returns this run's ledger rows.
    """
    begin = dt.datetime.now(dt.timezone.utc)
    past = read_ledger(spark, ledger)
    todo = new_files(list_files(spark, folder, glob), past.where("status = 'success'")).select("path")
    # A file of a type that is known but not decoded gets one error row, as another try would end alike.
    undecoded = ~is_loadable(F.col("path"))
    tried = past.select(F.col("file_path").alias("path")).distinct()
    todo = todo.where(~undecoded).unionByName(todo.where(undecoded).join(tried, "path", "left_anti"))
    for results in _handle_all((r["path"] for r in todo.toLocalIterator()), on_file, parallel):
        append_results(spark, ledger, results)
    return read_ledger(spark, ledger).where(F.col("processed_at") >= F.lit(begin))
