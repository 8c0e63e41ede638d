"""One JSON document per series with its whole history and its forecast, written by a data source with commit.

Rows arrive sorted by series and by their place in the document, so a document of any length is written with one row in
memory.  Each task writes to files of its own names; only the commit of the whole job gives them their
final ones, so a lost task or a failed job leaves no half document.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tablewright.functions.columns import col
from tablewright.operators.forecast import series

#: Lists of a document in their order: key of the object, name of the list in it (fixed by readers of such documents).
LISTS = [
    ("original_data", "dates"), ("original_data", "values"), ("forecast", "dates"), ("forecast", "values"),
    ("confidence_intervals", "lower"), ("confidence_intervals", "upper"),
]


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, folder = fs.FileSystem.from_uri(self.folder)
        system.create_dir(folder, recursive=True)
        files, out, at, name = [], None, -1, None
        for row in iterator:
            if row["document"] != name:
                if out is not None:
                    self._close(out, at)
                name, at = row["document"], -1
                temporary = f"{folder}/_{self.job}-{uuid.uuid4().hex}"
                files.append((temporary, f"{folder}/{name}.json"))
                out = system.open_output_stream(temporary)
                out.write(row["head"][:-1].encode())  # goes on behind its last value
                continue
            if row["list"] != at:
                self._lists(out, at, row["list"])
                at = row["list"]
            else:
                out.write(b", ")
            out.write(row["item"].encode())
        if out is not None:
            self._close(out, at)
        return _Written(files)

    @staticmethod
    def _lists(out, at: int, to: int) -> None:
        """Ends the list that is open and opens those up to ``to``, empty ones included."""
        for i in range(at, to):
            if i >= 0:
                out.write(b"]")
                if LISTS[i][0] != LISTS[i + 1][0]:
                    out.write(b"}")
            group, name = LISTS[i + 1]
            out.write(b", ")
            if i < 0 or LISTS[i][0] != group:
                out.write(f"{json.dumps(group)}: {{".encode())
            out.write(f"{json.dumps(name)}: [".encode())

    def _close(self, out, at: int) -> None:
        self._lists(out, at, len(LISTS) - 1)
        out.write(b"]}}\n")
        out.close()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.folder)
        for message in messages:
            for temporary, final in message.files if message else ():
                system.move(temporary, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.folder)
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith(f"_{self.job}-"):
                system.delete_file(info.path)


class ForecastDocuments(DataSource):
    """``df.write.format("forecast_documents")`` of sorted document rows; used by :func:`write_forecasts`."""

    @classmethod
    def name(cls) -> str:
        return "forecast_documents"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def _items(df: DataFrame, ts: str, value: str, forecast: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by…, list, _order, item)``: every item of every list as JSON text."""
    keys = [col(b) for b in by]

    def number(name: str) -> Column:
        c = F.col(name)
        odd = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(odd, F.lit("null")).otherwise(c.cast("string"))

    def items(*texts: Column, first: int) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(first + i).alias("list"), t.alias("item")) for i, t in enumerate(texts)]))

    date = F.concat(F.lit('"'), F.col("ts").cast("string"), F.lit('"'))
    order = F.struct(F.col("ts").alias("ts"), F.col("step").cast("long").alias("step"), F.col("value").alias("value")).alias("_order")
    past = series(df, ts, value, by).withColumn("step", F.lit(0)).select(*keys, order, "ts", "value")
    ahead = forecast.where("step IS NOT NULL").select(*keys, order, "ts", "value", "lower", "upper")
    old = past.select(*keys, "_order", items(date, number("value"), first=0))
    new = ahead.select(*keys, "_order", items(date, number("value"), number("lower"), number("upper"), first=2))
    return old.unionByName(new)


def _heads(forecast: DataFrame, value: str, periods: Column, by: Sequence[str]) -> DataFrame:
    """``(by…, head)``: the single values of each document as a JSON object."""
    single = {n: F.any_value(n, True) for n in ("model", "frequency", "window_size", "p", "d", "q", "aic", "bic", "error") if n in forecast.columns}
    params = F.struct(*[c.alias(n) for n, c in single.items() if n in ("frequency", "window_size", "p", "d", "q")])
    metrics = F.struct(*[single[n].alias(n) for n in ("aic", "bic") if n in single] or [F.lit(None).cast("double").alias("aic")])
    entries = [*[col(b).alias(b) for b in by], single["model"].alias("model"), F.lit(value).alias("target_column"), periods.alias("periods")]
    head = F.struct(*entries, params.alias("model_params"), metrics.alias("performance_metrics"), single["error"].alias("error"))
    return forecast.groupBy(*[col(b) for b in by]).agg(F.to_json(head).alias("head"))


def write_forecasts(df: DataFrame, ts: str, value: str, forecast: DataFrame, folder: str, by: Sequence[str] = ()) -> str:
    """Writes ``<folder>/<series>.json`` for each series: its head, history, forecast and intervals.

    ``folder`` is a path or URI that every executor can write to.  Present documents of the same series are replaced.
    """
    session = df.sparkSession
    session.dataSource.register(ForecastDocuments)
    name = F.concat_ws("_", *[F.coalesce(col(b).cast("string"), F.lit("null")) for b in by]) if by else F.lit("forecast")
    # A key that is no plain file name is told by a digest; an empty one, too.
    plain = F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "-"), 1, 80)
    fits = (plain == name) & name.rlike("^[A-Za-z0-9]")
    document = F.when(fits, plain).otherwise(F.concat(F.lit("x"), plain, F.lit("-"), F.substring(F.sha2(F.to_json(F.array(*[col(b).cast("string") for b in by])), 256), 1, 16)) if by else plain)
    items = _items(df, ts, value, forecast, by).select(document.alias("document"), F.lit(None).cast("string").alias("head"), "list", "_order", "item")
    # The head goes to a document's file once, with a row of its own before all others.
    heads = _heads(forecast, value, F.count("step"), by)
    heads = heads.select(document.alias("document"), "head", F.lit(-1).alias("list"), F.lit(None).cast(items.schema["_order"].dataType).alias("_order"), F.lit("").alias("item"))
    rows = heads.unionByName(items).repartition("document").sortWithinPartitions("document", "list", "_order")
    target = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows.drop("_order").write.format("forecast_documents").mode("append").option("path", target).save()
    return folder
