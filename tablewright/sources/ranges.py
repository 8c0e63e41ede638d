"""Records that span lines, read from byte ranges in parallel.

A range of a file does not show whether it begins inside a quoted cell or a nested record.  Its own
text shows what it does to either state, though: one pass gives that for each range, putting these together in
order gives the state that each range begins in, and a second pass cuts the records.  What is left open
at the end of a range is joined to what the next ones begin with; all else stays where it was read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import stored

State = tuple[int, int]  # inside a quoted text or not, depth of nesting


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Texts between separators with their file, the start of their byte range, and their order."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )


def _rows(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], schema.field(n).type) for n in schema.names], schema=schema)


_STATE = "file string, block long, inside int, depth int"
_EFFECT = "file string, block long, inside0 int, depth0 int, inside1 int, depth1 int"
_EFFECT_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64())] + [(n, pa.int32()) for n in ("inside0", "depth0", "inside1", "depth1")])
_STATE_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("inside", pa.int32()), ("depth", pa.int32())])
_RECORD = "file string, block long, place int, first boolean, text string"
_RECORD_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int32()), ("first", pa.bool_()), ("text", pa.string())])
_LEAD, _WHOLE, _TRAIL = range(3)


def begin_states(rows: DataFrame, step: Callable[[str, State], State]) -> DataFrame:
    """The state in which each byte range begins."""

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of a range follow each other in one task.
        at, ends = None, ()
        for batch in batches:
            done: list[tuple] = []
            for file, block, value in zip(*[batch.column(n).to_pylist() for n in ("file", "block", "value")]):
                if (file, block) != at:
                    if at is not None:
                        done.append((*at, *ends[0], *ends[1]))
                    at, ends = (file, block), ((0, 0), (1, 0))
                ends = (step(value, ends[0]), step(value, ends[1]))
            if done:
                yield _rows(dict(zip(_EFFECT_ARROW.names, map(list, zip(*done)))), _EFFECT_ARROW)
        if at is not None:
            yield _rows(dict(zip(_EFFECT_ARROW.names, [[v] for v in (*at, *ends[0], *ends[1])])), _EFFECT_ARROW)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state = None, (0, 0)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in _STATE_ARROW.names}
            for row in batch.to_pylist():
                if row["file"] != file:
                    file, state = row["file"], (0, 0)
                for n, v in zip(_STATE_ARROW.names, (file, row["block"], *state)):
                    out[n].append(v)
                state = (row[f"inside{state[0]}"], state[1] + row[f"depth{state[0]}"])
            yield _rows(out, _STATE_ARROW)

    # One row per range from here on.
    each = rows.mapInArrow(effects, _EFFECT)
    return each.repartition("file").sortWithinPartitions("file", "block").mapInArrow(follow, _STATE)


class Cutter:
    """How one kind of file is cut: ``step`` moves the state over a piece, ``is_open`` says that a record goes on."""

    separator = "\n"

    def step(self, piece: str, state: State) -> State:
        raise NotImplementedError

    def is_open(self, state: State) -> bool:
        raise NotImplementedError

    def cut(self, text: str, first: bool, state: State) -> str | None:
        """The record in a finished text; ``None`` where there is none."""
        return text

    def closing(self) -> str:
        """What the separator behind a record's last piece adds to it."""
        return ""


class QuotedLines(Cutter):
    """Lines of delimited text; one with an odd number of quotes opens or closes a cell over several lines."""

    def step(self, piece: str, state: State) -> State:
        return (state[0] + piece.count('"')) % 2, 0

    def is_open(self, state: State) -> bool:
        return bool(state[0])

    def cut(self, text: str, first: bool, state: State) -> str | None:
        text = text.removesuffix("\r")
        return text if text else None


class ListedRecords(Cutter):
    """Objects of a top-level JSON list, cut at closing braces by depth and string state."""

    separator = "}"
    _token = re.compile(r'\\.|["{}\[\]]', re.S)

    def _scan(self, piece: str, state: State) -> State:
        inside, depth = state
        for token in self._token.findall(piece):
            if token == '"':
                inside = 1 - inside
            elif not inside and token in "{[":
                depth += 1
            elif not inside and token in "}]":
                depth -= 1
        return inside, depth

    def step(self, piece: str, state: State) -> State:
        inside, depth = self._scan(piece, state)
        return inside, depth - (not inside)

    def is_open(self, state: State) -> bool:
        return bool(state[0]) or state[1] >= 2

    def cut(self, text: str, first: bool, state: State) -> str | None:
        text = text.lstrip("\ufeff \t\r\n")
        if first:
            if not text.startswith("["):
                raise ValueError("JSON file must hold a list of records")
            text = text[1:].lstrip(" \t\r\n")
        if state[1] < 1:  # the piece behind the last record closes the list, and no brace follows it
            if text.rstrip(" \t\r\n") not in ("]", ""):
                raise ValueError("JSON list holds something else than records")
            return None
        text = text.lstrip(", \t\r\n")
        if not text.startswith("{"):
            raise ValueError("JSON list holds something else than records")
        # Line ends can only stand between values, not inside a string.
        return text.replace("\n", " ").replace("\r", " ")

    def closing(self) -> str:
        return "}"


def records(spark: SparkSession, path: str, cutter: Cutter) -> DataFrame:
    """``(file, first, text)``: every record, and whether it is its file's first."""
    rows = pieces(spark, path, cutter.separator)
    # Small: one row per range.  Without a hint Spark decides by its size how it goes to the ranges.
    begins = stored(begin_states(rows, cutter.step))
    rows = rows.join(begins, ["file", "block"]).sortWithinPartitions("file", "block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, held, place, first = None, (0, 0), [], _WHOLE, False
        for batch in batches:
            out: dict[str, list] = {n: [] for n in _RECORD_ARROW.names}

            def give(where: int, text: str) -> None:
                for n, v in zip(_RECORD_ARROW.names, (*at, where, first, text)):
                    out[n].append(v)

            for file, block, value, inside, depth in zip(*[batch.column(n).to_pylist() for n in ("file", "block", "value", "inside", "depth")]):
                if (file, block) != at:
                    if at is not None and held:
                        give(_LEAD if place == _LEAD else _TRAIL, cutter.separator.join(held))
                    at, state, held, first = (file, block), (inside, depth), [], block == 0
                    place = _LEAD if cutter.is_open(state) else _WHOLE
                held.append(value)
                state = cutter.step(value, state)
                if cutter.is_open(state):
                    continue
                text = cutter.separator.join(held) + cutter.closing()
                if place == _LEAD:
                    give(_LEAD, text)  # its beginning is in a range before
                else:
                    record = cutter.cut(text if state[1] >= 1 or not cutter.closing() else text[:-1], first, state)
                    if record is not None:
                        give(_WHOLE, record)
                        first = False
                held, place = [], _WHOLE
            if out["file"]:
                yield _rows(out, _RECORD_ARROW)
        if at is not None and held:
            out = {n: [v] for n, v in zip(_RECORD_ARROW.names, (*at, _LEAD if place == _LEAD else _TRAIL, first, cutter.separator.join(held)))}
            yield _rows(out, _RECORD_ARROW)

    cut = stored(rows.mapInArrow(run, _RECORD))
    # At most two open parts a range; each belongs to the last beginning before it.
    so_far = Window.partitionBy("file").orderBy("block", "place")
    parts = cut.where(F.col("place") != _WHOLE).withColumn("begin", F.max(F.when(F.col("place") == _TRAIL, F.col("block"))).over(so_far))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "place", "text"))), lambda x: x["text"]), cutter.separator)
    joined = parts.groupBy("file", "begin").agg(F.max("first").alias("first"), whole.alias("text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("first", pa.bool_()), ("text", pa.string())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = cutter.cut(row["text"], row["first"], (0, 1))
                if text is not None:
                    out.append({**row, "text": text})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    joined = joined.select("file", "first", "text").mapInArrow(finish, "file string, first boolean, text string")
    return cut.where(F.col("place") == _WHOLE).select("file", "first", "text").unionByName(joined)
