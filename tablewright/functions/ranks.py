"""Exact order statistics and row numbers without sorting a whole key in one task.

Spark's ``percentile`` holds every distinct value of a group in one buffer and
``row_number() over (partition by key)`` sorts a whole key in one task.  Both
break when one key holds a third of a large table.  Here the value range is cut
into segments at split points taken from a bounded quantile sketch.  Splits
only steer how the work is spread: segment counts are exact, so results do not
depend on how good the sketch was.  A segment is a pure function of the row and
of literals, so a recomputed task gives the same segments as the lost one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import as_double, col

PIECES = 512  # segments a column is cut into; a segment holds about 1/512 of the rows
SUB_PIECES = 4096  # parts of a segment that is cut again
MOST_PIECES = 20000
SPLIT_SHARE = 0.02  # share of the rows looked at for split points
ROWS_PER_TASK = 4_000_000  # rows one task should sort
COUNTED_DIRECTLY = 250_000  # rows up to which counting every value is the quicker way


def _some(df: DataFrame) -> DataFrame:
    return df.sample(False, SPLIT_SHARE, seed=17)


def _sketch(some: DataFrame, names: Sequence[str], pieces: int) -> tuple[list[list[float]], float]:
    """Quantile grid of each named double column over ``_some`` rows, and the estimated number of all rows.

    As in a range partitioning, some of the rows are enough to place the
    splits; every row is counted and ranked afterwards.
    """
    grid = [i / pieces for i in range(1, pieces)]
    row = some.agg(F.count("*"), *[F.percentile_approx(n, grid, 2 * pieces) for n in names]).first()
    return [list(q or []) for q in row[1:]], row[0] / SPLIT_SHARE


def _segment(df: DataFrame, value: str, splits: Sequence[float], name: str) -> DataFrame:
    """Adds the segment number of ``value``; binary search over literal splits, in the JVM."""
    inner = sorted(s for s in set(splits) if abs(s) != float("inf")) or [0.0]
    edges = [float("-inf"), *inner, float("inf")]
    cut = Bucketizer(splits=edges, inputCol=value, outputCol=name).transform(df)
    return cut.withColumn(name, F.col(name).cast("int"))


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    exact: bool = True,
    pieces: int = PIECES,
    rows_per_task: int = ROWS_PER_TASK,
    counted_directly: int = COUNTED_DIRECTLY,
) -> DataFrame:
    """Quantiles (linear interpolation) of numeric columns: ``(by…, column, n, <names>)``.

    A table of at most ``counted_directly`` rows is counted by value.  Beyond
    that there is one pass for the splits, one that counts rows per
    segment (a tiny shuffle), and one that looks only at the segments holding a
    wanted rank; segments that would still be large are counted in finer parts
    first.  Missing cells are skipped.  ``exact=False`` uses the bounded sketch
    of ``percentile_approx``.  The input is read in each pass: checkpoint or
    write one that is costly to make.
    """
    names = list(names or [f"q{round(p * 100):02d}" for p in probs])
    # Columns are told apart by a number, which is cheaper to hash than a name.
    keys = ["_key", "_code"] if by else ["_code"]
    key_cols = [F.col(k) for k in keys]
    groups = [F.col("_key")[b].alias(b) for b in by]
    label = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_code")).alias("column")
    cells = [F.struct(F.lit(i + 1).alias("_code"), as_double(df, c).alias("value")) for i, c in enumerate(columns)]
    # A struct is equal to itself in a join also where a group value in it is null.
    key = [F.struct(*[col(b) for b in by]).alias("_key")] if by else []

    def cells_of(rows: DataFrame) -> DataFrame:
        return rows.select(*key, F.inline(F.array(*cells))).where("value IS NOT NULL")

    long = cells_of(df)
    if not exact:
        picks = F.percentile_approx("value", list(probs), 10000)
        out = long.groupBy(*key_cols).agg(F.count("*").alias("n"), picks.alias("q"))
        return out.select(*groups, label, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])

    def place(p: float) -> Column:
        return (F.col("n") - 1) * F.lit(float(p))

    def low(p: float) -> Column:
        return F.floor(place(p)).cast("long") + 1

    def high(p: float) -> Column:
        return F.least(low(p) + 1, F.col("n"))

    def holds(rank: Column) -> Column:
        return (F.col("before") < rank) & (rank <= F.col("upto"))

    wanted = F.lit(False)
    for p in probs:
        wanted = wanted | holds(low(p)) | holds(high(p))

    def holding(sizes: DataFrame, inside: list[str], part: str) -> DataFrame:
        """The parts that hold a wanted rank, with the rows before them; at most 2 * len(probs) per key.

        ``sizes`` has one row per key and part, so its windows stay small.
        """
        whole = Window.partitionBy(*[col(c) for c in inside])
        so_far = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        total = F.sum("c").over(whole) if part == "seg" else F.col("n")
        start = F.lit(0) if part == "seg" else F.col("start")
        placed = sizes.select(
            *[col(c) for c in inside],
            part,
            "lo",
            "hi",
            (start + F.sum("c").over(so_far)).alias("upto"),
            (start + F.sum("c").over(so_far) - F.col("c")).alias("before"),
            total.alias("n"),
        )
        found = placed.where(wanted).select(
            *[col(c) for c in inside], part, "lo", "hi", F.col("before").alias("start"), "n"
        )
        # Without groups there is a fixed number of such rows per column of the schema.
        return found if by else F.broadcast(found)

    def segmented() -> DataFrame:
        """Rows of the parts that hold a wanted rank, counted by value."""
        most = min(pieces * len(columns), 2 * max(pieces, PIECES))
        (splits,), rows = _sketch(cells_of(_some(df)), ["value"], most)
        cut = _segment(long, "value", splits, "seg")
        range_of = [F.count("*").alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi")]
        counts = cut.groupBy(*key_cols, "seg").agg(*range_of)
        near = cut.join(holding(counts, keys, "seg"), [*keys, "seg"]).withColumn("sub", F.lit(0))
        if rows / most > rows_per_task:
            share = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
            stretch = (F.col("hi") > F.col("lo")) & (F.col("hi") - F.col("lo") < float("inf"))
            sub = F.when(stretch, F.least(F.floor(share * SUB_PIECES), F.lit(SUB_PIECES - 1)).cast("int")).otherwise(0)
            finer = near.withColumn("sub", sub).select(*key_cols, "seg", "sub", "value", "start", "n")
            counts = finer.groupBy(*key_cols, "seg", "sub").agg(
                *range_of, F.max("start").alias("start"), F.max("n").alias("n")
            )
            near = finer.drop("start", "n").join(holding(counts, [*keys, "seg"], "sub"), [*keys, "seg", "sub"])
        return near.groupBy(*key_cols, "seg", "sub", "value").agg(
            F.count("*").alias("c"), F.max("start").alias("start"), F.max("n").alias("n")
        )

    if df.count() <= counted_directly:
        # Few enough rows for one task, whatever the keys: no segments needed.
        part = []
        counted = (
            long.groupBy(*key_cols, "value")
            .agg(F.count("*").alias("c"))
            .withColumn("start", F.lit(0))
            .withColumn("n", F.sum("c").over(Window.partitionBy(*key_cols)))
        )
    else:
        part = ["seg", "sub"]
        counted = segmented()
    in_part = (
        Window.partitionBy(*key_cols, *part).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.withColumn("upto", F.sum("c").over(in_part) + F.col("start")).withColumn(
        "before", F.col("upto") - F.col("c")
    )
    picks = []
    for i, p in enumerate(probs):
        picks += [
            F.max(F.when(holds(low(p)), F.col("value"))).alias(f"lo{i}"),
            F.max(F.when(holds(high(p)), F.col("value"))).alias(f"hi{i}"),
        ]
    found = ranked.groupBy(*key_cols).agg(F.max("n").alias("n"), *picks)
    return found.select(
        *groups,
        label,
        "n",
        *[
            (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (place(p) - F.floor(place(p)))).alias(name)
            for i, (p, name) in enumerate(zip(probs, names))
        ],
    )


def wall_micros(column: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without time zone, whatever the session's zone."""
    seconds = F.hour(column) * 3600 + F.minute(column) * 60
    micros = (F.date_part(F.lit("SECOND"), column) * 1000000).cast("long")
    return (F.unix_date(column.cast("date")).cast("long") * 86400 + seconds) * 1000000 + micros


def sort_number(column: Column, data_type: T.DataType) -> Column:
    """Order-preserving double of a numeric, date or timestamp column."""
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(data_type, T.TimestampNTZType):
        return wall_micros(column).cast("double")
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column).cast("double")
    return column.cast("double")


def index_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    previous: Sequence[str] = (),
    pieces: int = PIECES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Row number ``t`` (from 1) and row count ``n`` of every row within its key.

    ``order`` is one or two columns (number, date or timestamp; no nulls in the
    first, nulls first in the second).  ``previous`` adds ``prev_<name>``: the
    named column of the row before.  In a table of more than ``rows_per_task``
    rows a key is spread over the segments of the first order column; a value
    so frequent that it fills segments of its own is spread further by the
    second column.  Rows are shuffled once.  The input is read three times:
    checkpoint or write one that is costly to make.
    """
    kept = df.columns
    # A struct is equal to itself in a join also where a key value in it is null.
    df = df.withColumn("_key", F.struct(*[col(b) for b in by]) if by else F.struct(F.lit(0).alias("all")))
    key_cols = [F.col("_key")]
    tie = order[1] if len(order) > 1 else None
    ordering = [col(order[0]), *([col(tie).asc_nulls_first()] if tie else [])]
    if df.count() <= rows_per_task:
        whole = Window.partitionBy(*key_cols)
        in_order = whole.orderBy(*ordering)
        return df.select(
            *[col(c) for c in kept],
            F.row_number().over(in_order).cast("long").alias("t"),
            F.count("*").over(whole).alias("n"),
            *[F.lag(col(p)).over(in_order).alias(f"prev_{p}") for p in previous],
        )
    types = {f.name: f.dataType for f in df.schema.fields}
    work = df.withColumn("_x", sort_number(col(order[0]), types[order[0]]))
    if tie:
        y = sort_number(col(tie), types[tie])
        work = work.withColumn("_y", F.coalesce(F.nanvl(y, F.lit(None)), F.lit(float("-inf"))))

    names = ["_x", "_y"] if tie else ["_x"]
    grids, rows_seen = _sketch(_some(work), names, pieces)
    if rows_seen / pieces > rows_per_task:
        grids, _ = _sketch(_some(work), names, min(MOST_PIECES, int(rows_seen / rows_per_task)))
    frequent = sorted({a for a, b in zip(grids[0], grids[0][1:]) if a == b}) if tie else []
    # A frequent value v gets the segment [v, next double) for itself.
    after = [_next_double(v) for v in frequent]
    work = _segment(work, "_x", [*grids[0], *after], "_seg")
    if frequent:
        work = _segment(work, "_y", grids[1], "_sub")
        work = work.withColumn("_sub", F.when(F.col("_x").isin(frequent), F.col("_sub")).otherwise(0))
    else:
        work = work.withColumn("_sub", F.lit(0))

    segment = ["_seg", "_sub"]
    stats = [F.count("*").alias("c")]
    if list(previous) == [order[0]]:
        stats.append(F.max(col(order[0])).alias("_last_0"))
    elif previous:
        last = F.max(F.struct(F.col("_x"), *([F.col("_y")] if tie else []), *[col(p) for p in previous]))
        stats += [last[p].alias(f"_last_{i}") for i, p in enumerate(previous)]
    per_key = Window.partitionBy(*key_cols)
    by_segment = per_key.orderBy(*segment)
    so_far = by_segment.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At most one row per key and segment, so these windows stay small.
    offsets = (
        work.groupBy(*key_cols, *segment)
        .agg(*stats)
        .select(
            *key_cols,
            *segment,
            (F.sum("c").over(so_far) - F.col("c")).alias("_before"),
            F.sum("c").over(per_key).alias("n"),
            *[F.lag(f"_last_{i}").over(by_segment).alias(f"_carry_{i}") for i in range(len(previous))],
        )
    )
    inside = Window.partitionBy(*key_cols, *segment).orderBy(*ordering)
    first = F.col("_rn") == 1
    rows = work.withColumn("_rn", F.row_number().over(inside))
    for i, p in enumerate(previous):
        rows = rows.withColumn(f"_lag_{i}", F.lag(col(p)).over(inside))
    joined = rows.join(offsets, ["_key", *segment])
    return joined.select(
        *[col(c) for c in kept],
        (F.col("_before") + F.col("_rn")).alias("t"),
        "n",
        *[
            F.when(first, F.col(f"_carry_{i}")).otherwise(F.col(f"_lag_{i}")).alias(f"prev_{p}")
            for i, p in enumerate(previous)
        ],
    )


def _next_double(v: float) -> float:
    import math

    return math.nextafter(v, math.inf)


def in_blocks(df: DataFrame, lags: int, block_rows: int = 65536) -> DataFrame:
    """Cuts numbered rows (column ``t``) into blocks of bounded size.

    Adds ``block`` and ``own``; the last ``lags`` rows of a block are repeated
    at the head of the next one with ``own = false``, so that a task holding
    one block sees all the earlier rows it needs.
    """
    zero = F.col("t") - 1
    block = F.floor(zero / F.lit(block_rows)).cast("long")
    at_end = (zero % block_rows) >= F.lit(block_rows - lags)
    last = F.floor((F.col("n") - 1) / F.lit(block_rows)).cast("long")
    homes = F.when(at_end & (block < last), F.array(block, block + 1)).otherwise(F.array(block))
    return (
        df.withColumn("_home", block).withColumn("block", F.explode(homes)).withColumn("own", F.col("block") == F.col("_home")).drop("_home")
    )
