"""The tables behind distribution charts: histograms, densities, boxes, correlations, top values."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double, col, melt, numeric_columns, text_columns
from tablewright.functions.ranks import quantiles
from tablewright.functions.texts import top_texts

CHART_COLUMNS = 5  # numeric columns charted by default
CHART_CATEGORIES = 2  # text columns charted by default
GRID_POINTS = 200  # points of a density curve


def _charted(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else numeric_columns(df)[:CHART_COLUMNS]


def _stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, std, min, max per column as rows, from one aggregation."""
    aggregates, entries = [], []
    for i, c in enumerate(columns):
        v = as_double(df, c)
        aggregates += [
            F.count(v).alias(f"n{i}"),
            F.stddev_samp(v).alias(f"s{i}"),
            F.min(v).alias(f"l{i}"),
            F.max(v).alias(f"h{i}"),
        ]
        integral = df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long", "tinyint", "smallint", "bigint")
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(integral).alias("integral"),
                F.col(f"n{i}").alias("n"),
                F.col(f"s{i}").alias("std"),
                F.col(f"l{i}").alias("lo"),
                F.col(f"h{i}").alias("hi"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*entries))).where("n > 0")


def _whole_numbers(count: Column) -> Column:
    """Numbers ``0 … count-1`` in blocks, so that no single array gets long."""
    return F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / 65536).cast("long"))


def bin_rule(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bins per column: ``(column, n, lo, hi, bins)``.

    The width is the smaller of 2·IQR / n^(1/3) and range / (log2 n + 1), the
    first one raised to range / (2·√n) so that a few far values cannot cause
    bins without end; integer columns get a width of at least 1.
    """
    q = quantiles(df, columns, [0.25, 0.75], names=["q1", "q3"]).drop("n")
    # One row per column of the schema on both sides.
    stats = _stats(df, columns).join(F.broadcast(q), "column")
    span = F.col("hi") - F.col("lo")
    n = F.col("n").cast("double")
    sturges = span / (F.log2(n) + 1)
    spread = 2 * (F.col("q3") - F.col("q1")) / F.pow(n, F.lit(1.0 / 3))
    width = F.least(F.greatest(spread, span / F.sqrt(n) / 2), sturges)
    width = F.when(F.col("integral"), F.greatest(width, F.lit(1.0))).otherwise(width)
    bins = F.greatest(F.coalesce(F.ceil(F.try_divide(span, width)).cast("long"), F.lit(1)), F.lit(1))
    # A constant column is shown as one bin of width 1 around its value.
    flat = F.col("hi") == F.col("lo")
    return stats.select(
        "column",
        "n",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        bins.alias("bins"),
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def histogram(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Histogram rows ``(column, bin, low, high, count)``, empty bins included, last bin closed."""
    columns = _charted(df, columns)
    found = bin_rule(df, columns)
    rules = found.collect()  # one row per column of the schema
    if not rules:
        return df.sparkSession.createDataFrame([], "column string, bin long, low double, high double, count long")
    rule = F.broadcast(df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rules)], f"code int, {_ddl(found)}"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    # The rule is written into the expressions, so rows are binned where they are read and counted by two numbers.
    places = []
    for i, r in enumerate(rules):
        v, step = as_double(df, r["column"]), (r["hi"] - r["lo"]) / r["bins"]
        place = F.least(F.floor((v - F.lit(r["lo"])) / F.lit(step)).cast("long"), F.lit(r["bins"] - 1).cast("long"))
        places.append(F.struct(F.lit(i).alias("code"), F.when(v.isNotNull(), place).alias("bin")))
    counts = df.select(F.inline(F.array(*places))).where("bin IS NOT NULL").groupBy("code", "bin").agg(F.count("*").alias("c"))
    block = rule.withColumn("block", F.explode(_whole_numbers(F.col("bins"))))
    start = F.col("block") * 65536
    every = block.withColumn("bin", F.explode(F.sequence(start, F.least(start + 65535, F.col("bins") - 1))))
    return every.join(counts, ["code", "bin"], "left").select(
        "column",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("low"),
        F.when(F.col("bin") == F.col("bins") - 1, F.col("hi"))
        .otherwise(F.col("lo") + (F.col("bin") + 1) * width)
        .alias("high"),
        F.coalesce("c", F.lit(0)).alias("count"),
    )


def density(df: DataFrame, columns: Sequence[str] | None = None, points: int = GRID_POINTS) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth: ``(column, point, x, density)``.

    Values are gathered in cells of 1/8 bandwidth; a cell keeps the sums of the first powers of its
    values' distances from its middle, and the kernels of all its values come from those by the kernel's series
    around the middle.  A value is at most 1/16 bandwidth off, so the terms left out are below 1e-12 of the
    kernel's top for each value: the curve is the row-by-row one.  Points so far from a cell that its
    kernels are exactly 0.0 are left out.
    """
    columns = _charted(df, columns)
    stats = _stats(df, columns).where("n > 1 AND std > 0")
    bandwidth = F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    grid = F.broadcast(stats.withColumn("h", bandwidth))  # one row per column
    width = F.col("h") / CELLS_PER_BANDWIDTH
    cell = F.floor((F.col("value") - F.col("lo")) / width).cast("long")
    middle = F.col("lo") + (F.col("cell") + 0.5) * width
    placed = melt(df, columns).join(grid, "column").withColumn("cell", cell).withColumn("off", (F.col("value") - middle) / F.col("h"))
    power, powers = F.lit(1.0), []
    for k in range(SERIES_TERMS):
        powers.append(F.sum(power / math.factorial(k)).alias(f"m{k}"))
        power = power * F.col("off")
    cells = placed.groupBy("column", "cell").agg(*powers)
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    first = F.ceil((middle - ZERO_BEYOND * F.col("h") - F.col("lo")) / step)
    last = F.floor((middle + ZERO_BEYOND * F.col("h") - F.col("lo")) / step)
    near = F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(points - 1)).cast("int"))
    x = F.col("lo") + F.col("point") * step
    # Hermite polynomials are what the kernel's derivatives multiply it with.
    u = F.col("u")
    hermite = [F.lit(1.0), u]
    while len(hermite) < SERIES_TERMS:
        hermite.append(u * hermite[-1] - (len(hermite) - 1) * hermite[-2])
    kernels = F.exp(-u * u / 2) * sum((F.col(f"m{k}") * hermite[k] for k in range(1, SERIES_TERMS)), F.col("m0"))
    reached = (
        cells.join(grid, "column")
        .where(last >= first)
        .withColumn("point", F.explode(near))
        .withColumn("u", (x - middle) / F.col("h"))
        .groupBy("column", "point")
        .agg(F.sum(kernels).alias("kernels"))
    )
    every = grid.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    total = F.coalesce("kernels", F.lit(0.0)) / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    return every.join(reached, ["column", "point"], "left").select("column", "point", x.alias("x"), total.alias("density"))


CELLS_PER_BANDWIDTH = 8
SERIES_TERMS = 8
ZERO_BEYOND = 39.0  # bandwidths behind which exp(-u²/2) is 0.0 in double precision


def _fences(df: DataFrame, columns: Sequence[str], reach: float) -> DataFrame:
    q = quantiles(df, columns, [0.25, 0.5, 0.75], names=["q1", "median", "q3"])
    width = (F.col("q3") - F.col("q1")) * reach
    return q.withColumns({"low_fence": F.col("q1") - width, "high_fence": F.col("q3") + width})


def boxes(df: DataFrame, columns: Sequence[str] | None = None, reach: float = 1.5) -> DataFrame:
    """Box-plot numbers per column; whiskers end at the furthest value within the fences."""
    columns = _charted(df, columns)
    fences = F.broadcast(_fences(df, columns, reach))  # one row per column
    v = F.col("value")
    inside = (v >= F.col("low_fence")) & (v <= F.col("high_fence"))
    return (
        melt(df, columns)
        .join(fences, "column")
        .groupBy("column", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("lo"),
            F.max(F.when(inside, v)).alias("hi"),
            F.count_if(~inside).alias("outliers"),
        )
        .select(
            "column",
            F.least("lo", "q1").alias("whisker_low"),
            "q1",
            "median",
            "q3",
            F.greatest("hi", "q3").alias("whisker_high"),
            "outliers",
        )
    )


def outliers(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), reach: float = 1.5) -> DataFrame:
    """Values beyond the fences, in long form: ``(by…, column, value)``; ``by`` carries row identifiers along."""
    columns = _charted(df, columns)
    fences = F.broadcast(_fences(df, columns, reach).select("column", "low_fence", "high_fence"))  # one row per column
    far = (F.col("value") < F.col("low_fence")) | (F.col("value") > F.col("high_fence"))
    return melt(df, columns, by).join(fences, "column").where(far).select(*[col(b) for b in by], "column", "value")


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix of the numeric columns: ``(column_x, column_y, corr)``.

    Each pair uses the rows where both are present; a constant column gives null.  One scan adds up four
    matrix products for each task, whatever the number of columns, so no row is made for a pair of columns.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column_x string, column_y string, corr double")
    wide = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    # Products of values far from 0 lose their digits, so values are taken from one of the column's own.
    near = wide.limit(CENTRE_ROWS).agg(*[F.percentile_approx(c, 0.5) for c in wide.columns]).first()
    centre = np.array([0.0 if v is None or not math.isfinite(v) else v for v in near])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(_PRODUCTS), len(columns), len(columns)))
        for batch in batches:
            total += _products(batch, centre)
        yield _matrix_rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            got = np.stack([np.stack(batch.column(n).to_numpy(zero_copy_only=False)) for n in _PRODUCTS], axis=1)
            for i, row in zip(batch.column("i").to_pylist(), got):
                rows[i] = rows[i] + row if i in rows else row
        if rows:
            yield _matrix_rows(np.stack([rows[i] for i in sorted(rows)], axis=1), sorted(rows))

    # Rows of the matrices meet in two rounds, first with those of a few hundred tasks, so no task adds up all.
    sums = wide.mapInArrow(partial, _MATRIX).withColumn("part", F.spark_partition_id() % TASKS_PER_ROUND)
    sums = sums.repartition("i", "part").drop("part").mapInArrow(add, _MATRIX).repartition("i").mapInArrow(add, _MATRIX)
    cells = sums.select("i", F.posexplode(F.arrays_zip(*_PRODUCTS)).alias("j", "a"))
    # A pair needs its cell from either side of the diagonal.
    first, second = F.least("i", "j"), F.greatest("i", "j")
    upper = F.col("i") <= F.col("j")
    sided = [F.max(F.when(upper, F.col(f"a.{n}"))).alias(f"{n}_x") for n in _PRODUCTS]
    sided += [F.max(F.when(F.col("i") >= F.col("j"), F.col(f"a.{n}"))).alias(f"{n}_y") for n in _PRODUCTS]
    pairs = cells.groupBy(first.alias("x"), second.alias("y")).agg(*sided)

    def spread(side: str) -> Column:
        squares, drift = F.col(f"squares_{side}"), F.col(f"sums_{side}") * F.col(f"sums_{side}") / F.col("rows_x")
        left = squares - drift
        # What rounding alone can leave of a constant column.
        return F.when(left > squares * 1e-14, left)

    enough = F.col("rows_x") > 1
    r = F.when(enough, (F.col("both_x") - F.col("sums_x") * F.col("sums_y") / F.col("rows_x")) / F.sqrt(spread("x") * spread("y")))
    r = F.when(F.col("odd_x") + F.col("odd_y") > 0, F.lit(float("nan"))).otherwise(F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))))
    r = F.when(F.col("x") == F.col("y"), F.when(r.isNotNull(), F.lit(1.0))).otherwise(r).alias("corr")
    named = [F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(n) + 1) for n in ("x", "y")]
    out = pairs.select(named[0].alias("column_x"), named[1].alias("column_y"), r)
    one = F.struct("column_x", "column_y", "corr")
    mirrored = F.struct(F.col("column_y").alias("column_x"), F.col("column_x").alias("column_y"), "corr")
    same = F.col("column_x") == F.col("column_y")
    return out.select(F.inline(F.when(same, F.array(one)).otherwise(F.array(one, mirrored))))


CENTRE_ROWS = 1000  # rows that show where a column's values lie
TASKS_PER_ROUND = 256
#: For a pair (a, b) over the rows where both are: rows, sum of a, sum of a squared, sum of a times b, infinite values of a.
_PRODUCTS = ["rows", "sums", "squares", "both", "odd"]
_MATRIX = "i int, " + ", ".join(f"{n} array<double>" for n in _PRODUCTS)


def _products(batch: pa.RecordBatch, centre: np.ndarray) -> np.ndarray:
    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - centre
    odd = np.isinf(x)
    present = (~np.isnan(x)).astype(float)
    x = np.where(np.isfinite(x), x, 0.0)
    strange = odd.T.astype(float) @ present if odd.any() else np.zeros((x.shape[1],) * 2)
    return np.stack([present.T @ present, x.T @ present, (x * x).T @ present, x.T @ x, strange])


def _matrix_rows(total: np.ndarray, places: Sequence[int] | None = None) -> pa.RecordBatch:
    places = range(total.shape[1]) if places is None else places
    columns = [pa.array(list(places), pa.int32())] + [pa.array(list(m), pa.list_(pa.float64())) for m in total]
    return pa.RecordBatch.from_arrays(columns, ["i", *_PRODUCTS])


def pair_bins(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """Scatter of each pair of numeric columns as counts on a ``bins`` × ``bins`` grid.

    For 2 to 4 numeric columns, as more pairs make no readable picture; the
    diagonal is ``histogram``.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    if not 2 <= len(columns) <= 4:
        raise ValueError("Pair counts are made for 2 to 4 numeric columns")
    ranges = df.agg(
        F.struct(
            *[F.min(as_double(df, c)).alias(f"lo{i}") for i, c in enumerate(columns)],
            *[F.max(as_double(df, c)).alias(f"hi{i}") for i, c in enumerate(columns)],
        ).alias("stats")
    ).scalar()
    cell = {}
    for i, c in enumerate(columns):
        v, lo, hi = as_double(df, c), ranges.getField(f"lo{i}"), ranges.getField(f"hi{i}")
        place = F.least(F.floor(F.coalesce(F.try_divide((v - lo) * bins, hi - lo), F.lit(0.0))), F.lit(bins - 1))
        cell[c] = F.when(v.isNotNull(), place.cast("int"))
    marks = df.select(*[b.alias(c) for c, b in cell.items()])
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("column_x"), F.lit(b).alias("column_y"), col(a).alias("x_bin"), col(b).alias("y_bin"))
            for a, b in combinations(columns, 2)
        ]
    )
    # At most six entries per row, and at most bins² counts per pair after the map side.
    return (
        marks.select(F.inline(pairs))
        .where("x_bin IS NOT NULL AND y_bin IS NOT NULL")
        .groupBy("column_x", "column_y", "x_bin", "y_bin")
        .agg(F.count("*").alias("count"))
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """The most frequent values of the first text columns: ``(column, value, count)``."""
    columns = list(columns) if columns is not None else text_columns(df)[:CHART_CATEGORIES]
    return top_texts(df, columns, top)
