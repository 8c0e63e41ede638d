"""Moving-average forecasts of one or many series, with inferred frequency and dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import as_double, check_columns, col
from tablewright.functions.ranks import MOST_PIECES, PIECES, ROWS_PER_TASK, _segment, _sketch, _some, index_rows, wall_micros

Z_95 = 1.96  # fixed multiplier of the moving-average interval
DAY = 86_400_000_000
_MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
_DAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]

# Column names of the results, not available as names of series columns.
OWN_COLUMNS = {"ts", "value", "t", "n", "step", "kind", "lower", "upper", "model", "frequency", "window_size", "error"}
SHORT_SERIES = "Need at least 3 dates to infer frequency"


def series(df: DataFrame, ts: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, ts timestamp_ntz, value double)``; text dates are parsed, a bad or missing date is an error."""
    check_columns(df, [ts, value, *by])
    clash = sorted(set(by) & OWN_COLUMNS)
    if clash:
        raise ValueError(f"Rename series columns that results use themselves: {', '.join(clash)}")
    kind = df.schema[ts].dataType
    if isinstance(kind, T.StringType):
        moment = F.to_timestamp_ntz(col(ts))
    else:
        moment = col(ts).cast("timestamp_ntz")
    moment = F.coalesce(moment, F.raise_error(F.lit(f"Missing date in column {ts}")).cast("timestamp_ntz"))
    return df.select(*[col(b) for b in by], moment.alias("ts"), as_double(df, value).alias("value"))


def numbered(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), previous: Sequence[str] = ("ts",)) -> DataFrame:
    """The series with ``t``, ``n`` and the previous row's columns; equal dates are ordered by value."""
    return index_rows(series(df, ts, value, by), by, ["ts", "value"], previous=previous)


def differences(df: DataFrame, ts: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """First difference of each series; rows without a predecessor or with a missing side are dropped."""
    rows = numbered(df, ts, value, by, previous=("value",))
    diff = rows.withColumn("diff", F.col("value") - F.col("prev_value"))
    return diff.where("diff IS NOT NULL").select(*[col(b) for b in by], "ts", "t", "value", "diff")


def _picked(names: Sequence[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def _date_flags(now: Column) -> dict[str, Column]:
    """Where a date lies in its month."""
    dom, month_days = F.dayofmonth(now), F.dayofmonth(F.last_day(now.cast("date")))
    ends, starts = dom == month_days, dom == 1
    return {
        "month_starts": starts,
        "business_starts": starts | ((dom <= 3) & (F.weekday(now) == 0)),
        "month_ends": ends,
        "business_ends": ends | ((month_days - dom < 3) & (F.weekday(now) == 4)),
    }


def _gaps(now: Column, before: Column) -> tuple[Column, Column, Column]:
    """Microseconds and months since the date before, and whether the step is one between working days."""
    gap = wall_micros(now) - wall_micros(before)
    month_gap = (F.year(now) * 12 + F.month(now)) - (F.year(before) * 12 + F.month(before))
    # 0 = Monday … 6 = Sunday
    weekday = F.weekday(now)
    business_step = ((weekday == 0) & (gap == 3 * DAY)) | ((weekday > 0) & (weekday <= 4) & (gap == DAY))
    return gap, month_gap, business_step


def _per_series(rows: DataFrame, by: Sequence[str], window: Column) -> DataFrame:
    """One row per series: date pattern and level of the last ``window`` rows, in one partial aggregation."""
    now = F.col("ts")
    gap, month_gap, business_step = _gaps(now, F.col("prev_ts"))
    tail = F.when(F.col("t") > F.col("n") - window, F.col("value"))
    return rows.groupBy(*[col(b) for b in by]).agg(
        F.max("n").alias("n"),
        F.min(now).alias("first_ts"),
        F.max(now).alias("last_ts"),
        F.min(gap).alias("min_gap"),
        F.max(gap).alias("max_gap"),
        F.min(month_gap).alias("min_months"),
        F.max(month_gap).alias("max_months"),
        F.bool_and(business_step).alias("business_days"),
        *[F.bool_and(c).alias(n) for n, c in _date_flags(now).items()],
        F.avg(tail).alias("level"),
        F.stddev_samp(tail).alias("spread"),
    )


def _date_pattern(dates: DataFrame, by: Sequence[str], pieces: int = PIECES, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The date columns of :func:`_per_series` out of ``(by…, ts)``, without numbering any row.

    Rows of one date are counted before they move.  Dates are cut into ranges; each range of a series gives its first and
    last date, its least and greatest gap and its flags, and the ranges' summaries are merged in
    order, the gap between two of them included.
    """
    key = F.struct(*[col(b).alias(b) for b in by]) if by else F.struct(F.lit(0).alias("all"))
    dates = dates.select(key.alias("_key"), "ts").withColumn("_x", wall_micros(F.col("ts")).cast("double"))
    rows, splits = dates.count(), []
    if rows > rows_per_task:
        (splits,), _ = _sketch(_some(dates), ["_x"], max(pieces, min(MOST_PIECES, rows // rows_per_task)))
    days = dates.groupBy("_key", "ts", "_x").agg(F.count("*").alias("c"))
    days = _segment(days, "_x", splits, "_range")
    # What the gaps and flags are made of, worked out once a date.
    now = F.col("ts")
    flags = _date_flags(now)
    days = days.select(
        "_key", "_range", "ts", "c", wall_micros(now).alias("us"), (F.year(now) * 12 + F.month(now)).alias("month"),
        F.weekday(now).alias("weekday"), *[c.alias(n) for n, c in flags.items()],
    )
    inside = Window.partitionBy("_key", "_range").orderBy("ts")
    gap, months = F.col("us") - F.lag("us").over(inside), F.col("month") - F.lag("month").over(inside)
    days = days.select("*", gap.alias("gap"), months.alias("months"))

    def business_step(gap: Column, weekday: Column) -> Column:
        # 0 = Monday … 6 = Sunday
        return ((weekday == 0) & (gap == 3 * DAY)) | ((weekday > 0) & (weekday <= 4) & (gap == DAY))

    ranges = days.groupBy("_key", "_range").agg(
        F.sum("c").alias("n"),
        F.max("c").alias("most"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"),
        F.min("months").alias("min_months"),
        F.max("months").alias("max_months"),
        F.bool_and(business_step(F.col("gap"), F.col("weekday"))).alias("business_days"),
        *[F.bool_and(n).alias(n) for n in flags],
    )
    # One row per series and range, so this window stays small.
    in_order = Window.partitionBy("_key").orderBy("_range")
    seams = {"seam": F.col("first_us") - F.lag("last_us").over(in_order), "seam_months": F.col("first_month") - F.lag("last_month").over(in_order)}
    ranges = ranges.select("*", *[c.alias(n) for n, c in seams.items()])
    seam_step = business_step(F.col("seam"), F.weekday("first_ts"))
    twice = F.col("most") > 1  # a second row of a date follows at no distance
    none = F.when(twice, F.lit(0))
    merged = ranges.groupBy("_key").agg(
        F.sum("n").alias("n"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min(F.least("min_gap", "seam", none)).alias("min_gap"),
        F.max(F.greatest("max_gap", "seam", none)).alias("max_gap"),
        F.min(F.least("min_months", "seam_months", none)).alias("min_months"),
        F.max(F.greatest("max_months", "seam_months", none)).alias("max_months"),
        F.bool_and(F.coalesce(F.col("business_days"), seam_step, ~twice) & F.coalesce(seam_step, F.lit(True)) & ~twice).alias("business_days"),
        *[F.bool_and(n).alias(n) for n in flags],
    )
    return merged.select(*[F.col("_key")[b].alias(b) for b in by], *merged.columns[1:])


def _with_frequency(stats: DataFrame) -> DataFrame:
    """Adds ``frequency`` (its code), ``inferred``, ``unit`` and ``step`` to per-series date statistics."""
    g = F.col("min_gap")
    regular = g == F.col("max_gap")
    months = F.col("min_months")
    even_months = (months == F.col("max_months")) & (months > 0) & (g > 0) & (g % DAY == 0)
    ending = (
        F.when(F.col("month_ends"), "E")
        .when(F.col("business_ends"), "BE")
        .when(F.col("month_starts"), "S")
        .when(F.col("business_starts"), "BS")
    )
    anchored = even_months & ending.isNotNull()
    month_name = _picked(_MONTHS, F.month("last_ts") - 1)
    quarter_name = _picked(["OCT", "NOV", "DEC"], (F.month("last_ts") + 2) % 3)

    def many(count: Column, code: Column) -> Column:
        return F.when(count == 1, code).otherwise(F.concat(count.cast("string"), code))

    def code_of(letter: str) -> Column:
        # business codes put the B first: BME, BQS, BYE
        business = ending.startswith("B")
        side = F.right(ending, F.lit(1))
        return F.concat(F.when(business, "B").otherwise(""), F.lit(letter), side)

    days = F.floor(g / DAY).cast("long")
    pattern = (
        F.when((F.col("n") < 3) | (g <= 0), F.lit(None).cast("string"))
        .when(anchored & (months % 12 == 0), many(F.floor(months / 12), F.concat(code_of("Y"), F.lit("-"), month_name)))
        .when(anchored & (months % 3 == 0), many(F.floor(months / 3), F.concat(code_of("Q"), F.lit("-"), quarter_name)))
        .when(anchored, many(months, code_of("M")))
        .when(regular & (g % (7 * DAY) == 0), many(F.floor(days / 7), F.concat(F.lit("W-"), _picked(_DAYS, F.weekday("last_ts")))))
        .when(regular & (g % DAY == 0), many(days, F.lit("D")))
        .when(F.col("business_days") & (F.col("max_gap") == 3 * DAY) & (g == DAY), F.lit("B"))
        .when(regular & (g % 3_600_000_000 == 0), many(F.floor(g / 3_600_000_000), F.lit("h")))
        .when(regular & (g % 60_000_000 == 0), many(F.floor(g / 60_000_000), F.lit("min")))
        .when(regular & (g % 1_000_000 == 0), many(F.floor(g / 1_000_000), F.lit("s")))
        .when(regular & (g % 1000 == 0), many(F.floor(g / 1000), F.lit("ms")))
        .when(regular, many(g, F.lit("us")))
    )
    mean_gap = (wall_micros(F.col("last_ts")) - wall_micros(F.col("first_ts"))) / (F.col("n") - 1) / 1e6
    rough = (
        F.when(F.col("n") < 3, F.lit(None).cast("string"))
        .when(mean_gap < 60, "S")
        .when(mean_gap < 3600, "T")
        .when(mean_gap < 86400, "H")
        .when(mean_gap < 86400 * 7, "D")
        .when(mean_gap < 86400 * 31, "W")
        .otherwise("M")
    )
    fixed = {"S": 1_000_000, "T": 60_000_000, "H": 3_600_000_000, "D": DAY}
    rough_step = F.coalesce(*[F.when(F.col("rough") == k, F.lit(v)) for k, v in fixed.items()])
    from_pattern = F.col("pattern").isNotNull()
    is_business = F.col("pattern") == "B"
    unit = (
        F.when(from_pattern & is_business, "business")
        .when(from_pattern & anchored, F.concat(F.lit("month_"), ending))
        .when(from_pattern, "micros")
        .when(F.col("rough") == "W", "sunday")
        .when(F.col("rough") == "M", "month_E")
        .otherwise("micros")
    )
    step = F.when(from_pattern & anchored, months.cast("long")).when(from_pattern, g).otherwise(F.coalesce(rough_step, F.lit(1)))
    return (
        stats.withColumns({"pattern": pattern, "rough": rough})
        .withColumns(
            {
                "frequency": F.coalesce("pattern", "rough"),
                "inferred": from_pattern,
                "unit": unit,
                "step_size": step.cast("long"),
            }
        )
        .drop("pattern", "rough")
    )


def _month_date(unit: Column, month_start: Column) -> Column:
    """The anchor date of a month: first or last day, or its first or last working day."""
    last = F.last_day(month_start)
    first_shift = F.when(F.weekday(month_start) > 4, 7 - F.weekday(month_start)).otherwise(0)
    last_shift = F.when(F.weekday(last) > 4, F.weekday(last) - 4).otherwise(0)
    return (
        F.when(unit == "month_S", month_start)
        .when(unit == "month_BS", F.date_add(month_start, first_shift))
        .when(unit == "month_BE", F.date_sub(last, last_shift))
        .otherwise(last)
    )


def future_date(last: Column, unit: Column, step: Column, k: Column) -> Column:
    """The k-th date after ``last``; the time of day is kept.

    The first date of the range starting at ``last`` is left out.  Under the
    rough weekly and monthly codes that range starts at the next Sunday or
    month end, so a last date off that anchor loses the first anchor: after
    2023-01-11 come 22 January (weekly) and 28 February (monthly).
    """
    day = last.cast("date")
    time = wall_micros(last) - F.unix_date(day).cast("long") * DAY
    weekday = F.weekday(day)
    # Working days: five to the week, counted from the Monday of the last date's week.
    monday = F.date_sub(day, weekday)
    nth = weekday + k
    business = F.date_add(monday, (F.floor(nth / 5) * 7 + nth % 5).cast("int"))
    sunday = F.date_add(day, ((6 - weekday) + 7 * k).cast("int"))
    month_start = F.trunc(day, "month")
    months = F.add_months(month_start, (step * k).cast("int"))
    moved = F.when(unit == "business", business).when(unit == "sunday", sunday).otherwise(_month_date(unit, months))
    in_days = F.unix_date(moved).cast("long") * DAY + time
    micros = F.when(unit == "micros", wall_micros(last) + step * k).otherwise(in_days)
    return wall_time(micros)


def wall_time(micros: Column) -> Column:
    """Timestamp without zone from microseconds since 1970-01-01, whatever the session's zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    span = F.make_dt_interval(
        F.floor(micros / DAY).cast("int"), F.lit(0), F.lit(0), (F.pmod(micros, F.lit(DAY)) / 1_000_000).cast("decimal(18,6)")
    )
    return origin + span


def frequency(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Date pattern per series: ``(by…, n, first_ts, last_ts, frequency, inferred)``.

    A regular pattern is named (``D``, ``2h``, ``W-MON``, ``MS``, ``QE-DEC``,
    ``B`` …); otherwise the mean gap picks S, T, H, D, W or M.  Fewer than
    three dates give null.
    """
    dates = series(df.withColumn("_one", F.lit(0.0)), ts, "_one", by).drop("value")
    return _with_frequency(_date_pattern(dates, by)).select(*[col(b) for b in by], "n", "first_ts", "last_ts", "frequency", "inferred")


def window_rows(n: Column, fraction: float = 0.3, least: int = 5) -> Column:
    return F.greatest(F.lit(least).cast("long"), F.floor(n * F.lit(float(fraction))).cast("long"))


def forecast_sma(
    df: DataFrame,
    ts: str,
    value: str,
    periods: int = 30,
    by: Sequence[str] = (),
    window_fraction: float = 0.3,
    min_window: int = 5,
) -> DataFrame:
    """Constant forecast per series at the mean of its last rows.

    Window: ``max(min_window, floor(window_fraction * n))`` rows, missing values
    skipped; interval: mean ± 1.96 sample standard deviations of the window.
    Columns ``(by…, step, ts, value, lower, upper, model, frequency,
    window_size, error)``.  A series of fewer than three rows gives one row
    with an error and no step.
    """
    window = window_rows(F.col("n"), window_fraction, min_window)
    stats = _with_frequency(_per_series(numbered(df, ts, value, by), by, window))
    return _sma_rows(stats, by, periods, window)


def _sma_rows(stats: DataFrame, by: Sequence[str], periods: int, window: Column, model: str = "sma") -> DataFrame:
    enough = F.col("n") >= 3
    steps = F.when(enough, F.sequence(F.lit(1), F.lit(periods))).otherwise(F.array(F.lit(None).cast("int")))
    rows = stats.withColumn("step", F.explode(steps))
    known = F.col("step").isNotNull()
    return rows.select(
        *[col(b) for b in by],
        "step",
        F.when(known, future_date(F.col("last_ts"), F.col("unit"), F.col("step_size"), F.col("step"))).alias("ts"),
        F.when(known, F.col("level")).alias("value"),
        F.when(known, F.col("level") - Z_95 * F.col("spread")).alias("lower"),
        F.when(known, F.col("level") + Z_95 * F.col("spread")).alias("upper"),
        F.lit(model).alias("model"),
        "frequency",
        F.when(known, window).alias("window_size"),
        F.when(~known, F.lit(SHORT_SERIES)).alias("error"),
    )


def arima_pq(n: Column) -> tuple[Column, Column]:
    """AR and MA orders from the series length."""
    p = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(n / 10).cast("int")))
    q = F.least(F.lit(2), F.greatest(F.lit(1), F.floor(n / 20).cast("int")))
    return p, q


def chart_series(df: DataFrame, ts: str, value: str, forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """History and forecast with its band in one table: ``(by…, kind, ts, value, lower, upper)``."""
    history = series(df, ts, value, by).withColumn("kind", F.lit("history"))
    ahead = forecast.where("step IS NOT NULL").withColumn("kind", F.lit("forecast"))
    columns = [*[col(b) for b in by], "kind", "ts", "value"]
    null = F.lit(None).cast("double")
    return history.select(*columns, null.alias("lower"), null.alias("upper")).unionByName(
        ahead.select(*columns, "lower", "upper")
    )
