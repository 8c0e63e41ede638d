"""Whole runs over a table or file: clean, describe, find facts, forecast."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import nan_to_null, numeric_columns, stored, text_columns
from tablewright.operators import arima, clean, distribution, facts, forecast, profile, transform, validate
from tablewright.sources import files, sinks

MODES = ("full", "process_only", "insights_only", "forecast_only")


@dataclass
class Options:
    """What a run does; column arguments left out switch the step off."""

    strategy: str | None = "mean"
    dedupe: bool = True
    required: Sequence[str] = ()
    normalize: Sequence[str] = ()
    scale: Sequence[str] = ()
    clean_text: Sequence[str] = ()
    clip: Sequence[str] = ()
    one_hot: Sequence[str] = ()
    measure: str | None = None
    dimension: str | None = None
    date: str | None = None
    target: str | None = None
    model: str = "sma"
    periods: int = 30
    by: Sequence[str] = field(default_factory=list)


def prepared(df: DataFrame, options: Options) -> DataFrame:
    """Cleaned and transformed table."""
    out = clean.clean(df, options.strategy, options.dedupe)
    for step, columns in (
        (transform.clean_text, options.clean_text),
        (transform.clip_outliers, options.clip),
        (transform.normalize, options.normalize),
        (transform.scale, options.scale),
    ):
        if columns:
            out = step(out, columns)
    for column in options.one_hot:
        out = transform.one_hot(out, column)
    return out


class Results(Mapping[str, DataFrame]):
    """Result tables by name; each is built when it is first asked for, and then kept."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders, self._built = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def run(df: DataFrame, mode: str = "full", options: Options | None = None) -> Results:
    """Result tables of a run by name.  No job runs before one is asked for.

    The processed table is made and written once, by whichever result needs it first.
    """
    if mode not in MODES:
        raise ValueError(f"Unknown mode: {mode}")
    options = options or Options()
    df = nan_to_null(df)
    made: list[DataFrame] = []

    def table() -> DataFrame:
        # A forecast alone is one of the processed table, too.
        if not made:
            made.append(df if mode == "insights_only" else stored(prepared(df, options)))
        return made[0]

    out: dict[str, Callable[[], DataFrame]] = {"validation": lambda: validate.validate(df, options.required)}
    if mode in ("full", "process_only"):
        out["processed"] = table
        out["cleaning_report"] = lambda: clean.cleaning_report(df, options.strategy, options.dedupe)
    if mode in ("full", "insights_only"):
        out |= _insights(df, table, options)
    if mode in ("full", "forecast_only") and options.date and options.target:
        out["forecast"] = lambda: arima.forecast(table(), options.date, options.target, options.periods, options.model, by=options.by)
        out["forecast_chart"] = lambda: forecast.chart_series(table(), options.date, options.target, results["forecast"], options.by)
    results = Results(out)
    return results


def _insights(df: DataFrame, table: Callable[[], DataFrame], options: Options) -> dict[str, Callable[[], DataFrame]]:
    """What there is to show follows from the column types alone: cleaning keeps them, indicator columns are numbers."""
    numbers = len(numeric_columns(df)) + len(options.one_hot)
    texts = [c for c in text_columns(df) if c not in options.one_hot]
    out = {
        "summary": lambda: profile.summary(table()),
        "missing": lambda: profile.missing(table()),
        "complete_rows": lambda: profile.complete_rows(table()),
        "description": lambda: profile.description_lines(table()),
    }
    if numbers:
        out["describe"] = lambda: profile.describe(table())
        out["histogram"] = lambda: distribution.histogram(table())
        out["boxes"] = lambda: distribution.boxes(table())
    if numbers > 1:
        out["correlations"] = lambda: distribution.correlations(table())
    if texts:
        out["top_values"] = lambda: distribution.top_values(table())
    if options.measure and options.dimension:
        out["measure_by"] = lambda: facts.measure_by(table(), options.measure, options.dimension)
        out["group_gap"] = lambda: facts.group_gap(table(), options.measure, options.dimension)
    if options.dimension:
        out["group_share"] = lambda: facts.group_share(table(), options.dimension)
    if options.date:
        out["rows_by_year"] = lambda: facts.rows_by_year(table(), options.date, options.dimension)
    return out


def file_worker(spark: SparkSession, folder: str, options: Options | None = None, fmt: str = "csv") -> Callable[[str], dict]:
    """Function for ``watch`` and ``run_batch``: load a file, clean it, write the table and its summary.

    Outputs are named after the file and overwritten, so a file handled twice leaves one result.
    """
    options = options or Options()

    def work(path: str) -> dict:
        df = files.load(spark, path)
        state = validate.validate(df, options.required).first()
        if not state["valid"]:
            raise files.IngestError("; ".join(state["errors"]))
        table = stored(prepared(df, options))
        target = sinks.write_files(table, sinks.processed_path(folder, path), fmt)
        texts = profile.description_lines(table).agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text")
        )
        insights = F.create_map(F.lit("data_description"), texts.scalar())
        use_cases = F.array().cast("array<struct<title:string,description:string,impact:string,effort:string>>")
        document = sinks.insights_document(table, path.rsplit("/", 1)[-1], insights, use_cases)
        sinks.write_files(document, sinks.processed_path(folder, path, "insights"), "json")
        return {"output_path": target}

    return work
