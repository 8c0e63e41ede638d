"""Matrix correlations, texts counted by digest and date patterns by ranges, against pandas and plain loops."""

import datetime as dt
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest

from tablewright.functions.texts import top_texts
from tablewright.operators import clean, distribution, forecast, profile


def test_correlations_pairwise(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 7)) * [1, 1e-6, 1e6, 1, 1, 1, 1] + [0, 5, 1e9, 0, 0, 0, 0]
    x[:, 3] = 0.1 + 0.2
    x[:, 4] += x[:, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:1500, 5], x[1500:, 6] = np.nan, np.nan  # never together
    frame = pd.DataFrame(x, columns=[f"a.{i} b" for i in range(7)])
    df = spark.createDataFrame(frame).repartition(5)
    got = {(r["column_x"], r["column_y"]): r["corr"] for r in distribution.correlations(df).collect()}
    want = frame.corr()
    assert len(got) == 49
    for a, b in itertools.product(frame.columns, frame.columns):
        constant = frame.columns[3] in (a, b) or {a, b} == set(frame.columns[5:])
        assert got[a, b] is None if constant else np.isclose(got[a, b], want.loc[a, b], atol=1e-9), (a, b)


def test_correlations_of_odd_columns(spark):
    inf = float("inf")
    rows = [(1.0, inf, None, 2), (2.0, 1.0, None, 4), (3.0, 2.0, None, 7), (None, 5.0, None, 1)]
    got = {(r["column_x"], r["column_y"]): r["corr"] for r in distribution.correlations(spark.createDataFrame(rows, "a double, b double, c double, d int")).collect()}
    assert np.isnan(got["a", "b"]) and got["a", "c"] is None and np.isclose(got["a", "d"], np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    empty = spark.createDataFrame([], "a double, b double")
    assert [r["corr"] for r in distribution.correlations(empty).collect()] in ([], [None] * 4)


def test_correlations_scan_once(spark):
    wide = spark.range(200, numPartitions=3).selectExpr(*[f"sin(id * {i + 1}) AS c{i}" for i in range(120)])
    df = distribution.correlations(wide)
    plan = df._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert len(re.findall(r"Range \(", initial)) == 1
    assert df.count() == 120 * 120


def _top(values, top):
    counts = pd.Series([v for v in values if v is not None], dtype=object).value_counts()
    return sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:top]


@pytest.mark.parametrize("top", [1, 2, 5, 40])
def test_top_texts_with_long_common_beginnings(spark, top):
    dice = random.Random(top)
    begin = "boilerplate " * 40
    texts = [begin + "x" * i + dice.choice("abc") for i in range(9)] + [begin, begin[:64], "short", "", "é" * 64, "é" * 65, "z" * 300_000]
    values = [dice.choice(texts) for _ in range(200)] + [begin + f"tie {i}" for i in range(30)] + [None] * 50
    df = spark.createDataFrame([(v, "same", None) for v in values], "t string, u string, v string").repartition(6)
    got = top_texts(df, ["t", "u", "v"], top).collect()
    assert sorted((r["value"], r["count"]) for r in got if r["column"] == "t") == sorted(_top(values, top))
    assert [(r["value"], r["count"]) for r in got if r["column"] != "t"] == [("same", len(values))]
    assert clean.column_modes(df).first()["t"] == _top(values, 1)[0][0]
    line = {r["column"]: r for r in profile.describe_text(df).collect()}
    assert (line["t"]["top"], line["t"]["freq"]) == _top(values, 1)[0] and line["t"]["unique"] == len({*values} - {None})
    assert line["v"]["top"] is None and line["v"]["count"] == 0


def test_long_texts_do_not_move(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = profile.text_counts(docs, ["text"])._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "Exchange" in line)
    assert "text" not in exchange and "key" in exchange


def _dates(spark):
    day = dt.datetime(2024, 1, 1)
    series = {
        "daily": [day + dt.timedelta(days=i) for i in range(400)],
        "hot": [day + dt.timedelta(days=i) for i in range(200)] + [day + dt.timedelta(days=60)] * 150,
        "work": [d for d in (day + dt.timedelta(days=i) for i in range(300)) if d.weekday() < 5],
        "work hole": [d for d in (day + dt.timedelta(days=i) for i in range(300)) if d.weekday() < 5 and d.month != 5],
        "ends": list(pd.date_range(day, periods=90, freq="ME").to_pydatetime()),
        "quarters": list(pd.date_range(day, periods=60, freq="BQS-JAN").to_pydatetime()),
        "odd": [day + dt.timedelta(seconds=i * i) for i in range(300)],
        "two": [day, day + dt.timedelta(days=1)],
        "one date": [day] * 20,
    }
    return spark.createDataFrame([(k, d) for k, v in series.items() for d in v], "k string, ts timestamp_ntz")


@pytest.mark.parametrize("pieces, rows_per_task", [(512, 4_000_000), (8, 10), (40, 3)])
def test_date_patterns_by_ranges(spark, pieces, rows_per_task):
    df = _dates(spark)
    dated = forecast.numbered(df.selectExpr("*", "0D AS v"), "ts", "v", ["k"])
    want = {r["k"]: r.asDict() for r in forecast._with_frequency(forecast._per_series(dated, ["k"], forecast.F.lit(0))).collect()}
    found = forecast._with_frequency(forecast._date_pattern(df, ["k"], pieces, rows_per_task))
    got = {r["k"]: r.asDict() for r in found.collect()}
    for k, row in got.items():
        same = {n: v for n, v in row.items() if n != "business_days"}
        assert same == {n: want[k][n] for n in same}, k
        assert bool(row["business_days"]) == bool(want[k]["business_days"]) or row["n"] < 3, k
    assert got.keys() == want.keys()


def test_date_patterns_number_no_rows(spark):
    plan = forecast.frequency(_dates(spark), "ts", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan.lower()
    assert forecast.frequency(_dates(spark).drop("k").where("false"), "ts").count() == 0


def test_density_of_far_values(spark):
    x = np.concatenate([np.random.default_rng(3).normal(size=400), [1e4, 1e4 + 1e-3]])
    got = distribution.density(spark.createDataFrame(pd.DataFrame({"x": x}))).toPandas().sort_values("point")
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.exp(-(((grid[:, None] - x[None, :]) / h) ** 2) / 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert len(got) == 200 and np.allclose(got["density"], want, rtol=1e-9, atol=want.max() * 1e-12)
