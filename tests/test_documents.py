"""Forecast documents: whole history, forecast and intervals of each series, all or nothing."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tablewright.operators import arima, forecast
from tablewright.sources import documents


def _rows():
    day = dt.datetime(2024, 1, 1)
    long = [("a", day + dt.timedelta(days=i), float(i) if i % 9 else None) for i in range(3000)]
    return long + [("a", day, -1.0)] + [("x/é y", day + dt.timedelta(days=i), 2.5) for i in range(6)] + [(None, day + dt.timedelta(days=i), 1.0) for i in range(5)] + [("short", day, 1.0)]


def test_documents_hold_history_and_forecast(spark, tmp_path):
    df = spark.createDataFrame(_rows(), "k string, d timestamp_ntz, v double")
    ahead = forecast.forecast_sma(df, "d", "v", 3, by=["k"])
    folder = str(tmp_path / "out")
    for _ in range(2):  # a second time replaces the documents
        documents.write_forecasts(df, "d", "v", ahead, folder, ["k"])
    found = {}
    for name in os.listdir(folder):
        assert name.endswith(".json")
        with open(f"{folder}/{name}") as f:
            document = json.load(f)
        found[document.get("k")] = (name, document)
    assert found.keys() == {"a", "x/é y", None, "short"} and found["a"][0] == "a.json"
    past = sorted((r for r in _rows() if r[0] == "a"), key=lambda r: (r[1], r[2] is not None, r[2] or 0))
    document = found["a"][1]
    assert document["original_data"]["dates"] == [str(r[1]) for r in past] and document["original_data"]["values"] == [r[2] for r in past]
    rows = sorted((r for r in ahead.collect() if r["k"] == "a"), key=lambda r: r["step"])
    assert document["forecast"] == {"dates": [str(r["ts"]) for r in rows], "values": [r["value"] for r in rows]}
    assert document["confidence_intervals"]["upper"] == [r["upper"] for r in rows] and document["periods"] == 3
    assert document["target_column"] == "v" and document["model"] == "sma" and document["model_params"]["window_size"] == 900
    short = found["short"][1]
    assert short["error"] and short["forecast"] == {"dates": [], "values": []} and short["original_data"]["values"] == [1.0]


def test_one_series_by_arima(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 7)) for i in range(90)], "d date, v double")
    ahead = arima.forecast_arima(df, "d", "v", 2, order=(1, 0, 0))
    documents.write_forecasts(df, "d", "v", ahead, str(tmp_path), [])
    document = json.loads((tmp_path / "forecast.json").read_text())
    assert document["model_params"]["p"] == 1 and document["performance_metrics"]["aic"] and len(document["forecast"]["values"]) == 2


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame(_rows(), "k string, d timestamp_ntz, v double")
    ahead = forecast.forecast_sma(df, "d", "v", 3, by=["k"])
    broken = df.withColumn("v", F.when(F.col("v") == 2999.0, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        documents.write_forecasts(broken, "d", "v", ahead, str(tmp_path / "out"), ["k"])
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
