"""Exact ranks against pandas, with keys and ties that fill whole segments."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.ranks import in_blocks, index_rows, quantiles


def _skewed(spark, rows=6000):
    rng = np.random.default_rng(7)
    key = np.where(rng.random(rows) < 0.4, "hot", rng.choice(list("abcd"), rows))
    x = np.where(rng.random(rows) < 0.3, 5.0, np.round(rng.lognormal(0, 3, rows), 3))
    y = rng.integers(0, 1000, rows).astype(float)
    pdf = pd.DataFrame({"key": key, "x": x, "y": y, "id": np.arange(rows)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("pieces,rows_per_task", [(4, 10**9), (4, 3000), (512, 3000), (4, 1), (512, 1)])
def test_quantiles_match_pandas(spark, pieces, rows_per_task):
    pdf, df = _skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = quantiles(df, ["x", "y"], probs, pieces=pieces, rows_per_task=rows_per_task, counted_directly=rows_per_task).toPandas().set_index("column")
    for c in ("x", "y"):
        want = pdf[c].quantile([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]).to_numpy()
        assert np.allclose(got.loc[c, ["q00", "q10", "q25", "q50", "q75", "q100"]].astype(float), want)


@pytest.mark.parametrize("pieces,rows_per_task", [(4, 10**9), (4, 3000), (512, 3000), (4, 1)])
def test_grouped_quantiles_match_pandas(spark, pieces, rows_per_task):
    pdf, df = _skewed(spark)
    got = quantiles(df, ["x"], [0.25, 0.5], by=["key"], pieces=pieces, rows_per_task=rows_per_task, counted_directly=rows_per_task).toPandas().set_index("key")
    for k, group in pdf.groupby("key"):
        assert got.loc[k, "n"] == len(group)
        assert np.allclose(got.loc[k, ["q25", "q50"]].astype(float), group["x"].quantile([0.25, 0.5]).to_numpy())


def test_quantiles_skip_missing_and_one_row(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 4), (3.0, None)], "a double, b int")
    got = {r["column"]: (r["n"], r["q50"]) for r in quantiles(df, ["a", "b"], [0.5]).collect()}
    assert got == {"a": (2, 2.0), "b": (1, 4.0)}
    empty = df.where("a > 100")
    assert quantiles(empty, ["a"], [0.5]).collect() == []


@pytest.mark.parametrize("pieces,rows_per_task", [(4, 3000), (64, 3000), (64, 50), (64, 10**9)])
def test_index_rows_matches_a_sort(spark, pieces, rows_per_task):
    pdf, df = _skewed(spark)
    got = index_rows(df, ["key"], ["x", "y"], previous=["x", "id"], pieces=pieces, rows_per_task=rows_per_task).toPandas()
    assert len(got) == len(pdf)
    for k, group in got.groupby("key"):
        group = group.sort_values("t")
        assert group["t"].tolist() == list(range(1, len(group) + 1))
        assert (group["n"] == len(group)).all()
        ordered = group[["x", "y"]].apply(tuple, axis=1).tolist()
        assert ordered == sorted(ordered)
        # the row before has the value just smaller in (x, y)
        assert group["prev_x"].iloc[1:].tolist() == group["x"].iloc[:-1].tolist()
        assert group["prev_x"].isna().iloc[0]


def test_index_rows_by_timestamp_without_key(spark):
    df = spark.range(100).select(
        F.expr("timestamp_ntz'2024-03-30 00:00:00' + make_interval(0,0,0,0, int(id))").alias("ts"),
        (F.col("id") % 3).alias("v"),
    )
    for rows in (10, 1000):
        got = index_rows(df, [], ["ts", "v"], previous=["ts"], pieces=8, rows_per_task=rows).orderBy("t").collect()
        assert [r["t"] for r in got] == list(range(1, 101)) and {r["n"] for r in got} == {100}
        assert [r["prev_ts"] for r in got][1:] == [r["ts"] for r in got][:-1]


def test_blocks_repeat_only_the_needed_rows(spark):
    df = spark.range(1, 26).select(F.col("id").alias("t"), F.lit(25).alias("n"))
    rows = in_blocks(df, lags=2, block_rows=10).collect()
    own = [r for r in rows if r["own"]]
    halo = sorted((r["t"], r["block"]) for r in rows if not r["own"])
    assert len(own) == 25
    assert halo == [(9, 1), (10, 1), (19, 2), (20, 2)]


def test_quantiles_with_infinities_and_one_value(spark):
    pdf = pd.DataFrame({"a": [1.0] * 500 + [np.inf, -np.inf], "b": [3.0] * 502})
    got = quantiles(spark.createDataFrame(pdf), ["a", "b"], [0.25, 0.5], rows_per_task=1, counted_directly=1).collect()
    assert {r["column"]: (r["q25"], r["q50"]) for r in got} == {"a": (1.0, 1.0), "b": (3.0, 3.0)}


def test_plans_keep_segments_apart(spark):
    """No window of a rank operator is partitioned by the key alone over unaggregated rows."""
    _, df = _skewed(spark)
    plan = index_rows(df, ["key"], ["x", "y"], rows_per_task=1000)._jdf.queryExecution().executedPlan().toString()
    rank = next(line for line in plan.splitlines() if "row_number()" in line)
    assert "_seg" in rank.split("row_number()")[1]


@pytest.mark.parametrize("rows_per_task", [10, 10**9])
def test_null_keys_are_a_group_of_their_own(spark, rows_per_task):
    rows = [(None if i % 2 else "k", float(i), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, x double, y double")
    got = index_rows(df, ["key"], ["x", "y"], pieces=8, rows_per_task=rows_per_task)
    assert {(r["key"], r["n"], r["max(t)"]) for r in got.groupBy("key", "n").agg(F.max("t")).collect()} == {("k", 50, 50), (None, 50, 50)}
    medians = quantiles(df, ["x"], [0.5], by=["key"], pieces=8, counted_directly=rows_per_task).collect()
    assert {r["key"]: r["q50"] for r in medians} == {"k": 49.0, None: 50.0}
