"""Moving averages and dates against pandas; ARIMA by recovering what was simulated."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from tablewright.operators import arima, css, forecast

DATES = {
    "daily": pd.date_range("2024-01-01", periods=40, freq="D"),
    "3 days": pd.date_range("2024-01-01", periods=20, freq="3D"),
    "weekly": pd.date_range("2024-01-03", periods=20, freq="W-WED"),
    "2 weeks": pd.date_range("2024-01-07", periods=20, freq="2W-SUN"),
    "month starts": pd.date_range("2023-02-01", periods=20, freq="MS"),
    "month ends": pd.date_range("2023-01-31", periods=20, freq="ME"),
    "2 months": pd.date_range("2023-01-01", periods=20, freq="2MS"),
    "quarter ends": pd.date_range("2023-03-31", periods=9, freq="QE-DEC"),
    "quarter starts": pd.date_range("2023-02-01", periods=9, freq="QS-NOV"),
    "year ends": pd.date_range("2010-12-31", periods=9, freq="YE-DEC"),
    "year starts": pd.date_range("2010-04-01", periods=9, freq="YS-APR"),
    "business days": pd.date_range("2024-01-04", periods=30, freq="B"),
    "business month ends": pd.date_range("2023-01-31", periods=14, freq="BME"),
    "business month starts": pd.date_range("2023-01-02", periods=14, freq="BMS"),
    "hours": pd.date_range("2024-03-30 22:30", periods=30, freq="h"),
    "15 minutes": pd.date_range("2024-03-30 23:00", periods=30, freq="15min"),
    "10 seconds": pd.date_range("2024-03-30 23:00", periods=30, freq="10s"),
    "millis": pd.date_range("2024-03-30 23:00", periods=30, freq="250ms"),
    "3 rows": pd.date_range("2024-02-28", periods=3, freq="D"),
    "uneven seconds": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:00:25"]),
    "uneven minutes": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:10", "2024-01-01 00:25"]),
    "uneven hours": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 05:00", "2024-01-01 23:00"]),
    "uneven days": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-07"]),
    "off a sunday": pd.to_datetime(["2022-12-20", "2022-12-30", "2023-01-11"]),
    "on a sunday": pd.to_datetime(["2022-12-05", "2022-12-20", "2023-01-08"]),
    "off a month end": pd.to_datetime(["2022-08-20", "2022-11-30", "2023-01-11"]),
    "on a month end": pd.to_datetime(["2022-08-20", "2022-11-30", "2023-01-31"]),
    "equal dates": pd.to_datetime(["2024-01-01", "2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]),
}
ROUGH = [(60, "s", "S"), (3600, "min", "T"), (86400, "h", "H"), (86400 * 7, "D", "D"), (86400 * 31, "W", "W"), (1e18, "ME", "M")]


def _expected(dates: pd.DatetimeIndex) -> tuple[str, list]:
    code = pandas_code = pd.infer_freq(dates)
    if code is None:
        gap = np.diff(dates.astype("datetime64[ns]").astype(np.int64)).mean() / 1e9
        pandas_code, code = next((p, c) for limit, p, c in ROUGH if gap < limit)
    return code, list(pd.date_range(dates[-1], periods=6, freq=pandas_code)[1:].to_pydatetime())


@pytest.fixture(scope="module")
def rhythms(spark):
    rows = [(k, d.to_pydatetime(), float(i)) for k, dates in DATES.items() for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, v double")


def test_frequencies_and_dates_match_pandas(rhythms):
    got = forecast.forecast_sma(rhythms, "ts", "v", 5, by=["series"]).toPandas()
    for name, dates in DATES.items():
        mine = got[got["series"] == name].sort_values("step")
        code, ahead = _expected(dates)
        assert (mine["frequency"] == code).all(), (name, mine["frequency"].iloc[0], code)
        assert [t.to_pydatetime() for t in mine["ts"]] == ahead, name


def test_session_zone_does_not_shift_dates(spark, rhythms):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = forecast.forecast_sma(rhythms.where("series IN ('hours', 'daily')"), "ts", "v", 5, by=["series"]).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in ("hours", "daily"):
        assert sorted(r["ts"] for r in got if r["series"] == name) == _expected(DATES[name])[1]


@pytest.mark.parametrize("n,window", [(3, 5), (4, 5), (5, 5), (16, 5), (17, 5), (20, 6), (40, 12)])
def test_window_and_interval(spark, n, window):
    v = np.random.default_rng(n).normal(size=n)
    pdf = pd.DataFrame({"d": pd.date_range("2024-01-01", periods=n).astype(str), "v": v})
    rows = forecast.forecast_sma(spark.createDataFrame(pdf), "d", "v", 4).orderBy("step").collect()
    tail = pd.Series(v).tail(window)
    assert len(rows) == 4 and rows[0]["window_size"] == window
    assert np.isclose(rows[3]["value"], tail.mean())
    assert np.isclose(rows[0]["lower"], tail.mean() - 1.96 * tail.std())
    assert np.isclose(rows[0]["upper"], tail.mean() + 1.96 * tail.std())


def test_missing_values_count_in_the_window_but_not_in_the_mean(spark):
    rows = [(dt.date(2024, 1, i + 1), v) for i, v in enumerate([9.0, 9.0, 9.0, None, 1.0, float("nan"), 3.0, 2.0])]
    got = forecast.forecast_sma(spark.createDataFrame(rows, "d date, v double"), "d", "v", 1).first()
    assert got["value"] == 2.0 and got["window_size"] == 5


def test_short_series_and_bad_dates(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-02", 2.0)], "k string, d string, v double")
    row = forecast.forecast_sma(df, "d", "v", 3, by=["k"]).collect()
    assert len(row) == 1 and row[0]["step"] is None and row[0]["error"] and row[0]["value"] is None
    for bad in ("2024-13-77", None):
        broken = df.unionByName(spark.createDataFrame([("a", bad, 1.0)], df.schema))
        with pytest.raises(PySparkException):
            forecast.forecast_sma(broken, "d", "v", 3, by=["k"]).collect()
    with pytest.raises(ValueError, match="nope"):
        forecast.forecast_sma(df, "d", "nope")


def test_equal_dates_are_ordered_by_value(spark):
    rows = [("2024-01-01", float(i)) for i in range(10)] + [("2023-12-30", 50.0), ("2023-12-31", 70.0)]
    got = forecast.forecast_sma(spark.createDataFrame(rows, "d string, v double"), "d", "v", 1).first()
    assert got["value"] == np.mean([5, 6, 7, 8, 9])


def test_differences(spark):
    v = [5.0, 7.0, None, 4.0, 10.0]
    rows = [(dt.date(2024, 1, i + 1), x) for i, x in enumerate(v)]
    got = forecast.differences(spark.createDataFrame(rows, "d date, v double"), "d", "v").orderBy("t").collect()
    assert [(r["t"], r["diff"]) for r in got] == [(2, 2.0), (5, 6.0)]


def test_order_rule(spark):
    df = spark.createDataFrame([(n,) for n in (3, 9, 20, 39, 40, 59, 1000)], "n long")
    p, q = forecast.arima_pq(df["n"])
    assert [tuple(r) for r in df.select(p, q).collect()] == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (5, 2)]


def test_chart_series(spark, rhythms):
    one = rhythms.where("series = 'daily'").drop("series")
    chart = forecast.chart_series(one, "ts", "v", forecast.forecast_sma(one, "ts", "v", 7))
    assert {r["kind"]: r["count"] for r in chart.groupBy("kind").count().collect()} == {"history": 40, "forecast": 7}


def _arma(rng, n, ar=(), ma=(), const=0.0, integrate=0):
    e, y = rng.normal(size=n + 300), np.zeros(n + 300)
    for t in range(5, n + 300):
        y[t] = const + e[t] + sum(a * y[t - 1 - i] for i, a in enumerate(ar)) + sum(b * e[t - 1 - i] for i, b in enumerate(ma))
    y = y[300:]
    for _ in range(integrate):
        y = np.cumsum(y)
    return y


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(4)
    data = {
        "ar": _arma(rng, 4000, ar=[0.6, -0.3], const=2.0),
        "arma": _arma(rng, 4000, ar=[0.7], ma=[0.4], const=50.0),
        "walk": _arma(rng, 1500, integrate=1),
        "smooth": _arma(rng, 1500, ar=[0.3], integrate=2),
        "flat": np.full(60, 4.0),
        "tiny": np.array([1.0, 2.0, 1.5, 3.0]),
        "pair": np.array([1.0, 2.0]),
    }
    rows = [(k, d.to_pydatetime(), float(x)) for k, v in data.items() for d, x in zip(pd.date_range("2010-01-01", periods=len(v)), v)]
    return data, spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")


def test_arima_orders_and_fallback(simulated):
    data, df = simulated
    got = {r["k"]: r for r in arima.fit_arima(df, "ts", "v", 3, by=["k"]).collect()}
    for k in ("ar", "arma", "walk", "smooth"):
        y = data[k]
        unstable = _unit_root_directly(y, 12) > 0.05
        assert got[k]["d"] == unstable * (1 + (_unit_root_directly(np.diff(y), 12) > 0.05)), k
    assert got["ar"]["d"] == got["arma"]["d"] == 0 and got["walk"]["d"] == 1
    assert (got["ar"]["p"], got["ar"]["q"]) == (5, 2)
    rows = arima.forecast_arima(df, "ts", "v", 3, by=["k"]).collect()
    count = {k: sum(r["k"] == k and r["step"] is not None for r in rows) for k in data}
    assert count == {**dict.fromkeys(data, 3), "pair": 0}
    flat = next(r for r in rows if r["k"] == "flat")
    assert flat["model"] == "sma" and flat["error"] and flat["value"] == 4.0 and flat["window_size"] == 18
    walk = sorted((r["step"], r["value"], r["upper"] - r["lower"]) for r in rows if r["k"] == "walk")
    assert abs(walk[0][1] - data["walk"][-1]) < 4 and walk[0][2] < walk[1][2] < walk[2][2]


def test_arima_recovers_coefficients_whatever_the_block_size(simulated):
    data, df = simulated
    ar = df.where("k = 'ar'").drop("k")
    big = arima.fit_arima(ar, "ts", "v", 2, order=(2, 0, 0)).first()
    small = arima.fit_arima(ar, "ts", "v", 2, order=(2, 0, 0), block_rows=300).first()
    assert np.allclose(big["ar"], [0.6, -0.3], atol=0.05) and abs(big["sigma2"] - 1) < 0.08
    assert np.allclose(big["ar"], small["ar"]) and np.allclose(big["values"], small["values"])
    mixed = arima.fit_arima(df.where("k = 'arma'"), "ts", "v", 2, by=["k"], order=(1, 0, 1)).first()
    assert abs(mixed["ar"][0] - 0.7) < 0.06 and abs(mixed["ma"][0] - 0.4) < 0.08
    assert abs(mixed["const"] / (1 - mixed["ar"][0]) - data["arma"].mean()) < 1


def test_arima_interval_covers(spark):
    rng = np.random.default_rng(23)
    runs = {f"s{i:03d}": _arma(rng, 161, ar=[0.5], const=1.0) for i in range(120)}
    rows = [(k, d.to_pydatetime(), float(x)) for k, v in runs.items() for d, x in zip(pd.date_range("2020-01-01", periods=160), v)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    got = arima.forecast_arima(df, "ts", "v", 1, by=["k"], confidence=0.9, order=(1, 0, 1)).collect()
    inside = np.mean([r["lower"] <= runs[r["k"]][-1] <= r["upper"] for r in got])
    assert len(got) == 120 and 0.8 <= inside <= 0.97


def _unit_root_directly(y, max_lag):
    """The unit-root test by ordinary least squares on the whole series."""
    n, dy = len(y), np.diff(y)
    lags = min(max_lag, int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)

    def fit(k, first):
        t = np.arange(first, n)
        x = np.column_stack([y[t - 1], np.ones(len(t)), *[dy[t - 1 - j] for j in range(1, k + 1)]])
        beta, *_ = np.linalg.lstsq(x, dy[t - 1], rcond=None)
        error = ((dy[t - 1] - x @ beta) ** 2).sum()
        scale = np.sqrt(error / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
        return beta[0] / scale, len(t) * np.log(error / len(t)) + 2 * x.shape[1]

    best = min(range(lags + 1), key=lambda k: fit(k, lags + 1)[1])
    return arima.df_pvalue(fit(best, best + 1)[0])


@pytest.mark.parametrize("n", [12, 15, 31, 100, 700])
def test_unit_root_from_sums_equals_least_squares(n):
    for seed in range(5):
        y = np.cumsum(np.random.default_rng(seed).normal(size=n)) + 1000
        basis = arima._basis(y, arima._depth(n, 12))
        basis = basis[~np.isnan(basis).any(axis=1)]
        sums = arima._Moments(basis.T @ basis, y[: arima.EDGE])
        assert np.isclose(arima._unit_root(sums, 0, n, 12), _unit_root_directly(y, 12), atol=1e-6)
        assert np.isclose(arima._unit_root(sums, 1, n - 1, 12), _unit_root_directly(np.diff(y), 12), atol=1e-6)


def test_arima_lags_follow_the_rule_and_the_order(spark):
    """Lags past 12 decide the differences of a series with a long season, and a long order uses all its lags."""
    rng = np.random.default_rng(24)
    y = rng.normal(size=2000)
    for t in range(24, 2000):
        y[t] += 0.99 * y[t - 24]
    days = pd.date_range("2010-01-01", periods=2000)
    df = spark.createDataFrame([(d.to_pydatetime(), float(x)) for d, x in zip(days, y)], "ts timestamp_ntz, v double")
    rule = 10**6  # no cap: the rule's own number of lags
    assert _unit_root_directly(y, 12) < 0.05 < _unit_root_directly(y, rule)
    want = 1 + (_unit_root_directly(np.diff(y), rule) > 0.05)
    for block_rows in (65536, 300):
        got = arima.fit_arima(df, "ts", "v", 3, block_rows=block_rows).first()
        assert got["error"] is None and got["d"] == want
    assert arima.fit_arima(df, "ts", "v", 3, max_lag=12).first()["d"] == 0
    long = arima.fit_arima(df, "ts", "v", 1, order=(36, 0, 0)).first()
    assert long["error"] is None and len(long["ar"]) == 36
    assert np.isclose(long["values"][0], long["const"] + np.dot(long["ar"], y[:-37:-1]))


def test_unit_root_pvalues():
    # well-known critical values of the test with a constant: 1 %, 5 %, 10 %
    assert abs(arima.df_pvalue(-3.43) - 0.01) < 0.002
    assert abs(arima.df_pvalue(-2.86) - 0.05) < 0.003
    assert abs(arima.df_pvalue(-2.57) - 0.10) < 0.005
    assert arima.df_pvalue(5) == 1 and arima.df_pvalue(-30) == 0


def test_a_null_key_is_a_series(spark):
    rng = np.random.default_rng(2)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(x)) for k in (None, "a") for i, x in enumerate(rng.normal(size=60))]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    for model in ("sma", "arima"):
        got = arima.forecast(df, "d", "v", 2, model=model, by=["k"]).collect()
        assert sorted((str(r["k"]), r["step"], r["model"]) for r in got) == [
            ("None", 1, model), ("None", 2, model), ("a", 1, model), ("a", 2, model),
        ]
    with pytest.raises(ValueError, match="step"):
        forecast.forecast_sma(df.withColumnRenamed("k", "step"), "d", "v", 2, by=["step"])


def test_model_choice(spark, rhythms):
    daily = rhythms.where("series = 'daily'").drop("series")
    assert arima.forecast(daily, "ts", "v", 2, model="prophet").first()["model"] == "sma"


def test_arima_forecasts_over_missing_rows(spark):
    """A hole among the last rows widens the interval, and never counts as the value 0."""
    noise = np.random.Generator(np.random.Philox(key=3)).normal(size=200)
    level = [0.0, 0.0]
    for e in noise:
        level.append(0.5 * level[-1] + 0.3 * level[-2] + float(e))
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(len(level))]
    rows = []
    for k, holes in (("full", ()), ("last", (1,)), ("inner", (2, 60, 61))):
        rows += [(k, d, None if len(days) - i in holes else 1000 + v) for i, (d, v) in enumerate(zip(days, level))]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    got = {}
    for block_rows in (65536, 70):
        fits = arima.fit_arima(df, "d", "v", 3, by=["k"], order=(2, 0, 1), block_rows=block_rows).collect()
        got[block_rows] = {r["k"]: r for r in fits}
        assert all(r["error"] is None for r in fits)
    for k in ("full", "last", "inner"):
        one, cut = got[65536][k], got[70][k]
        assert np.allclose(one["values"], cut["values"], atol=1e-3) and np.isclose(one["aic"], cut["aic"], atol=1e-5)
        assert min(one["values"]) > 900
    width = {k: r["uppers"][0] - r["lowers"][0] for k, r in got[65536].items()}
    assert width["last"] > 1.05 * width["full"] and width["inner"] > 0.9 * width["full"]
    # The whole series' filter by hand.
    one, orders = got[65536]["inner"], css.Orders(2, 0, 1)
    beta, y = np.array([one["const"], *one["ar"], *one["ma"]]), np.array([r[2] if r[2] is not None else np.nan for r in rows[-len(days) :]])
    move, add, load, read = css.transition(orders, beta)
    mean, spread = css.known_state(y[:2], orders), np.zeros((3, 3))
    for value in y[2:]:
        mean, spread = move @ mean + add, move @ spread @ move.T + one["sigma2"] * np.outer(load, load)
        if not np.isnan(value):
            gain = spread @ read / (read @ spread @ read)
            mean, spread = mean + gain * (value - read @ mean), spread - np.outer(gain, read @ spread)
    assert np.allclose(css.ahead(mean, spread, orders, beta, one["sigma2"], 3)[0], one["values"])


def test_unit_root_tests_skip_missing_rows(spark):
    y = np.cumsum(np.random.default_rng(8).normal(size=400))
    days = pd.date_range("2020-01-01", periods=500)
    full = [(d.to_pydatetime(), float(v)) for d, v in zip(days, y)]
    gaps = [(d.to_pydatetime(), None) for d in days[400:450]]
    df = spark.createDataFrame(full + gaps, "ts timestamp_ntz, v double")
    for block_rows in (65536, 90):
        got = arima.unit_root_tests(df, "ts", "v", block_rows=block_rows).first()
        assert got["n"] == 400 and np.isclose(got["p_value"], _unit_root_directly(y, 10**6), atol=1e-6)
    # Holes inside: the test goes over the rows that are there, and over the differences that are.
    y[37:390:9] = np.nan
    df = spark.createDataFrame([(d.to_pydatetime(), None if np.isnan(v) else float(v)) for d, v in zip(days, y)], "ts timestamp_ntz, v double")
    steps = np.diff(y)
    unstable = _unit_root_directly(y[~np.isnan(y)], 10**6) > 0.05
    want = unstable * (1 + (_unit_root_directly(steps[~np.isnan(steps)], 10**6) > 0.05))
    assert arima.fit_arima(df, "ts", "v", 2, max_order=(1, 2, 1)).first()["d"] == want
