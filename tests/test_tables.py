"""Cleaning, transforms, profile, distributions and facts against pandas and numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.columns import column_class, columns_of_class, nan_to_null
from tablewright.operators import clean, distribution, facts, profile, transform, validate


@pytest.fixture(scope="module")
def staff():
    rng = np.random.default_rng(3)
    n = 400
    pay = rng.normal(90000, 20000, n).round(2)
    pay[rng.random(n) < 0.1] = np.nan
    unit = rng.choice(["Sales", "Ops", "HR", None], n, p=[0.5, 0.3, 0.15, 0.05])
    return pd.DataFrame(
        {
            "id": np.arange(n),
            "unit": unit,
            "pay": pay,
            "age": rng.integers(20, 60, n),
            "level": np.full(n, 2.0),
            "since": pd.Timestamp("2015-01-01") + pd.to_timedelta(rng.integers(0, 3000, n), unit="D"),
        }
    )


@pytest.fixture(scope="module")
def table(spark, staff):
    rows = [[None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r] for r in staff.itertuples(index=False)]
    rows = [[int(r[0]), r[1], r[2], int(r[3]), r[4], r[5]] for r in rows]
    return spark.createDataFrame(rows, "id long, unit string, pay double, age int, level double, since timestamp_ntz")


def test_column_classes(spark):
    df = spark.createDataFrame([], "a int, b decimal(5,2), c string, d date, e boolean, f array<int>, g timestamp")
    assert [column_class(f.dataType) for f in df.schema.fields] == [
        "numeric", "numeric", "categorical", "date", "boolean", "categorical", "date",
    ]
    assert columns_of_class(df, "date", "boolean") == ["d", "e", "g"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 2), (3.0, None)], "x double, y int")
    assert [r["x"] for r in nan_to_null(df).collect()] == [None, None, 3.0]
    assert {r["column"]: r["missing"] for r in profile.missing(df).collect()} == {"x": 2, "y": 1}
    assert profile.complete_rows(df).first().asDict() == {"rows": 3, "complete_rows": 0, "share": 0.0}


def test_validate(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b double")
    assert validate.validate(df, ["a"]).first()["errors"] == ["Columns with all null values: b"]
    got = validate.validate(df.select("a"), ["a"]).first()
    assert got["valid"] and got["errors"] == []
    assert validate.validate(df.where("a > 5"), ["zz"]).first()["errors"] == ["DataFrame is empty"]
    assert validate.validate(df, ["zz", "q"]).first()["errors"][0] == "Missing required columns: zz, q"


@pytest.mark.parametrize("strategy", ["mean", "median", "zero"])
def test_fill_numbers(table, staff, strategy):
    want = {"mean": staff["pay"].mean(), "median": staff["pay"].median(), "zero": 0.0}[strategy]
    got = clean.fill_missing(table, strategy).toPandas().sort_values("id")
    assert np.allclose(got["pay"], staff["pay"].fillna(want))
    assert (got["unit"] == staff["unit"].fillna("Unknown")).all()
    assert dict(clean.fill_missing(table, "median").dtypes)["age"] == "double"


def test_fill_mode_ties_and_empty_columns(spark):
    df = spark.createDataFrame(
        [("b", 1, None, None), ("a", 2, None, None), ("a", 2, None, True), ("b", None, None, True), (None, 1, None, False)],
        "k string, v int, x double, ok boolean",
    )
    rows = clean.fill_missing(df, "mode").collect()
    assert sorted(r["k"] for r in rows) == ["a", "a", "a", "b", "b"]
    assert sorted(r["v"] for r in rows) == [1, 1, 1, 2, 2]
    assert {r["x"] for r in rows} == {None}
    assert [r["ok"] for r in rows].count(True) == 4
    modes = clean.column_modes(df).first().asDict()
    assert modes == {"k": "a", "v": 1, "x": None, "ok": True}


def test_drop_unknown_strategy_and_none(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("c", float("nan"))], "k string, v double")
    assert [tuple(r) for r in clean.fill_missing(df, "drop").collect()] == [("a", 1.0)]
    assert sorted((r["k"], r["v"]) for r in clean.fill_missing(df, "whatever").collect() if r["v"]) == [("Unknown", 2.0), ("a", 1.0)]
    assert clean.fill_missing(df, None).where("k IS NULL").count() == 1


def test_dates_and_booleans_stay_null(spark):
    df = spark.createDataFrame([(None, None, None)], "d date, b boolean, s string")
    assert tuple(clean.fill_missing(df, "mean").first()) == (None, None, "Unknown")


def test_clean_is_idempotent_and_counts_copies(table):
    twice = table.unionByName(table)
    once = clean.clean(twice, "mean")
    assert once.count() == table.count()
    assert clean.clean(once, "mean").exceptAll(once).count() == 0
    report = {(r["step"], r["column"]): r["count"] for r in clean.cleaning_report(twice, "mean").collect()}
    assert report[("remove_duplicates", None)] == table.count()
    assert report[("fill", "pay")] == 2 * table.where("pay IS NULL").count()
    dropped = clean.cleaning_report(table, "drop", dedupe=False).collect()
    assert [(r["step"], r["count"]) for r in dropped] == [("drop_rows", table.where("pay IS NULL OR unit IS NULL").count())]


def test_rows_differing_only_by_null_are_not_copies(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", 1)], "k string, v int")
    assert clean.remove_duplicates(df).count() == 2


def test_nested_columns_are_deduplicated(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}, [1]), (1, {"b": 2, "a": 1}, [1]), (1, None, [2])], "x int, m map<string,int>, l array<int>")
    assert clean.clean(df, "mean").count() == 2
    assert clean.clean(df, "mode").where("m IS NULL").count() == 1


def test_transforms(table, staff):
    got = transform.normalize(table, ["pay", "level"]).toPandas().sort_values("id")
    span = staff["pay"].max() - staff["pay"].min()
    assert np.allclose(got["pay"], (staff["pay"] - staff["pay"].min()) / span, equal_nan=True)
    assert (got["level"] == 0).all()
    got = transform.scale(table, ["pay", "level"]).toPandas().sort_values("id")
    assert np.allclose(got["pay"], (staff["pay"] - staff["pay"].mean()) / staff["pay"].std(), equal_nan=True)
    assert (got["level"] == 0).all()
    got = transform.clip_outliers(table, ["pay"], reach=0.5).toPandas().sort_values("id")
    q1, q3 = staff["pay"].quantile([0.25, 0.75])
    assert np.allclose(got["pay"], staff["pay"].clip(q1 - 0.5 * (q3 - q1), q3 + 0.5 * (q3 - q1)), equal_nan=True)


def test_clean_text_and_one_hot(spark):
    df = spark.createDataFrame([("  a \t\n b ",), ("   ",), (None,)], "s string")
    assert [r["s"] for r in transform.clean_text(df, ["s"]).collect()] == ["a b", None, None]
    hot = transform.one_hot(spark.createDataFrame([("x",), ("y",), (None,)], "s string"), "s")
    assert sorted(tuple(r) for r in hot.collect()) == [(0, 0), (0, 1), (1, 0)] and hot.columns == ["s_x", "s_y"]
    with pytest.raises(ValueError):
        transform.one_hot(spark.range(20), "id", max_values=10)


def test_describe(table, staff):
    got = profile.describe(table).toPandas().set_index("column")
    for c in ("id", "pay", "age", "level"):
        want = staff[c].describe()
        assert np.allclose(
            got.loc[c, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]].astype(float),
            want[["count", "mean", "std", "min", "25%", "50%", "75%", "max"]],
        )
    rough = profile.describe(table, ["pay"], exact=False).first()
    assert abs(rough["q50"] - staff["pay"].median()) < staff["pay"].std() / 5


def test_describe_text_and_summary(table, staff):
    row = profile.describe_text(table).first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (
        staff["unit"].count(), 3, "Sales", int((staff["unit"] == "Sales").sum()),
    )
    s = profile.summary(table, "/a/b.csv", F.lit(2048)).first()
    missing = int(staff.isna().sum().sum())
    assert (s["file_name"], s["file_size_kb"], s["rows"], s["columns"], s["missing_values"]) == ("b.csv", 2.0, 400, 6, missing)
    assert s["missing_percentage"] == round(missing / 2400 * 100, 2)
    assert (s["n_numeric"], s["n_categorical"], s["n_date"]) == (4, 1, 1)
    stats = {r["column"]: r for r in profile.summary(table, with_stats=True).first()["stats"]}
    assert np.isclose(stats["pay"]["q50"], staff["pay"].median()) and set(stats) == {"id", "pay", "age", "level"}


@pytest.mark.parametrize("values,with_null,listed", [(19, False, True), (19, True, False), (20, False, False)])
def test_value_count_gate(spark, values, with_null, listed):
    rows = [(f"v{i:02d}",) for i in range(values) for _ in range(i + 1)] + ([(None,)] if with_null else [])
    got = profile.value_counts(spark.createDataFrame(rows, "k string")).orderBy(F.desc("count")).collect()
    assert bool(got) == listed
    if listed:
        assert [(r["value"], r["count"]) for r in got] == [(f"v{i:02d}", i + 1) for i in range(18, 8, -1)]


def test_distinct_counts(table, staff):
    want = {c: len(staff[c].unique()) for c in staff}
    assert {r["column"]: r["distinct_values"] for r in profile.distinct_counts(table).collect()} == want
    rough = {r["column"]: r["distinct_values"] for r in profile.distinct_counts(table, exact=False).collect()}
    texts = table.sparkSession.createDataFrame([("x" * 500 + str(i % 7),) for i in range(30)] + [("x",), (None,)], "s string")
    assert profile.distinct_counts(texts).first()["distinct_values"] == 9
    assert rough["unit"] == want["unit"] and abs(rough["id"] - want["id"]) < 60


def test_column_details(table, staff):
    got = {r["column"]: r for r in profile.column_details(table).collect()}
    assert got["unit"]["unique_values"] == 3 and got["unit"]["top_values"][0]["value"] == "Sales"
    assert np.isclose(got["pay"]["median"], staff["pay"].median())
    assert got["since"]["type"] == "timestamp_ntz" and got["since"]["min"] is None
    assert np.isclose(got["pay"]["missing_percentage"], staff["pay"].isna().mean() * 100)


def test_description_lines(table):
    lines = [r["line"] for r in profile.description_lines(table).orderBy("line_no").collect()]
    assert lines[0] == "DataFrame shape: 400 rows, 6 columns"
    assert lines[1] == "Columns: id, unit, pay, age, level, since"
    assert any(x.startswith("  - pay: count ") for x in lines)
    assert lines[-1].startswith("  - unit: {'Sales': ")


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=3000), "b": rng.exponential(size=3000), "c": np.repeat([1.0, 2.0, 2.0, 2.0, 2.0, 9.0], 500)})
    got = distribution.histogram(spark.createDataFrame(pdf)).toPandas()
    for c in pdf:
        counts, edges = np.histogram(pdf[c], bins="auto")
        mine = got[got["column"] == c].sort_values("bin")
        assert mine["count"].tolist() == counts.tolist()
        assert np.allclose(mine["low"], edges[:-1]) and np.allclose(mine["high"], edges[1:])


def test_histogram_of_integers_and_a_constant(spark):
    pdf = pd.DataFrame({"i": np.arange(1000) % 3, "k": np.full(1000, 7)})
    got = distribution.histogram(spark.createDataFrame(pdf)).toPandas()
    counts, edges = np.histogram(pdf["i"], bins="auto")
    mine = got[got["column"] == "i"].sort_values("bin")
    assert mine["count"].tolist() == counts.tolist()
    flat = got[got["column"] == "k"]
    assert flat[["low", "high", "count"]].values.tolist() == [[6.5, 7.5, 1000]]


def test_density_close_to_direct_sum(spark):
    x = np.random.default_rng(9).normal(size=800)
    got = distribution.density(spark.createDataFrame(pd.DataFrame({"x": x}))).toPandas().sort_values("point")
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.exp(-(((grid[:, None] - x) / h) ** 2) / 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose(got["x"], grid) and np.abs(got["density"] - want).max() < 1e-11 * want.max()


def test_boxes_and_outliers(spark):
    x = np.array([1.0, 2, 3, 4, 5, 6, 7, 8, 9, 50, -40])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "id": np.arange(len(x))}))
    box = distribution.boxes(df, ["x"]).first()
    assert (box["whisker_low"], box["median"], box["whisker_high"], box["outliers"]) == (1.0, 5.0, 9.0, 2)
    assert sorted(tuple(r) for r in distribution.outliers(df, ["x"], ["id"]).collect()) == [(9, "x", 50.0), (10, "x", -40.0)]


def test_correlations(table, staff):
    got = distribution.correlations(table).toPandas().pivot(index="column_x", columns="column_y", values="corr")
    want = staff[["id", "pay", "age", "level"]].corr()
    names = ["id", "pay", "age"]
    assert np.allclose(got.loc[names, names], want.loc[names, names])
    assert got.loc["level"].isna().all()
    assert distribution.correlations(table, ["pay"]).collect() == []


def test_pair_bins_hold_all_complete_rows(table, staff):
    got = distribution.pair_bins(table, ["pay", "age", "level"], bins=5).toPandas()
    sums = got.groupby(["column_x", "column_y"])["count"].sum()
    assert sums[("pay", "age")] == staff["pay"].count() and sums[("age", "level")] == len(staff)
    assert got["x_bin"].between(0, 4).all()
    with pytest.raises(ValueError):
        distribution.pair_bins(table, ["pay"])


def test_top_values(table, staff):
    got = [(r["value"], r["count"]) for r in distribution.top_values(table, top=2).collect()]
    assert got == list(staff["unit"].value_counts().head(2).items())


def test_facts(table, staff):
    got = facts.measure_by(table, "pay", "unit").toPandas().set_index("unit")
    want = staff.groupby("unit")["pay"].agg(["count", "mean", "median", "min", "max"])
    assert np.allclose(got.loc[want.index].astype(float), want)
    shares = facts.group_share(table, "unit").collect()
    assert [r["unit"] for r in shares] == ["Sales", "Ops", "HR"] and np.isclose(sum(r["share"] for r in shares), 1)
    gap = facts.group_gap(table, "pay", "unit").first()
    means = want["mean"]
    assert (gap["highest"], gap["lowest"]) == (means.idxmax(), means.idxmin())
    assert np.isclose(gap["gap_percent"], (means.max() / means.min() - 1) * 100)
    c = facts.correlation(table, "age", "pay").first()
    assert np.isclose(c["corr"], staff["age"].corr(staff["pay"])) and c["rows"] == staff["pay"].count()
    assert facts.correlation(table, "age", "level").first()["corr"] is None
    years = {(r["year"], r["unit"]): r["count"] for r in facts.rows_by_year(table, "since", "unit").collect()}
    assert years == staff.groupby([staff["since"].dt.year, "unit"]).size().to_dict()
    best = facts.top_per_category(table.where("unit IS NOT NULL"), "unit", [F.desc("pay"), F.col("id")], 2)
    assert best.groupBy("unit").count().collect()[0]["count"] == 2


def test_tenure(spark):
    df = spark.createDataFrame([(100.0, dt.date(2010, 1, 1)), (50.0, dt.date(2019, 1, 1)), (50.0, dt.date(2015, 6, 1))], "pay double, d date")
    r = facts.tenure_split(df, "pay", "d", "2020-06-01").first()
    assert (r["n_above"], r["n_up_to"], r["mean_above"], r["difference_percent"]) == (1, 2, 100.0, 100.0)


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (3.0, "a")], "`a.b` double, `c d` string")
    assert sorted(r["a.b"] for r in clean.clean(df, "mean", dedupe=False).collect()) == [1.0, 2.0, 3.0]
    assert profile.describe(df).first()["q50"] == 2.0
    assert distribution.top_values(df).first()["count"] == 2
    assert clean.column_modes(df).first()["c d"] == "a"
