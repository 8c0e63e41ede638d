"""Every registered query against its SQL, run by another engine on the same files."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from tablewright.plans import catalog, inputs

SPARK_TO_SQL = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def other(sf_dir):
    engine = duckdb.connect()
    for t in inputs.TABLES:
        engine.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return engine


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, other, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    result = other.execute(catalog.SQL[name])
    described = {d[0]: str(d[1]) for d in result.description}
    assert {n: SPARK_TO_SQL[t] for n, t in df.dtypes} == described
    order = [list(described).index(n) for n in names]
    want = [tuple(r[i] for i in order) for r in result.fetchall()]
    assert _sorted(tuple(r[n] for n in names) for r in df.collect()) == _sorted(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_give_rows(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and all(r["error"] is None for r in rows)


def test_entry(spark):
    path = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())


def test_no_cross_joins(spark, sf_dir):
    for name in ("clean_mean", "transform_scale", "transform_clip", "fact_group_share", "dist_histogram", "dist_kde", "pair_bins"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_scans_read_only_what_is_needed(spark, sf_dir):
    plan = catalog.QUERIES["sql_filter_limit"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan
    assert "l_comment" not in plan and "l_shipdate" not in plan
