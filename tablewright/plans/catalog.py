"""Every operator as a named query over the given tables, with the same result stated in plain SQL.

A query takes ``(spark, folder)`` and returns a DataFrame; its SQL runs in any
engine where the tables are views.  Inputs that both sides share (tables with
gaps or copies made from the given ones) are written once, as SQL.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import checkpointed, shared_folder
from tablewright.operators import arima, clean, distribution, extract, facts, forecast, profile, transform, validate
from tablewright.plans import inputs, runs
from tablewright.functions import ranks
from tablewright.sources import documents, files, sinks, tables
from tablewright.streaming import ledger, watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def made(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Input made from given tables by SQL that names them as ``{name}``."""
    used = {n: table(spark, folder, n) for n in inputs.TABLES if "{" + n + "}" in sql}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The same SQL with bare table names."""
    return sql.format(**{n: n for n in inputs.TABLES})


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


ORDERS = plain(inputs.ORDERS_WITH_GAPS)
CUSTOMERS = plain(inputs.CUSTOMERS_WITH_GAPS)


# --- sources -----------------------------------------------------------------------------------------------------


@query(
    "scan_parquet",
    """SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS quantity,
              round(avg(l_extendedprice), 4) AS mean_price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def scan_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return (
        files.load(spark, f"{folder}/lineitem.parquet")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n"),
            F.sum("l_quantity").alias("quantity"),
            F.round(F.avg("l_extendedprice"), 4).alias("mean_price"),
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
        )
    )


@query(
    "file_type_counts",
    f"""SELECT file_type, file_type IN ('.csv', '.xls', '.xlsx', '.json', '.parquet') AS supported,
               CAST(count(*) AS BIGINT) AS files
        FROM (SELECT lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS file_type FROM ({plain(inputs.FILE_NAMES)}) f) t
        GROUP BY 1, 2""",
)
def file_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    names = made(spark, folder, inputs.FILE_NAMES)
    return names.groupBy(
        files.file_type(F.col("path")).alias("file_type"), files.is_supported(F.col("path")).alias("supported")
    ).agg(F.count("*").alias("files"))


@query("table_scan_limit", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM orders LIMIT 10000) t")
def table_scan_limit(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").createOrReplaceTempView("tw_orders")
    return tables.load_table(spark, "tw_orders", limit=10000).agg(F.count("*").alias("n"))


_FILTERED = """SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} WHERE l_returnflag = 'R'
               ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100"""
_GROUPED = """SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total
              FROM {orders} GROUP BY o_orderpriority ORDER BY o_orderpriority"""


@query("sql_filter_limit", plain(_FILTERED))
def sql_filter_limit(spark: SparkSession, folder: str) -> DataFrame:
    return tables.query(spark, _FILTERED, lineitem=table(spark, folder, "lineitem"))


@query("sql_group_sum", plain(_GROUPED))
def sql_group_sum(spark: SparkSession, folder: str) -> DataFrame:
    return tables.query(spark, _GROUPED, orders=table(spark, folder, "orders"))


# --- classes and validation --------------------------------------------------------------------------------------


@query(
    "column_classes",
    " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS type, '{k}' AS class,
                   CAST(count({c}) AS BIGINT) AS present FROM ({ORDERS}) o"""
        for i, (c, t, k) in enumerate(
            [
                ("o_orderkey", "bigint", "numeric"),
                ("o_custkey", "bigint", "numeric"),
                ("o_orderstatus", "string", "categorical"),
                ("o_totalprice", "double", "numeric"),
                ("o_orderdate", "timestamp_ntz", "date"),
                ("o_orderpriority", "string", "categorical"),
            ]
        )
    ),
)
def column_classes(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_listing(made(spark, folder, inputs.ORDERS_WITH_GAPS))


@query(
    "validate_table",
    f"""SELECT count(*) > 0 AND count(nothing) > 0 AS valid,
               CASE WHEN count(*) = 0 THEN 'DataFrame is empty'
                    ELSE 'Missing required columns: region_code, branch'
                         || CASE WHEN count(nothing) = 0 THEN '; Columns with all null values: nothing' ELSE '' END
               END AS errors
        FROM (SELECT *, NULLIF(c_custkey, c_custkey) AS nothing FROM ({CUSTOMERS}) c) t""",
)
def validate_table(spark: SparkSession, folder: str) -> DataFrame:
    df = made(spark, folder, inputs.CUSTOMERS_WITH_GAPS)
    df = df.withColumn("nothing", F.nullif(F.col("c_custkey"), F.col("c_custkey")))
    checked = validate.validate(df, ["c_custkey", "region_code", "branch"])
    return checked.select("valid", F.array_join("errors", "; ").alias("errors"))


# --- cleaning ----------------------------------------------------------------------------------------------------


def _filled(number: str, status: str) -> str:
    """Orders with gaps, numbers made double and filled, the status filled."""
    return f"""SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
                      coalesce(o_orderstatus, {status}) AS o_orderstatus,
                      round(coalesce(o_totalprice, {number}), 4) AS o_totalprice, o_orderdate, o_orderpriority
               FROM ({ORDERS}) o"""


def _cleaned(strategy: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(clean.fill_missing(made(spark, folder, inputs.ORDERS_WITH_GAPS), strategy), 4, "o_totalprice")

    return run


query(
    "clean_drop",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority
        FROM ({ORDERS}) o WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL""",
)(_cleaned("drop"))
query("clean_mean", _filled(f"(SELECT avg(o_totalprice) FROM ({ORDERS}) m)", "'Unknown'"))(_cleaned("mean"))
query("clean_median", _filled(f"(SELECT quantile_cont(o_totalprice, 0.5) FROM ({ORDERS}) m)", "'Unknown'"))(
    _cleaned("median")
)


def _most_frequent(column: str) -> str:
    return f"""(SELECT {column} FROM ({ORDERS}) m WHERE {column} IS NOT NULL
                GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"""


query(
    "clean_mode",
    f"""SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, {_most_frequent("o_orderstatus")}) AS o_orderstatus,
               round(coalesce(o_totalprice, {_most_frequent("o_totalprice")}), 4) AS o_totalprice, o_orderdate,
               o_orderpriority FROM ({ORDERS}) o""",
)(_cleaned("mode"))
query(
    "clean_zero",
    f"""SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, 'Unknown') AS o_orderstatus,
               round(coalesce(o_totalprice, 0), 4) AS o_totalprice, o_orderdate, o_orderpriority FROM ({ORDERS}) o""",
)(_cleaned("zero"))


@query("clean_dedup", f"SELECT DISTINCT * FROM ({plain(inputs.ORDERS_TWICE)}) o")
def clean_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return clean.remove_duplicates(made(spark, folder, inputs.ORDERS_TWICE))


@query(
    "clean_full",
    f"""SELECT DISTINCT coalesce(o_orderstatus, 'Unknown') AS o_orderstatus,
               round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM ({plain(inputs.ORDERS_TWICE)}) m)), 4)
               AS o_totalprice, o_orderpriority
        FROM ({plain(inputs.ORDERS_TWICE)}) o""",
)
def clean_full(spark: SparkSession, folder: str) -> DataFrame:
    df = made(spark, folder, inputs.ORDERS_TWICE).select("o_orderstatus", "o_totalprice", "o_orderpriority")
    return rounded(clean.clean(df, "median", dedupe=True), 4, "o_totalprice")


@query(
    "clean_report",
    f"""WITH o AS ({plain(inputs.ORDERS_TWICE)})
        SELECT 'fill' AS step, 'o_totalprice' AS "column", CAST(NULL AS VARCHAR) AS text_value,
               round(avg(o_totalprice), 4) AS number_value, CAST(count(*) - count(o_totalprice) AS BIGINT) AS "count"
        FROM o HAVING count(*) > count(o_totalprice)
        UNION ALL
        SELECT 'fill', 'o_orderstatus', 'Unknown', NULL, CAST(count(*) - count(o_orderstatus) AS BIGINT)
        FROM o HAVING count(*) > count(o_orderstatus)
        UNION ALL
        SELECT 'remove_duplicates', NULL, NULL, NULL,
               CAST((SELECT count(*) FROM o) - (SELECT count(*) FROM (SELECT DISTINCT * FROM o) d) AS BIGINT)""",
)
def clean_report(spark: SparkSession, folder: str) -> DataFrame:
    report = clean.cleaning_report(made(spark, folder, inputs.ORDERS_TWICE), "mean", dedupe=True)
    number = F.col("detail").try_cast("double")
    return report.select(
        "step",
        "column",
        F.when(number.isNull(), F.col("detail")).alias("text_value"),
        F.round(number, 4).alias("number_value"),
        "count",
    )


# --- transforms --------------------------------------------------------------------------------------------------


@query(
    "transform_normalize",
    f"""SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 8)
               AS c_acctbal FROM ({CUSTOMERS}) c""",
)
def transform_normalize(spark: SparkSession, folder: str) -> DataFrame:
    df = made(spark, folder, inputs.CUSTOMERS_WITH_GAPS).select("c_custkey", "c_acctbal")
    return rounded(transform.normalize(df, ["c_acctbal"]), 8, "c_acctbal")


@query(
    "transform_scale",
    f"""SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS c_acctbal
        FROM ({CUSTOMERS}) c""",
)
def transform_scale(spark: SparkSession, folder: str) -> DataFrame:
    df = made(spark, folder, inputs.CUSTOMERS_WITH_GAPS).select("c_custkey", "c_acctbal")
    return rounded(transform.scale(df, ["c_acctbal"]), 6, "c_acctbal")


@query(
    "transform_clean_text",
    """SELECT conv_id, turn, NULLIF(trim(regexp_replace('  ' || text || ' ', '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '') AS text
       FROM conversations""",
)
def transform_clean_text(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "conversations")
    df = df.select("conv_id", "turn", F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"))
    return transform.clean_text(df, ["text"])


@query(
    "transform_clip",
    """WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents)
       SELECT doc_id, round(greatest(least(CAST(n_chars AS DOUBLE), q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)), 4) AS n_chars
       FROM documents, q""",
)
def transform_clip(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "documents").select("doc_id", "n_chars")
    return rounded(transform.clip_outliers(df, ["n_chars"]), 4, "n_chars")


@query(
    "transform_onehot",
    f"""SELECT c_custkey, """
    + ", ".join(
        f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s}"
        for s in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + f" FROM ({CUSTOMERS}) c",
)
def transform_onehot(spark: SparkSession, folder: str) -> DataFrame:
    df = made(spark, folder, inputs.CUSTOMERS_WITH_GAPS).select("c_custkey", "c_mktsegment")
    return transform.one_hot(df, "c_mktsegment")


# --- profile -----------------------------------------------------------------------------------------------------


@query(
    "profile_summary",
    f"""SELECT CAST(count(*) AS BIGINT) AS "rows", 6 AS "columns",
               'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS column_list,
               CAST(2 * count(*) - count(o_orderstatus) - count(o_totalprice) AS BIGINT) AS missing_values,
               round(CAST(2 * count(*) - count(o_orderstatus) - count(o_totalprice) AS DOUBLE) / (6 * count(*)) * 100, 2)
               AS missing_percentage,
               'o_orderkey,o_custkey,o_totalprice' AS numeric_columns, 'o_orderstatus,o_orderpriority' AS categorical_columns,
               'o_orderdate' AS date_columns, 3 AS n_numeric, 2 AS n_categorical, 1 AS n_date
        FROM ({ORDERS}) o""",
)
def profile_summary(spark: SparkSession, folder: str) -> DataFrame:
    df = profile.summary(made(spark, folder, inputs.ORDERS_WITH_GAPS))
    lists = ["column_list", "numeric_columns", "categorical_columns", "date_columns"]
    return df.withColumns({c: F.array_join(c, ",") for c in lists})


@query(
    "profile_missing",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS missing,
                   round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 6) AS share FROM ({ORDERS}) o"""
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
)
def profile_missing(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.missing(made(spark, folder, inputs.ORDERS_WITH_GAPS)), 6, "share")


@query(
    "fact_complete_rows",
    f"""SELECT CAST(count(*) AS BIGINT) AS "rows",
               CAST(count(*) FILTER (WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL) AS BIGINT) AS complete_rows,
               round(count(*) FILTER (WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL) / CAST(count(*) AS DOUBLE), 6)
               AS share
        FROM ({ORDERS}) o""",
)
def fact_complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.complete_rows(made(spark, folder, inputs.ORDERS_WITH_GAPS)), 6, "share")


_LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


def _described(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", CAST(count({column}) AS BIGINT) AS "count", round(avg({column}), 4) AS mean,
                      round(stddev_samp({column}), 4) AS std, CAST(min({column}) AS DOUBLE) AS "min",
                      round(quantile_cont({column}, 0.25), 4) AS q25, round(quantile_cont({column}, 0.5), 4) AS q50,
                      round(quantile_cont({column}, 0.75), 4) AS q75, CAST(max({column}) AS DOUBLE) AS "max" FROM {source}"""


@query("profile_describe", " UNION ALL ".join(_described(c, "lineitem") for c in _LINE_NUMBERS))
def profile_describe(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.describe(table(spark, folder, "lineitem")), 4, "mean", "std", "q25", "q50", "q75")


@query(
    "profile_describe_text",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST((SELECT count({c}) FROM ({ORDERS}) o) AS BIGINT) AS "count",
                   CAST((SELECT count(DISTINCT {c}) FROM ({ORDERS}) o) AS BIGINT) AS "unique", top, CAST(freq AS BIGINT) AS freq
            FROM (SELECT {c} AS top, count(*) AS freq FROM ({ORDERS}) o WHERE {c} IS NOT NULL
                  GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) t"""
        for c in ("o_orderstatus", "o_orderpriority")
    ),
)
def profile_describe_text(spark: SparkSession, folder: str) -> DataFrame:
    return profile.describe_text(made(spark, folder, inputs.ORDERS_WITH_GAPS))


def _counted(column: str, source: str, gate: str = "") -> str:
    return f"""SELECT * FROM (SELECT '{column}' AS "column", {column} AS value, CAST(count(*) AS BIGINT) AS "count"
               FROM {source} WHERE {column} IS NOT NULL {gate} GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 10) t"""


@query(
    "profile_value_counts",
    " UNION ALL ".join(
        _counted(
            c, "part", f"AND (SELECT count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM part) < 20"
        )
        for c in ("p_name", "p_brand", "p_type")
    ),
)
def profile_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_counts(table(spark, folder, "part"))


@query(
    "profile_distinct",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT)
            AS distinct_values FROM ({ORDERS}) o"""
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
)
def profile_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_counts(made(spark, folder, inputs.ORDERS_WITH_GAPS))


def _column_row(position: int, column: str, kind: str) -> str:
    head = f"""SELECT {position} AS position, '{column}' AS "column", '{kind}' AS type, '{'categorical' if kind == 'string' else 'numeric'}' AS class,
               CAST(count(*) - count({column}) AS BIGINT) AS missing, round((count(*) - count({column})) * 100.0 / count(*), 4) AS missing_percentage"""
    if kind == "string":
        return f"""{head}, CAST(NULL AS DOUBLE) AS "min", CAST(NULL AS DOUBLE) AS "max", CAST(NULL AS DOUBLE) AS mean,
                   CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS std, CAST(count(DISTINCT {column}) AS BIGINT) AS unique_values,
                   (SELECT string_agg(value || '=' || n, '|' ORDER BY n DESC, value) FROM
                    (SELECT {column} AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) t) AS top_values FROM part"""
    return f"""{head}, CAST(min({column}) AS DOUBLE), CAST(max({column}) AS DOUBLE), round(avg({column}), 4),
               round(quantile_cont({column}, 0.5), 4), round(stddev_samp({column}), 4), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM part"""


_PART = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")]


@query(
    "profile_columns",
    # a text row goes first: it names every column of the result
    " UNION ALL ".join(_column_row(i, c, k) for i, (c, k) in sorted(enumerate(_PART), key=lambda x: x[1][1] != "string")),
)
def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    df = profile.column_details(table(spark, folder, "part"))
    listed = F.array_join(F.transform("top_values", lambda v: F.concat(v["value"], F.lit("="), v["count"].cast("string"))), "|")
    return rounded(df.withColumn("top_values", listed), 4, "missing_percentage", "mean", "median", "std")


def _stat_line(column: str) -> str:
    return f"""'  - {column}: count ' || count({column}) || ', mean ' || printf('%.6f', avg({column})) || ', std '
               || printf('%.6f', stddev_samp({column})) || ', min ' || printf('%.6f', CAST(min({column}) AS DOUBLE)) || ', q25 '
               || printf('%.6f', quantile_cont({column}, 0.25)) || ', q50 ' || printf('%.6f', quantile_cont({column}, 0.5)) || ', q75 '
               || printf('%.6f', quantile_cont({column}, 0.75)) || ', max ' || printf('%.6f', CAST(max({column}) AS DOUBLE))"""


_CUSTOMER = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]


def _description_sql() -> str:
    source = f"({CUSTOMERS}) c"
    parts = [
        f"SELECT 0 AS s, 0 AS p, 'DataFrame shape: ' || count(*) || ' rows, 5 columns' AS line FROM {source}",
        f"SELECT 1, 0, 'Columns: {', '.join(c for c, _ in _CUSTOMER)}'",
        "SELECT 2, -1, 'Column data types:'",
        *[f"SELECT 2, {i}, '  - {c}: {t}'" for i, (c, t) in enumerate(_CUSTOMER)],
        "SELECT 3, -1, 'Numeric column statistics:'",
        *[f"SELECT 3, {i}, {_stat_line(c)} FROM {source}" for i, (c, t) in enumerate(_CUSTOMER) if t != "string"],
        "SELECT 4, -1, 'Missing values by column:'",
        *[
            f"""SELECT 4, {i}, '  - {c}: ' || (count(*) - count({c})) || ' missing values ('
                || printf('%.2f', (count(*) - count({c})) * 100.0 / count(*)) || '%)' FROM {source} HAVING count(*) > count({c})"""
            for i, (c, _) in enumerate(_CUSTOMER)
        ],
        "SELECT 5, -1, 'Categorical column distributions:'",
        *[
            f"""SELECT 5, {i}, '  - {c}: {{' || string_agg('''' || v || ''': ' || n, ', ' ORDER BY n DESC, v) || '}}' FROM
                (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) t
                WHERE (SELECT count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM {source}) < 20
                HAVING count(*) > 0"""
            for i, (c, t) in enumerate(_CUSTOMER)
            if t == "string"
        ],
    ]
    return f"SELECT CAST(row_number() OVER (ORDER BY s, p) AS INTEGER) AS line_no, line FROM ({' UNION ALL '.join(parts)}) t"


@query("describe_text", _description_sql())
def describe_text(spark: SparkSession, folder: str) -> DataFrame:
    return profile.description_lines(made(spark, folder, inputs.CUSTOMERS_WITH_GAPS))


# --- distributions -----------------------------------------------------------------------------------------------

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _long(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL""" for c in columns
    )


@query(
    "dist_histogram",
    f"""WITH long AS ({_long(_MEASURES, "lineitem")}),
        s AS (SELECT "column", count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr
              FROM long GROUP BY "column"),
        r AS (SELECT "column", lo, hi, CAST(ceil((hi - lo) / least(
                     greatest(2 * iqr / pow(CAST(n AS DOUBLE), CAST(1.0 AS DOUBLE) / 3), (hi - lo) / sqrt(CAST(n AS DOUBLE)) / 2),
                     (hi - lo) / (log2(CAST(n AS DOUBLE)) + 1))) AS BIGINT) AS bins FROM s),
        c AS (SELECT "column", CAST(least(floor((v - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS bin, count(*) AS n
              FROM long JOIN r USING ("column") GROUP BY 1, 2),
        e AS (SELECT "column", lo, hi, bins, unnest(range(bins)) AS bin FROM r)
        SELECT "column", bin, round(lo + bin * ((hi - lo) / bins), 6) AS low,
               round(CASE WHEN bin = bins - 1 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / bins) END, 6) AS high,
               CAST(coalesce(n, 0) AS BIGINT) AS "count"
        FROM e LEFT JOIN c USING ("column", bin)""",
)
def dist_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(distribution.histogram(table(spark, folder, "lineitem"), _MEASURES), 6, "low", "high")


@query(
    "dist_kde",
    f"""WITH long AS ({_long(_MEASURES[:2], "lineitem")}),
        s AS (SELECT "column", count(*) AS n, min(v) AS lo, max(v) AS hi,
                     stddev_samp(v) * pow(CAST(count(*) AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS h FROM long GROUP BY "column"),
        grid AS (SELECT *, lo + p * (hi - lo) / 199 AS x FROM s, (SELECT unnest(range(200)) AS p) g)
        SELECT "column", CAST(p AS INTEGER) AS point, round(x, 6) AS x,
               round(sum(exp(-pow((x - v) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 9) AS density
        FROM grid JOIN long USING ("column") GROUP BY "column", p, x, n, h""",
)
def dist_kde(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rounded(distribution.density(table(spark, folder, "lineitem"), _MEASURES[:2]), 6, "x"), 9, "density")


@query(
    "dist_boxplot",
    f"""WITH long AS ({_long(["n_chars", "doc_id"], "documents")}),
        q AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
              FROM long GROUP BY "column"),
        f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
        SELECT "column", least(min(v) FILTER (WHERE v BETWEEN lo AND hi), q1) AS whisker_low, round(q1, 4) AS q1,
               round(median, 4) AS median, round(q3, 4) AS q3,
               greatest(max(v) FILTER (WHERE v BETWEEN lo AND hi), q3) AS whisker_high,
               CAST(count(*) FILTER (WHERE v < lo OR v > hi) AS BIGINT) AS outliers
        FROM long JOIN f USING ("column") GROUP BY "column", q1, median, q3""",
)
def dist_boxplot(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(distribution.boxes(table(spark, folder, "documents")), 4, "q1", "median", "q3")


@query(
    "dist_outliers",
    """WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents)
       SELECT doc_id, 'n_chars' AS "column", CAST(n_chars AS DOUBLE) AS value FROM documents, q
       WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)""",
)
def dist_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return distribution.outliers(table(spark, folder, "documents"), ["n_chars"], by=["doc_id"])


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS column_x, '{b}' AS column_y, {'1.0' if a == b else f'round(corr({a}, {b}), 6)'}::DOUBLE AS corr
            FROM lineitem"""
        + (" HAVING count(*) > 0" if a == b else "")
        for a in _LINE_NUMBERS
        for b in _LINE_NUMBERS
    ),
)
def corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(distribution.correlations(table(spark, folder, "lineitem")), 6, "corr")


_PAIRS = [("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice")]


def _bin20(c: str) -> str:
    return f"CAST(least(floor(({c} - min({c}) OVER ()) * CAST(20 AS DOUBLE) / (max({c}) OVER () - min({c}) OVER ())), 19) AS INTEGER)"


@query(
    "pair_bins",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS column_x, '{b}' AS column_y, x_bin, y_bin, CAST(count(*) AS BIGINT) AS "count"
            FROM (SELECT {_bin20(a)} AS x_bin, {_bin20(b)} AS y_bin FROM part) t GROUP BY x_bin, y_bin"""
        for a, b in _PAIRS
    ),
)
def pair_bins(spark: SparkSession, folder: str) -> DataFrame:
    return distribution.pair_bins(table(spark, folder, "part"))


@query("top_categories", " UNION ALL ".join(_counted(c, "part") for c in ("p_name", "p_brand")))
def top_categories(spark: SparkSession, folder: str) -> DataFrame:
    return distribution.top_values(table(spark, folder, "part"))


@query("top_texts", " UNION ALL ".join(_counted(c, "documents") for c in ("text", "source")))
def top_texts(spark: SparkSession, folder: str) -> DataFrame:
    return distribution.top_values(table(spark, folder, "documents"), ["text", "source"])


# --- facts -------------------------------------------------------------------------------------------------------


@query(
    "fact_measure_by_dim",
    f"""SELECT c_mktsegment, CAST(count(c_acctbal) AS BIGINT) AS "count", round(avg(c_acctbal), 4) AS mean,
               round(quantile_cont(c_acctbal, 0.5), 4) AS median, min(c_acctbal) AS "min", max(c_acctbal) AS "max"
        FROM ({CUSTOMERS}) c WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""",
)
def fact_measure_by_dim(spark: SparkSession, folder: str) -> DataFrame:
    df = made(spark, folder, inputs.CUSTOMERS_WITH_GAPS)
    return rounded(facts.measure_by(df, "c_acctbal", "c_mktsegment"), 4, "mean", "median")


@query(
    "fact_group_share",
    f"""SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS "count", round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
        FROM ({CUSTOMERS}) c WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""",
)
def fact_group_share(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(facts.group_share(made(spark, folder, inputs.CUSTOMERS_WITH_GAPS), "c_mktsegment"), 6, "share")


@query(
    "fact_group_gap",
    f"""WITH m AS (SELECT c_mktsegment AS g, avg(c_acctbal) AS a FROM ({CUSTOMERS}) c WHERE c_mktsegment IS NOT NULL GROUP BY 1),
        h AS (SELECT g AS highest, a AS highest_mean FROM m ORDER BY a DESC, g LIMIT 1),
        l AS (SELECT g AS lowest, a AS lowest_mean FROM m ORDER BY a, g LIMIT 1)
        SELECT highest, round(highest_mean, 4) AS highest_mean, lowest, round(lowest_mean, 4) AS lowest_mean,
               round((highest_mean - lowest_mean) / lowest_mean * 100, 4) AS gap_percent,
               round((SELECT avg(c_acctbal) FROM ({CUSTOMERS}) c), 4) AS overall_mean FROM h, l""",
)
def fact_group_gap(spark: SparkSession, folder: str) -> DataFrame:
    df = facts.group_gap(made(spark, folder, inputs.CUSTOMERS_WITH_GAPS), "c_acctbal", "c_mktsegment")
    return rounded(df, 4, "highest_mean", "lowest_mean", "gap_percent", "overall_mean")


@query(
    "fact_correlation",
    """SELECT CAST(count(*) AS BIGINT) AS "rows", round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem""",
)
def fact_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(facts.correlation(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"), 6, "corr")


@query(
    "fact_tenure_split",
    """WITH m AS (SELECT o_totalprice, (2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate)
                         + (1 - day(o_orderdate)) / CAST(31 AS DOUBLE) AS months FROM orders),
       a AS (SELECT CAST(count(*) FILTER (WHERE months > 60) AS BIGINT) AS n_above,
                    CAST(count(*) FILTER (WHERE months <= 60) AS BIGINT) AS n_up_to,
                    avg(o_totalprice) FILTER (WHERE months > 60) AS x, avg(o_totalprice) FILTER (WHERE months <= 60) AS y FROM m)
       SELECT n_above, n_up_to, round(x, 4) AS mean_above, round(y, 4) AS mean_up_to,
              round((x - y) / y * 100, 4) AS difference_percent FROM a""",
)
def fact_tenure_split(spark: SparkSession, folder: str) -> DataFrame:
    df = facts.tenure_split(table(spark, folder, "orders"), "o_totalprice", "o_orderdate", "2001-08-01", years=5)
    return rounded(df, 4, "mean_above", "mean_up_to", "difference_percent")


@query(
    "fact_rows_by_year",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, CAST(count(*) AS BIGINT) AS "count"
       FROM orders GROUP BY 1, 2""",
)
def fact_rows_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return facts.rows_by_year(table(spark, folder, "orders"), "o_orderdate", "o_orderpriority")


@query(
    "fact_top_per_category",
    """SELECT o_orderpriority, o_orderkey, o_totalprice, place FROM
       (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place
        FROM orders) t WHERE place <= 5""",
)
def fact_top_per_category(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return facts.top_per_category(df, "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 5)


# --- extraction --------------------------------------------------------------------------------------------------


@query(
    "extract_json",
    f"""WITH r AS (SELECT p_partkey, NULLIF(regexp_extract(text, '(?s)\\[.*\\]', 0), '') AS j FROM ({plain(inputs.JSON_RESPONSES)}) t),
        g AS (SELECT p_partkey, CASE WHEN json_valid(j) THEN j END AS j FROM r),
        e AS (SELECT p_partkey, j, unnest(range(CAST(json_array_length(j) AS BIGINT))) AS i FROM g WHERE j IS NOT NULL)
        SELECT p_partkey, CAST(i + 1 AS INTEGER) AS case_no, json_extract_string(j, '$[' || i || '].title') AS title,
               json_extract_string(j, '$[' || i || '].description') AS description,
               json_extract_string(j, '$[' || i || '].impact') AS impact, json_extract_string(j, '$[' || i || '].effort') AS effort
        FROM e""",
)
def extract_json(spark: SparkSession, folder: str) -> DataFrame:
    cases = extract.extract_cases(made(spark, folder, inputs.JSON_RESPONSES))
    return cases.where("source = 'json'").drop("source")


_CASES_SQL = f"""
    WITH raw AS (SELECT doc_id, str_split(text, chr(10)) AS parts FROM ({plain(inputs.LINE_RESPONSES)}) t),
    split AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM raw),
    lines AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)) AS line FROM split),
    marked AS (SELECT *, lower(line) AS low, regexp_matches(line, '^[0-9]') AND contains(substr(line, 1, 3), '.') AS title
               FROM lines WHERE line <> ''),
    numbered AS (SELECT *, greatest(1, sum(CASE WHEN title THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)) AS case_no,
                        max(CASE WHEN title THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS titled,
                        NOT title AND contains(low, 'description') AS is_desc FROM marked),
    placed AS (SELECT *, max(CASE WHEN title THEN pos END) OVER (PARTITION BY doc_id, case_no) AS title_pos FROM numbered WHERE titled = 1),
    firsts AS (SELECT *, min(CASE WHEN pos > title_pos THEN pos END) OVER (PARTITION BY doc_id, case_no) AS first_pos,
                      max(CASE WHEN is_desc AND pos < title_pos THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, case_no) AS desc_before
               FROM placed),
    used AS (SELECT *, is_desc OR (pos = first_pos AND desc_before = 0) AS taken,
                    CASE WHEN contains(low, 'high') THEN 'High' WHEN contains(low, 'medium') THEN 'Medium'
                         WHEN contains(low, 'low') THEN 'Low' END AS level FROM firsts),
    cases AS (SELECT doc_id, case_no,
                     max(CASE WHEN title THEN trim(substr(line, strpos(line, '.') + 1), ' ' || chr(9)) END) AS title,
                     coalesce(arg_max(line, pos) FILTER (WHERE is_desc), max(line) FILTER (WHERE pos = first_pos)) AS description,
                     arg_max(level, pos) FILTER (WHERE NOT title AND NOT taken AND contains(low, 'impact') AND level IS NOT NULL) AS impact,
                     arg_max(level, pos) FILTER (WHERE NOT title AND NOT taken AND contains(low, 'effort')
                                                 AND NOT contains(low, 'impact') AND level IS NOT NULL) AS effort
              FROM used GROUP BY doc_id, case_no),
    filled AS (SELECT doc_id, CAST(case_no AS INTEGER) AS case_no, title,
                      coalesce(CASE WHEN contains(description, ':')
                                    THEN trim(substr(description, strpos(description, ':') + 1), ' ' || chr(9)) ELSE description END,
                               'No description provided') AS description,
                      coalesce(impact, 'Medium') AS impact, coalesce(effort, 'Medium') AS effort FROM cases),
    answer AS (SELECT *, 'lines' AS source FROM filled UNION ALL
               SELECT doc_id, 1, 'Data-Driven Decision Making',
                      'Implement a framework for making decisions based on data insights.', 'High', 'Medium', 'default'
               FROM ({plain(inputs.LINE_RESPONSES)}) t WHERE doc_id NOT IN (SELECT doc_id FROM filled))
"""


@query("extract_lines", f"{_CASES_SQL} SELECT * FROM answer")
def extract_lines(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract_cases(made(spark, folder, inputs.LINE_RESPONSES))


@query("extract_tag_counts", f"""{_CASES_SQL} SELECT impact, effort, CAST(count(*) AS BIGINT) AS "count" FROM answer GROUP BY 1, 2""")
def extract_tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    return extract.tag_counts(extract.extract_cases(made(spark, folder, inputs.LINE_RESPONSES)))


@query("join_texts", "SELECT doc_id, source || chr(10) || chr(10) || lang || chr(10) || chr(10) || text AS text FROM documents")
def join_texts(spark: SparkSession, folder: str) -> DataFrame:
    insights = F.map_values(
        F.create_map(F.lit("origin"), F.col("source"), F.lit("language"), F.col("lang"), F.lit("body"), F.col("text"))
    )
    return table(spark, folder, "documents").select("doc_id", extract.join_texts(insights).alias("text"))


# --- forecasts ---------------------------------------------------------------------------------------------------

_PERIODS = 10
_SMA = """
    WITH o AS (SELECT event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS t,
                      count(*) OVER (PARTITION BY event_type) AS n FROM events),
    w AS (SELECT *, greatest(5, CAST(floor(n * CAST(0.3 AS DOUBLE)) AS BIGINT)) AS window_size FROM o),
    s AS (SELECT event_type, max(n) AS n, max(window_size) AS window_size, max(ts) AS last_ts,
                 avg(value) FILTER (WHERE t > n - window_size) AS level,
                 stddev_samp(value) FILTER (WHERE t > n - window_size) AS spread,
                 (epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(max(n) - 1 AS DOUBLE) / 1e6 AS gap FROM w GROUP BY event_type),
    f AS (SELECT *, CASE WHEN gap < 60 THEN 'S' WHEN gap < 3600 THEN 'T' WHEN gap < 86400 THEN 'H' END AS frequency,
                 CASE WHEN gap < 60 THEN 1000000 WHEN gap < 3600 THEN 60000000 ELSE 3600000000 END AS us FROM s),
    ahead AS (SELECT *, CAST(step AS INTEGER) AS k, make_timestamp(epoch_us(last_ts) + CAST(us * step AS BIGINT)) AS next_ts
              FROM f, (SELECT unnest(range(1, 11)) AS step) p)
"""


@query(
    "forecast_sma",
    f"""{_SMA} SELECT event_type, k AS step, next_ts AS ts, round(level, 6) AS value, round(level - 1.96 * spread, 6) AS lower,
               round(level + 1.96 * spread, 6) AS upper, 'sma' AS model, frequency, CAST(window_size AS BIGINT) AS window_size FROM ahead""",
)
def forecast_sma(spark: SparkSession, folder: str) -> DataFrame:
    df = forecast.forecast_sma(table(spark, folder, "events"), "ts", "value", _PERIODS, by=["event_type"])
    return rounded(df.drop("error"), 6, "value", "lower", "upper")


@query(
    "forecast_series",
    f"""{_SMA} SELECT event_type, 'history' AS kind, ts, round(value, 6) AS value, CAST(NULL AS DOUBLE) AS lower,
                      CAST(NULL AS DOUBLE) AS upper FROM events
               UNION ALL SELECT event_type, 'forecast', next_ts, round(level, 6), round(level - 1.96 * spread, 6),
                                round(level + 1.96 * spread, 6) FROM ahead""",
)
def forecast_series(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    ahead = forecast.forecast_sma(events, "ts", "value", _PERIODS, by=["event_type"])
    df = forecast.chart_series(events, "ts", "value", ahead, by=["event_type"])
    return rounded(df, 6, "value", "lower", "upper")


_RHYTHMS_SQL = plain(inputs.RHYTHMS)
_FREQUENCY = f"""
    WITH g AS (SELECT series, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, year(ts) * 12 + month(ts) AS m,
                      year(ts) * 12 + month(ts) - lag(year(ts) * 12 + month(ts)) OVER w AS months
               FROM ({_RHYTHMS_SQL}) r WINDOW w AS (PARTITION BY series ORDER BY ts)),
    s AS (SELECT series, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, min(gap) AS a, max(gap) AS b, min(months) AS c,
                 max(months) AS d, bool_and(day(ts) = 1) AS starts, bool_and(day(ts) = day(last_day(ts))) AS ends FROM g GROUP BY series),
    f AS (SELECT *, (epoch_us(last_ts) - epoch_us(first_ts)) / CAST(n - 1 AS DOUBLE) / 1e6 AS mean_gap,
                 a > 0 AND c > 0 AND c = d AND (starts OR ends) AND a % 86400000000 = 0 AS monthly,
                 CASE WHEN ends THEN 'E' ELSE 'S' END AS side FROM s),
    k AS (SELECT *, CASE WHEN n < 3 OR a <= 0 THEN NULL
                 WHEN monthly AND c % 12 = 0 THEN CASE WHEN c = 12 THEN '' ELSE CAST(c // 12 AS VARCHAR) END || 'Y' || side || '-'
                      || upper(strftime(last_ts, '%b'))
                 WHEN monthly AND c % 3 = 0 THEN CASE WHEN c = 3 THEN '' ELSE CAST(c // 3 AS VARCHAR) END || 'Q' || side || '-'
                      || CASE month(last_ts) % 3 WHEN 0 THEN 'DEC' WHEN 1 THEN 'OCT' ELSE 'NOV' END
                 WHEN monthly THEN CASE WHEN c = 1 THEN '' ELSE CAST(c AS VARCHAR) END || 'M' || side
                 WHEN a = b AND a % 604800000000 = 0 THEN CASE WHEN a = 604800000000 THEN '' ELSE CAST(a // 604800000000 AS VARCHAR) END
                      || 'W-' || upper(strftime(last_ts, '%a'))
                 WHEN a = b AND a % 86400000000 = 0 THEN CASE WHEN a = 86400000000 THEN '' ELSE CAST(a // 86400000000 AS VARCHAR) END || 'D'
                 WHEN a = b AND a % 3600000000 = 0 THEN CASE WHEN a = 3600000000 THEN '' ELSE CAST(a // 3600000000 AS VARCHAR) END || 'h'
                 END AS pattern,
                 CASE WHEN n < 3 THEN NULL WHEN mean_gap < 60 THEN 'S' WHEN mean_gap < 3600 THEN 'T' WHEN mean_gap < 86400 THEN 'H'
                      WHEN mean_gap < 604800 THEN 'D' WHEN mean_gap < 2678400 THEN 'W' ELSE 'M' END AS rough FROM f)
"""


@query(
    "forecast_frequency",
    f"""{_FREQUENCY} SELECT series, CAST(n AS BIGINT) AS n, first_ts, last_ts, coalesce(pattern, rough) AS frequency,
                           pattern IS NOT NULL AS inferred FROM k""",
)
def forecast_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.frequency(checkpointed(made(spark, folder, inputs.RHYTHMS)), "ts", by=["series"])


@query(
    "forecast_dates",
    f"""{_FREQUENCY} SELECT series, CAST(step AS INTEGER) AS step, CASE
            WHEN pattern IS NOT NULL AND monthly AND ends THEN CAST(last_day(last_ts + CAST(c * step AS INTEGER) * INTERVAL 1 MONTH) AS TIMESTAMP)
            WHEN pattern IS NOT NULL AND monthly THEN last_ts + CAST(c * step AS INTEGER) * INTERVAL 1 MONTH
            WHEN pattern IS NOT NULL THEN make_timestamp(epoch_us(last_ts) + CAST(a * step AS BIGINT))
            WHEN rough = 'H' THEN last_ts + CAST(step AS INTEGER) * INTERVAL 1 HOUR
            WHEN rough = 'T' THEN last_ts + CAST(step AS INTEGER) * INTERVAL 1 MINUTE
            WHEN rough = 'S' THEN last_ts + CAST(step AS INTEGER) * INTERVAL 1 SECOND
            WHEN rough = 'D' THEN last_ts + CAST(step AS INTEGER) * INTERVAL 1 DAY
            WHEN rough = 'W' THEN last_ts + CAST((7 - isodow(last_ts)) + 7 * step AS INTEGER) * INTERVAL 1 DAY
            ELSE CAST(last_day(CAST(date_trunc('month', last_ts) AS TIMESTAMP) + CAST(step AS INTEGER) * INTERVAL 1 MONTH) AS TIMESTAMP) END AS ts
        FROM k, (SELECT unnest(range(1, 11)) AS step) p WHERE n >= 3""",
)
def forecast_dates(spark: SparkSession, folder: str) -> DataFrame:
    df = forecast.forecast_sma(checkpointed(made(spark, folder, inputs.RHYTHMS)), "ts", "value", _PERIODS, by=["series"])
    return df.where("step IS NOT NULL").select("series", "step", "ts")


@query(
    "forecast_pq",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS n,
              CAST(least(5, greatest(1, count(*) // 10)) AS INTEGER) AS p, CAST(least(2, greatest(1, count(*) // 20)) AS INTEGER) AS q
       FROM events GROUP BY event_type""",
)
def forecast_pq(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    p, q = forecast.arima_pq(F.col("n"))
    return counts.withColumns({"p": p, "q": q})


@query(
    "series_diff",
    """SELECT event_type, ts, CAST(t AS BIGINT) AS t, value, round(diff, 8) AS diff FROM
       (SELECT event_type, ts, value, row_number() OVER w AS t, value - lag(value) OVER w AS diff FROM events
        WINDOW w AS (PARTITION BY event_type ORDER BY ts, value)) d WHERE diff IS NOT NULL""",
)
def series_diff(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(forecast.differences(table(spark, folder, "events"), "ts", "value", by=["event_type"]), 8, "diff")


@query("forecast_arima_order")
def forecast_arima_order(spark: SparkSession, folder: str) -> DataFrame:
    daily = checkpointed(made(spark, folder, inputs.DAILY_ORDERS))
    fits = arima.fit_arima(daily, "ts", "value", _PERIODS, by=["o_orderpriority"])
    return fits.select("o_orderpriority", "n", "frequency", "p", "d", "q", "error")


@query("forecast_arima")
def forecast_arima(spark: SparkSession, folder: str) -> DataFrame:
    daily = checkpointed(made(spark, folder, inputs.DAILY_ORDERS))
    return arima.forecast(daily, "ts", "value", _PERIODS, model="arima", by=["o_orderpriority"])


_FIVE_PERCENT = -2.861593  # statistic whose p-value is 0.05


@query(
    "unit_root",
    """WITH s AS (SELECT event_type, value AS y, lag(value) OVER (PARTITION BY event_type ORDER BY ts, value) AS x FROM events),
            f AS (SELECT event_type, count(*) AS n, regr_slope(y - x, x) AS b, regr_syy(y - x, x) - regr_sxy(y - x, x) * regr_slope(y - x, x) AS error,
                         regr_count(y - x, x) AS m, regr_sxx(y - x, x) AS sxx FROM s GROUP BY event_type)
       SELECT event_type, CAST(n AS BIGINT) AS n, CAST(0 AS INTEGER) AS lags, round(b / sqrt(error / (m - 2) / sxx), 6) AS statistic FROM f""",
)
def unit_root(spark: SparkSession, folder: str) -> DataFrame:
    found = arima.unit_root_tests(table(spark, folder, "events"), "ts", "value", by=["event_type"], max_lag=0)
    return rounded(found.select("event_type", "n", "lags", "statistic"), 6, "statistic")


@query(
    "forecast_order",
    f"""WITH s AS (SELECT o_orderpriority AS k, value AS y, lag(value) OVER w AS x, lag(value, 2) OVER w AS x2
                  FROM ({plain(inputs.DAILY_ORDERS)}) d WINDOW w AS (PARTITION BY o_orderpriority ORDER BY ts, value)),
            f AS (SELECT k, count(*) AS n, regr_slope(y - x, x) / sqrt((regr_syy(y - x, x) - regr_sxy(y - x, x) * regr_slope(y - x, x)) / (regr_count(y - x, x) - 2) / regr_sxx(y - x, x)) AS level,
                         regr_slope(y - 2 * x + x2, x - x2) / sqrt((regr_syy(y - 2 * x + x2, x - x2) - regr_sxy(y - 2 * x + x2, x - x2) * regr_slope(y - 2 * x + x2, x - x2))
                             / (regr_count(y - 2 * x + x2, x - x2) - 2) / regr_sxx(y - 2 * x + x2, x - x2)) AS step FROM s GROUP BY k)
       SELECT k AS o_orderpriority, CAST(n AS BIGINT) AS n, CAST(least(5, greatest(1, n // 10)) AS INTEGER) AS p,
              CAST(CASE WHEN level <= {_FIVE_PERCENT} THEN 0 WHEN step <= {_FIVE_PERCENT} THEN 1 ELSE 2 END AS INTEGER) AS d,
              CAST(least(2, greatest(1, n // 20)) AS INTEGER) AS q FROM f""",
)
def forecast_order(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with unit-root tests without lags, where the other engine can state them."""
    daily = checkpointed(made(spark, folder, inputs.DAILY_ORDERS))
    fits = arima.fit_arima(daily, "ts", "value", _PERIODS, by=["o_orderpriority"], max_lag=0)
    return fits.select("o_orderpriority", "n", "p", "d", "q")


@query(
    "forecast_ar1",
    """WITH RECURSIVE s AS (
           SELECT event_type, ts, value AS y, lag(value) OVER w AS x, row_number() OVER w AS t, count(*) OVER (PARTITION BY event_type) AS n
           FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, value)),
       f AS (
           SELECT event_type, regr_intercept(y, x) AS c, regr_slope(y, x) AS a, regr_count(y, x) AS m,
                  (regr_syy(y, x) - regr_sxy(y, x) * regr_slope(y, x)) / regr_count(y, x) AS s2, max(CASE WHEN t = n THEN y END) AS last
           FROM s GROUP BY event_type),
       h AS (
           SELECT event_type, 1 AS step, c + a * last AS value, s2 AS spread, a, c, s2, m FROM f
           UNION ALL SELECT event_type, step + 1, c + a * value, s2 + a * a * spread, a, c, s2, m FROM h WHERE step < 10)
       SELECT event_type, CAST(step AS INTEGER) AS step, round(value, 6) AS value, round(value - 1.959963984540054 * sqrt(spread), 6) AS lower,
              round(value + 1.959963984540054 * sqrt(spread), 6) AS upper, CAST(1 AS INTEGER) AS p, CAST(0 AS INTEGER) AS d, CAST(0 AS INTEGER) AS q,
              round(m * (ln(2 * pi() * s2) + 1) + 6, 6) AS aic, round(m * (ln(2 * pi() * s2) + 1) + 3 * ln(m), 6) AS bic
       FROM h""",
)
def forecast_ar1(spark: SparkSession, folder: str) -> DataFrame:
    df = arima.forecast_arima(table(spark, folder, "events"), "ts", "value", _PERIODS, by=["event_type"], order=(1, 0, 0))
    found = df.select("event_type", "step", "value", "lower", "upper", "p", "d", "q", "aic", "bic")
    return rounded(found, 6, "value", "lower", "upper", "aic", "bic")


# --- incremental -------------------------------------------------------------------------------------------------


@query(
    "new_files_antijoin",
    f"""SELECT base_name, path FROM (SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS base_name,
               lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS file_type FROM ({plain(inputs.FILE_NAMES)}) f) t
        WHERE file_type IN ('.csv', '.xls', '.xlsx', '.json', '.parquet')
          AND base_name NOT IN (SELECT base_name FROM ({plain(inputs.PROCESSED)}) p)""",
)
def new_files_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    names, done = made(spark, folder, inputs.FILE_NAMES), made(spark, folder, inputs.PROCESSED)
    return ledger.new_files(names, done).select("base_name", "path")


@query(
    "batch_summary",
    f"""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE status = 'success') AS BIGINT) AS successes,
               CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS failures FROM ({plain(inputs.PROCESSED)}) p""",
)
def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.batch_summary(made(spark, folder, inputs.PROCESSED))


@query(
    "batch_file_results",
    f"""SELECT regexp_extract(file_path, '([^/]*)$', 1) AS file, status, coalesce(message, 'Processed successfully') AS details
        FROM ({plain(inputs.PROCESSED)}) p""",
)
def batch_file_results(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.file_results(made(spark, folder, inputs.PROCESSED))


@query(
    "stream_new_files",
    " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS file, 'success' AS status, CAST(count(*) AS VARCHAR) AS details FROM {t}" for t in inputs.TABLES
    ),
)
def stream_new_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every table file picked up by the file stream, loaded and counted."""

    def count_rows(path: str) -> dict:
        return {"message": str(files.load(spark, path).count())}

    state = f"{shared_folder(spark).rstrip('/')}/watch-{uuid.uuid4().hex}"
    run = watch.watch(spark, folder, state, count_rows, "*.parquet", start=dt.datetime(1969, 1, 1), poll_seconds=None)
    run.awaitTermination()
    return ledger.file_results(ledger.read_ledger(spark, f"{state}/ledger"))


# --- a whole run -------------------------------------------------------------------------------------------------


@query(
    "customer_segments",
    f"""WITH m AS (SELECT coalesce(c_mktsegment, 'Unknown') AS c_mktsegment,
                          coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM ({CUSTOMERS}) x)) AS c_acctbal FROM ({CUSTOMERS}) c)
        SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS "count", round(avg(c_acctbal), 4) AS mean,
               round(quantile_cont(c_acctbal, 0.5), 4) AS median, min(c_acctbal) AS "min", max(c_acctbal) AS "max",
               round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM m GROUP BY c_mktsegment""",
)
def customer_segments(spark: SparkSession, folder: str) -> DataFrame:
    options = runs.Options(strategy="mean", dedupe=True, measure="c_acctbal", dimension="c_mktsegment")
    results = runs.run(made(spark, folder, inputs.CUSTOMERS_WITH_GAPS), "full", options)
    groups, shares = results["measure_by"], results["group_share"].select("c_mktsegment", "share")
    return rounded(rounded(groups.join(shares, "c_mktsegment"), 4, "mean", "median"), 6, "share")


@query(
    "run_summary",
    f"""SELECT CAST(count(*) AS BIGINT) AS "rows", 5 AS "columns", 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS column_list,
               CAST(0 AS BIGINT) AS missing_values, CAST(0 AS DOUBLE) AS missing_percentage, 'c_custkey,c_nationkey,c_acctbal' AS numeric_columns,
               'c_name,c_mktsegment' AS categorical_columns, '' AS date_columns, 3 AS n_numeric, 2 AS n_categorical, 0 AS n_date
        FROM (SELECT DISTINCT * FROM ({CUSTOMERS}) x) c""",
)
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    results = runs.run(made(spark, folder, inputs.CUSTOMERS_WITH_GAPS), "full", runs.Options(strategy="mean"))
    lists = ("column_list", "numeric_columns", "categorical_columns", "date_columns")
    return results["summary"].withColumns({c: F.array_join(c, ",") for c in lists})


@query(
    "run_forecast",
    f"""WITH m AS (SELECT avg(o_totalprice) AS v FROM ({ORDERS}) o),
             r AS (SELECT DISTINCT o_orderkey, o_custkey, coalesce(o_orderstatus, 'Unknown') AS s, coalesce(o_totalprice, v) AS y, o_orderdate AS ts, o_orderpriority
                   FROM ({ORDERS}) o, m),
             n AS (SELECT y, row_number() OVER (ORDER BY ts, y) AS t, count(*) OVER () AS n FROM r),
             w AS (SELECT avg(y) AS level, stddev_samp(y) AS spread, max(greatest(5, CAST(floor(n * 0.3) AS BIGINT))) AS size
                   FROM n WHERE t > n - greatest(5, CAST(floor(n * 0.3) AS BIGINT)))
        SELECT CAST(k AS INTEGER) AS step, round(level, 4) AS value, round(level - 1.96 * spread, 4) AS lower, round(level + 1.96 * spread, 4) AS upper,
               'sma' AS model, CAST(size AS BIGINT) AS window_size FROM w, (SELECT unnest(range(1, 11)) AS k) p""",
)
def run_forecast(spark: SparkSession, folder: str) -> DataFrame:
    options = runs.Options(strategy="mean", date="o_orderdate", target="o_totalprice", periods=_PERIODS)
    results = runs.run(made(spark, folder, inputs.ORDERS_WITH_GAPS), "forecast_only", options)
    return rounded(results["forecast"].select("step", "value", "lower", "upper", "model", "window_size"), 4, "value", "lower", "upper")


# --- files, tables and documents, there and back -----------------------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}-{name}"


@query("csv_round_trip", "SELECT doc_id, nullif(text, '') AS text, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts, with the lines and quotes they hold, written as delimited text and loaded again."""
    path = sinks.write_files(table(spark, folder, "documents"), _place(spark, "documents.csv"), "csv")
    return files.load(spark, path)


@query("json_round_trip", "SELECT c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON list of records for each nation, loaded as one table."""
    records = F.to_json(F.collect_list(F.struct("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment"))).alias("value")
    path = _place(spark, "customers.json")
    table(spark, folder, "customer").groupBy("c_nationkey").agg(records).write.partitionBy("c_nationkey").text(path)
    return files.load(spark, path)


@query("table_replace_append", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def table_replace_append(spark: SparkSession, folder: str) -> DataFrame:
    name = "round_trip_names"
    parts = [table(spark, folder, t).select(f"{t[0]}_{t}key", f"{t[0]}_name").toDF("r_regionkey", "r_name") for t in ("nation", "region", "nation")]
    for part, mode in zip(parts, ("replace", "replace", "append")):
        sinks.write_table(part, name, mode)
    return tables.load_table(spark, name)


@query("sql_statement", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def sql_statement(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").createOrReplaceTempView("statement_orders")
    done = tables.execute(spark, "CREATE OR REPLACE TEMPORARY VIEW finished AS SELECT * FROM statement_orders WHERE o_orderstatus = 'F'")
    assert not done.columns
    return tables.query(spark, "SELECT o_orderpriority, count(*) AS n FROM finished GROUP BY o_orderpriority")


@query(
    "folder_listing",
    " UNION ALL ".join(f"SELECT '{t}' AS base_name, '.parquet' AS file_type, TRUE AS supported FROM (SELECT count(*) FROM {t}) x" for t in inputs.TABLES),
)
def folder_listing(spark: SparkSession, folder: str) -> DataFrame:
    found = files.list_files(spark, folder, "*.parquet")
    return found.select(files.base_name(F.col("path")).alias("base_name"), "file_type", "supported")


@query(
    "insights_document",
    f"""SELECT 'orders.parquet' AS file_name, 'DataFrame shape: ' || CAST(count(*) AS VARCHAR) || ' rows, 6 columns' AS first_line,
               CAST(count(*) AS BIGINT) AS "rows", 6 AS "columns", CAST(count(*) - count(o_totalprice) AS BIGINT) AS missing_prices,
               'Review the price' AS first_case FROM ({ORDERS}) o""",
)
def insights_document(spark: SparkSession, folder: str) -> DataFrame:
    """An insights document written as JSON and read again."""
    df = made(spark, folder, inputs.ORDERS_WITH_GAPS)
    lines = profile.description_lines(df).agg(F.min_by("line", "line_no")).scalar()
    case = F.struct(*[F.lit(v).alias(n) for n, v in (("title", "Review the price"), ("description", "-"), ("impact", "High"), ("effort", "Low"))])
    document = sinks.insights_document(df, "orders.parquet", F.create_map(F.lit("data_description"), lines), F.array(case))
    path = sinks.write_files(document, _place(spark, "orders_insights"), "json")
    found = spark.read.json(path)
    return found.select(
        "file_name",
        F.col("insights.data_description").alias("first_line"),
        F.col("data_summary.rows").alias("rows"),
        F.col("data_summary.columns").cast("int").alias("columns"),
        F.col("data_summary.missing_values.o_totalprice").alias("missing_prices"),
        F.col("use_cases")[0]["title"].alias("first_case"),
    )


@query(
    "forecast_document",
    f"""{_SMA}, h AS (SELECT event_type, count(*) AS n, sum(value) AS total, max(ts) AS last_ts FROM events GROUP BY event_type),
             g AS (SELECT event_type, count(*) AS n, max(level) AS level, max(level + 1.96 * spread) AS upper, max(next_ts) AS last_ts FROM ahead GROUP BY event_type)
        SELECT h.event_type, CAST(h.n AS BIGINT) AS n_history, round(total, 4) AS total, CAST(g.n AS BIGINT) AS n_ahead,
               round(level, 6) AS value, round(upper, 6) AS upper, g.last_ts FROM h JOIN g USING (event_type)""",
)
def forecast_document(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with whole history and forecast, written and read again."""
    events = table(spark, folder, "events")
    ahead = forecast.forecast_sma(events, "ts", "value", _PERIODS, by=["event_type"])
    found = spark.read.json(documents.write_forecasts(events, "ts", "value", ahead, _place(spark, "forecasts"), ["event_type"]))
    past, next_ = F.col("original_data.values"), F.col("forecast.values")
    return found.select(
        "event_type",
        F.size(past).cast("long").alias("n_history"),
        F.round(F.aggregate(past, F.lit(0.0), lambda a, v: a + v), 4).alias("total"),
        F.size(next_).cast("long").alias("n_ahead"),
        F.round(next_[0], 6).alias("value"),
        F.round(F.col("confidence_intervals.upper")[0], 6).alias("upper"),
        F.to_timestamp_ntz(F.array_max("forecast.dates")).alias("last_ts"),
    )


@query(
    "forecast_fallback",
    """SELECT event_type, CAST(step AS INTEGER) AS step, CAST(3 AS DOUBLE) AS value, CAST(3 AS DOUBLE) AS lower, 'sma' AS model, TRUE AS has_reason
       FROM (SELECT DISTINCT event_type FROM events) e, (SELECT unnest(range(1, 11)) AS step) p""",
)
def forecast_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A model that cannot be fitted, as no value differs from another, gives way to the moving average."""
    flat = table(spark, folder, "events").select("event_type", "ts", F.lit(3.0).alias("value"))
    found = arima.forecast(flat, "ts", "value", _PERIODS, model="arima", by=["event_type"])
    return found.select("event_type", "step", "value", "lower", "model", F.col("error").isNotNull().alias("has_reason"))


@query(
    "run_batch",
    " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS file, 'success' AS status, CAST(count(*) AS VARCHAR) AS details FROM {t}" for t in inputs.TABLES if t != "region"
    )
    + " UNION ALL SELECT 'region.parquet', 'error', 'region has ' || CAST(count(*) AS VARCHAR) || ' rows' FROM region",
)
def run_batch(spark: SparkSession, folder: str) -> DataFrame:
    """One scheduled batch over the table files, of which one fails; the others are handled all the same."""

    def count_rows(path: str) -> dict:
        n = files.load(spark, path).count()
        if "region" in path.rsplit("/", 1)[-1]:
            raise ValueError(f"region has {n} rows")
        return {"message": str(n)}

    return ledger.file_results(watch.run_batch(spark, folder, _place(spark, "ledger"), count_rows, "*.parquet"))


# --- the ways taken by tables too large for one task, with their limits forced down -------------------------------


@query(
    "quantiles_segmented",
    """SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(quantile_cont(value, 0.25), 6) AS q25,
              round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY event_type""",
)
def quantiles_segmented(spark: SparkSession, folder: str) -> DataFrame:
    found = ranks.quantiles(
        table(spark, folder, "events"), ["value"], [0.25, 0.5, 0.75], by=["event_type"], pieces=32, rows_per_task=10, counted_directly=0
    )
    return rounded(found.drop("column"), 6, "q25", "q50", "q75")


@query(
    "rows_segmented",
    """SELECT event_type, ts, value, CAST(row_number() OVER w AS BIGINT) AS t, CAST(count(*) OVER (PARTITION BY event_type) AS BIGINT) AS n
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, value)""",
)
def rows_segmented(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    return ranks.index_rows(rows, ["event_type"], ["ts", "value"], pieces=64, rows_per_task=10)


@query(
    "correlations_with_gaps",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS column_x, '{b}' AS column_y, {'CASE WHEN count(' + a + ') > 1 THEN 1.0 END' if a == b else f'round(corr({a}, {b}), 6)'}::DOUBLE AS corr
            FROM ({CUSTOMERS}) c""" for a in ("c_custkey", "c_nationkey", "c_acctbal") for b in ("c_custkey", "c_nationkey", "c_acctbal")
    ),
)
def correlations_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(distribution.correlations(made(spark, folder, inputs.CUSTOMERS_WITH_GAPS)), 6, "corr")
