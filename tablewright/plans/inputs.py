"""Inputs that queries and their SQL share, written once as SQL over ``{table}`` names."""

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# The given tables hold no nulls and no copies; these have both.
ORDERS_WITH_GAPS = """
    SELECT o_orderkey, o_custkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus,
           CASE WHEN o_orderpriority <> '2-HIGH' THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
    FROM {orders}"""
ORDERS_TWICE = """
    SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus,
           CASE WHEN o_orderpriority <> '2-HIGH' THEN o_totalprice END AS o_totalprice, o_orderpriority FROM {orders}
    UNION ALL
    SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus,
           CASE WHEN o_orderpriority <> '2-HIGH' THEN o_totalprice END AS o_totalprice, o_orderpriority FROM {orders}"""
CUSTOMERS_WITH_GAPS = """
    SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
           NULLIF(c_mktsegment, 'BUILDING') AS c_mktsegment
    FROM {customer}"""

# File names as they would lie in a source folder, and the ledger of those already handled.
FILE_NAMES = """
    SELECT '/data/' || source || '/doc_' || CAST(doc_id AS VARCHAR(20)) || CASE
             WHEN lang = 'en' THEN '.CSV' WHEN lang = 'fr' THEN '.json' WHEN n_chars > 2000 THEN '.parquet'
             WHEN n_chars > 500 THEN '.txt' ELSE '.xlsx' END AS path
    FROM {documents}"""
PROCESSED = """
    SELECT 'doc_' || CAST(doc_id AS VARCHAR(20)) AS base_name, '/data/in/doc_' || CAST(doc_id AS VARCHAR(20)) || '.csv' AS file_path,
           CASE WHEN toxic = 1 THEN 'error' ELSE 'success' END AS status,
           CASE WHEN toxic = 1 THEN 'No rows in file' END AS message
    FROM {labels}"""

# Free-text answers around the content of a table: some JSON is cut short, some has text behind it.
JSON_RESPONSES = """
    SELECT p_partkey, 'Here are the cases: [{{"title": "Promote ' || p_name || '", "description": "Sold as ' || p_brand
           || '", "impact": "' || CASE WHEN p_size > 25 THEN 'High' ELSE 'Low' END || '", "effort": "Medium"}}'
           || CASE WHEN p_type = 'ECONOMY' THEN ', {{"title": "Review price", "impact": "Medium"}}]'
                   WHEN p_type = 'PROMO' THEN ', {{"title": '
                   WHEN p_type = 'SMALL' THEN '] and [more]'
                   ELSE '] as asked.' END AS text
    FROM {part}"""
LINE_RESPONSES = """
    SELECT doc_id, CASE WHEN lang = 'de' THEN text ELSE
           'Findings for ' || source || '\n' || CASE WHEN n_chars > 4000 THEN 'Short Description: seen early\nImpact: low\n' ELSE '' END
           || '\n 1. Review ' || source || '. All of it \n' || text || '\nImpact: '
           || CASE WHEN n_chars > 3000 THEN 'High' WHEN n_chars > 1000 THEN 'medium' ELSE 'unknown' END
           || '\n10) no title\n2. Measure quality.\n\tDescription: there are ' || CAST(n_chars AS VARCHAR(20))
           || ' characters: many\nExpected effort: low\nImpact on effort: high\n3. Stop' END AS text
    FROM {documents}"""

# Series with different rhythms.  A distinct day counts once; the raw series keeps equal dates.
RHYTHMS = """
    SELECT 'daily ' || event_type AS series, CAST(date_trunc('day', ts) AS DATE) AS ts, sum(value) AS value
    FROM {events} GROUP BY event_type, date_trunc('day', ts)
    UNION ALL
    SELECT 'weekly' AS series, CAST(date_trunc('week', o_orderdate) AS DATE) AS ts, sum(o_totalprice) AS value
    FROM {orders} GROUP BY date_trunc('week', o_orderdate)
    UNION ALL
    SELECT 'monthly ' || o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, sum(o_totalprice) AS value
    FROM {orders} GROUP BY o_orderpriority, date_trunc('month', o_orderdate)
    UNION ALL
    SELECT 'month ends' AS series, last_day(o_orderdate) AS ts, sum(o_totalprice) AS value
    FROM {orders} GROUP BY last_day(o_orderdate)
    UNION ALL
    SELECT 'quarterly' AS series, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ts, sum(o_totalprice) AS value
    FROM {orders} GROUP BY date_trunc('quarter', o_orderdate)
    UNION ALL
    SELECT 'yearly' AS series, CAST(date_trunc('year', o_orderdate) AS DATE) AS ts, sum(o_totalprice) AS value
    FROM {orders} GROUP BY date_trunc('year', o_orderdate)
    UNION ALL
    SELECT 'raw ' || o_orderstatus AS series, o_orderdate AS ts, o_totalprice AS value FROM {orders}
    UNION ALL
    SELECT 'events' AS series, ts AS ts, value FROM {events}"""
DAILY_ORDERS = """
    SELECT o_orderpriority, CAST(date_trunc('day', o_orderdate) AS DATE) AS ts, sum(o_totalprice) AS value
    FROM {orders} GROUP BY o_orderpriority, date_trunc('day', o_orderdate)"""
