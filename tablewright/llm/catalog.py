"""The numbered operators as named queries over whole tables, with SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (
    chat,
    contamination,
    exact_copies,
    language,
    lm_scoring,
    near_copies,
    pieces,
    prefix_trie,
    quality_model,
    quality_rules,
    repair,
    token_counts,
    toxicity,
)
from tablewright.llm.common import public_file, read

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


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.token_counts(read(spark, folder, "documents"), public_file("word_bpe_49k.json"))
    return token_counts.with_limit(counts, 2048)


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, folder, "documents"))


@query(
    "op6_contamination",
    r"""
    WITH doc AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents),
    item AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark),
    win AS (
        SELECT item_id, w[i:i + 12] AS phrase, least(len(w), 13) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0) t),
    sizes AS (SELECT DISTINCT n FROM win),
    place AS (
        SELECT doc_id, i, n, w[i:i + n - 1] AS phrase
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n) t),
    hit AS (SELECT DISTINCT p.doc_id, p.i, p.n, win.item_id FROM place p JOIN win ON win.phrase = p.phrase),
    hit_words AS (
        SELECT doc_id, count(DISTINCT j) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) t GROUP BY doc_id),
    hit_items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) t GROUP BY doc_id)
    SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
)
def op6_contamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.drop("n_near_items")


@query("op9_pieces")
def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_digests(read(spark, folder, "documents"), public_file("piece_bpe_32k.model"))


@query("op2_quality_model")
def op2_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    return quality_model.score(documents, quality_model.fit(documents, read(spark, folder, "labels")))


@query("op5_language")
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    return language.predict(documents, language.learn(documents))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    return toxicity.score(documents, toxicity.fit(documents, read(spark, folder, "labels")))


@query(
    "op8_near_copies",
    r"""
    WITH RECURSIVE doc AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    shingle AS (
        SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM doc WHERE len(w) > 0) t),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
    ranked AS (
        SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS place
        FROM shingle JOIN (SELECT s, count(*) AS f FROM shingle GROUP BY s) q USING (s) JOIN sizes USING (doc_id)),
    -- Two sets that share 80 in 100 of their union share one of their rarest n - ceil(0.8 n) + 1 shingles.
    rare AS (SELECT doc_id, s, n FROM ranked WHERE place <= n - (80 * n + 99) // 100 + 1),
    pairs AS (
        SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb
        FROM rare a JOIN rare b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
    shared AS (
        SELECT p.a, p.b, p.na, p.nb, count(*) AS both_have
        FROM pairs p JOIN shingle x ON x.doc_id = p.a JOIN shingle y ON y.doc_id = p.b AND y.s = x.s GROUP BY ALL),
    link AS (SELECT a, b FROM shared WHERE 100 * both_have >= 80 * (na + nb - both_have)),
    way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM way UNION SELECT reach.doc_id, way.b FROM reach JOIN way ON way.a = reach.other),
    comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc.doc_id) AS component_id,
           coalesce(component_id, doc.doc_id) = doc.doc_id AS kept
    FROM doc LEFT JOIN sizes USING (doc_id) LEFT JOIN comp USING (doc_id)""",
)
def op8_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies.near_copies(read(spark, folder, "documents"))


@query(
    "op10_chat_format",
    r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    -- No text of the table has a backslash, so escaping adds one to each control string.
    r AS (
        SELECT *, length(regexp_replace(text, '(</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\])', '\\\1', 'g'))
                  + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 15 ELSE 17 + length(role) END AS chars
        FROM t)
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
           CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
    FROM r GROUP BY conv_id""",
)
def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    marks = "</s>[INST] ok [/INST]"
    rows = chat.with_conversation(read(spark, folder, "conversations"), -7, [("user", marks), ("assistant", marks)])
    return chat.read_back(chat.format_turns(rows))


@query("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.lm_scores(read(spark, folder, "documents"))


@query(
    "op11_exact_copies",
    r"""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op11_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_copies.exact_copies(read(spark, folder, "documents"))


#: crc32 of an ASCII text, which the other engine has no function for.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({s}) + 1), lambda i: ord(substr({s}, i, 1))::BIGINT)),
            lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END))), 4294967295)"""


@query(
    "op12_conversation_repair",
    r"""
    WITH RECURSIVE raw AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
    fate AS (SELECT *, """ + _CRC.format(s="name") + r""" % 20 AS f FROM raw),
    hurt AS (
        SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
               CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS again
        FROM fate WHERE f <> 0),
    line AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), again) AS i,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS seen,
               regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending, left(role, 1) AS letter
        FROM hurt),
    row_fault AS (
        SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
               lag(letter) OVER (PARTITION BY conv_id ORDER BY i) || letter AS pair
        FROM line),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
        FROM row_fault GROUP BY conv_id),
    -- From the last row on: cost and audit of what is left, behind nothing (q), a system (s), a user (u) and an assistant (a) row.
    togo AS (
        SELECT conv_id, n AS i, {'c': 0::BIGINT, 'e': ''} AS q, {'c': 4::BIGINT, 'e': 'II'} AS s, {'c': 2::BIGINT, 'e': 'I'} AS u, {'c': 0::BIGINT, 'e': ''} AS a FROM counts
        UNION ALL
        SELECT conv_id, i, list_min([q, {'c': 2 + list_min([u, {'c': 2 + a.c, 'e': 'I' || a.e}]).c, 'e': 'I' || list_min([u, {'c': 2 + a.c, 'e': 'I' || a.e}]).e}]),
               list_min([s, {'c': 2 + list_min([u, {'c': 2 + a.c, 'e': 'I' || a.e}]).c, 'e': 'I' || list_min([u, {'c': 2 + a.c, 'e': 'I' || a.e}]).e}]),
               list_min([u, {'c': 2 + a.c, 'e': 'I' || a.e}]), list_min([a, {'c': 2 + u.c, 'e': 'I' || u.e}])
        FROM (
            SELECT t.conv_id, t.i - 1 AS i,
                   list_min([{'c': 3 + q.c, 'e': 'D' || q.e}, CASE WHEN ok THEN {'c': 2 + cut + u.c, 'e': 'R' || u.e} END,
                             CASE WHEN ok AND letter = 's' THEN {'c': cut + s.c, 'e': 'K' || s.e} WHEN ok AND letter = 'u' THEN {'c': cut + u.c, 'e': 'K' || u.e} END]) AS q,
                   list_min([{'c': 3 + s.c, 'e': 'D' || s.e}, CASE WHEN ok THEN {'c': 2 + cut + u.c, 'e': 'R' || u.e} END,
                             CASE WHEN ok AND letter = 'u' THEN {'c': cut + u.c, 'e': 'K' || u.e} END]) AS s,
                   list_min([{'c': 3 + u.c, 'e': 'D' || u.e}, CASE WHEN ok THEN {'c': 2 + cut + a.c, 'e': 'R' || a.e} END,
                             CASE WHEN ok AND letter = 'a' THEN {'c': cut + a.c, 'e': 'K' || a.e} END]) AS u,
                   list_min([{'c': 3 + a.c, 'e': 'D' || a.e}, CASE WHEN ok THEN {'c': 2 + cut + u.c, 'e': 'R' || u.e} END,
                             CASE WHEN ok AND letter = 'u' THEN {'c': cut + u.c, 'e': 'K' || u.e} END]) AS a
            FROM togo t JOIN (SELECT conv_id, i, letter, fault NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM row_fault) r
                 ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i) x),
    best AS (SELECT conv_id, q.c AS cost, q.e AS audit FROM togo WHERE i = 0),
    edit AS (
        SELECT conv_id, p, e, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS i,
               sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS k
        FROM (SELECT conv_id, p, substr(audit, p, 1) AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best) y) z),
    placed AS (
        SELECT e.conv_id, e.p, e.e, e.k, r.role, r.text,
               max(CASE WHEN e.k = 1 AND e.e = 'K' AND r.letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
        FROM edit e LEFT JOIN row_fault r ON e.e <> 'I' AND r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i
        WHERE e.e <> 'D'),
    mended AS (
        SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
                   || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS digest
        FROM placed GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
         LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM o.conv_id""",
)
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(read(spark, folder, "conversations"))


@query(
    "op13_prefix_trie",
    r"""
    WITH RECURSIVE said AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
        FROM conversations WHERE conv_id IS NOT NULL),
    conv AS (SELECT conv_id, """ + _CRC.format(s="name") + r""" % 9 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM said) x),
    rebuilt AS (
        SELECT c.conv_id, s.i, s.role, s.text FROM conv c JOIN said s ON s.conv_id = c.conv_id - c.conv_id % 5 AND s.i <= c.h
        UNION ALL SELECT c.conv_id, s.i, s.role, s.text FROM conv c JOIN said s ON s.conv_id = c.conv_id AND s.i > c.h),
    step AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, sha256(length(role) || ':' || role || text) AS t, strlen(text) AS n_bytes FROM rebuilt),
    member AS (
        SELECT conv_id, d, string_agg(t, ',') OVER (PARTITION BY conv_id ORDER BY d) AS node, n_bytes, d = count(*) OVER (PARTITION BY conv_id) AS ends FROM step
        UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM step) FROM conv),
    node AS (
        SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
               CASE WHEN d > 1 THEN left(node, 65 * (d - 1) - 1) WHEN d = 1 THEN '' END AS parent
        FROM member GROUP BY node, d),
    child AS (SELECT parent, count(*) AS n FROM node GROUP BY parent),
    under AS (
        SELECT n.node AS top, n.node, n.d FROM node n
        UNION ALL SELECT u.top, n.node, n.d FROM under u JOIN node n ON n.parent = u.node),
    total AS (
        SELECT u.top, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.n_bytes) AS saved
        FROM under u JOIN node n ON n.node = u.node LEFT JOIN child c ON c.parent = u.node GROUP BY u.top)
    SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
           CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM node n LEFT JOIN node p ON p.node = n.parent LEFT JOIN child c ON c.parent = n.node JOIN total t ON t.top = n.node""",
)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, folder, "conversations"))
