"""DuckDB SQL for the queries of queries.py, by the same names and with the same columns."""

from __future__ import annotations

from . import plan_queries, wide_queries  # plan_queries registers its own
from .more_queries import MORE

_SIDES = """
    a AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders),
    raw_b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 103 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0
              UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 89 = 0),
    b AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM raw_b)"""
_ALL = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_DIGEST = "md5(" + " || ".join(f"coalesce('V' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N')" for c in _ALL) + ")"
_VERDICT = "CASE WHEN target_digest IS NULL THEN 'sourceOnly' WHEN source_digest IS NULL THEN 'targetOnly' WHEN source_digest <> target_digest THEN 'changed' ELSE 'same' END"
_DIFF = f"""WITH {_SIDES},
    da AS (SELECT o_orderkey, o_orderpriority, {_DIGEST} AS source_digest FROM a), db AS (SELECT o_orderkey, o_orderpriority, {_DIGEST} AS target_digest FROM b)"""
_VERSION_PARTS = """
    v AS (SELECT p_partkey, p_brand AS script_name, CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE '' END || (p_partkey % 4) || '.' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || (p_partkey % 5) END || CASE WHEN p_partkey % 7 = 0 THEN '-rc.' || (p_partkey % 3) ELSE '' END AS version,
        p_partkey % 4 AS p1, p_size AS p2, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 5 END AS p3, p_partkey % 7 <> 0 AS release, p_partkey % 3 AS pre FROM part)"""

_SNAPSHOTS = """
    l AS (SELECT p_brand AS t, 'c' || p_partkey AS c, 'varchar(' || p_size || ')' AS type, p_size, p_partkey % 2 = 0 AS nullable, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS def, p_partkey AS k FROM part),
    r AS (SELECT t, c, CASE WHEN k % 5 = 0 THEN 'varchar(20)' WHEN k % 17 = 0 THEN 'text' ELSE type END AS type, CASE WHEN k % 13 = 0 THEN NOT nullable ELSE nullable END AS nullable, CASE WHEN k % 19 = 0 THEN NULL ELSE def END AS def FROM l WHERE k % 11 <> 0
          UNION ALL SELECT t, c || '_new', type, nullable, def FROM l WHERE k % 23 = 0)"""


def _bytes(n: str) -> str:
    steps = "".join(f" WHEN {n} >= pow(1024.0, {p}) THEN printf('%.1f', floor({n} / pow(1024.0, {p}) * 10 + 0.5) / 10) || ' {u}'" for p, u in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")))
    return f"CASE{steps} ELSE CAST({n} AS BIGINT) || ' B' END"


ORACLES = {
    "rowdiff_orders": f"{_DIFF} SELECT coalesce(da.o_orderkey, db.o_orderkey) AS o_orderkey, source_digest, target_digest, {_VERDICT} AS verdict FROM da FULL JOIN db ON da.o_orderkey = db.o_orderkey",
    "rowdiff_columns": f"WITH {_SIDES}, j AS (SELECT a.o_orderkey, unnest([" + ", ".join(f"{{'column': '{c}', 'left': CAST(a.{c} AS VARCHAR), 'right': CAST(b.{c} AS VARCHAR)}}" for c in _ALL[1:]) + "]) AS x FROM a JOIN b ON a.o_orderkey = b.o_orderkey) SELECT o_orderkey, x['column'] AS \"column\", x['left'] AS \"left\", x['right'] AS \"right\" FROM j WHERE x['left'] IS DISTINCT FROM x['right']",
    "rowdiff_dup_keys": "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "rowdiff_without_dups": "SELECT l_orderkey, l_linenumber, any_value(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1",
    "rowdiff_cutoff": f"""{_DIFF}, ka AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, source_digest FROM da ORDER BY k LIMIT 2000), kb AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, target_digest FROM db ORDER BY k LIMIT 2000),
        reach AS (SELECT max(k) AS l, count(*) AS n FROM ka UNION ALL SELECT max(k), count(*) FROM kb), cut AS (SELECT min(CASE WHEN n >= 2000 THEN l END) AS c FROM reach)
        SELECT coalesce(ka.k, kb.k) AS o_orderkey, {_VERDICT} AS verdict FROM ka FULL JOIN kb ON ka.k = kb.k, cut WHERE c IS NULL OR coalesce(ka.k, kb.k) <= c""",
    "rowdiff_sample": f"""{_DIFF}, d AS (SELECT coalesce(da.o_orderkey, db.o_orderkey) AS o_orderkey, {_VERDICT} AS verdict FROM da FULL JOIN db ON da.o_orderkey = db.o_orderkey),
        r AS (SELECT *, CAST(CASE verdict WHEN 'sourceOnly' THEN 1 WHEN 'targetOnly' THEN 2 ELSE 3 END AS BIGINT) AS "rank" FROM d WHERE verdict <> 'same')
        SELECT "rank", o_orderkey, verdict, (SELECT count(*) FROM r) > 10 AS more FROM r ORDER BY "rank", o_orderkey LIMIT 10""",
    "table_checksum": f"""WITH {_SIDES}, r AS (SELECT 'source' AS side, {_DIGEST} AS d FROM a UNION ALL SELECT 'target', {_DIGEST} FROM b)
        SELECT side, count(*) AS row_count, md5(count(*) || ':' || CAST(sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(d, 16, 15) AS BIGINT)) AS VARCHAR)) AS checksum FROM r GROUP BY 1""",
    "table_checksum_sorted": f"""WITH {_SIDES}, r AS (SELECT 'source' AS side, {_DIGEST} AS d FROM a UNION ALL SELECT 'target', {_DIGEST} FROM b),
        i AS (SELECT side, CAST('0x' || substr(d, 1, 4) AS INTEGER) % 256 AS bucket, count(*) AS n, md5(string_agg(d, '' ORDER BY d)) AS h FROM r GROUP BY 1, 2)
        SELECT side, CAST(sum(n) AS BIGINT) AS row_count, md5(string_agg(h, '' ORDER BY bucket)) AS checksum FROM i GROUP BY 1""",
    "manifest_fingerprint": "SELECT md5(string_agg(p, ',' ORDER BY p)) AS fingerprint FROM (SELECT n_nationkey || ':' || n_name AS p FROM nation)",
    "data_compare_summary": f"""{_DIFF}, d AS (SELECT coalesce(da.o_orderpriority, db.o_orderpriority) AS table_name, {_VERDICT} AS verdict FROM da FULL JOIN db ON da.o_orderkey = db.o_orderkey)
        SELECT table_name, count(*) FILTER (verdict = 'same') AS same, count(*) FILTER (verdict = 'changed') AS changed, count(*) FILTER (verdict = 'sourceOnly') AS source_only, count(*) FILTER (verdict = 'targetOnly') AS target_only,
               count(*) FILTER (verdict IN ('changed', 'targetOnly')) AS rows_at_risk, count(*) FILTER (verdict = 'same') = count(*) AS identical FROM d GROUP BY 1""",
    "name_outer_join": """WITH a AS (SELECT DISTINCT trim(p_name || ' ' || p_partkey) AS name FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT DISTINCT trim(' ' || p_name || ' ' || p_partkey) AS name FROM part WHERE p_partkey % 7 <> 0)
        SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'onlyA' WHEN a.name IS NULL THEN 'onlyB' ELSE 'matched' END AS status FROM a FULL JOIN b ON a.name = b.name""",
    "keyed_objects": """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'onlyA' WHEN p_partkey % 13 = 0 THEN 'kindMismatch' WHEN p_partkey % 17 = 0 THEN 'definitionMismatch' ELSE 'same' END AS status FROM part""",
    "two_stage_match": """WITH l AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey || ':' || CAST(floor(s_acctbal / 100) AS BIGINT) AS signature FROM supplier),
        r AS (SELECT id + 1000 AS id, CASE WHEN id % 3 = 0 THEN name || '_renamed' ELSE name END AS name, signature FROM l),
        one AS (SELECT l.id AS left_id, r.id AS right_id, 1 AS stage FROM l JOIN r ON l.name = r.name),
        la AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY id) AS n FROM l WHERE id NOT IN (SELECT left_id FROM one)), ra AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY id) AS n FROM r WHERE id NOT IN (SELECT right_id FROM one))
        SELECT * FROM one UNION ALL SELECT la.id, ra.id, CASE WHEN la.id IS NOT NULL AND ra.id IS NOT NULL THEN 2 END FROM la FULL JOIN ra ON la.signature = ra.signature AND la.n = ra.n""",
    "similarity_best": """WITH p AS (SELECT a.n_nationkey AS left_id, b.n_nationkey + 100 AS right_id, floor((CASE WHEN lower(a.n_name) = lower(b.n_name || 's') THEN 1.0::DOUBLE ELSE greatest(0.0, 1.0::DOUBLE - levenshtein(lower(a.n_name), lower(b.n_name || 's'))::DOUBLE / greatest(length(a.n_name), length(b.n_name) + 1)) END) * 100 * 10 + 0.5) / 10.0::DOUBLE AS score FROM nation a, nation b),
        r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS rl, row_number() OVER (PARTITION BY right_id ORDER BY score DESC, left_id) AS rr FROM p)
        SELECT left_id, right_id, score FROM r WHERE rl = 1 AND rr = 1 AND score >= 70""",
    "jaccard_benchmark": """WITH a AS (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark), b AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents),
        na AS (SELECT item_id, count(*) AS n FROM a WHERE w <> '' GROUP BY 1), nb AS (SELECT doc_id, count(*) AS n FROM b WHERE w <> '' GROUP BY 1),
        s AS (SELECT item_id, doc_id, count(*) AS n FROM a JOIN b USING (w) WHERE w <> '' GROUP BY 1, 2)
        SELECT item_id, doc_id, round(s.n::DOUBLE / (na.n + nb.n - s.n), 9) AS similarity FROM s JOIN na USING (item_id) JOIN nb USING (doc_id)""",
    "jaccard_docs": """WITH w AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS s FROM benchmark)
        SELECT a.item_id, round(CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 9) AS similarity FROM w a JOIN w b ON b.item_id = a.item_id + 1""",
    "multiset_sim": """WITH c AS (SELECT p_brand AS g, p_type AS t, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT g, sum(n) AS size FROM c GROUP BY 1),
        p AS (SELECT a.g AS a, b.g AS b, a.size AS sa, b.size AS sb FROM s a JOIN s b ON substr(a.g, 1, 7) = substr(b.g, 1, 7) AND a.g < b.g),
        h AS (SELECT p.a, p.b, sum(least(x.n, y.n)) AS shared FROM p JOIN c x ON x.g = p.a JOIN c y ON y.g = p.b AND y.t = x.t GROUP BY 1, 2)
        SELECT p.a, p.b, round(CAST(coalesce(shared, 0) AS DOUBLE) / CAST(sa + sb - coalesce(shared, 0) AS DOUBLE), 9) AS similarity FROM p LEFT JOIN h ON p.a = h.a AND p.b = h.b""",
    "trend_daily": "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS runs, count(*) FILTER (value > 5) AS measured_runs, round(quantile_cont(value, 0.5) FILTER (value > 5), 6) AS median_value, round(max(value) FILTER (value > 5), 6) AS max_value, round(CAST(quantile_cont(CAST(user_id AS DOUBLE), 0.5) AS DOUBLE), 6) AS median_score FROM events GROUP BY 1",
    "usage_rollup": "SELECT event_type, count(*) AS calls, count(*) FILTER (value > 10) AS n_over_10, count(*) FILTER (value > 50) AS n_over_50, count(*) FILTER (value > 100) AS n_over_100, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "usage_pad": "WITH k AS (SELECT DISTINCT event_type FROM events UNION ALL SELECT 'never'), r AS (SELECT event_type, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS total_users FROM events WHERE value > 200 GROUP BY 1) SELECT k.event_type, coalesce(calls, 0) AS calls, coalesce(total_users, 0) AS total_users FROM k LEFT JOIN r ON k.event_type = r.event_type",
    "rate_window": "WITH c AS (SELECT user_id, count(*) FILTER (ts <= TIMESTAMP '2024-01-30 12:00:00' AND ts >= TIMESTAMP '2024-01-30') AS today, count(*) FILTER (ts <= TIMESTAMP '2024-01-30 12:00:00' AND ts > TIMESTAMP '2024-01-30 11:59:00') AS last_minute FROM events GROUP BY 1) SELECT * FROM c WHERE today > 0 OR last_minute > 0",
    "latest_per_customer": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
    "retention_rank": 'SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn > 8',
    "retention_age": "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAYS GROUP BY 1",
    "on_change_events": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type",
    "run_compare": "WITH p AS (SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders), r AS (SELECT *, CASE WHEN previous <> 0 THEN o_totalprice / previous END AS ratio FROM p) SELECT o_orderkey, round(ratio, 6) AS ratio, CASE WHEN previous IS NULL THEN 'first' WHEN ratio >= 1.2::DOUBLE THEN 'slower' WHEN ratio <= 1 / 1.2::DOUBLE THEN 'faster' ELSE 'same' END AS verdict FROM r",
    "change_over_window": "WITH w AS (SELECT event_type, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, count(*) AS samples FROM events GROUP BY 1) SELECT *, round(last_value - first_value, 6) AS change FROM w",
    "forward_only": "WITH h AS (SELECT p_partkey, p_retailprice, max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_water FROM part) SELECT p_partkey, high_water, high_water IS NULL OR p_retailprice > high_water AS forward FROM h",
    "forward_until_violation": "WITH h AS (SELECT p_brand, p_partkey, p_size, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hw FROM part), c AS (SELECT p_brand, min(p_partkey) FILTER (NOT (hw IS NULL OR p_size > hw)) AS cut FROM h GROUP BY 1) SELECT h.p_brand, p_partkey, p_size FROM h JOIN c ON h.p_brand = c.p_brand WHERE cut IS NULL OR p_partkey < cut",
    "appeared_resolved": "WITH a AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08' AND value > 120), b AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' AND value > 120) SELECT user_id, 'appeared' AS status FROM b WHERE user_id NOT IN (SELECT user_id FROM a) UNION ALL SELECT user_id, 'resolved' FROM a WHERE user_id NOT IN (SELECT user_id FROM b)",
    "ledger_status": """WITH r AS (SELECT DISTINCT p_brand AS family, p_size AS version FROM part WHERE p_size <= 30), p AS (SELECT DISTINCT p_brand AS family, p_size AS version FROM part WHERE p_size <= 25 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 9 = 0)), t AS (SELECT family, max(version) AS top FROM p GROUP BY 1),
        j AS (SELECT coalesce(r.family, p.family) AS family, coalesce(r.version, p.version) AS version, r.family IS NOT NULL AS inr, p.family IS NOT NULL AS inp FROM r FULL JOIN p ON r.family = p.family AND r.version = p.version)
        SELECT j.family, version, CASE WHEN NOT inr THEN 'unregistered' WHEN inp THEN 'applied' WHEN top IS NULL OR version > top THEN 'pending' ELSE 'skipped' END AS status FROM j LEFT JOIN t ON j.family = t.family""",
    "version_sort": f"WITH {_VERSION_PARTS}, r AS (SELECT *, row_number() OVER (PARTITION BY script_name ORDER BY p1 DESC, p2 DESC, p3 DESC, release DESC, CASE WHEN release THEN 0 ELSE pre END DESC, p_partkey DESC) AS rn FROM v) SELECT script_name, version AS head FROM r WHERE rn = 1",
    "version_keys": f"WITH {_VERSION_PARTS} SELECT p_partkey, p1 || '.' || p2 || '.' || p3 || CASE WHEN release THEN '' ELSE '-rc.' || pre END AS key FROM v",
    "timeline_merge": """WITH s AS (SELECT p_brand AS f, p_size AS v, bool_and(p_partkey % 10 = 0) AS failed, p FROM (SELECT *, unnest(CASE WHEN p_partkey % 6 = 0 THEN ['l', 'r'] WHEN p_partkey % 2 = 0 THEN ['l'] WHEN p_partkey % 3 = 0 THEN ['r'] ELSE [] END) AS p FROM part) GROUP BY p_brand, p_size, p),
        h AS (SELECT f, p, max(v) FILTER (NOT failed) AS head, min(v) AS floor FROM s GROUP BY 1, 2),
        l AS (SELECT s.f, s.v, failed, coalesce(v = head, FALSE) AS head FROM s JOIN h ON s.f = h.f AND s.p = h.p WHERE s.p = 'l'), r AS (SELECT s.f, s.v, failed, coalesce(v = head, FALSE) AS head FROM s JOIN h ON s.f = h.f AND s.p = h.p WHERE s.p = 'r'),
        j AS (SELECT coalesce(l.f, r.f) AS f, coalesce(l.v, r.v) AS v, l.failed AS left_failed, r.failed AS right_failed, l.head AS left_head, r.head AS right_head FROM l FULL JOIN r ON l.f = r.f AND l.v = r.v)
        SELECT j.f AS script_name, '1.' || j.v || '.0' AS key, left_failed, right_failed, left_head, right_head, coalesce(left_failed IS NULL AND j.v < hl.floor, FALSE) AS unknown_left, coalesce(right_failed IS NULL AND j.v < hr.floor, FALSE) AS unknown_right
        FROM j LEFT JOIN h hl ON hl.f = j.f AND hl.p = 'l' LEFT JOIN h hr ON hr.f = j.f AND hr.p = 'r'""",
    "family_heads": """WITH a AS (SELECT p_brand AS f, max(p_size) AS v FROM part WHERE p_partkey % 5 = 0 GROUP BY 1), b AS (SELECT p_brand AS f, max(p_size) AS v FROM part WHERE p_partkey % 6 = 0 GROUP BY 1)
        SELECT coalesce(a.f, b.f) AS script_name, '2.' || a.v AS left_head, '2.' || b.v AS right_head, CASE WHEN a.v IS NULL OR b.v IS NULL THEN NULL WHEN a.v < b.v THEN 'left' WHEN a.v > b.v THEN 'right' ELSE 'same' END AS older FROM a FULL JOIN b ON a.f = b.f""",
    "semi_anti": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'orders' ELSE 'none' END AS kind FROM customer",
    "search_patterns": "WITH e AS (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_type AS \"table\", 'c' || (k % 3) AS equality, CASE WHEN k % 2 = 0 THEN 'ts' END AS \"range\", count(DISTINCT user_id) AS queries, count(*) AS runs FROM e GROUP BY 1, 2, 3",
    "worst_severity_dedupe": "SELECT l_orderkey, ['info', 'low', 'medium', 'high'][max(l_linenumber % 4 + 1)] AS severity FROM lineitem GROUP BY 1",
    "severity_counts": "SELECT count(*) FILTER (l_linenumber % 4 = 0) AS info, count(*) FILTER (l_linenumber % 4 = 1) AS low, count(*) FILTER (l_linenumber % 4 = 2) AS medium, count(*) FILTER (l_linenumber % 4 = 3) AS high FROM lineitem",
    "category_matrix": "WITH c AS (SELECT c_mktsegment AS category, CASE WHEN c_custkey % 7 = 0 THEN 'added' WHEN c_custkey % 11 = 0 THEN 'dropped' WHEN c_custkey % 5 = 0 THEN 'changed' END AS k FROM customer) SELECT category, count(*) FILTER (k = 'added') AS added, count(*) FILTER (k = 'dropped') AS dropped, count(*) FILTER (k = 'changed') AS changed, greatest(0, count(*) - count(*) FILTER (k = 'added') - count(*) FILTER (k = 'changed')) AS in_sync FROM c GROUP BY 1",
    "null_safe_diff": "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS b FROM orders) SELECT * FROM x WHERE a IS DISTINCT FROM b",
    "tuple_in": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '5-LOW'), ('P', '2-HIGH'))",
    "feed_filter": "SELECT event_id, event_type FROM events WHERE contains(lower(event_type || ' ' || props), 'c') ORDER BY ts DESC, event_id DESC LIMIT 200",
    "due_select": "WITH o AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1), c AS (SELECT c_custkey, last, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 43200 END AS every FROM customer LEFT JOIN o ON c_custkey = o_custkey) SELECT c_custkey, every FROM c WHERE every > 0 AND (last IS NULL OR TIMESTAMP '2001-08-01 00:00:05' >= last + to_minutes(every)) ORDER BY last NULLS FIRST, c_custkey LIMIT 6",
    "threshold_breach": "WITH l AS (SELECT l_suppkey, round(count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*), 9) AS returned, round(avg(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1) SELECT l_suppkey, 'returned' AS metric, round(returned / 0.33::DOUBLE, 6) AS overshoot FROM l WHERE returned > 0.33::DOUBLE UNION ALL SELECT l_suppkey, 'quantity', round(25.0::DOUBLE / quantity, 6) FROM l WHERE quantity < 25.0::DOUBLE",
    "ratio_levels": "WITH r AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*) AS ratio FROM lineitem GROUP BY 1) SELECT l_suppkey, round(ratio, 9) AS ratio, CASE WHEN ratio >= 0.36::DOUBLE THEN 'bad' WHEN ratio >= 0.3::DOUBLE THEN 'watch' ELSE 'good' END AS level FROM r",
    "size_format": f"WITH d AS (SELECT doc_id, CAST(n_chars AS BIGINT) * n_chars AS n FROM documents) SELECT doc_id, {_bytes('n')} AS bytes, CASE WHEN n >= 1000000 THEN printf('%.1f', floor(n / 1e6::DOUBLE * 10 + 0.5) / 10) || 'M' WHEN n >= 1000 THEN printf('%.1f', floor(n / 1e3::DOUBLE * 10 + 0.5) / 10) || 'k' ELSE CAST(n AS VARCHAR) END AS count FROM d",
    "score_rounding": "SELECT s_suppkey, floor(s_acctbal * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS score FROM supplier",
    "text_similarity": "WITH n AS (SELECT n_nationkey, lower(n_name) AS a, lower(reverse(n_name)) AS b FROM nation) SELECT n_nationkey, round(CASE WHEN a = b THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) END, 9) AS similarity FROM n",
    "fnv_fingerprint": """WITH q AS (SELECT p_partkey, 'select * from t where a = ? and b = ?' AS s FROM part)
        SELECT p_partkey, lower(lpad(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)), 8, '0')) AS fingerprint FROM q""",
    "calendar_spine": "WITH s AS (SELECT CAST(unnest(generate_series(DATE '2024-02-02' - INTERVAL 34 DAYS, DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day), c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE value > 150 GROUP BY 1) SELECT s.day, coalesce(n, 0) AS n FROM s LEFT JOIN c ON s.day = c.day",
    "series_geometry": """WITH d AS (SELECT event_type, date_trunc('day', ts) AS ts_day, max(value) AS value FROM events GROUP BY 1, 2), e AS (SELECT *, epoch(ts_day) AS t FROM d),
        f AS (SELECT event_type, min(t) AS t0, max(t) AS t1, min(value) AS low, max(value) AS high FROM e GROUP BY 1), g AS (SELECT *, CASE WHEN high > low THEN (high - low) * 0.1::DOUBLE ELSE greatest(abs(high) * 0.1::DOUBLE, 0.5::DOUBLE) END AS pad FROM f)
        SELECT e.event_type, strftime(ts_day, '%Y-%m-%d') AS day, round(CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0.5::DOUBLE END, 6) AS x, round(1 - (value - (low - pad)) / (high - low + 2 * pad), 6) AS y FROM e JOIN g ON e.event_type = g.event_type""",
    "union_privileges": "SELECT 'region' AS kind, r_name AS name FROM region UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'supplier', s_name FROM supplier",
    "recursive_region": """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
        r(node, depth) AS (SELECT 'r' || r_regionkey, 0 FROM region WHERE r_regionkey < 2 UNION ALL SELECT e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY node""",
    "topological_depth": """WITH RECURSIVE e AS (SELECT n_nationkey AS node, CAST(floor(n_nationkey / 2) AS INTEGER) AS needs FROM nation WHERE n_nationkey > 0),
        r(node, depth) AS (SELECT n_nationkey, 0 FROM nation UNION ALL SELECT e.node, r.depth + 1 FROM r JOIN e ON e.needs = r.node WHERE r.depth < 50) SELECT node, max(depth) AS depth FROM r GROUP BY node""",
    "ancestor_fold": """WITH RECURSIVE e AS (SELECT n_nationkey AS child, CAST(floor(n_nationkey / 2) AS INTEGER) AS parent FROM nation WHERE n_nationkey > 0), a(node, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT a.node, e.parent, a.depth + 1 FROM a JOIN e ON e.child = a.ancestor),
        t AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 3 <> 0), m AS (SELECT node, arg_max(ancestor, depth) AS top FROM a WHERE ancestor IN (SELECT k FROM t) GROUP BY 1) SELECT CAST(t.k AS VARCHAR) AS "table", CAST(coalesce(m.top, t.k) AS VARCHAR) AS top FROM t LEFT JOIN m ON m.node = t.k""",
    "asof_previous": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events",
    "asof_last_nonnull": "SELECT event_id, last_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_known FROM events",
    "range_after_oldest": "WITH m AS (SELECT o_custkey, min((o_orderdate, o_orderkey)) AS oldest FROM orders GROUP BY 1) SELECT orders.o_custkey, o_orderkey FROM orders JOIN m ON orders.o_custkey = m.o_custkey WHERE (o_orderdate, o_orderkey) > oldest",
    "topn_nested": "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), n AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS s FROM e WHERE rn <= 5 GROUP BY 1) SELECT c_custkey AS user_id, coalesce(s, '') AS events FROM customer LEFT JOIN n ON c_custkey = n.user_id",
    "alert_transitions": """WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'drifted' WHEN 'error' THEN 'unreachable' ELSE 'in_sync' END AS s, floor(value / 20) AS m FROM events),
        p AS (SELECT *, lag(s) OVER w AS ps, lag(m) OVER w AS pm FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_id, ps AS previous_status, CASE WHEN s = 'unreachable' AND ps IS DISTINCT FROM 'unreachable' THEN 'unreachable' WHEN s = 'drifted' AND ps = 'unreachable' THEN 'reachable' WHEN s = 'drifted' AND ps IS DISTINCT FROM 'drifted' THEN 'drifted' WHEN s = 'drifted' AND pm <> m THEN 'changed' WHEN s = 'in_sync' AND ps = 'drifted' THEN 'in_sync' WHEN s = 'in_sync' AND ps = 'unreachable' THEN 'reachable' ELSE 'nothing' END AS alert FROM p""",
    "recorded_outcomes": """WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'drifted' WHEN 'error' THEN 'unreachable' ELSE 'in_sync' END AS s, CASE WHEN event_id % 4 <> 0 THEN floor(value / 20) END AS m FROM events),
        n AS (SELECT *, lag(s) OVER w IS DISTINCT FROM s AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n),
        k AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM r) SELECT event_id FROM k WHERE new OR (m IS NOT NULL AND known IS DISTINCT FROM m)""",
    "incremental_lookback": "SELECT event_id FROM events WHERE event_id > 900 AND event_id % 3 <> 0 ORDER BY event_id LIMIT 200",
    "structure_diff": """WITH b AS (SELECT p_brand || '/' || p_size AS parent, p_partkey, p_type FROM part), a AS (SELECT p_brand || '/' || p_size AS parent, p_partkey, CASE WHEN p_partkey % 21 = 0 THEN 'new' ELSE p_type END AS p_type FROM part WHERE p_partkey % 10 <> 0 AND p_size <> 7)
        SELECT b.parent, b.p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'gone' ELSE 'changed' END AS status FROM b LEFT JOIN a ON a.p_partkey = b.p_partkey WHERE (a.p_partkey IS NULL AND b.parent IN (SELECT parent FROM a)) OR a.p_type <> b.p_type""",
    "fallback_label": "SELECT o_orderkey, coalesce(c_name, '(deleted connection)') AS label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey",
    "wanted_pairs": "SELECT o_orderkey, c_custkey, status FROM orders JOIN (SELECT unnest([1, 2, 3, 4])::BIGINT AS c_custkey, unnest(['F', 'O', 'P', 'F']) AS status) ON o_custkey = c_custkey AND o_orderstatus = status",
    "latest_with_counts": "WITH o AS (SELECT o_custkey, count(*) AS n, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1) SELECT c_custkey, coalesce(n, 0) AS orders, latest FROM customer LEFT JOIN o ON c_custkey = o_custkey",
    "role_permissions": "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (o_totalprice > 100000) AS permissions FROM orders GROUP BY 1",
    "either_side": "SELECT DISTINCT n_nationkey, n_name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey WHERE n_regionkey = 1 OR s_suppkey % 10 = 0",
    "order_preference": "SELECT c_custkey FROM customer ORDER BY c_custkey = 77 DESC, c_mktsegment = 'BUILDING' DESC, c_custkey LIMIT 1",
    "loudest_level": "SELECT p_brand, p_name, ['unknown', 'patch', 'additive', 'breaking'][max(CASE WHEN p_size > 45 THEN 4 WHEN p_size > 20 THEN 3 WHEN p_size > 3 THEN 2 ELSE 1 END)] AS level FROM part GROUP BY 1, 2",
    "type_changes": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE WHEN p_partkey % 3 = 1 AND p_size = 20 THEN 20.0::DOUBLE ELSE 12.0::DOUBLE END AS score, p_partkey % 3 = 1 AND p_size > 20 AS narrows FROM part",
    "cadence_normalized": "WITH p AS (SELECT p_partkey, p_size * 7 - 10 AS m FROM part) SELECT p_partkey, CASE WHEN m > 0 THEN list_sort([[abs(a - m), -a] for a in [5, 15, 30, 60, 180, 360]])[1][2] * -1 END AS minutes FROM p",
    "schema_column_changes": f"""WITH {_SNAPSHOTS}, j AS (SELECT coalesce(l.t, r.t) AS t, coalesce(l.c, r.c) AS c, l.c IS NULL AS no_l, r.c IS NULL AS no_r, l.type AS lt, r.type AS rt, p_size, l.nullable AS ln, r.nullable AS rn, l.def AS ld, r.def AS rd FROM l FULL JOIN r ON l.t = r.t AND l.c = r.c)
        SELECT t AS "table", c AS "column", CASE WHEN no_r THEN 'onlyA' ELSE 'onlyB' END AS status, NULL::VARCHAR AS kind, NULL::VARCHAR AS severity FROM j WHERE no_l OR no_r
        UNION ALL SELECT t, c, 'matched', 'type', 'high' FROM j WHERE rt = 'text'
        UNION ALL SELECT t, c, 'matched', 'size', CASE WHEN p_size < 20 THEN 'high' ELSE 'low' END FROM j WHERE rt = 'varchar(20)' AND lt <> rt
        UNION ALL SELECT t, c, 'matched', 'nullability', CASE WHEN ln THEN 'low' ELSE 'high' END FROM j WHERE ln <> rn
        UNION ALL SELECT t, c, 'matched', 'default', 'low' FROM j WHERE NOT no_l AND NOT no_r AND ld IS DISTINCT FROM rd
        UNION ALL SELECT l.t, l.c, 'matched', 'foreignKey', 'medium' FROM l JOIN r ON l.t = r.t AND l.c = r.c WHERE k % 4 <> 0""",
    "drift_fingerprint": f"""WITH {_SNAPSHOTS}, x AS (SELECT 'column onlyA ' || t || '.' || c AS line FROM l WHERE (t, c) NOT IN (SELECT (t, c) FROM r) UNION ALL SELECT 'column onlyB ' || t || '.' || c FROM r WHERE (t, c) NOT IN (SELECT (t, c) FROM l))
        SELECT sha1(string_agg(line, chr(10) ORDER BY line)) AS fingerprint, count(*) AS differences FROM x""",
    "migration_script": f"""WITH {_SNAPSHOTS} SELECT 8 AS phase, 'add-column' AS kind, t AS "table", c AS object, CASE WHEN NOT nullable AND def IS NULL THEN 'high' ELSE 'low' END AS severity, FALSE AS destructive, 'ALTER TABLE "' || t || '" ADD COLUMN "' || c || '" ' || type || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END || coalesce(' DEFAULT ' || def, '') AS sql FROM l WHERE (t, c) NOT IN (SELECT (t, c) FROM r)
        UNION ALL SELECT 10, 'drop-column', t, c, 'high', TRUE, 'ALTER TABLE "' || t || '" DROP COLUMN "' || c || '"' FROM r WHERE (t, c) NOT IN (SELECT (t, c) FROM l)""",
    "structural_level": f"WITH {_SNAPSHOTS} SELECT CASE WHEN count(*) FILTER (c LIKE '%_new') > 0 THEN 'breaking' ELSE 'patch' END AS level FROM r",
}
ORACLES |= {name: sql for name, (_, sql) in MORE.items() if sql} | {"rowdiff_tree": wide_queries._tree_sql()}
