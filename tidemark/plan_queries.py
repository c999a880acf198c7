"""Queries of plans, advice, filters and readings of scripts over rows: orders stand for plans and columns, customers for tables, lines for indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, tasks
from .functions import sqltext
from .more_queries import _t, query
from .plans import advice, findings, steps
from .wide_queries import _part_scripts, _parts

_MORE = {"Relation Name": "string", "Filter": "string", "Actual Rows": "double", "Actual Loops": "double", "Actual Total Time": "double", "Rows Removed by Filter": "double", "Sort Space Type": "string", "Lossy Heap Blocks": "double", "Heap Fetches": "double"}


def _node(kind: str, rows: Column, cost: Column, *kids: Column, **more) -> Column:
    fields = [F.lit(kind).alias("Node Type"), rows.cast("double").alias("Plan Rows"), cost.cast("double").alias("Total Cost")]
    fields += [(more[n.replace(" ", "_")] if n.replace(" ", "_") in more else F.lit(None)).cast(t).alias(n) for n, t in _MORE.items()]
    return F.struct(*fields, *([F.array(*kids).alias("Plans")] if kids else []))


def _order_plans(spark, d) -> tuple[DataFrame, DataFrame]:
    """(steps of a plan for each order, of one of nine kinds; rows of the tables that they read, one a customer)."""
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    names = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    orders = _t(spark, d, "orders").join(names, "o_custkey").withColumn("t", F.floor("o_totalprice").cast("long"))
    n, one, relation, removed, number = F.col("n"), F.lit(1), F.col("c_name"), F.floor(F.col("t") / 20), F.lit
    leaf = _node("Index Scan", one, number(9), Relation_Name=relation)
    kinds = [
        _node("Seq Scan", n, number(900), Relation_Name=relation, Filter=F.lit("(a = 1)")),
        _node("Seq Scan", n, number(90), Relation_Name=relation, Actual_Rows=n, Actual_Loops=one, Actual_Total_Time=number(4), Rows_Removed_by_Filter=removed),
        _node("Index Scan", one, number(9), Relation_Name=relation, Actual_Rows=3 * n, Actual_Loops=one, Actual_Total_Time=number(2)),
        _node("Sort", n, number(50), leaf, Sort_Space_Type=F.when(n % 2 == 0, "Disk").otherwise("Memory")),
        _node("Nested Loop", n, 800 * n + 200, _node("Index Scan", 400 * n, number(100), Relation_Name=relation), _node("Seq Scan", number(5), one, Relation_Name=relation)),
        _node("Bitmap Heap Scan", n, number(9), Relation_Name=relation, Lossy_Heap_Blocks=n - 1),
        _node("Index Only Scan", n, number(9), Relation_Name=relation, Heap_Fetches=removed),
        _node("Hash Join", 100 * n, number(2000), _node("Seq Scan", removed, number(900), Relation_Name=relation), _node("Hash", n, number(9))),
        _node("ModifyTable", one, number(10), leaf),
    ]
    text = F.concat(F.lit('[{"Plan": '), F.coalesce(*[F.when(F.col("o_orderkey") % len(kinds) == i, F.to_json(kind)) for i, kind in enumerate(kinds)]), F.lit("}]"))
    plans = tasks.spread(orders.join(lines, "o_orderkey"), "o_orderkey", _t(spark, d, "orders").count()).select(F.col("o_orderkey").cast("string").alias("plan_id"), text.alias("plan"))
    sizes = orders.groupBy(F.col("c_name").alias("relation")).agg(F.floor(F.sum("t") / 100).cast("double").alias("rows"))
    return scratch.materialize(steps.weighed(steps.flattened(plans)), "order-plan-steps"), sizes


_PLANS = """WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, c_name, floor(o_totalprice)::BIGINT AS t FROM orders JOIN customer ON c_custkey = o_custkey),
    r AS (SELECT c_name, sum(t) // 100 >= 10000 AS big FROM o GROUP BY 1), p AS (SELECT k, k % 9 AS kind, n, t // 20 AS t, big, (400 * n)::DOUBLE / (800 * n + 200)::DOUBLE AS share FROM o JOIN l USING (k) JOIN r USING (c_name)),
    f AS (SELECT *, CASE kind WHEN 0 THEN CASE WHEN big THEN 'seq-scan' END WHEN 1 THEN CASE WHEN t >= 10000 THEN 'wasteful-filter' END WHEN 2 THEN CASE WHEN n >= 4 THEN 'estimate-off' END WHEN 3 THEN CASE WHEN n % 2 = 0 THEN 'sort-on-disk' END
        WHEN 4 THEN CASE WHEN big THEN 'nested-loop' END WHEN 5 THEN CASE WHEN n > 1 THEN 'lossy-bitmap' END WHEN 6 THEN CASE WHEN t >= 10000 THEN 'heap-fetches' END WHEN 7 THEN CASE WHEN t >= 10000 AND 100 * n <= 0.1::DOUBLE * t THEN 'join-key' END END AS finding FROM p),
    g AS (SELECT *, CASE WHEN finding IN ('seq-scan', 'nested-loop') THEN 'high' WHEN finding IN ('lossy-bitmap', 'heap-fetches') THEN 'low' WHEN finding IS NOT NULL THEN 'medium' END AS severity FROM f)"""


@query(f"{_PLANS} SELECT k AS o_orderkey, CASE kind WHEN 4 THEN 3 ELSE 1 END AS step_id, finding, severity FROM g WHERE finding IS NOT NULL")
def order_plan_findings(spark, d):
    found, sizes = _order_plans(spark, d)
    return findings.plan_findings(found, sizes).select(F.col("plan_id").cast("long").alias("o_orderkey"), "step_id", "finding", "severity")


@query(f"""{_PLANS}, s AS (SELECT k, kind, 100 - CASE severity WHEN 'high' THEN 12 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END - CASE kind WHEN 0 THEN CASE WHEN big THEN 25 ELSE 0 END WHEN 1 THEN CASE WHEN big THEN 25 ELSE 0 END WHEN 2 THEN CASE WHEN n >= 4 THEN 15 ELSE 0 END
        WHEN 3 THEN CASE WHEN n % 2 = 0 THEN 10 ELSE 0 END WHEN 4 THEN CASE WHEN big THEN floor(25 * share + 0.5::DOUBLE) ELSE 0 END + CASE WHEN n >= 3 THEN floor(20 * share + 0.5::DOUBLE) ELSE 0 END WHEN 7 THEN CASE WHEN big THEN 11 ELSE 0 END ELSE 0 END AS score FROM g)
    SELECT k AS o_orderkey, score::INT AS score, CASE WHEN score >= 85 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS band, kind <> 8 AS reads_only FROM s""")
def order_plan_scores(spark, d):
    found, sizes = _order_plans(spark, d)
    scores = steps.scored(found, findings.plan_findings(found, sizes), sizes).join(findings.reads_only(found), "plan_id")
    return scores.select(F.col("plan_id").cast("long").alias("o_orderkey"), "score", "band", "reads_only")


def _table_advice(spark, d) -> tuple[DataFrame, DataFrame]:
    """(all advice, foreign keys) on tables that customers stand for: orders are their columns, every second with a foreign key of its own, lines their indexes."""
    c, table, nation = F.col("c_custkey"), F.concat(F.lit("t"), F.col("c_custkey")).alias("table"), F.col("c_nationkey")
    customers = _t(spark, d, "customer")
    tables = customers.select(table, (c % 5 != 0).alias("has_primary_key"), (c % 4 == 0).alias("partitioned"), (nation.cast("long") * 1_000_000).alias("rows"))
    stats = customers.select(table, nation.alias("seq_scans"), (nation * c * 90).alias("seq_rows"), F.lit(12).alias("index_scans"), (c * 100).alias("live"), (c * nation * 4).alias("dead"), F.when(c % 6 != 0, F.lit("2024-01-01").cast("timestamp")).alias("last_analyzed"), (c * 100).alias("hits"), (c * nation).alias("reads"))
    k = F.col("k")
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("t"), F.col("o_custkey")).alias("table"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("column"))
    types = F.array(*map(F.lit, ("timestamp without time zone", "boolean", "character(3)", "text", "timestamp with time zone")))
    columns = orders.select("table", "column", F.get(types, (k % 5).cast("int")).alias("type"), F.when(k % 7 == 0, "nextval('s')").alias("default"), (k % 3 == 0).alias("in_primary_key"))
    keys = orders.select("table", F.concat(F.lit("f"), k).alias("name"), F.array(F.when(k % 2 == 0, F.col("column")).otherwise("z")).alias("columns"))
    line = F.col("l_linenumber")
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber").distinct().join(orders, "k")
    indexes = lines.select("table", F.concat(F.lit("i"), k, F.lit("."), line).alias("index"), F.when(line % 3 == 0, F.array("column", F.lit("x"))).otherwise(F.array("column")).alias("columns"), (line == 5).alias("is_unique"), (line != 6).alias("valid"), (k % 4 < 2).alias("partitioned"), (k % 2).alias("scans"), (line * 10).alias("stats_days"), F.when(line == 4, "u").alias("supports"))
    indexes = scratch.materialize(indexes, "advice-indexes")  # nearly every rule looks at them
    found = advice.structural(tables, columns, indexes, keys).unionByName(advice.statistical(stats, indexes)).unionByName(advice.partitioning(tables, columns))
    return found, keys


_ADVICE = """WITH c AS (SELECT 't' || c_custkey AS tab, c_custkey AS k, c_nationkey AS n FROM customer), o AS (SELECT 't' || o_custkey AS tab, o_orderkey AS k, 'o' || o_orderkey AS col, o_orderkey % 5 AS type FROM orders),
    i AS (SELECT DISTINCT tab, 'i' || k || '.' || l_linenumber AS idx, l_linenumber AS ln, k, col, type, l_linenumber % 3 = 0 AS two FROM lineitem JOIN o ON k = l_orderkey),
    a AS (SELECT 'no-primary-key' AS advice, 'high' AS severity, tab, tab AS subject FROM c WHERE k % 5 = 0
        UNION ALL SELECT 'foreign-key-not-indexed', 'high', tab, 'f' || k FROM o WHERE k % 2 <> 0 OR k NOT IN (SELECT k FROM i WHERE ln <> 6)
        UNION ALL SELECT 'duplicate-index', 'medium', tab, idx FROM i AS x WHERE ln NOT IN (4, 6) AND EXISTS (SELECT 1 FROM i AS y WHERE y.k = x.k AND y.ln <> 6 AND y.two = x.two AND (y.ln = 5) = (x.ln = 5) AND y.idx < x.idx)
        UNION ALL SELECT 'redundant-index', 'low', tab, idx FROM i AS x WHERE NOT two AND ln NOT IN (4, 5) AND EXISTS (SELECT 1 FROM i AS y WHERE y.k = x.k AND y.ln <> 6 AND y.two)
        UNION ALL SELECT 'boolean-index', 'low', tab, idx FROM i WHERE NOT two AND type = 1
        UNION ALL SELECT 'many-indexes', 'medium', tab, tab FROM i GROUP BY tab HAVING count(*) > 6
        UNION ALL SELECT 'timestamp-without-timezone', 'medium', tab, col FROM o WHERE type = 0 UNION ALL SELECT 'blank-padded-char', 'low', tab, col FROM o WHERE type = 2
        UNION ALL SELECT 'serial-not-identity', 'low', tab, col FROM o WHERE k % 7 = 0 UNION ALL SELECT 'text-primary-key', 'low', tab, col FROM o WHERE k % 3 = 0 AND type = 3
        UNION ALL SELECT 'sequential-scan-heavy', 'high', tab, tab FROM c WHERE k * 100 >= 10000 AND n > 12 AND k * 90 >= 10000
        UNION ALL SELECT 'dead-tuples', 'medium', tab, tab FROM c WHERE k * n * 4 >= 10000 AND n * 4 * 4 >= 100
        UNION ALL SELECT 'never-analyzed', 'medium', tab, tab FROM c WHERE k > 0 AND k % 6 = 0
        UNION ALL SELECT 'low-cache-hit', 'medium', tab, tab FROM c WHERE k * (100 + n) >= 10000 AND 1000 < 9 * (100 + n)
        UNION ALL SELECT 'unused-index', 'medium', tab, idx FROM i WHERE k % 2 = 0 AND ln NOT IN (4, 5, 6) AND ln >= 3
        UNION ALL SELECT CASE WHEN k % 4 < 2 THEN 'unfinished-partitioned-index' ELSE 'invalid-index' END, CASE WHEN k % 4 < 2 THEN 'medium' ELSE 'high' END, tab, idx FROM i WHERE ln = 6
        UNION ALL SELECT CASE WHEN col IS NULL THEN 'partitioning-candidate' ELSE 'partition-by-date' END, 'medium', tab, coalesce(col, tab) FROM c LEFT JOIN (SELECT tab, min(col) AS col FROM o WHERE type IN (0, 4) GROUP BY tab) USING (tab) WHERE n >= 10 AND k % 4 <> 0)"""


@query(f'{_ADVICE} SELECT advice, severity, tab AS "table", subject FROM a')
def table_advice(spark, d):
    return _table_advice(spark, d)[0]


@query(f"""{_ADVICE}, r AS (SELECT *, list_position(['duplicate-index', 'redundant-index', 'boolean-index', 'unused-index'], advice) AS rank FROM a)
    SELECT advice, severity, tab AS "table", subject, advice = 'foreign-key-not-indexed' AND coalesce(TRY_CAST(substr(subject, 2) AS BIGINT) % 4 = 0, FALSE) AS attached FROM r QUALIFY rank IS NULL OR rank = 0 OR rank = min(rank) OVER (PARTITION BY tab, subject, rank > 0)""")
def table_advice_kept(spark, d):
    """The advice where an index that several rules would drop is named once, and whether the composite advice for a column (here of every fourth order) serves a foreign key, too."""
    found, keys = _table_advice(spark, d)
    k = F.col("o_orderkey")
    wanted = _t(spark, d, "orders").filter(k % 4 == 0).select(F.concat(F.lit("t"), "o_custkey").alias("table"), F.array(F.concat(F.lit("o"), k), F.lit("y")).alias("equality"))
    return advice.with_wanted_indexes(advice.without_repeats(found), wanted, keys).select("advice", "severity", "table", "subject", "attached")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'p_brand,p_name' WHEN 3 THEN 'p_name' ELSE '' END AS equality, CASE WHEN p_partkey % 4 IN (0, 2) THEN 'p_size' END AS "range" FROM part""")
def part_filters(spark, d):
    """The searched columns of a filter on each part: conjunctions, alternatives, casts, and words of SQL within literals."""
    k, name, size = F.col("p_partkey") % 4, F.regexp_replace("p_name", "'", "''"), F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("((p_name = '"), name, F.lit("') AND (part.p_size > "), size, F.lit(") AND (p_brand = 'a'))")))
    text = text.when(k == 1, F.concat(F.lit("((p_size = "), size, F.lit(") OR (p_name = '"), name, F.lit("'))"))).when(k == 2, F.concat(F.lit("((p_size)::bigint >= "), size, F.lit(")")))
    text = text.otherwise(F.concat(F.lit("(p_name = '"), name, F.lit(" OR more')")))
    return _parts(spark, d).select("p_partkey", findings.udfs()["filter_columns"](text).alias("f")).select("p_partkey", F.array_join("f.equality", ",").alias("equality"), F.col("f.range").alias("range"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'additive' END AS declared, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'breaking' ELSE 'additive' END AS level FROM part)
    SELECT p_partkey, declared, coalesce(declared, level) AS recorded, level = 'breaking' AS counts_as_breaking, CASE WHEN p_partkey % 13 = 0 THEN 'COMMIT' ELSE '' END AS control FROM p""")
def script_readings(spark, d):
    """What each part's script is recorded as: every fourth says so itself, every thirteenth ends its transaction."""
    k, u = F.col("p_partkey"), sqltext.udfs()
    text = F.concat(F.when(k % 4 == 0, "-- Change-type: additive\n").otherwise(""), "script", F.when(k % 13 == 0, "\n;\nCOMMIT").otherwise(""))
    rows = _part_scripts(spark, d).select("p_partkey", text.alias("script")).select("p_partkey", u["sql_change_reading"]("script").alias("r"), F.array_join(u["sql_transaction_control"]("script"), ",").alias("control"))
    return rows.select("p_partkey", "r.declared", "r.recorded", "r.counts_as_breaking", "control")
