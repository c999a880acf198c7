"""Queries of the operators that are made for tables of any size: similarity joins, checksum trees, prefix scans."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import scratch, tasks
from .functions import sqltext
from .more_queries import _t, query
from .operators import history, object_diff, rowtree, simjoin
from .plans import findings, steps
from .sources import objects
from .streaming import changes, idlog

_WORDS = "list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> ''))"


def _words(text: str = "text"):
    return F.array_distinct(F.filter(F.split(F.lower(text), " "), lambda w: w != ""))


@query(f"""WITH d AS (SELECT doc_id, list_sort({_WORDS}) AS w FROM documents), c AS (SELECT min(doc_id) AS class, w FROM d WHERE len(w) > 0 GROUP BY w), m AS (SELECT doc_id, class FROM d JOIN c USING (w)),
    t AS (SELECT class, len(w) AS n, unnest(w) AS word FROM c),
    p AS (SELECT a.class AS x, b.class AS y FROM t AS a JOIN t AS b ON a.word = b.word AND a.class < b.class AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9 GROUP BY a.class, b.class, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.8),
    n AS (SELECT class, count(*) AS links FROM (SELECT x AS class FROM p UNION ALL SELECT y FROM p) GROUP BY 1)
    SELECT doc_id, class, coalesce(links, 0) AS links FROM m LEFT JOIN n USING (class)""")
def similar_documents(spark, d):
    """Each document with words, its class of equal word sets, and how many other classes are similar by 0.8 or more."""
    sets = simjoin.token_sets(_t(spark, d, "documents"), "doc_id", F.array_remove(F.split(F.lower("text"), " "), ""))
    pairs = simjoin.similar_pairs(sets, None, 0.8)
    links = pairs.select(F.explode(F.array("left_id", "right_id")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    classes = simjoin.members(sets.select(F.col("key").alias("doc_id"), "value"), "doc_id", "value")
    return classes.join(links, "class", "left").select("doc_id", "class", F.coalesce("links", F.lit(0)).alias("links"))


@query(f"""WITH d AS (SELECT min(doc_id) AS doc, w FROM (SELECT doc_id, list_sort({_WORDS}) AS w FROM documents) GROUP BY w), b AS (SELECT min(item_id) AS item, w FROM (SELECT item_id, list_sort({_WORDS}) AS w FROM benchmark) GROUP BY w),
    p AS (SELECT item, doc, len(list_intersect(b.w, d.w)) AS i, len(b.w) AS n, len(d.w) AS m FROM b JOIN d ON least(len(b.w), len(d.w)) >= 0.2 * greatest(len(b.w), len(d.w)) - 1e-9)
    SELECT item AS left_id, doc AS right_id, round(i / (n + m - i), 9) AS similarity FROM p WHERE n + m > i AND i / (n + m - i) >= 0.2""")
def similar_benchmark(spark, d):
    found = simjoin.similar_sets(_t(spark, d, "benchmark"), _t(spark, d, "documents"), "item_id", "doc_id", _words(), 0.2)
    return found.withColumn("similarity", F.round("similarity", 9))


@query("""WITH c AS (SELECT min(c_custkey) AS k, c_name AS s FROM customer GROUP BY c_name)
    SELECT a.k AS left_id, b.k AS right_id, levenshtein(a.s, b.s)::INT AS distance FROM c AS a JOIN c AS b ON a.k < b.k AND abs(length(a.s) - length(b.s)) <= 1 AND levenshtein(a.s, b.s) <= 1""")
def similar_customers(spark, d):
    return simjoin.similar_strings(_t(spark, d, "customer"), None, "c_custkey", "c_custkey", F.col("c_name"), most=1)


def _tree_sql() -> str:
    from .oracles import _DIFF, _VERDICT

    return f"{_DIFF}, v AS (SELECT coalesce(da.o_orderkey, db.o_orderkey) AS o_orderkey, source_digest, target_digest FROM da FULL JOIN db ON da.o_orderkey = db.o_orderkey) SELECT o_orderkey, {_VERDICT} AS verdict FROM v WHERE {_VERDICT} <> 'same'"


def rowdiff_tree(spark, d):
    """The differences of rowdiff_orders, by checksums of key ranges and a second look at those that differ."""
    from .queries import ORDER_VALUES, _sides

    return rowtree.tree_diff(*_sides(spark, d), "o_orderkey", ORDER_VALUES).select("o_orderkey", "verdict")


#: A third of all events belong to one key.
_HOT = "CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_type || '-' || (user_id % 20) END"


@query(f"""WITH e AS (SELECT event_id, ts, {_HOT} AS k, value FROM events), h AS (SELECT event_id, k, value, max(value) OVER (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_water FROM e)
    SELECT event_id, k, high_water, high_water IS NULL OR value > high_water AS forward FROM h""")
def forward_in_pieces(spark, d):
    """Running maxima with a hot key in pieces of 500 rows."""
    e = _t(spark, d, "events").select("event_id", "ts", F.expr(_HOT).alias("k"), "value")
    return history.below_high_water(e, "k", ["ts", "event_id"], "value", rows=500).select("event_id", "k", "high_water", "forward")


@query(f"""WITH e AS (SELECT event_id, ts, {_HOT} AS k, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events)
    SELECT event_id, k, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_known FROM e""")
def last_known_in_pieces(spark, d):
    e = _t(spark, d, "events").select("event_id", "ts", F.expr(_HOT).alias("k"), F.expr("if(event_id % 4 = 0, null, value)").alias("v"))
    return history.last_known(e, ["k"], ["ts", "event_id"], "v", rows=500).select("event_id", "k", "last_known")


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'drifted' WHEN 'error' THEN 'unreachable' ELSE 'in_sync' END AS s, CASE WHEN event_id % 4 <> 0 THEN floor(value / 20) END AS m FROM events),
    n AS (SELECT *, lag(s) OVER w AS ps, last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm, lead(ts) OVER w AS next FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(CASE WHEN ps IS DISTINCT FROM s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n),
    k AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM r)
    SELECT user_id, event_id, epoch_us(ts) AS at, CASE WHEN s = 'unreachable' AND ps IS DISTINCT FROM 'unreachable' THEN 'unreachable' WHEN s = 'drifted' AND ps = 'unreachable' THEN 'reachable' WHEN s = 'drifted' AND ps IS DISTINCT FROM 'drifted' THEN 'drifted' WHEN s = 'drifted' AND pm <> m THEN 'changed' WHEN s = 'in_sync' AND ps = 'drifted' THEN 'in_sync' WHEN s = 'in_sync' AND ps = 'unreachable' THEN 'reachable' ELSE 'nothing' END AS alert
    FROM k WHERE ps IS DISTINCT FROM s OR (m IS NOT NULL AND known IS DISTINCT FROM m)
    UNION ALL SELECT user_id, NULL, epoch_us(ts + INTERVAL 12 HOURS), 'silent' FROM n WHERE coalesce(next, (SELECT max(ts) - INTERVAL 10 MINUTES FROM e)) > ts + INTERVAL 12 HOURS""")
def stream_recorded(spark, d):
    """What the log gets of events that come in four parts, the query restarted for each, with a word where a user was silent for 12 hours."""
    status = F.when(F.col("event_type") == "click", "drifted").when(F.col("event_type") == "error", "unreachable").otherwise("in_sync")
    mark = F.when(F.col("event_id") % 4 != 0, F.floor(F.col("value") / 20).cast("string"))
    events = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), mark.alias("fingerprint"))
    top = f"{scratch.root(spark)}/stream-recorded-{os.urandom(6).hex()}"
    cuts = events.select(F.unix_micros("ts").alias("at")).agg(F.percentile_approx("at", [0.25, 0.5, 0.75], 1000)).first()[0] or []
    part = F.array_size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.unix_micros("ts"))) if cuts else F.lit(0)
    for n in range(len(cuts) + 1):
        events.filter(part == n).write.mode("append").parquet(f"{top}/in")
        stream = changes.recorded_on_change(spark.readStream.schema(events.schema).parquet(f"{top}/in"), "12 hours")
        changes.tick(stream, f"{top}/rows", f"{top}/checkpoint").awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{top}/rows")
    return found.select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), F.unix_micros("ts").alias("at"), "alert")


#: Events come in four parts by id; every seventh id comes a part later, and every eleventh comes twice.
_PARTS = "WITH m AS (SELECT max(event_id) + 1 AS n FROM events), e AS (SELECT event_id, user_id, event_id * 4 // n AS part, event_id % 7 = 3 AS late FROM events, m)"


@query(f"""{_PARTS}, h AS (SELECT part, max(event_id) FILTER (NOT late) AS top FROM e GROUP BY part)
    SELECT event_id, user_id, late FROM e JOIN h USING (part) WHERE NOT late OR event_id > top - 100""")
def stream_late_ids(spark, d):
    """Events read by id with a lookback of 100, the query restarted after each part: late ones that are further back are lost, repeats come once."""
    events = _t(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 7 == 3).alias("late"))
    n = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    came = F.floor(F.col("event_id") * 4 / n) + F.col("late").cast("int")
    top = f"{scratch.root(spark)}/stream-late-{os.urandom(6).hex()}"
    for part in range(5):
        now = F.when(F.col("event_id") % 11 == 0, came.isin(part, part - 1)).otherwise(came == part)
        events.filter(now).write.mode("append").parquet(f"{top}/in")
        changes.tick(idlog.stream(spark, f"{top}/in", events.schema, "event_id"), f"{top}/rows", f"{top}/checkpoint").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{top}/rows")


def _enum_sides(spark, d):
    """Each region is an enum of its nations by key; the other side lacks every third nation, lists region 3 backwards and has one more label in region 4."""
    n = _t(spark, d, "nation")
    text = lambda a: F.concat(F.lit("ENUM ("), F.array_join(F.transform(a, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit(")"))
    listed = lambda df: df.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("a"))
    name = F.concat(F.lit("t"), F.col("n_regionkey"))
    rows = lambda df, a: df.select(F.lit("TYPE").alias("kind"), F.lit(None).cast("string").alias("table"), name.alias("name"), text(a).alias("definition"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("boolean").alias("is_unique"), F.lit(None).cast("array<string>").alias("grants"))
    right = F.when(F.col("n_regionkey") == 3, F.reverse("a")).when(F.col("n_regionkey") == 4, F.concat("a", F.array(F.lit("LOST")))).otherwise(F.col("a"))
    return rows(listed(n), F.col("a")), rows(listed(n.filter("n_nationkey % 3 <> 0")), right)


@query("""WITH l AS (SELECT n_regionkey AS r, n_nationkey AS k, n_name AS x, n_nationkey % 3 <> 0 AS old FROM nation), m AS (SELECT r FROM l WHERE r = 3 GROUP BY r HAVING count(*) FILTER (old) > 1 UNION SELECT 4),
    a AS (SELECT r, x, row_number() OVER (PARTITION BY r ORDER BY k) - 1 AS i, (SELECT min_by(o.x, o.k) FROM l AS o WHERE o.r = n.r AND o.old AND o.k > n.k) AS next FROM l AS n WHERE NOT old AND r NOT IN (SELECT r FROM m))
    SELECT 'alter-type' AS kind, 't' || r || ' ' || printf('%04d', i) AS object, 'ALTER TYPE "t' || r || '" ADD VALUE ''' || x || '''' || coalesce(' BEFORE ''' || next || '''', '') AS sql FROM a
    UNION ALL SELECT 'manual', 't' || r, '-- MANUAL: change type "t' || r || '" to ENUM (' || string_agg('''' || x || '''', ', ' ORDER BY k) || ')' FROM l WHERE r IN (SELECT r FROM m) GROUP BY r""")
def enum_script(spark, d):
    return object_diff.object_statements(object_diff.compared(*_enum_sides(spark, d))).select("kind", "object", "sql")


# SQL texts and plans made from rows, read by table functions

#: The statements of a part's script: which parts have it, the kind, the text around the key and the name, and what it does, in order.
_STATEMENTS = (
    ("TRUE", "create", "CREATE TABLE t{k} (a text DEFAULT '{x}; y')", "adds"),
    ("p_partkey % 2 = 0", "data", "INSERT INTO t{k} VALUES ($b${x}; DROP TABLE u$b$)", ""),
    ("p_partkey % 3 = 0", "block", "DO $$ BEGIN UPDATE t{k} SET a = '{x}'; END $$", ""),
    ("p_partkey % 5 = 0", "drop", "DROP /* {x}; /* inner; */ */ TABLE t{k}", "breaks"),
    ("p_partkey % 7 = 0", "alter", 'ALTER TABLE t{k} ALTER COLUMN "a;b" SET NOT NULL', "may fail"),
    ("p_partkey % 11 = 0", "data", "DELETE FROM t{k} -- {x}; all", "deletes"),
)


def _statement(text: str) -> str:
    """SQL, in both dialects, for a statement's text."""
    return " || ".join("CAST(p_partkey AS STRING)" if piece == "{k}" else "p_name" if piece == "{x}" else "'" + piece.replace("'", "''") + "'" for piece in text.replace("{k}", "\1{k}\1").replace("{x}", "\1{x}\1").split("\1") if piece)


def _parts(spark, d):
    """part, spread over tasks for what Python does with a row."""
    part = _t(spark, d, "part")
    return tasks.spread(part, "p_partkey", part.count())


def _part_scripts(spark, d):
    pieces = [F.expr(f"CASE WHEN {which} THEN {_statement(text)} END") for which, _, text, _ in _STATEMENTS]
    return _parts(spark, d).select("p_partkey", F.concat(F.lit("-- Note: of a part;\n"), F.array_join(F.array_compact(F.array(*pieces)), "\n;; ")).alias("script"))


_EACH = " UNION ALL ".join(f"SELECT p_partkey, {i} AS place, '{kind}' AS kind, {_statement(text)} AS statement FROM part WHERE {which}" for i, (which, kind, text, _) in enumerate(_STATEMENTS))


@query(f"""SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY place) AS INT) AS step, kind, CASE WHEN place = 0 THEN '-- Note: of a part;' || chr(10) || statement ELSE statement END AS statement FROM ({_EACH})""")
def script_steps(spark, d):
    """The statements of each part's script; separators stand in literals, comments, bodies and quoted names, too."""
    return _part_scripts(spark, d).select("p_partkey", F.inline(sqltext.udfs()["sql_steps_of"]("script")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 35 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'breaking' ELSE 'additive' END AS level,
    CASE WHEN p_partkey % 5 = 0 THEN 'DROP TABLE' WHEN p_partkey % 7 = 0 THEN 'SET NOT NULL' END AS label,
    concat_ws(',', CASE WHEN p_partkey % 11 = 0 THEN 'DELETE' END, CASE WHEN p_partkey % 5 = 0 THEN 'DROP TABLE' END) AS destroys,
    CASE WHEN p_partkey % 7 = 0 THEN 'SET NOT NULL' ELSE '' END AS might_fail FROM part""")
def script_grades(spark, d):
    u = sqltext.udfs()
    rows = _part_scripts(spark, d).select("p_partkey", u["sql_review"]("script").alias("g"))
    return rows.select("p_partkey", "g.level", "g.label", F.array_join("g.destroys", ",").alias("destroys"), F.array_join("g.might_fail", ",").alias("might_fail"))


def _order_plans(spark, d):
    """A plan for each order: a nested loop over its lines as a sort and an index scan that runs for each, or a hash join."""
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    node = lambda kind, rows, cost, more="", kids=(): F.concat(F.lit(f'{{"Node Type": "{kind}", "Plan Rows": '), rows.cast("string"), F.lit(', "Total Cost": '), cost.cast("string"), F.lit(more), *([F.lit(', "Plans": ['), *[x for kid in kids for x in (F.lit(","), kid)][1:], F.lit("]")] if kids else []), F.lit("}"))
    n, one, k = F.col("n"), F.lit(1), F.col("o_orderkey")
    scan = node("Seq Scan", n, n * 3, ', "Relation Name": "lineitem", "Filter": "(l_quantity > 5)"')
    loop = node("Nested Loop", n, n * 100, "", [node("Sort", n, n * 5, "", [scan]), node("Index Scan", one, F.lit(2), ', "Relation Name": "orders"')])
    join = node("Hash Join", n, n * 10, ', "Join Type": "Left"', [scan, node("Hash", one, F.lit(4))])
    orders = _t(spark, d, "orders").select("o_orderkey")
    return tasks.spread(orders.join(lines, "o_orderkey"), "o_orderkey", orders.count()).select("o_orderkey", F.concat(F.lit('[{"Plan": '), F.when(k % 2 == 0, loop).otherwise(join), F.lit("}]")).alias("plan"))


@query("""WITH n AS (SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT o_orderkey, step_id, parent_id, depth, node_type, relation, inner_side, CAST(runs AS DOUBLE) AS estimated_runs, CAST(self AS DOUBLE) AS self_cost FROM (
        SELECT o_orderkey, 1 AS step_id, NULL AS parent_id, 0 AS depth, 'Nested Loop' AS node_type, NULL AS relation, FALSE AS inner_side, 1 AS runs, n * 100 - n * 5 - n * 2 AS self FROM n WHERE o_orderkey % 2 = 0
        UNION ALL SELECT o_orderkey, 2, 1, 1, 'Sort', NULL, FALSE, 1, n * 2 FROM n WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 3, 2, 2, 'Seq Scan', 'lineitem', FALSE, 1, n * 3 FROM n WHERE o_orderkey % 2 = 0
        UNION ALL SELECT o_orderkey, 4, 1, 1, 'Index Scan', 'orders', TRUE, n, n * 2 FROM n WHERE o_orderkey % 2 = 0
        UNION ALL SELECT o_orderkey, 1, NULL, 0, 'Hash Join', NULL, FALSE, 1, n * 7 - 4 FROM n WHERE o_orderkey % 2 <> 0 UNION ALL SELECT o_orderkey, 2, 1, 1, 'Seq Scan', 'lineitem', FALSE, 1, n * 3 FROM n WHERE o_orderkey % 2 <> 0
        UNION ALL SELECT o_orderkey, 3, 1, 1, 'Hash', NULL, FALSE, 1, 4 FROM n WHERE o_orderkey % 2 <> 0)""")
def order_plan_steps(spark, d):
    found = steps.flattened(_order_plans(spark, d), "o_orderkey")
    return found.select(F.col("plan_id").cast("long").alias("o_orderkey"), "step_id", "parent_id", "depth", "node_type", "relation", "inner_side", "estimated_runs", "self_cost")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 'locks' WHEN 3 THEN 'several-statements' END AS refused, CASE p_partkey % 4 WHEN 0 THEN 'select-star,leading-wildcard' WHEN 1 THEN 'unfiltered-count' ELSE '' END AS findings FROM part""")
def part_query_findings(spark, d):
    """Queries on each part's own name: one that scans, one that counts everything, one that locks, and two statements in one."""
    k, name, key = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_partkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("SELECT * FROM part WHERE p_name LIKE '%"), name, F.lit("'"))).when(k == 1, F.concat(F.lit("SELECT count(*) FROM part -- WHERE p_name = "), name)).when(k == 2, F.concat(F.lit("SELECT p_name FROM part WHERE p_partkey = "), key, F.lit(" FOR UPDATE"))).otherwise(F.concat(F.lit("SELECT 1; SELECT "), key))
    u = findings.udfs()
    return _parts(spark, d).select("p_partkey", text.alias("q")).select("p_partkey", u["sql_gate"]("q").alias("refused"), F.array_join(u["sql_findings"]("q"), ",").alias("findings"))


# typed extracts of a catalog: suppliers, parts and customers stand for its objects


@query("""SELECT 's' || s_suppkey AS sequence, s_suppkey AS start, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 THEN n_name END AS owned_by_table, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 AND s_suppkey % 4 < 3 THEN 'c' || s_suppkey % 4 END AS owned_by_column
    FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE NOT (s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 AND n_nationkey = 7)""")
def sequence_rows(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") == 7, "script_patch").otherwise(F.col("n_name")).alias("table"))
    s = _t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("k")).select("s_suppkey", "table", F.concat(F.lit("s"), "s_suppkey").alias("sequence"))
    k = F.col("s_suppkey")
    owned = s.filter("s_suppkey % 3 = 0").select("sequence", "table", (k % 4).alias("number"), F.when(k % 2 == 1, "a").otherwise("n").alias("kind"))
    attributes = n.select("table", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("number")).withColumn("column", F.concat(F.lit("c"), "number"))
    return objects.sequences(s.select("sequence", k.alias("start")), owned, attributes).select("sequence", "start", "owned_by_table", "owned_by_column")


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS name, CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'procedure' END AS kind FROM part), a AS (SELECT k, string_agg(n_name, ', ' ORDER BY i) AS t FROM p, range(3) AS r(i), nation WHERE i < k % 4 AND n_nationkey = (k * 7 + i * 3) % 25 GROUP BY k)
    SELECT k AS definition, kind, coalesce(t, '') AS arg_types, name || '(' || coalesce(t, '') || ')' AS identity FROM p LEFT JOIN a USING (k) WHERE kind IS NOT NULL AND k % 10 <> 0""")
def routine_rows(spark, d):
    k = F.col("p_partkey")
    letter = F.when(k % 3 == 0, "f").when(k % 3 == 1, "p").otherwise("a")
    arguments = F.slice(F.array(*[(k * 7 + 3 * i) % 25 for i in range(3)]), F.lit(1), (k % 4).cast("int"))
    part = _t(spark, d, "part").select(k.alias("routine_id"), F.col("p_brand").alias("name"), letter.alias("letter"), arguments.alias("arguments"), F.lit("sql").alias("language"), k.alias("definition"))
    types = _t(spark, d, "nation").select(F.col("n_nationkey").alias("type_id"), F.col("n_name").alias("type"))
    return objects.routines(part, types, part.filter("routine_id % 10 = 0").select("routine_id")).select("definition", "kind", "arg_types", "identity")


@query("""SELECT n_name AS "table", c_name AS name, s_name AS "function", c_custkey % 4 <> 0 AS enabled FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN supplier ON s_suppkey = c_custkey % 50 WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 3""")
def trigger_rows(spark, d):
    k = F.col("c_custkey")
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    extract = c.select(F.col("n_name").alias("table"), F.col("c_name").alias("name"), F.lit("").alias("definition"), (k % 50).alias("function_id"), F.when(k % 4 == 0, "D").otherwise("O").alias("state"), (k % 5 == 0).alias("internal"), F.when(k % 7 == 3, k).otherwise(0).alias("parent_id"))
    return objects.triggers(extract, _t(spark, d, "supplier").select(F.col("s_suppkey").alias("function_id"), F.col("s_name").alias("function"))).drop("definition")


@query("""SELECT c_custkey AS "index", CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END AS scans, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 9 < 3) AS backs_constraint, c_custkey IN (SELECT s_suppkey FROM supplier) AS is_partition_child FROM customer""")
def index_statistics(spark, d):
    k = F.col("c_custkey")
    extract = _t(spark, d, "customer").select(k.alias("index"), F.col("c_mktsegment").alias("table"), F.when(k % 3 != 0, k).alias("scans"))
    kinds = F.get(F.array(*map(F.lit, "puxfffccc")), (F.col("o_orderkey") % 9).cast("int"))
    return objects.index_statistics(extract, _t(spark, d, "orders").select(F.col("o_custkey").alias("index"), kinds.alias("kind")), _t(spark, d, "supplier").select(F.col("s_suppkey").alias("child"))).drop("table")


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS "table", k % 4 = 0 AS part, CASE WHEN k % 3 = 0 THEN 'p' WHEN k % 3 = 1 THEN 'r' ELSE 'v' END AS kind FROM (SELECT c_custkey, c_name, c_custkey AS k FROM customer)),
    e AS (SELECT o_custkey AS k, list(o_orderkey::VARCHAR ORDER BY o_orderdate, o_orderkey) AS a FROM orders GROUP BY 1)
    SELECT "table", CASE WHEN kind = 'p' THEN CASE k % 2 WHEN 0 THEN 'RANGE' ELSE 'HASH' END END AS strategy, CASE WHEN kind = 'p' THEN '(c' || k || ')' END AS key, CASE WHEN part THEN a[1] END AS partition_of, CASE WHEN part THEN 'b' || k END AS bounds, CASE WHEN NOT part THEN array_to_string(a, ',') END AS inherits FROM c LEFT JOIN e USING (k) WHERE kind <> 'v'""")
def partitioning_rows(spark, d):
    k = F.col("c_custkey")
    c = _t(spark, d, "customer")
    classes = c.select(F.col("c_name").alias("table"), F.when(k % 3 == 0, "p").when(k % 3 == 1, "r").otherwise("v").alias("kind"), (k % 4 == 0).alias("is_partition"), F.concat(F.lit("b"), k).alias("bounds"))
    keys = c.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("table"), F.when(k % 2 == 0, "r").otherwise("h").alias("letter"), F.concat(F.lit("(c"), k, F.lit(")")).alias("key"))
    edges = _t(spark, d, "orders").join(c, F.col("o_custkey") == k).select(F.col("c_name").alias("child"), F.col("o_orderkey").cast("string").alias("parent"), F.struct("o_orderdate", "o_orderkey").alias("position"))
    return objects.partitioning(classes, keys, edges).withColumn("inherits", F.array_join("inherits", ","))
