from __future__ import annotations

import hashlib
import random
import datetime as dt

from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators import activity, graph, history, ledger, matching, quantiles, rollups, rowdiff, schema_diff, sets
from tidemark.sources import catalog, export

COLUMNS = catalog.COLUMNS


def columns(spark, tables: dict[str, list]):
    """tables: name -> [(column, type, nullable)]"""
    rows = [(t, c, i, kind, null, None, None, None, False, [], []) for t, cs in tables.items() for i, (c, kind, null) in enumerate(cs, 1)]
    return spark.createDataFrame(rows, COLUMNS)


BASE = {"author": [("id", "integer", False), ("name", "varchar(120)", False), ("email", "varchar(200)", False)], "tag": [("id", "integer", False), ("label", "varchar(60)", False)]}


def test_compare_with_itself_is_empty(spark):
    a = columns(spark, BASE)
    report = schema_diff.compare(a, a)
    assert report["columns"].count() == 0
    assert {r.status for r in report["tables"].collect()} == {"matched"}


def test_swapping_sides_swaps_only_a_and_only_b(spark):
    a, b = columns(spark, BASE), columns(spark, {"author": BASE["author"][:2], "quite_other": [("x", "bytea", True)]})
    one, two = ({(r.left_table, r.right_table, r.status) for r in schema_diff.compare(x, y)["tables"].collect()} for x, y in ((a, b), (b, a)))
    assert {(r, l, {"onlyA": "onlyB", "onlyB": "onlyA"}.get(s, s)) for l, r, s in one} == two
    assert ("tag", None, "onlyA") in one and (None, "quite_other", "onlyB") in one


def test_plural_names_are_renames_and_archives_are_not(spark):
    a = columns(spark, {"customer": BASE["author"], "Post": BASE["tag"]})
    b = columns(spark, {"customers": BASE["author"], "post": BASE["tag"]})
    assert {(r.left_table, r.right_table, r.status) for r in schema_diff.compare(a, b)["tables"].collect()} == {("customer", "customers", "renamed"), ("Post", "post", "renamed")}
    c = columns(spark, {"customer_archive": BASE["author"]})
    found = schema_diff.compare(columns(spark, {"customer": BASE["author"]}), c)
    assert {r.status for r in found["tables"].collect()} == {"onlyA", "onlyB"}
    assert found["candidates"].count() == 1


def test_column_changes(spark):
    a = columns(spark, {"post": [("title", "varchar(300)", False), ("body", "text", True)]})
    b = columns(spark, {"post": [("title", "varchar(200)", True), ("body", "bytea", True)]})
    found = {r.column: {(c.kind, c.severity) for c in r.changes} for r in schema_diff.compare(a, b)["columns"].collect()}
    assert found == {"title": {("size", "low"), ("nullability", "high")}, "body": {("type", "high")}}


def test_null_arrays_are_not_compared(spark):
    a = columns(spark, BASE)
    b = a.withColumn("unique", F.lit(None).cast("array<string>"))
    c = a.withColumn("unique", F.array(F.lit("u")))
    assert schema_diff.column_changes(a, b).filter("size(changes) > 0").count() == 0
    assert schema_diff.column_changes(a, c).filter("size(changes) > 0").count() == a.count()


def test_pair_budget(spark):
    big = spark.range(120).select(F.col("id"))
    assert not matching.within_budget(big, big, matching.TABLE_PAIRS)
    assert matching.within_budget(spark.range(100), spark.range(100), matching.TABLE_PAIRS)


def test_blocked_pairs_come_back_as_candidates(spark):
    pairs = spark.createDataFrame([(1, 10, 90.0, False), (1, 11, 80.0, True), (2, 10, 60.0, True)], "left_id int, right_id int, score double, allowed boolean")
    accepted, rest = matching.match_renames(pairs, 70, 55)
    assert {(r.left_id, r.right_id) for r in accepted.collect()} == {(1, 11)}
    assert {(r.left_id, r.right_id) for r in rest.collect()} == {(2, 10)}


def test_rename_query(spark):
    rows = queries.rename_matching(spark, "/root/testdata/sf0.001").collect()
    assert {(r.left_id + 100 == r.right_id) for r in rows if r.kind == "renamed"} == {True} and len(rows) == 18


def test_checksum_ignores_order(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    one, two = (rowdiff.table_checksum(x, ["id", "x"]).first() for x in (df, df.orderBy(F.desc("id")).repartition(7)))
    assert one == two and one.row_count == 1000
    assert rowdiff.table_checksum(df.filter("id <> 5"), ["id", "x"]).first().checksum != one.checksum


def test_encoding_is_injective(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), (None, "ab"), ("", "ab"), ("N", None)], "x string, y string")
    assert df.select(rowdiff.encoded(F.col("x"), F.col("y")).alias("e")).distinct().count() == 5


def test_ledgers(spark):
    a = spark.createDataFrame([("s", "v1.0.0", "x"), ("s", "2.0.0", "y"), ("s", "3.0.0", "z")], "script_name string, version string, sql_content string")
    b = spark.createDataFrame([("s", "1.0", "x"), ("s", "2.0.0", "other")], "script_name string, version string, sql_content string")
    assert {(r.version, r.status) for r in ledger.ledger_diff(a, b).collect()} == {("2.0.0", "diverged"), ("3.0.0", "missing")}
    heads = ledger.family_heads(a, b)
    assert heads.first().older == "right" and ledger.newer_side(heads).first().newer == "left"
    assert ledger.current_version(a).first().version == "3.0.0"
    assert ledger.push_check(a, "s", "3.0.0").first().verdict == "taken"
    assert ledger.push_check(a, "s", "2.5").first().verdict == "not-above-highest"
    assert ledger.push_check(a, "s", "3.0.1").first().verdict == "ok"
    assert [r.version for r in ledger.rollback_plan(a, "1.0.0").orderBy("step").collect()] == ["3.0.0", "2.0.0"]


def test_timeline(spark):
    at = dt.datetime(2024, 1, 1)
    kind = "script_name string, version string, applied_at timestamp, failed boolean"
    a = spark.createDataFrame([("s", "v1.2.0", at, False), ("s", "1.3.0", at, True), ("s", " ", at, False)], kind)
    b = spark.createDataFrame([("s", "1.2", at, False), ("s", "0.9", at, False), ("t", "1.0", at, False)], kind)
    rows = {(r.script_name, r.key): r for r in ledger.timeline_order(ledger.timeline(a, b)).collect()}
    assert set(rows) == {("s", "1.2.0"), ("s", "1.3.0"), ("s", "0.9.0"), ("t", "1.0.0")}
    assert rows["s", "1.2.0"].left.head and not rows["s", "1.3.0"].left.head
    assert rows["s", "0.9.0"].unknown_left and not rows["s", "1.3.0"].unknown_right


def test_alerts_and_on_change(spark):
    df = spark.createDataFrame([("k", i, s, f) for i, (s, f) in enumerate([("in_sync", None), ("drifted", "a"), ("drifted", "a"), ("drifted", "b"), ("unreachable", None), ("in_sync", None)])], "key string, id int, status string, fp string")
    assert [r.alert for r in history.alerts(df, "key", ["id"], "status", "fp").orderBy("id").collect()] == ["nothing", "drifted", "nothing", "changed", "unreachable", "reachable"]
    assert [r.id for r in history.recorded_outcomes(df, "key", ["id"], "status", "fp").orderBy("id").collect()] == [0, 1, 3, 4, 5]
    assert [r.id for r in history.on_change(df, "key", ["id"], ["status", "fp"]).orderBy("id").collect()] == [0, 1, 3, 4, 5]


def test_composite_advice(spark):
    patterns = spark.createDataFrame([("t", ["a", "b"], "c", 2, 2), ("t", ["a"], None, 1, 3), ("u", ["x"], None, 1, 1)], "table string, equality array<string>, range string, queries long, runs long")
    indexes = spark.createDataFrame([("t", ["b", "a", "c"])], "table string, columns array<string>")
    assert [(r.table, r.equality) for r in rollups.composite_advice(patterns, indexes).collect()] == [("t", ["a"])]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert graph.ancestors(edges).filter("node = 'a'").count() == 2  # the cycle ends
    made = graph.dependents(("view", spark.createDataFrame([("v", "t"), ("w", "t")], "object string, depends_on string")))
    assert [d.object for d in made.first().dependents] == ["v", "w"]


def test_activity(spark):
    c = spark.createDataFrame([(99, 1, 10, 0, 0, 0, 5, 10)], "blks_hit long, blks_read long, xact_commit long, xact_rollback long, deadlocks long, temp_files long, numbackends long, max_connections int")
    r = activity.health(c).first()
    assert (r.cache_level, r.rollback_level, r.connections_level, r.deadlock_level) == ("good", "good", "good", "good")
    s = spark.createDataFrame([(1, "active", "Lock", 5.0, 0.0, "q"), (2, "idle in transaction", None, 0.0, 70.0, "q"), (3, "active", None, 90.0, 0.0, None), (4, "active", None, 1.0, 0.0, "q")], "pid int, state string, wait_event_type string, query_seconds double, state_seconds double, query string")
    kinds = activity.session_kind(s)
    assert [r.kind for r in activity.sessions_in_order(kinds).collect()] == list(activity.KINDS)
    assert activity.session_summary(kinds).first().any_hidden
    t = spark.createDataFrame([(["A "], ["a"]), ([], ["a"]), (["b"], None), (["b"], []), (["b"], ["a"])], "h array<string>, o array<string>")
    assert [r.x for r in t.select(activity.targeting(F.col("h"), F.col("o")).alias("x")).collect()] == ["applies", "everyone", "unknown", "none-hosted", "other"]


def test_catalog(spark):
    cons = spark.createDataFrame([("pk", "t", "p", [2, 1])], "constraint string, table string, kind string, key array<int>")
    att = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b")], "table string, number int, column string")
    assert catalog.constraints(cons, att).first().columns == ["b", "a"]
    cols = columns(spark, BASE)
    nested = catalog.nested(cols, "public")
    assert nested.count() == 1 and catalog.flat(nested).select(*cols.columns).exceptAll(cols).count() == 0
    acl = spark.createDataFrame([("t", [("r", "SELECT")]), ("u", None)], "name string, acl array<struct<grantee:string,privilege:string>>")
    assert catalog.privileges(acl, acl.limit(0), acl.limit(0)).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c", "t", "o", 'say "hi"', "low", "=1", True)], "category string, table string, object string, change string, severity string, detail string, manual boolean")
    assert '"say ""hi"""' in export.csv_lines(df).first().line
    export.activity_csv(df, str(tmp_path / "a"))
    assert "'=1" in "".join(p.read_text() for p in (tmp_path / "a").glob("*.csv"))
    assert "## c" in export.markdown(df, "x") and '"manual" : true' in export.json_documents(df).first().document
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert {(r.k, r.v) for r in export.upserted(old, new, ["k"]).collect()} == {(1, "a"), (2, "c")}
    assert {(r.k, r.v) for r in export.upserted(old, new, ["k"], replace=False).collect()} == {(1, "a"), (2, "b")}


def test_sets(spark):
    a = spark.createDataFrame([("x", "p", "1")], "k string, parent string, shape string")
    b = spark.createDataFrame([], "k string, parent string, shape string")
    assert sets.structure_diff(a, b, ["k", "parent"], "shape").count() == 1
    assert sets.structure_diff(a, b, ["k", "parent"], "shape", "parent").count() == 0
    assert sets.shared_columns(["a", "b"], ["b", "c"]) == {"shared": ["b"], "only_left": ["a"], "only_right": ["c"]}


def test_chains_of_any_depth(spark):
    from tidemark.operators import graph

    chain = spark.createDataFrame([(i, i + 1) for i in range(54)] + [(54, 0)], "parent int, child int")
    reached = graph.closure(chain, spark.createDataFrame([(0,)], "node int"))
    assert {r.node: r.depth for r in reached.collect()} == {i: i for i in range(55)}
    needs = spark.createDataFrame([(i + 1, i) for i in range(54)], "node int, needs int")
    nodes = spark.createDataFrame([(i,) for i in range(55)], "node int")
    assert {r.node: r.depth for r in graph.topological_depth(nodes, needs).collect()} == {i: i for i in range(55)}


def test_versions_compare_as_versions(spark):
    registry = spark.createDataFrame([("f", f"1.{n}") for n in (8, 9, 10, 11)], "family string, version string")
    status = ledger.ledger_status(registry, registry.filter("version = '1.9'"), "family", "version")
    assert {r.version: r.status for r in status.collect()} == {"1.8": "skipped", "1.9": "applied", "1.10": "pending", "1.11": "pending"}
    assert [r.version for r in ledger.pending_through(status, "family", "version", F.lit("1.10")).collect()] == ["1.10"]


def test_run_fingerprint_counts_items(spark):
    mark = lambda rows: spark.createDataFrame(rows, "k string, s string").agg(rollups.run_fingerprint(F.col("k"), F.col("s")).alias("f")).first().f
    one, twice = [("a", "high"), ("b", None)], [("a", "high"), ("a", "high"), ("b", None), ("b", None)]
    assert len({mark(one), mark(twice), mark([]), mark([("a", "high")])}) == 4 and mark(one) == mark(one[::-1])


def test_long_chains_reach_their_end(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(52)], "child string, parent string")
    assert graph.ancestors(edges).filter("node = '0'").agg(F.max("depth")).first()[0] == 52


def test_manifests_in_key_order_and_keys_as_text(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a")], "id int, v string")
    first = lambda x: x.first().fingerprint
    assert first(rowdiff.ordered_fingerprint(df, F.col("id"), F.col("v"))) == hashlib.md5(b"9:a,10:b").hexdigest()
    assert first(rowdiff.ordered_fingerprint(df, F.col("id"), F.col("v"), by_text=True)) == hashlib.md5(b"10:b,9:a").hexdigest()
    assert [r.id for r in rowdiff.matching_rows(df, ["id"], [["9"], ["11"]]).collect()] == [9]
    assert rowdiff.one_sided_counts({"t": df}, "source").first().row_count == 2


def test_exact_percentiles_equal_the_plain_ones(spark):
    rng = random.Random(2)
    rows = [(g, None if rng.random() < 0.1 else float(rng.choice([7, 7, 7, rng.randrange(1000)])) + (0.5 if g == "b" else 0)) for g in ("a", "b", None) for _ in range(700)] + [("one", 3.0), ("none", None)]
    rows += [(f"n{n}", rng.random()) for n in range(2, 30) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"p0": 0.0, "p3": 0.03, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    want = {r.g: tuple(r)[1:] for r in df.groupBy("g").agg(*[F.percentile("v", s).alias(n) for n, s in shares.items()]).collect()}
    got = {r.g: tuple(r)[1:] for r in quantiles.exact_percentiles(df, F.col("g"), "g", F.col("v"), shares).collect()}
    assert set(want) - set(got) == {"none"} and all(abs(x - y) < 1e-9 for g in got for x, y in zip(got[g], want[g], strict=True))


def test_percentiles_of_several_values_narrow_crowded_brackets(spark):
    rng = random.Random(3)
    rows = [(g, rng.random(), rng.choice([None, 1.0, 1.0, rng.gauss(0, 9)])) for g in ("a", "b", None) for _ in range(4000)] + [("none", None, 2.0), ("two", 5.0, None), ("two", 6.0, None)] + [("same", 3.0, 3.0)] * 3000
    df = spark.createDataFrame(rows, "g string, v double, w double")
    shares = {"v0": ("v", 0.0), "v50": ("v", 0.5), "v951": ("v", 0.951), "w40": ("w", 0.4), "w100": ("w", 1.0)}
    want = {r.g: tuple(r)[1:] for r in df.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile(c, s).alias(n) for n, (c, s) in shares.items()]).collect()}
    for fits in (1, 3, 1000):  # one value a piece, a few, no narrowing
        found = quantiles.percentiles(df, F.col("g"), "g", {n: (F.col(c), s) for n, (c, s) in shares.items()}, F.count("*").alias("n"), fits=fits)
        assert found.columns == ["g", "n", *shares]
        got = {r.g: tuple(r)[1:] for r in found.collect()}
        assert set(got) == set(want)
        assert all((x is None and y is None) or abs(x - y) < 1e-9 for g in got for x, y in zip(got[g], want[g], strict=True))
    assert quantiles.percentiles(df.limit(0), F.col("g"), "g", {"p": (F.col("v"), 0.5)}).count() == 0


def test_ledger_sides_meet_on_versions(spark):
    from tidemark.operators import ledger

    registry = spark.createDataFrame([("f", v) for v in ("1.2.0", "1.3", "v1.10", "2.0.0", "2.0", "notes")], "family string, version string")
    applied = spark.createDataFrame([("f", v) for v in ("v1.2", "1.9", "release-2", "1.3.0")], "family string, version string")
    got = {r.version: r.status for r in ledger.ledger_status(registry, applied, "family", "version").collect()}
    assert got == {"1.2.0": "applied", "1.3": "applied", "1.9": "unregistered", "v1.10": "pending", "2.0": "pending", "release-2": "unregistered", "notes": "skipped"}
    heads = ledger.highest(spark.createDataFrame([("f", "1.2"), ("f", "v1.2.0"), ("f", "1.1")], "script_name string, version string"))
    assert heads.first()["head"] == "v1.2.0"


def test_token_similarity_shuffles_sets_not_pairs(spark, monkeypatch):
    """Every pair that shares a word, over several blocks and parts; rows of one id are one set; null ids and texts have no row; no pair is shuffled."""
    monkeypatch.setattr(sets, "LEFT", 3, raising=False)
    monkeypatch.setattr(sets, "RIGHT", 4, raising=False)
    left = [(i, f"the w{i % 4} W{i % 3} x") for i in range(8)] + [(3, "more words the"), (90, None), (91, "  "), (None, "the x"), (92, "alone")]
    right = [(f"d{i}", f"w{i % 5} w{i % 5} the y{i}" if i % 3 else f"w{i % 4}") for i in range(11)] + [("d2", "x x"), (None, "the"), ("d99", "")]
    got = sets.token_similarity(spark.createDataFrame(left, "a int, t string"), spark.createDataFrame(right, "b string, t string"), "a", "b", "t")

    def bags(rows):
        out = {}
        for k, t in rows:
            if k is not None and t is not None:
                out.setdefault(k, set()).update(t.lower().split())
        return out

    want = {(a, b): len(x & y) / len(x | y) for a, x in bags(left).items() for b, y in bags(right).items() if x & y}
    rows = got.collect()
    assert {(r.a, r.b): r.similarity for r in rows} == want and len(rows) == len(want) > 60
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
