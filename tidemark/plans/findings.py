"""Findings in plans and in query texts, and the gate that lets only reading queries through."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import masked, split, words_of
from .steps import sized

#: Thresholds of the plan findings.
LARGE_ROWS, SELECTIVE, SMALL_SIDE, JOIN_OUTPUT, DRIFT = 10_000, 0.1, 0.01, 0.1, 10.0


def plan_findings(steps: DataFrame, table_rows: DataFrame) -> DataFrame:
    """plan_id, step_id, finding, severity. steps: of weighed(); table_rows: relation, rows."""
    s = sized(steps, table_rows)
    actual = F.col("actual_rows") * F.coalesce("loops", F.lit(1.0))
    removed = F.coalesce("rows_removed", F.lit(0.0)) * F.coalesce("loops", F.lit(1.0))
    kept = F.coalesce(actual, F.col("estimated_rows"))
    large = F.coalesce(F.col("table_rows") >= LARGE_ROWS, F.lit(False))
    off = F.greatest(F.try_divide(actual, "estimated_rows"), F.try_divide("estimated_rows", actual))
    one = lambda name, severity, condition: F.when(condition, F.struct(F.lit(name).alias("finding"), F.lit(severity).alias("severity")))
    found = F.array(
        one("seq-scan", "high", (F.col("node_type") == "Seq Scan") & large & F.col("filter").isNotNull() & (F.try_divide(kept, "table_rows") <= SELECTIVE)),
        one("wasteful-filter", "medium", (removed >= LARGE_ROWS) & (F.try_divide(kept, kept + removed) <= SELECTIVE)),
        one("estimate-off", "medium", off >= DRIFT),
        one("sort-on-disk", "medium", F.col("sort_space") == "Disk"),
        one("nested-loop", "high", F.col("inner_side") & (F.col("node_type") == "Seq Scan") & large & (F.col("estimated_runs") > 1)),
        one("lossy-bitmap", "low", F.col("lossy_blocks") > 0),
        one("heap-fetches", "low", (F.col("node_type") == "Index Only Scan") & (F.col("heap_fetches") >= LARGE_ROWS)),
    )
    own = s.select("plan_id", "step_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("plan_id", "step_id", "f.*")
    # join-key: a hash join whose one side is small and whose output is small next to a large scanned side
    child = s.select("plan_id", F.col("parent_id").alias("step_id"), F.col("estimated_rows").alias("child_rows"), (F.col("node_type") == "Seq Scan").alias("scan"))
    sides = child.groupBy("plan_id", "step_id").agg(F.min("child_rows").alias("small"), F.max_by("child_rows", "child_rows").alias("big"), F.max_by("scan", "child_rows").alias("big_is_scan"), F.count("*").alias("n"))
    joins = s.filter("node_type in ('Hash Join', 'Merge Join')").join(sides, ["plan_id", "step_id"]).filter((F.col("n") == 2) & F.col("big_is_scan") & (F.col("big") >= LARGE_ROWS) & (F.col("small") <= SMALL_SIDE * F.col("big")) & (F.col("estimated_rows") <= JOIN_OUTPUT * F.col("big")))
    return own.unionByName(joins.select("plan_id", "step_id", F.lit("join-key").alias("finding"), F.lit("medium").alias("severity")))


#: Functions that act on the server or read its files, so that no analysed query may call them, and families of such, by the start of the name.
DENIED = (
    "pg_terminate_backend", "pg_cancel_backend", "pg_reload_conf", "pg_rotate_logfile", "pg_switch_wal", "pg_create_restore_point", "pg_promote", "lo_import", "lo_export", "pg_file_write",
    "pg_create_physical_replication_slot", "pg_create_logical_replication_slot", "pg_drop_replication_slot", "pg_copy_physical_replication_slot", "pg_copy_logical_replication_slot",
    "pg_replication_slot_advance", "pg_logical_slot_get_changes", "pg_logical_slot_get_binary_changes", "pg_read_file", "pg_read_binary_file", "pg_stat_file",
)
DENIED_FAMILIES = ("pg_advisory_", "pg_try_advisory_", "dblink", "pg_stat_reset", "pg_ls_")


def denied_call(sql: str) -> str | None:
    """The first denied function that the code calls, by a bare or a quoted name."""
    words = words_of(sql)
    names = (w.strip('"').lower() for w, after in zip(words, words[1:], strict=False) if after == "(")
    return next((n for n in names if n in DENIED or n.startswith(DENIED_FAMILIES)), None)


def gate(sql: str) -> str | None:
    """Why a text may not be analysed (null if it may): empty, several-statements, not-a-query, writes, locks, denied-function."""
    statements = split(sql)
    if not statements:
        return "empty"
    if len(statements) > 1:
        return "several-statements"
    code = re.sub(r"\s+", " ", masked(statements[0]).lower()).strip()
    if not re.match(r"(\( *)*(select|with|values|table)\b", code):
        return "not-a-query"
    if re.search(r"\bfor (no key )?(update|share|key share)\b", code):
        return "locks"
    if re.search(r"\binto\b", code.split(" from ")[0]) or (code.startswith("with") and re.search(r"\b(insert into|update \S+ set|delete from|merge into)\b", code)):
        return "writes"
    return "denied-function" if denied_call(statements[0]) else None


def reads_only(steps: DataFrame) -> DataFrame:
    """plan_id, reads_only: no step of the plan modifies or locks rows."""
    return steps.groupBy("plan_id").agg((~F.bool_or(F.col("node_type").isin("ModifyTable", "LockRows"))).alias("reads_only"))


#: texts' findings and their severities.
TEXT_FINDINGS = {"select-star": "low", "leading-wildcard": "medium", "function-on-column": "medium", "not-in-subquery": "medium", "comma-join": "low", "order-by-no-limit": "low", "deep-offset": "medium", "unnecessary-distinct": "low", "unfiltered-count": "low", "missing-where": "high", "many-joins": "low"}
MANY_JOINS, DEEP_OFFSET = 6, 1000


def text_findings(sql: str) -> list[str]:
    """Names of what a query's text shows, in the order of TEXT_FINDINGS."""
    found = set()
    for statement in split(sql):
        code = re.sub(r"\s+", " ", masked(statement).lower()).strip()
        whole = re.sub(r"\s+", " ", statement.lower())
        where = m.group(1) if (m := re.search(r"\bwhere (.*?)(?:\bgroup by\b|\border by\b|\blimit\b|$)", code)) else ""
        tables = m.group(1) if (m := re.search(r"\bfrom (.*?)(?:\bwhere\b|\bgroup by\b|\border by\b|\blimit\b|$)", code)) else ""
        flat = re.sub(r"\([^()]*\)", "", tables)
        if re.search(r"\bselect (?:distinct )?(?:\w+\.)?\*", code):
            found.add("select-star")
        if re.search(r"\bi?like\s+'%", whole):
            found.add("leading-wildcard")
        if re.search(r"\b(lower|upper|date|trim|coalesce|to_char|date_trunc|substring|cast|extract)\s*\([^()]*[a-z_]\w*[^()]*\)\s*(=|<|>|like|in\b|between)", where):
            found.add("function-on-column")
        if re.search(r"\bnot in ?\( ?select\b", code):
            found.add("not-in-subquery")
        if "," in flat and not re.search(r"\b(lateral|unnest)\b", tables):
            found.add("comma-join")
        if re.search(r"\border by\b", code) and not re.search(r"\b(limit|fetch (first|next))\b", code) and not re.search(r"\bover ?\(", code):
            found.add("order-by-no-limit")
        if (m := re.search(r"\boffset (\d+)", code)) and int(m.group(1)) >= DEEP_OFFSET:
            found.add("deep-offset")
        if re.search(r"\bselect distinct\b.*\bgroup by\b", code):
            found.add("unnecessary-distinct")
        if re.search(r"\bselect count ?\( ?\*? ?\) from \S+ ?$", code):
            found.add("unfiltered-count")
        if re.match(r"(update|delete)\b", code) and not re.search(r"\bwhere\b", code):
            found.add("missing-where")
        if len(re.findall(r"\bjoin\b", code)) >= MANY_JOINS:
            found.add("many-joins")
    return [name for name in TEXT_FINDINGS if name in found]


_OPERATOR = re.compile(r"^\(*\s*\(?(?:\w+\.)?\"?(\w+)\"?\)?(?:::[\w ]+)?\s*(=|>=|<=|<>|!=|>|<)\s*(.+)$")


def searched(filter_text: str | None) -> tuple[list[str], str | None]:
    """(equality columns in order, first range column) of a plan's filter: conditions joined by AND, each a column against a value."""
    equal, ranged = set(), None
    text = filter_text or ""
    if re.search(r"\bOR\b", masked(text)):
        return [], None
    for part in re.split(r"\bAND\b", text):
        if m := _OPERATOR.match(part.strip()):
            if m.group(2) == "=":
                equal.add(m.group(1))
            elif m.group(2) in ("<", ">", "<=", ">=") and ranged is None:
                ranged = m.group(1)
    return sorted(equal), ranged if ranged not in equal else None


def udfs() -> dict:
    """Column functions of the above: sql_gate, sql_findings, filter_columns."""

    @F.pandas_udf("string")
    def sql_gate(sql: pd.Series) -> pd.Series:
        return sql.map(lambda t: None if t is None else gate(t))

    @F.pandas_udf("array<string>")
    def sql_findings(sql: pd.Series) -> pd.Series:
        return sql.map(lambda t: None if t is None else text_findings(t))

    @F.pandas_udf("struct<equality:array<string>,range:string>")
    def filter_columns(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([searched(t) for t in text], columns=["equality", "range"])

    return {"sql_gate": sql_gate, "sql_findings": sql_findings, "filter_columns": filter_columns}
