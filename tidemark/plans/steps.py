"""Plan trees as rows: flattening, runs, self cost, shares, scores."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = (
    "plan_id string, step_id int, parent_id int, depth int, node_type string, relation string, filter string, join_cond string, join_type string, "
    "estimated_rows double, estimated_cost double, actual_rows double, loops double, total_ms double, rows_removed double, sort_space string, lossy_blocks double, heap_fetches double, "
    "inner_side boolean, estimated_runs double, self_cost double, self_ms double"
)


def _walk(plan_id: str, node: dict, out: list[dict], parent: int | None, depth: int, runs: float, inner: bool) -> dict:
    get = node.get
    me = {
        "plan_id": plan_id, "step_id": len(out) + 1, "parent_id": parent, "depth": depth, "node_type": get("Node Type"), "relation": get("Relation Name"), "filter": get("Filter"),
        "join_cond": get("Hash Cond") or get("Merge Cond") or get("Join Filter") or get("Index Cond"), "join_type": get("Join Type"), "estimated_rows": get("Plan Rows"), "estimated_cost": get("Total Cost"),
        "actual_rows": get("Actual Rows"), "loops": get("Actual Loops"), "total_ms": get("Actual Total Time"), "rows_removed": get("Rows Removed by Filter"), "sort_space": get("Sort Space Type"),
        "lossy_blocks": get("Lossy Heap Blocks"), "heap_fetches": get("Heap Fetches"), "inner_side": inner, "estimated_runs": runs,
    }
    out.append(me)
    children = get("Plans", [])
    nested = me["node_type"] == "Nested Loop" and len(children) == 2
    kids = []
    for i, child in enumerate(children):
        repeated = nested and i == 1
        kids.append(_walk(plan_id, child, out, me["step_id"], depth + 1, runs * max(1.0, float(children[0].get("Plan Rows", 1))) if repeated else runs, inner or repeated))
    cost = lambda x: (x["estimated_cost"] or 0.0) * (x["estimated_runs"] / runs)
    me["self_cost"] = max(0.0, (me["estimated_cost"] or 0.0) - sum(map(cost, kids))) * runs
    time = lambda x: (x["total_ms"] or 0.0) * (x["loops"] or 0.0)
    me["self_ms"] = None if me["total_ms"] is None else max(0.0, time(me) - sum(map(time, kids)))
    return me


def _steps_of(plan_id: str, text: str) -> list[dict]:
    root = json.loads(text)
    root = root[0] if isinstance(root, list) else root
    out: list[dict] = []
    _walk(plan_id, root.get("Plan", root), out, None, 0, 1.0, False)
    return out


def register(spark) -> None:
    """Make the table function plan_steps(plan) known to SQL (for LATERAL): the columns of flattened() but plan_id; no row for a null or empty text."""
    kinds = [part.split() for part in STEP.split(", ")[1:]]

    class Steps:
        def eval(self, text: str):
            for step in _steps_of("", text) if text else []:
                yield tuple(float(step[name]) if kind == "double" and step[name] is not None else step[name] for name, kind in kinds)

    spark.udtf.register("plan_steps", F.udtf(Steps, returnType=", ".join(map(" ".join, kinds)), useArrow=True))


def flattened(plans: DataFrame, plan_id: str = "plan_id", plan: str = "plan") -> DataFrame:
    """A row for each step of JSON plans, in pre-order. The depth of the JSON isn't known beforehand, so this is an Arrow-batched Python step (the table function takes a call and a table a plan: it is for SQL over few plans); plans are independent rows, no shuffle."""

    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [(name, kinds[kind]) for name, kind in (part.split() for part in STEP.split(", "))]
    number = lambda x: None if x is None or x != x else float(x)

    def run(batches):
        for batch in batches:
            out: list[dict] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    out += _steps_of(str(name), text)
            columns = [pa.array([number(step[n]) for step in out] if kind == pa.float64() else [step[n] for step in out], kind) for n, kind in fields]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

    return plans.select(plan_id, plan).mapInArrow(run, STEP)


def weighed(steps: DataFrame) -> DataFrame:
    """steps with share: of the time if the plan was measured and took any, else of the cost; heaviest marks the largest (the first of equals)."""
    plan = Window.partitionBy("plan_id")
    measured = F.sum(F.coalesce("self_ms", F.lit(0.0))).over(plan) > 0
    weight = F.when(measured, F.coalesce("self_ms", F.lit(0.0))).otherwise(F.col("self_cost"))
    out = steps.withColumn("weight", weight).withColumn("share", F.coalesce(F.try_divide("weight", F.sum("weight").over(plan)), F.lit(0.0)))
    top = F.max(F.struct("share", -F.col("step_id"))).over(plan)
    return out.withColumn("heaviest", F.struct("share", -F.col("step_id")) == top).drop("weight")


def sized(steps: DataFrame, table_rows: DataFrame) -> DataFrame:
    """steps with table_rows, the rows of the relation that a step reads; steps that read none get keys of their own, so that they don't meet in one task."""
    at = F.coalesce("relation", F.concat(F.lit("\u0000"), "plan_id"))
    rows = table_rows.select(F.col("relation").alias("_at"), F.col("rows").alias("table_rows"))
    return steps.withColumn("_at", at).join(rows, "_at", "left").drop("_at")


#: Points off for findings and their cap; plan shapes; bands.
PENALTY, FINDINGS_CAP = {"high": 12, "medium": 5, "low": 2}, 45
LARGE_ROWS, MATERIAL, DRIFT, REPEATS = 10_000, 0.15, 10.0, 1000
GOOD, FAIR = 85, 60


def band(score: Column) -> Column:
    return F.when(score >= GOOD, "good").when(score >= FAIR, "fair").otherwise("poor")


def scored(steps: DataFrame, findings: DataFrame, table_rows: DataFrame) -> DataFrame:
    """plan_id, score, band. 100 less findings (at most 45), sequential scans of large tables (25 by share), repeated work (20 by share), a bad estimate (15) and spills (10 each).

    steps: of weighed(); findings: plan_id, severity; table_rows: relation, rows."""
    points = F.when(F.col("severity") == "high", PENALTY["high"]).when(F.col("severity") == "medium", PENALTY["medium"]).when(F.col("severity") == "low", PENALTY["low"]).otherwise(0)
    raised = findings.groupBy("plan_id").agg(F.least(F.sum(points), F.lit(FINDINGS_CAP)).alias("raised"))
    half_up = lambda x: F.floor(x + 0.5)
    s = sized(steps, table_rows)
    scan = F.when((F.col("node_type") == "Seq Scan") & (F.col("table_rows") >= LARGE_ROWS) & (F.col("share") >= MATERIAL), half_up(25 * F.col("share"))).otherwise(0)
    again = F.when(F.col("inner_side") & (F.col("estimated_runs") >= REPEATS) & (F.col("share") >= MATERIAL), half_up(20 * F.col("share"))).otherwise(0)
    actual = F.col("actual_rows") * F.coalesce("loops", F.lit(1.0))
    off = F.when(F.col("parent_id").isNull() & (actual > 0) & (F.col("estimated_rows") > 0) & (F.greatest(F.try_divide(actual, "estimated_rows"), F.try_divide("estimated_rows", actual)) >= DRIFT), 15).otherwise(0)
    spill = F.when(F.col("sort_space") == "Disk", 10).otherwise(0)
    by_plan = s.groupBy("plan_id").agg(F.sum(scan + again + off + spill).alias("shape")).join(raised, "plan_id", "left")
    score = F.greatest(F.lit(0), F.lit(100) - F.col("shape") - F.coalesce("raised", F.lit(0))).cast("int")
    return by_plan.select("plan_id", score.alias("score")).withColumn("band", band(F.col("score")))
