"""Plan guards: every registered query stays JVM-side, has no pair-producing join, and
the period filter reaches the parquet scan."""

import __spark_entry__ as E

FORBIDDEN = ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
             "MapInPandas", "PythonUDF")
SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _unbounded_nested_loops(plan: str) -> int:
    """Nested-loop joins whose broadcast side is not a keyless aggregate (exactly one row).

    Scoring cases against a single one-row investigation summary lets the optimizer fold
    the constant join key into a nested-loop join against that row; that emits no pairs.
    """
    lines = plan.split("\n")
    bad = 0
    for i, line in enumerate(lines):
        if "BroadcastNestedLoopJoin" in line:
            depth = len(line) - len(line.lstrip(" :|+-"))
            build = [x for x in lines[i + 1:] if "BroadcastExchange" in x
                     and len(x) - len(x.lstrip(" :|+-")) > depth][:1]
            j = lines.index(build[0], i) if build else -1
            nxt = lines[j + 1] if j >= 0 and j + 1 < len(lines) else ""
            if "Aggregate(keys=[]" not in nxt:
                bad += 1
    return bad


def test_no_pairs_no_python(spark):
    bad = {}
    for name, fn in E.queries().items():
        plan = _plan(fn(spark, SF))
        hits = [f for f in FORBIDDEN if f in plan]
        if _unbounded_nested_loops(plan):
            hits.append("BroadcastNestedLoopJoin")
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_period_filter_pushed_to_scan(spark):
    from shiftscope.operators.decompose import segment_period_totals
    from shiftscope.queries import ORDERS_PERIODS
    from shiftscope.sources import tpch_adapter as A
    plan = _plan(segment_period_totals(A.orders_tables(spark, SF), ORDERS_PERIODS, ["device"]))
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line and "o_orderdate" in line]
    assert scan and "2000-07-01" in scan[0] and "DataFilters" in scan[0]
    # column pruning: the orders scan reads only what the query needs
    assert "o_totalprice" not in scan[0]
