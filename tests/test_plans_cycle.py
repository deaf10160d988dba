"""Plan shape (pushdown, pruned joins), the end-to-end cycle, artifacts,
action plan and policy helpers."""
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillcycle.operators import artifacts as AR
from tillcycle.operators.key_trees import TreeParams
from tillcycle.operators import dispatch as DI
from tillcycle.operators import policy as PO
from tillcycle.plans.cycle import run_cycle
from tillcycle.plans.queries_core import q_kpis
from tillcycle.sources.tables import fact_sales


def _plan(df):
    """The formatted plan text (what ``explain("formatted")`` prints)."""
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_kpi_filters_reach_the_scan(spark):
    p = _plan(q_kpis(spark, SF_SMALL))
    assert "LessThanOrEqual(l_shipdate,2000-12-31" in p
    assert "GreaterThanOrEqual(l_shipdate,2000-10-02" in p
    assert "l_discount" not in p and "l_tax" not in p          # column pruning
    assert "p_name" not in p and "n_name" not in p             # no part / nation join


def test_dimension_joins_only_when_read(spark):
    narrow = _plan(fact_sales(spark, SF_SMALL, ["invoice_date", "stock_code", "revenue"]))
    assert "o_orderkey" not in narrow and "p_partkey" not in narrow
    full = _plan(fact_sales(spark, SF_SMALL))
    assert all(k in full for k in ("o_orderkey", "p_partkey", "c_custkey", "n_nationkey"))


def test_lines_are_not_dealt_by_customer(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = fact_sales(spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    at = next(i for i, x in enumerate(plan) if "SortMergeJoin [o_custkey" in x)
    under = [x for i, x in enumerate(plan) if i > at and all(d > depth[at] for d in depth[at + 1:i + 1])]
    assert any("c_nationkey" in x for x in under) and not any("l_orderkey" in x for x in under)


def test_cycle_end_to_end_and_rerun_appends(spark):
    out = tempfile.mkdtemp(prefix="tillcycle-cycle-")
    small = TreeParams(rounds=5)     # the pipeline, not the model, is under test
    r = run_cycle(spark, SF_SMALL, out, gbt_params=small)
    arts = spark.read.parquet(os.path.join(out, "run_artifacts"))
    types = {x.artifact_type for x in arts.collect()}
    assert types == {"analyst_report", "forecast_report", "decision", "control_review",
                     "audit_report", "dispatch_report"}
    assert r["kpis"].count() == 5
    for t in ("decision_log", "actions", "task_queue", "forecasts", "backtests"):
        assert os.path.isdir(os.path.join(out, t)), t
    fc = spark.read.parquet(os.path.join(out, "forecasts"))
    assert fc.where(F.col("yhat") < 0).count() == 0
    run_cycle(spark, SF_SMALL, out, skip_ingest=True, gbt_params=small)   # a second run appends
    arts = spark.read.parquet(os.path.join(out, "run_artifacts"))
    assert arts.count() == 12
    assert AR.latest_artifacts(arts).count() == 6


def test_artifact_helpers(spark):
    rows = [("r1", "decision", '{"v": 1}', dt.datetime(2011, 7, 1, 9)),
            ("r1", "decision", '{"v": 2}', dt.datetime(2011, 7, 1, 10)),
            ("r1", "analyst_report", '{"period_start": "2011-04-01", "period_end": "2011-06-30"}',
             dt.datetime(2011, 7, 1, 9)),
            ("r2", "decision", '{"v": 3}', dt.datetime(2011, 7, 2, 9))]
    a = spark.createDataFrame(rows, "run_id string, artifact_type string, artifact_json string, "
                                    "created_at timestamp_ntz")
    latest = {(x.run_id, x.artifact_type): x.artifact_json for x in AR.latest_artifacts(a).collect()}
    assert latest[("r1", "decision")] == '{"v": 2}'
    m = {x.run_id: x.artifacts for x in AR.artifact_map(a).collect()}
    assert set(m["r1"]) == {"decision", "analyst_report"} and m["r1"]["decision"] == '{"v": 2}'
    log = spark.createDataFrame([("r1", dt.date(2011, 6, 30), "bounded", dt.datetime(2011, 7, 1)),
                                 ("r2", dt.date(2011, 7, 1), "bounded", dt.datetime(2011, 7, 2))],
                                "run_id string, as_of_date date, mode string, created_at timestamp_ntz")
    rr = AR.recent_runs(log, a, limit=20).collect()
    assert [x.run_id for x in rr] == ["r2", "r1"] and rr[1].period_end == "2011-06-30"
    req = spark.createDataFrame([("r1",), ("r9",)], "run_id string")
    assert [x.run_id for x in AR.known_runs(req, a).collect()] == ["r1"]
    out = AR.to_artifacts(log, "x", F.struct("mode", F.lit(None).cast("string").alias("n")))
    assert '"n":null' in out.first().artifact_json            # NULL fields kept


def test_action_plan_first_task_per_type(spark):
    acts = spark.createDataFrame(
        [("r", "a0", "Restock", "restock SKU1", "high", ""), ("r", "a1", "promo", "promo", None, "More sales")],
        "run_id string, action_id string, action_type string, description string, urgency string, "
        "expected_impact string")
    tasks = spark.createDataFrame(
        [("r", "t1", "a7", "restock", "warehouse_team", "2011-07-05", "Stock ok"),
         ("r", "t2", "a0", "restock", "wh_b", "2011-07-03", "Stock b")],
        "run_id string, task_id string, action_id string, action_type string, assigned_to string, due_date string, "
        "expected_outcome string")
    got = {x.action_id: x for x in DI.action_plan(acts, tasks).collect()}
    assert (got["a0"].owner, got["a0"].due, got["a0"].impact, got["a0"].priority) == \
        ("wh_b", "2011-07-03", "Stock b", "HIGH")
    assert (got["a1"].owner, got["a1"].due, got["a1"].impact, got["a1"].priority) == \
        ("-", "-", "More sales", "MEDIUM")


def test_policy_helpers(spark):
    df = spark.createDataFrame([(20, 30.0, 400.0), (70, 60.0, 6000.0), (10, 10.0, 500.0)],
                               "idle int, pct double, value double")
    got = df.select(PO.markdown_tier("idle").alias("t"), PO.approval_role_for_discount("pct").alias("d"),
                    PO.approval_role_for_order("value").alias("o")).collect()
    assert [tuple(x) for x in got] == [(None, "operations_manager", "warehouse_manager"),
                                       (25, "director", "director"),
                                       (None, "category_manager", "operations_manager")]
    fc = spark.createDataFrame([("A", dt.date(2011, 7, 1) + dt.timedelta(days=i), 10.0) for i in range(28)],
                               "k string, ds date, yhat double")
    assert PO.order_quantities(fc, "k").first().order_qty == 77


def test_series_read_the_lines_once_and_no_orders(spark):
    from tillcycle.plans import queries_core as QC
    from tillcycle.plans import queries_forecast as QF
    scans = lambda p, table: p.count(f"/{table}.parquet")
    for series, lines in ((QF.brand_series, 1), (QF.all_sku_series, 1), (QF.top20_series, 2)):
        p = _plan(series(spark, SF_SMALL))
        assert scans(p, "lineitem") == lines and scans(p, "orders") == 0, series
    for query in (QC.q_forecast_candidates, QC.q_daily_demand, QC.q_top_skus, QC.q_bottom_skus):
        assert scans(_plan(query(spark, SF_SMALL)), "orders") == 0, query
    assert scans(_plan(QC.q_kpis(spark, SF_SMALL)), "orders") > 0
