"""Control review, dispatch gating: the reference's cases plus the full grid."""
import itertools

import pytest
from pyspark.sql import functions as F

from tillcycle.operators import controls as CR
from tillcycle.operators import dispatch as DI

SCHEMA = ("run_id string, action_id string, action_type string, stock_code string, "
          "category string, description string, quantity double, urgency string, "
          "expected_impact string, control_profile string")


def _actions(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _one(spark, typ, code, cat, qty, urg, profile):
    df = _actions(spark, [("r", "a0", typ, code, cat, "d", qty, urg, "", profile)])
    return CR.review_actions(df).collect()[0]


def test_low_risk_restock_auto_releases(spark):
    r = _one(spark, "restock", "SKU1", None, 50.0, "medium", "standard")
    assert (r.control_family, r.execution_state, r.approval_role) == ("inventory", "auto_release", "none")


def test_regulated_untargeted_promo_blocked(spark):
    r = _one(spark, "promo", None, None, None, "high", "regulated")
    assert r.execution_state == "blocked"
    assert r.approval_role == "manual_review_board"
    assert r.risk_tier == "critical"


def test_regulated_reorder_200_held_for_ops_manager(spark):
    r = _one(spark, "reorder", "SKU2", None, 200.0, "medium", "regulated")
    assert (r.execution_state, r.approval_role, r.risk_tier) == \
        ("hold_for_approval", "operations_manager", "critical")


INVENTORY, PRICING = ("restock", "reorder"), ("markdown", "promo")
AUTO, HOLD, STOP = "auto_release", "hold_for_approval", "blocked"
OPS, BOARD = "operations_manager", "manual_review_board"
# Expected (risk, role, state) of targeted actions: type group, quantity band, urgent -> standard, regulated.
# Bands: up to 100 units (or none given), up to 500, beyond.
EXPECTED = [
    (INVENTORY, "small", False, ("medium", "none", AUTO), ("high", "none", AUTO)),
    (INVENTORY, "small", True, ("high", OPS, HOLD), ("critical", OPS, HOLD)),
    (INVENTORY, "medium", False, ("high", OPS, HOLD), ("critical", OPS, HOLD)),
    (INVENTORY, "medium", True, ("high", OPS, HOLD), ("critical", OPS, HOLD)),
    (INVENTORY, "large", False, ("critical", "director", HOLD), ("critical", "director", HOLD)),
    (INVENTORY, "large", True, ("critical", "director", HOLD), ("critical", "director", HOLD)),
    (PRICING, "any", False, ("high", "category_manager", HOLD), ("critical", OPS, HOLD)),
    (PRICING, "any", True, ("high", OPS, HOLD), ("critical", OPS, HOLD)),
    (("staffing",), "any", False, ("high", OPS, HOLD), ("critical", OPS, HOLD)),
    (("staffing",), "any", True, ("high", OPS, HOLD), ("critical", OPS, HOLD)),
    (("audit_returns",), "any", False, ("low", "none", AUTO), ("medium", "none", AUTO)),
    (("audit_returns",), "any", True, ("low", "none", AUTO), ("medium", "none", AUTO)),
    (("other",), "any", False, ("critical", BOARD, STOP), ("critical", BOARD, STOP)),
    (("other",), "any", True, ("critical", BOARD, STOP), ("critical", BOARD, STOP)),
]
FAMILY = {"restock": "inventory", "reorder": "inventory", "markdown": "pricing", "promo": "pricing",
          "staffing": "operations", "audit_returns": "quality", "other": "manual_review"}
BAND = {None: "small", 0.0: "small", 100.0: "small", 101.0: "medium", 500.0: "medium", 501.0: "large"}


def test_control_grid(spark):
    targets = [("SKU9", None, True), (None, "cat", True), (None, None, False), ("  ", None, False)]
    rows, want = [], {}
    for types, band, urgent, standard, regulated in EXPECTED:
        cells = itertools.product(types, [q for q, b in BAND.items() if band in (b, "any")],
                                  ["high"] if urgent else ["low", "medium"], targets,
                                  [("standard", standard), ("regulated", regulated)])
        for t, q, u, (code, cat, targeted), (profile, outcome) in cells:
            i = f"a{len(rows)}"
            rows.append(("r", i, t, code, cat, "d", q, u, "", profile))
            # without a target only staffing is reviewed as usual
            want[i] = (FAMILY[t], *(outcome if targeted or t == "staffing" else ("critical", BOARD, STOP)))
    assert len(rows) == 7 * 3 * 6 * 4 * 2
    got = {r.action_id: (r.control_family, r.risk_tier, r.approval_role, r.execution_state)
           for r in CR.review_actions(_actions(spark, rows)).collect()}
    assert got == want


def test_summary_and_executable(spark):
    rows = [("r1", "a0", "restock", "S", None, "d", 10.0, "low", "", "standard"),
            ("r1", "a1", "promo", None, None, "d", None, "high", "", "standard"),
            ("r2", "a0", "staffing", None, "c", "d", None, "low", "", "standard")]
    acts = _actions(spark, rows)
    rev = CR.review_actions(acts)
    runs = spark.createDataFrame([("r1", "standard"), ("r2", "standard"), ("r3", "regulated")],
                                 "run_id string, control_profile string")
    s = {r.run_id: r for r in CR.review_summary(rev, runs).collect()}
    assert (s["r1"].auto_release, s["r1"].blocked, s["r1"].overall_state) == (1, 1, "blocked")
    assert s["r2"].overall_state == "approval_required" and s["r2"].requires_human_approval
    assert s["r3"].overall_state == "auto_release" and s["r3"].auto_release == 0
    assert "released 1 action(s)" in s["r1"].summary
    ex = {(r.run_id, r.action_id) for r in CR.executable(acts, rev).collect()}
    assert ex == {("r1", "a0")}
    # no review at all -> every action is executable
    assert CR.executable(acts, None).count() == 3


def test_citations_default_to_other(spark):
    rows = [("r", "a0", "teleport", "S", None, "d", 1.0, "low", "", "standard")]
    r = CR.with_citations(CR.review_actions(_actions(spark, rows))).collect()[0]
    assert [c.control_id for c in r.citations] == ["REG_NON_STANDARD_BLOCK"]


@pytest.fixture
def gate_inputs(spark):
    runs = spark.createDataFrame([("r1", "standard"), ("r2", "standard")],
                                 "run_id string, control_profile string")
    summary = spark.createDataFrame([("r1", True, 1), ("r2", False, 1)],
                                    "run_id string, requires_human_approval boolean, auto_release int")
    status = spark.createDataFrame([("r1", False), ("r2", True)], "run_id string, passed boolean")
    tasks = spark.createDataFrame(
        [("r2", "task-123", "warehouse_team", "Restock: S", "desc", "2011-07-02", "medium")],
        "run_id string, task_id string, assigned_to string, title string, description string, "
        "due_date string, priority string")
    return runs, summary, status, tasks


def test_dispatch_blocked_on_audit_error(spark, gate_inputs):
    runs, summary, status, tasks = gate_inputs
    rep = {r.run_id: r for r in DI.dispatch_reports(runs, summary, status, tasks,
                                                     DI.DispatchSettings()).collect()}
    assert rep["r1"].status == "blocked" and rep["r1"].n_records == 0


def test_dispatch_dry_run_record(spark, gate_inputs):
    runs, summary, status, tasks = gate_inputs
    settings = DI.DispatchSettings(dry_run=True, target_system="jira",
                                   api_base_url="https://tickets.example.invalid")
    rep = DI.dispatch_reports(runs, summary, status, tasks, settings)
    assert {r.run_id: r.status for r in rep.collect()}["r2"] == "dry_run"
    full = tasks.withColumn("as_of_date", F.lit("2011-06-30").cast("date")) \
        .withColumn("control_profile", F.lit("standard")) \
        .withColumn("acceptance_criteria", F.array(F.lit("done"))) \
        .withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    rec = DI.outbox(rep, full, settings).collect()
    assert len(rec) == 1 and rec[0].status == "dry_run" and rec[0].target_system == "jira"
    assert '"task_id":"task-123"' in rec[0].payload_json


def test_dispatch_not_configured_and_skipped(spark, gate_inputs):
    runs, summary, status, tasks = gate_inputs
    settings = DI.DispatchSettings(dry_run=False, api_base_url="")
    rep = {r.run_id: r.status for r in
           DI.dispatch_reports(runs, summary, status, tasks, settings).collect()}
    assert rep["r2"] == "not_configured"
    empty = tasks.where("false")
    rep2 = {r.run_id: r.status for r in
            DI.dispatch_reports(runs, summary, status.withColumn("passed", F.lit(True)), empty,
                                settings).collect()}
    assert rep2 == {"r1": "approval_required", "r2": "skipped"}


def test_dispatch_rollup(spark):
    resp = spark.createDataFrame(
        [("r1", "t1", "dispatched", '{"id": "", "ticket_id": "T-9"}'),
         ("r1", "t2", "dispatched", '{"record_id": "R1"}'),
         ("r2", "t3", "failed", None)],
        "run_id string, task_id string, status string, response_json string")
    per_run, recs = DI.dispatch_rollup(resp)
    assert {r.run_id: r.status for r in per_run.collect()} == {"r1": "dispatched", "r2": "failed"}
    assert {r.task_id: r.external_id for r in recs.collect()} == {"t1": "T-9", "t2": "R1", "t3": ""}
