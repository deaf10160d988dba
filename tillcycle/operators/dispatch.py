"""Worker tasks from released actions and the gated dispatch outbox (DI1-DI6, PR16, JO7).

Sending over the network is not built: records land in an outbox table
with status ``pending`` when an endpoint is configured; ``dispatch_rollup``
turns a table of send responses into the per-run report status.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.functions.topk import least_candidates
from tillcycle.session import bounded_broadcast, cut_lineage

# Owning team per action type (DI5).
OWNERS = {"restock": "warehouse_team", "reorder": "warehouse_team",
          "markdown": "marketing_team", "promo": "marketing_team",
          "staffing": "hr_team", "audit_returns": "qa_team", "other": "ops_team"}
DUE_DAYS = {"high": 2, "medium": 7, "low": 14}


@dataclass(frozen=True)
class DispatchSettings:
    dry_run: bool = True
    target_system: str = "jira"
    api_base_url: str = ""
    task_endpoint: str = "/tasks"

    @property
    def endpoint(self) -> str:
        base = self.api_base_url.rstrip("/")
        return f"{base}{self.task_endpoint}" if base else ""


def _map_lookup(mapping: dict, col, default):
    expr = F.lit(default)
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)).otherwise(expr)
    return expr


def derive_tasks(released: DataFrame, runs: DataFrame) -> DataFrame:
    """DI5/PR16: one worker task per released action.

    task_id is a deterministic hash of (run_id, action_id) instead of a
    random UUID, so re-running a job after a failure writes the same ids.
    """
    r = F.broadcast(runs.select("run_id", "as_of_date", "control_profile"))
    a = released.join(r, ["run_id"] + (["control_profile"] if "control_profile" in released.columns
                                       else []))
    t = F.col("action_type")
    urg = F.coalesce(F.col("urgency"), F.lit("medium"))
    title = F.concat(F.initcap(F.regexp_replace(t, "_", " ")), F.lit(": "),
                     F.coalesce(F.col("stock_code"), F.col("category"), F.lit("general")))
    due = F.date_add("as_of_date", _map_lookup(DUE_DAYS, urg, 7))
    return a.select(
        "run_id", "as_of_date", "control_profile",
        F.substring(F.sha2(F.concat_ws("|", "run_id", "action_id"), 256), 1, 32).alias("task_id"),
        "action_id",
        _map_lookup(OWNERS, t, "ops_team").alias("assigned_to"),
        t.alias("action_type"), title.alias("title"), F.col("description"),
        due.cast("string").alias("due_date"), urg.alias("priority"),
        F.array(F.lit("Review the action"), F.lit("Execute the action"),
                F.lit("Confirm the outcome")).alias("acceptance_criteria"),
        F.coalesce(F.col("expected_impact"), F.lit("")).alias("expected_outcome"),
        F.create_map(F.lit("action_id"), F.col("action_id"),
                     F.lit("stock_code"), F.coalesce(F.col("stock_code"), F.lit(""))).alias("metadata"))


def payload_json(tasks: DataFrame) -> DataFrame:
    """DI2: the outbound payload per task as a JSON string (NULLs kept)."""
    payload = F.struct("run_id", F.col("as_of_date").cast("string").alias("as_of_date"),
                       "control_profile", "task_id", "assigned_to", "title", "description",
                       "priority", "due_date", "acceptance_criteria", "metadata")
    return tasks.withColumn("payload_json",
                            F.to_json(payload, {"ignoreNullFields": "false"}))


def dispatch_reports(runs: DataFrame, summary: DataFrame, status: DataFrame,
                     tasks: DataFrame, settings: DispatchSettings) -> DataFrame:
    """DI1/DI3: the per-run gate, in order: no audit -> blocked; failed audit
    -> blocked; no tasks -> approval_required if the review holds actions,
    else skipped; otherwise dry_run / not_configured / queued.

    summary: review_summary output; status: audit_status output.
    """
    n = tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_tasks"))
    j = runs.select("run_id", "control_profile") \
        .join(status.select("run_id", "passed"), "run_id", "left") \
        .join(summary.select("run_id", "requires_human_approval", "auto_release"), "run_id", "left") \
        .join(n, "run_id", "left").withColumn("n_tasks", F.coalesce("n_tasks", F.lit(0)))
    if settings.dry_run:
        ready = "dry_run"
    elif not settings.endpoint:
        ready = "not_configured"
    else:
        ready = "queued"
    st = F.when(F.col("passed").isNull(), "blocked").when(~F.col("passed"), "blocked") \
        .when(F.col("n_tasks") == 0,
              F.when(F.coalesce(F.col("requires_human_approval"), F.lit(False)),
                     "approval_required").otherwise("skipped")) \
        .otherwise(ready)
    records = F.when(st.isin("dry_run", "not_configured", "queued"), F.col("n_tasks")).otherwise(0)
    stage = F.when(F.coalesce(F.col("auto_release"), F.lit(0)) > 0, "worker").otherwise("auditor")
    return j.select("run_id", F.lit(settings.target_system).alias("target_system"),
                    st.alias("status"), records.alias("n_records"), stage.alias("reached_stage"))


def outbox(reports: DataFrame, tasks: DataFrame, settings: DispatchSettings) -> DataFrame:
    """DI3: one record per task of the runs whose report prepared payloads."""
    open_runs = bounded_broadcast(reports.where(F.col("n_records") > 0).select("run_id"))
    rec_status = "dry_run" if settings.dry_run else ("skipped" if not settings.endpoint else "pending")
    endpoint = settings.endpoint or "<not-configured>"
    t = payload_json(tasks.join(open_runs, "run_id", "left_semi"))
    return t.select("run_id", "task_id", "assigned_to", "title",
                    F.lit(settings.target_system).alias("target_system"),
                    F.lit(endpoint).alias("endpoint"), F.lit(rec_status).alias("status"),
                    "payload_json")


def dispatch_rollup(responses: DataFrame) -> DataFrame:
    """DI4: responses (run_id, task_id, status, response_json) -> per-run
    status (dispatched only if every record was) and the external id of
    each record (first non-empty of id, ticket_id, record_id)."""
    ext = F.coalesce(*[F.nullif(F.get_json_object("response_json", f"$.{k}"), F.lit(""))
                       for k in ("id", "ticket_id", "record_id")], F.lit(""))
    recs = responses.withColumn("external_id", ext)
    per_run = recs.groupBy("run_id").agg(
        F.bool_and(F.col("status") == "dispatched").alias("_all"),
        F.count(F.lit(1)).alias("n_records"))
    per_run = per_run.select("run_id", "n_records",
                             F.when(F.col("_all"), "dispatched").otherwise("failed").alias("status"))
    return per_run, recs


def action_plan(actions: DataFrame, tasks: DataFrame) -> DataFrame:
    """JO7: each action with the first task of the same (lower-cased) type.

    Owner / due fall back to '-'; impact falls back action -> task -> '-'.
    'First' = the task of the smallest action_id: a run's actions are listed
    in that order, and tasks follow their actions.
    """
    tt = tasks.withColumn("_t", F.lower("action_type"))
    # min_by per (run, type): a partial aggregate, so a type with millions of
    # tasks never lands in one window partition; it sorts the candidates only.
    first = least_candidates(tt, ["run_id", "_t"], "action_id").groupBy("run_id", "_t").agg(F.min_by(
        F.struct(F.col("assigned_to").alias("_owner"), F.col("due_date").alias("_due"),
                 F.col("expected_outcome").alias("_outcome")), F.col("action_id")).alias("f")) \
        .select("run_id", "_t", "f.*")
    # at most seven rows per run, written so that they are made once and their size is known
    a = actions.withColumn("_t", F.lower("action_type")).join(cut_lineage(first), ["run_id", "_t"], "left")
    nz = lambda c: F.nullif(F.col(c), F.lit(""))
    return a.select(
        "run_id", "action_id", F.col("description").alias("action"),
        F.upper(F.coalesce(F.col("urgency"), F.lit("medium"))).alias("priority"),
        F.coalesce(nz("_owner"), F.lit("-")).alias("owner"),
        F.coalesce(nz("_due"), F.lit("-")).alias("due"),
        F.coalesce(nz("expected_impact"), nz("_outcome"), F.lit("-")).alias("impact"))


def reached_stage(runs: DataFrame, artifacts: DataFrame, summary: DataFrame) -> DataFrame:
    """DI6: where each run's routing leads.  A run without its analyst or
    forecast report, or without a decision, is only persisted; else it goes to
    the worker if the review released an action, to the auditor if not (or if
    there is no review)."""
    kinds = artifacts.groupBy("run_id").agg(*[
        F.bool_or(F.col("artifact_type") == t).alias(t) for t in ("analyst_report", "forecast_report", "decision")])
    j = runs.select("run_id").join(kinds, "run_id", "left") \
        .join(summary.select("run_id", "auto_release"), "run_id", "left")
    there = lambda t: F.coalesce(F.col(t), F.lit(False))
    stage = F.when(~there("analyst_report") | ~there("forecast_report") | ~there("decision"), "persist") \
        .when(F.coalesce("auto_release", F.lit(0)) > 0, "worker").otherwise("auditor")
    return j.select("run_id", stage.alias("reached_stage"))
