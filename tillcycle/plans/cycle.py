"""One operating cycle for one run request, end to end (the reference's
``run_cycle``): ingest -> analyst KPIs and ranked SKUs -> forecasts for the
top SKUs -> rule-based actions -> control review -> worker tasks -> audit
-> gated dispatch outbox -> append-only artifact tables.

Every step is a DataFrame job; the only driver-side values are the run
parameters.  Outputs land under ``out_dir`` (Parquet): curated facts
(month-partitioned), run_artifacts, decision_log, actions, task_queue,
dispatch_log.  Re-running appends new artifact rows; readers take the
newest per (run, type).
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tillcycle.operators import artifacts as AR
from tillcycle.operators import audit as AU
from tillcycle.operators import controls as CR
from tillcycle.operators import dispatch as DI
from tillcycle.operators import kpis as K
from tillcycle.operators.asof import as_of_view
from tillcycle.operators.boosted import forecast_all
from tillcycle.operators.demand import daily_demand, densify
from tillcycle.operators.key_trees import TreeParams
from tillcycle.params import RunParams
from tillcycle.plans import derived as DV
from tillcycle.sources.raw_sales import read_facts, refresh_curated
from tillcycle.sources.stored import VersionedTable
from tillcycle.sources.tables import fact_sales


def run_cycle(spark: SparkSession, sf_dir: str, out_dir: str, params: RunParams | None = None,
              settings: DI.DispatchSettings | None = None, skip_ingest: bool = False,
              gbt_params: TreeParams | None = None) -> dict:
    p = params or RunParams(as_of="2000-12-31", start="2000-10-02", run_id="run-cycle")
    settings = settings or DI.DispatchSettings()
    curated = VersionedTable(spark, f"{out_dir.rstrip('/')}/curated/fact_sales")
    if not skip_ingest or not curated.exists():
        refresh_curated(curated, fact_sales(spark, sf_dir))              # SC2/SC4
    facts = read_facts(spark, curated)                                   # SC3
    visible = as_of_view(facts, p.as_of, p.mode, p.end_of_day)          # FI1
    created = dt.datetime.now().replace(microsecond=0)

    runs = spark.createDataFrame(
        [(p.run_id, p.as_of, p.start, p.as_of, p.mode, p.profile, created)],
        "run_id string, as_of_date date, period_start date, period_end date, mode string, "
        "control_profile string, created_at timestamp_ntz")

    # analyst
    kpis = K.period_kpis(visible, p.start, p.as_of, p.end_of_day) \
        .withColumn("run_id", F.lit(p.run_id)).persist()
    top = K.top_skus(visible, p.start, p.as_of, k=10)
    bottom = K.bottom_skus(visible, p.start, p.as_of, k=10)

    # forecasts: rank 20, forecast the best 5 (all visible history)
    cand = K.top_keys(visible, "stock_code", 20)
    top5 = cand.where(F.col("rank") <= 5).select("stock_code")
    dem = daily_demand(visible, "stock_code", keys=cand)
    series = densify(dem.join(top5, "stock_code", "left_semi"), "stock_code", p.as_of, min_sale_days=14)
    fc = forecast_all(series, "stock_code", p.as_of, p.horizon, params=gbt_params)

    # decision (rule-based actions for this run), control review, tasks
    wide = DV.kpi_wide(kpis)
    stats = DV.sku_period_stats(facts, runs)
    actions = DV.candidate_actions(stats, runs, wide)
    decisions = DV.decisions(runs, wide, actions)
    reviews = CR.with_citations(CR.review_actions(actions.withColumn("control_profile",
                                                                      F.lit(p.profile))))
    # reused by several outputs: materialise once (spills to disk at scale)
    actions, reviews = actions.persist(), reviews.persist()
    summary = CR.review_summary(reviews, runs).persist()
    released = CR.executable(actions, reviews)
    tasks = DI.derive_tasks(released, runs).persist()

    # audit and dispatch
    kp_ev = kpis.withColumn("evidence", F.when(F.col("name") == "return_rate", "return_rate")
                            .otherwise("total_kpis"))
    findings = AU.audit(runs, kp_ev, decisions)
    status = AU.audit_status(runs, findings).persist()
    reports = DI.dispatch_reports(runs, summary, status, tasks, settings)
    records = DI.outbox(reports, tasks, settings)

    # persist (append-only)
    ts = F.lit(created).cast("timestamp_ntz")
    rep = runs.join(kp_ev.groupBy("run_id").agg(F.array_sort(F.collect_list(
        F.struct("name", "value", "unit", "period", "evidence"))).alias("kpis")), "run_id")
    ranked = top.select(F.lit(p.run_id).alias("run_id"), F.struct("*").alias("s")) \
        .groupBy("run_id").agg(F.array_sort(F.collect_list("s")).alias("top_skus"))
    rep = rep.join(ranked, "run_id", "left")
    arts = AR.to_artifacts(rep, "analyst_report", F.struct(
        "run_id", F.col("as_of_date").cast("string").alias("as_of_date"), "mode",
        F.col("period_start").cast("string").alias("period_start"),
        F.col("period_end").cast("string").alias("period_end"), "kpis", "top_skus"), ts)
    arts = arts.unionByName(AR.to_artifacts(summary, "control_review", F.struct(
        "run_id", "control_profile", "overall_state", "auto_release", "held", "blocked",
        "requires_human_approval", "summary"), ts))
    arts = arts.unionByName(AR.to_artifacts(status, "audit_report", F.struct(
        "run_id", "errors", "warnings", "infos", "passed"), ts))
    arts = arts.unionByName(AR.to_artifacts(reports, "dispatch_report", F.struct(
        "run_id", "target_system", "status", "n_records", "reached_stage"), ts))
    arts = arts.unionByName(AR.to_artifacts(fc["summary"].withColumn("run_id", F.lit(p.run_id)),
                                            "forecast_report", F.struct(
        "run_id", "model_name", "n_keys", "n_gbt", F.lit(p.horizon).alias("horizon_days")), ts))
    arts = arts.unionByName(AR.to_artifacts(decisions, "decision", F.struct(
        "run_id", "rationale", "confidence", "kpi_references", "forecast_references",
        "n_actions"), ts))

    def path(name):
        return os.path.join(out_dir, name)

    AR.append(arts, path("run_artifacts"))
    AR.append(decisions.select("run_id", "as_of_date", "mode", F.to_json(F.struct(
        "rationale", "confidence", "kpi_references", "forecast_references"))
        .alias("decision_json"), ts.alias("created_at")), path("decision_log"))
    AR.append(actions.withColumn("created_at", ts), path("actions"))
    AR.append(tasks.select("run_id", F.to_json(F.struct(*[c for c in tasks.columns]))
                           .alias("task_json"), F.lit("pending").alias("status"),
                           ts.alias("created_at")), path("task_queue"))
    AR.append(records.withColumn("created_at", ts), path("dispatch_log"))
    AR.append(fc["forecast"].withColumn("run_id", F.lit(p.run_id)), path("forecasts"))
    AR.append(fc["backtest"].withColumn("run_id", F.lit(p.run_id)), path("backtests"))
    for d in (actions, reviews, summary, tasks, status):
        d.unpersist()
    return {"kpis": kpis, "top_skus": top, "bottom_skus": bottom, "forecast": fc["forecast"],
            "backtest": fc["backtest"], "actions": actions, "reviews": reviews, "tasks": tasks,
            "findings": findings, "dispatch": reports, "out_dir": out_dir}
