"""Registered queries of the write, lookup, dispatch and validation entries:
each writes to a new folder of the shared one where it writes, reads that
back, and returns what a caller would see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.functions.topk import least_candidates
from tillcycle.operators import artifacts as AR
from tillcycle.operators import dispatch as DI
from tillcycle.operators import evals as EV
from tillcycle.operators import policy as PO
from tillcycle.operators.features import build_features, split_holdout
from tillcycle.operators.naive import naive_forecast
from tillcycle.operators.quality import dq_findings
from tillcycle.operators.retrieval import chunk, read_documents
from tillcycle.operators.validate import action_rules, coerce_actions, validate, validate_requests
from tillcycle.plans import derived as DV
from tillcycle.plans.queries_core import AS_OF
from tillcycle.plans.queries_cycle import (
    AUDIT_SQL, BASE, DATE_COLUMNS, REVIEW_SQL, SETTINGS, SUMMARY_SQL, TASKS_SQL, cycle)
from tillcycle.plans.queries_evals import (
    DEC_EVAL_SQL, FACT_EVAL_SQL, FC_EVAL_SQL, run_forecasts, run_tables, stored_artifacts, stored_kpis_from)
from tillcycle.plans.queries_forecast import BRAND_SERIES, _features_sql, brand_series, forecast_sql
from tillcycle.plans.queries_report import raw_lines
from tillcycle.plans.registry import register
from tillcycle.session import cut_lineage, ensure_checkpoint_dir
from tillcycle.sources.raw_sales import ingest
from tillcycle.sources.tables import FACT_COLUMNS, FACT_SALES_SQL, fact_sales, read_table


def new_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# ------------------------------------------------------------ ingest and appends
@register("csv_ingest", "SC1 SC2 SC3 SC4 PR1 PR2 PR3 PR4 PR5 PR6 PR7 PR8",
          f"WITH {FACT_SALES_SQL}\nSELECT {', '.join(FACT_COLUMNS)} FROM fact_sales")
def q_csv_ingest(spark, d):
    """Every line written as a Latin-1 CSV, ingested from there into the
    curated table, and read back."""
    at = new_folder(spark, "ingest")
    raw_lines(spark, d).write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{at}/raw")
    facts, _ = ingest(spark, f"{at}/raw", f"{at}/curated", f"{at}/quarantine")
    return facts


@register("decision_log_appends", "SC7", BASE + """
SELECT run_id, CAST(as_of_date AS VARCHAR) AS as_of_date, mode, rationale, confidence, n_actions, part
FROM decisions, (VALUES (1), (2)) p(part)""")
def q_decision_log(spark, d):
    """The decision log appended to twice: both appends are there."""
    at = new_folder(spark, "decision_log")
    log = cycle(spark, d)["decisions"].select(
        "run_id", F.to_json(F.struct(F.col("as_of_date").cast("string").alias("as_of_date"), "mode", "rationale",
                                     "confidence", "n_actions")).alias("decision_json"))
    for part in (1, 2):
        AR.append(log.withColumn("part", F.lit(part)), at)
    j = F.from_json("decision_json", "as_of_date string, mode string, rationale string, confidence double, "
                                     "n_actions long")
    return spark.read.parquet(at).select("run_id", "part", j.alias("j")).select("run_id", "j.*", "part")


@register("file_chunks", "SC15 TX6", """
SELECT item_id, CAST(i - 1 AS INTEGER) AS chunk_id, parts[i] AS text FROM (
  SELECT item_id, parts, generate_subscripts(parts, 1) AS i FROM (
    SELECT item_id, list_filter(list_transform(string_split(text, '. '),
             lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM benchmark))""")
def q_file_chunks(spark, d):
    """The benchmark passages as text files, a folder each, read back whole
    and split at sentences."""
    at = new_folder(spark, "files")
    read_table(spark, d, "benchmark").select("item_id", "text").repartition("item_id") \
        .write.partitionBy("item_id").text(at)
    docs = read_documents(spark, at, "*.txt")
    docs = docs.withColumn("item_id", F.regexp_extract("source", r"item_id=(\d+)/", 1).cast("long"))
    return chunk(docs, "item_id", "text", r"\. ")


# ------------------------------------------------------------ lookups and validation
@register("known_runs", "SC13", BASE + """
SELECT run_id FROM runs WHERE month(as_of_date) <> 12""")
def q_known_runs(spark, d):
    """Of the requested runs (every run, and one that was never stored for
    each) those with a stored artifact; December runs were not stored."""
    t = run_tables(spark, d)
    stored = stored_artifacts(t, ("analyst_report",)).join(
        t["runs"].where(F.month("as_of_date") != 12).select("run_id"), "run_id", "left_semi")
    ids = t["runs"].select("run_id")
    return AR.known_runs(ids.unionByName(ids.select(F.concat("run_id", F.lit("-x")).alias("run_id"))), stored)


@register("run_requests", "FI8", BASE + """,
span AS (SELECT CAST(min(invoice_date) AS DATE) AS lo, CAST(max(invoice_date) AS DATE) AS hi FROM fact_sales),
req AS (SELECT run_id, period_start AS start_date, as_of_date, CASE WHEN month(as_of_date) = 2 THEN 'open' ELSE mode END AS mode,
               control_profile FROM runs)
SELECT run_id, array_to_string(list_filter([
    CASE WHEN NOT start_date < as_of_date THEN 'start_before_as_of' END,
    CASE WHEN NOT start_date BETWEEN lo AND hi THEN 'start_in_span' END,
    CASE WHEN NOT as_of_date BETWEEN lo AND hi THEN 'as_of_in_span' END,
    CASE WHEN mode NOT IN ('bounded', 'omniscient') THEN 'mode_known' END], lambda x: x IS NOT NULL), ';') AS failed
FROM req, span""")
def q_run_requests(spark, d):
    """Every run as a request (February's with an unknown mode), checked
    against the span of the data; failed = '' where it is valid."""
    facts = fact_sales(spark, d, ["invoice_date"])
    req = run_tables(spark, d)["runs"].select(
        "run_id", F.col("period_start").alias("start_date"), "as_of_date",
        F.when(F.month("as_of_date") == 2, "open").otherwise(F.col("mode")).alias("mode"), "control_profile")
    ok, bad = validate_requests(req, facts)
    return ok.select("run_id", F.lit("").alias("failed")).unionByName(
        bad.select("run_id", F.array_join("failed_rules", ";").alias("failed")))


@register("action_records", "PR9 PR10", BASE + """
SELECT run_id, action_id, CASE WHEN action_type <> 'promo' THEN quantity END AS quantity,
       CASE WHEN urgency = 'low' THEN 'medium' ELSE urgency END AS urgency, expected_impact,
       CASE WHEN action_type = 'staffing' THEN 'action_type_known' ELSE '' END AS failed
FROM actions""")
def q_action_records(spark, d):
    """The actions as loose text records (numbers as text, 'n/a' for promos,
    no urgency where it is low, one unknown type), coerced and checked."""
    a = cycle(spark, d)["actions"]
    loose = a.withColumns({
        "quantity": F.when(F.col("action_type") == "promo", "n/a").otherwise(F.col("quantity").cast("string")),
        "urgency": F.when(F.col("urgency") != "low", F.col("urgency")),
        "action_type": F.when(F.col("action_type") == "staffing", "Staff").otherwise(F.col("action_type"))})
    ok, bad = validate(coerce_actions(loose), action_rules())
    cols = ["run_id", "action_id", "quantity", "urgency", "expected_impact"]
    return ok.select(*cols, F.lit("").alias("failed")).unionByName(
        bad.select(*cols, F.array_join("failed_rules", ";").alias("failed")))


@register("dq_partial_frame", "AG8 AG9 AG10 AG12", f"WITH {FACT_SALES_SQL}" + """
SELECT 'missing_columns' AS finding_type, 'country,customer_id,description' AS column_name, 3 AS n
UNION ALL SELECT 'rows', NULL, COUNT(*) FROM fact_sales
UNION ALL SELECT 'negative_quantity', NULL, COUNT(*) FILTER (WHERE quantity < 0) FROM fact_sales
UNION ALL SELECT 'duplicate_invoice_lines', NULL, n FROM (
  SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS n FROM (SELECT COUNT(*) AS c FROM fact_sales GROUP BY invoice_no, stock_code))
  WHERE n > 0""")
def q_dq_partial(spark, d):
    """The findings of a frame that lacks three columns, with its row count."""
    return dq_findings(fact_sales(spark, d, ["invoice_no", *DATE_COLUMNS]), with_rows=True)


# ------------------------------------------------------------ dispatch
PLAN_SQL = BASE + REVIEW_SQL + TASKS_SQL


@register("action_plan", "JO7", PLAN_SQL + """,
first AS (SELECT run_id, action_type, arg_min(assigned_to, action_id) AS owner, arg_min(due_date, action_id) AS due,
                 arg_min(expected_outcome, action_id) AS outcome FROM tasks GROUP BY run_id, action_type)
SELECT a.run_id, a.action_id, a.description AS action, upper(COALESCE(a.urgency, 'medium')) AS priority,
       COALESCE(f.owner, '-') AS owner, COALESCE(f.due, '-') AS due,
       COALESCE(NULLIF(a.expected_impact, ''), NULLIF(f.outcome, ''), '-') AS impact
FROM actions a LEFT JOIN first f ON a.run_id = f.run_id AND a.action_type = f.action_type""")
def q_action_plan(spark, d):
    t = cycle(spark, d)
    return DI.action_plan(t["actions"], t["tasks"])


@register("dispatch_outbox", "DI2 DI3", PLAN_SQL + SUMMARY_SQL + AUDIT_SQL + """,
go AS (SELECT run_id FROM astatus WHERE errors = 0)
SELECT t.run_id, t.task_id, t.assigned_to, t0 || ': ' || tgt_name AS title, 'jira' AS target_system,
       '<not-configured>' AS endpoint, 'dry_run' AS status,
       CAST(to_json({'run_id': t.run_id, 'as_of_date': CAST(r.as_of_date AS VARCHAR), 'control_profile': r.control_profile,
         'task_id': t.task_id, 'assigned_to': t.assigned_to, 'title': t0 || ': ' || tgt_name, 'description': a.description,
         'priority': t.priority, 'due_date': t.due_date,
         'acceptance_criteria': ['Review the action', 'Execute the action', 'Confirm the outcome'],
         'metadata': {'action_id': t.action_id, 'stock_code': COALESCE(a.stock_code, '')}}) AS VARCHAR) AS payload_json
FROM tasks t JOIN go ON t.run_id = go.run_id JOIN runs r ON t.run_id = r.run_id
JOIN actions a ON t.run_id = a.run_id AND t.action_id = a.action_id""")
def q_outbox(spark, d):
    t = cycle(spark, d)
    return DI.outbox(t["reports"], t["tasks"], SETTINGS)


ANSWER = "CASE substr(task_id, 2, 1) WHEN '0' THEN NULL WHEN '1' THEN '{\"id\":\"\",\"ticket_id\":\"T-' || substr(task_id, 1, 6) || '\"}' " \
         "ELSE '{\"id\":\"' || substr(task_id, 1, 8) || '\"}' END"


def responses(tasks: DataFrame) -> DataFrame:
    """Answers of the target system made up from the task ids: one in 256 fails."""
    return tasks.select("run_id", "task_id", F.expr(ANSWER).alias("response_json"), F.when(
        F.substring("task_id", 1, 2) == "00", "failed").otherwise("dispatched").alias("status"))


@register("dispatch_rollup", "DI4", PLAN_SQL + f""",
resp AS (SELECT run_id, task_id, {ANSWER} AS response_json,
                CASE WHEN substr(task_id, 1, 2) = '00' THEN 'failed' ELSE 'dispatched' END AS status FROM tasks),
ext AS (SELECT *, CASE substr(task_id, 2, 1) WHEN '0' THEN '' WHEN '1' THEN 'T-' || substr(task_id, 1, 6)
                  ELSE substr(task_id, 1, 8) END AS external_id FROM resp)
SELECT run_id, CASE WHEN bool_and(status = 'dispatched') THEN 'dispatched' ELSE 'failed' END AS status,
       COUNT(*) AS n_records, COUNT(*) FILTER (WHERE external_id <> '') AS n_external, min(external_id) AS first_external
FROM ext GROUP BY run_id""")
def q_rollup(spark, d):
    per_run, records = DI.dispatch_rollup(cut_lineage(responses(cycle(spark, d)["tasks"])))
    ids = records.groupBy("run_id").agg(F.count_if(F.col("external_id") != "").alias("n_external"))
    first = least_candidates(records.select("run_id", "external_id"), ["run_id"], "external_id").groupBy("run_id").agg(
        F.min("external_id").alias("first_external"))
    return per_run.join(ids, "run_id").join(first, "run_id").select(
        "run_id", "status", "n_records", "n_external", "first_external")


# ------------------------------------------------------------ policy and tree rows
@register("order_policy", "PO3 PO4", forecast_sql(BRAND_SERIES, "brand") + f""",
o AS (SELECT brand, CAST(CEIL(ROUND(SUM(yhat) * 1.1, 6)) AS BIGINT) AS order_qty FROM fc
      WHERE ds <= CAST(DATE '{AS_OF}' + 7 AS DATE) GROUP BY brand)
SELECT brand, order_qty, CASE WHEN order_qty * 2.5 < 500 THEN 'warehouse_manager' WHEN order_qty * 2.5 <= 5000
       THEN 'operations_manager' ELSE 'director' END AS approval_role,
       CASE WHEN order_qty % 60 <= 25 THEN 'category_manager' WHEN order_qty % 60 <= 50 THEN 'operations_manager'
            ELSE 'director' END AS discount_role FROM o""")
def q_order_policy(spark, d):
    """A week's order per brand from its forecast, who approves it at 2.50 a
    unit, and who would approve a discount of (quantity mod 60) percent."""
    o = PO.order_quantities(naive_forecast(brand_series(spark, d), "brand", AS_OF, 28), "brand")
    return o.select("brand", "order_qty", PO.approval_role_for_order(F.col("order_qty") * 2.5).alias("approval_role"),
                    PO.approval_role_for_discount(F.col("order_qty") % 60).alias("discount_role"))


@register("tree_split_brand", "TS12", _features_sql(BRAND_SERIES, "brand").replace(
    f"\nSELECT brand, ds, y, day_of_week", ",\nrows AS (SELECT brand, ds, y, day_of_week", 1) + """),
f AS (SELECT brand, ds, y, ROW_NUMBER() OVER (PARTITION BY brand ORDER BY ds DESC) <= 28 AS is_test FROM rows)
SELECT brand, is_test, COUNT(*) AS n, MIN(ds) AS first_ds, MAX(ds) AS last_ds, ROUND(AVG(y), 6) AS mean_y
FROM f GROUP BY brand, is_test""")
def q_tree_split(spark, d):
    """Training and holdout rows of the tree model per key."""
    f = split_holdout(build_features(brand_series(spark, d), "brand"), ["brand"], 28)
    return f.groupBy("brand", "is_test").agg(F.count(F.lit(1)).alias("n"), F.min("ds").alias("first_ds"),
                                             F.max("ds").alias("last_ds"), F.round(F.avg("y"), 6).alias("mean_y"))


# ------------------------------------------------------------ stored artifacts, scored
APRIL = "month(as_of_date) <> 4"


@register("stored_forecast_eval", "EV4 TS18 SC10 AG21", FC_EVAL_SQL + f"""
SELECT r.run_id, CASE WHEN x.run_id IS NULL THEN 'missing_artifact' ELSE 'scored' END AS status,
       x.total_skus_forecasted, x.skus_with_actuals, x.overall_actual_mape, x.overall_actual_rmse
FROM runs r LEFT JOIN (
  SELECT run_id, COUNT(*) AS total_skus_forecasted, COUNT(*) FILTER (WHERE n_actuals > 0) AS skus_with_actuals,
         ROUND(AVG(actual_mape), 6) AS overall_actual_mape, ROUND(AVG(actual_rmse), 6) AS overall_actual_rmse
  FROM per WHERE run_id IN (SELECT run_id FROM runs WHERE {APRIL}) GROUP BY run_id) x ON r.run_id = x.run_id""")
def q_stored_forecast_eval(spark, d):
    """The forecast rows and backtests of every run but April's stored as
    tables, read back and scored; April's report is missing."""
    t = run_tables(spark, d)
    f, at = run_forecasts(t), new_folder(spark, "forecasts")
    stored = t["runs"].where(APRIL).select("run_id")
    for name in ("forecast", "backtest"):
        AR.append(f[name].drop("as_of_date").join(F.broadcast(stored), "run_id", "left_semi"),  # one row per month
                  f"{at}/{name}")
    read = lambda name: spark.read.parquet(f"{at}/{name}")
    _, summary = EV.eval_forecast(read("forecast"), read("backtest"), f["actuals"].drop("as_of_date"),
                                  ["run_id", "stock_code"])
    return EV.with_missing(t["runs"], summary)


def _missing_sql(scored: str, month: int) -> str:
    """An evaluation's statement, with a row for every run and none of that month scored."""
    at = scored.rindex("\nSELECT ")
    return scored[:at].rstrip() + f""",
scored AS ({scored[at:]})
SELECT r.run_id, CASE WHEN x.run_id IS NULL THEN 'missing_artifact' ELSE 'scored' END AS status, x.* EXCLUDE (run_id)
FROM runs r LEFT JOIN (SELECT * FROM scored WHERE run_id IN (SELECT run_id FROM runs WHERE month(as_of_date) <> {month})) x
ON r.run_id = x.run_id"""


def _stored_but(spark, t: dict, artifact: str, month: int) -> DataFrame:
    """The latest artifacts of a type, of all runs but that month's, appended and read back."""
    at = new_folder(spark, artifact)
    stored = t["runs"].where(F.month("as_of_date") != month).select("run_id")
    rows = stored_artifacts(t, (artifact,)).where(F.col("artifact_type") == artifact)
    AR.append(rows.join(stored, "run_id", "left_semi"), at)
    return AR.latest_artifacts(spark.read.parquet(at), [artifact])


@register("stored_factuality_eval", "EV1 EV2 EV3 SC10", _missing_sql(FACT_EVAL_SQL, 12))
def q_stored_factuality_eval(spark, d):
    """Analyst reports of every run but December's, stored, read back and scored."""
    t = run_tables(spark, d)
    stored, narr = stored_kpis_from(_stored_but(spark, t, "analyst_report", 12))
    return EV.with_missing(t["runs"], EV.eval_factuality(stored, DV.run_kpis(t["facts"], t["runs"]), narr))


DECISION_SCHEMA = "rationale string, confidence double, kpi_references array<string>, forecast_references array<string>"


@register("stored_decision_eval", "EV5 EV6 EV7 SC10", _missing_sql(DEC_EVAL_SQL, 8))
def q_stored_decision_eval(spark, d):
    """Decisions of every run but August's, stored, read back and scored; the actions and the
    known KPIs of a run without a decision make no row of their own."""
    t = run_tables(spark, d)
    latest = _stored_but(spark, t, "decision", 8)
    decisions = latest.select("run_id", F.from_json("artifact_json", DECISION_SCHEMA).alias("r")).select("run_id", "r.*")
    return EV.with_missing(t["runs"], EV.eval_decisions(decisions, t["actions"], t["kpis"].select("run_id", "name")))


@register("forecast_warnings", "EV4", FC_EVAL_SQL + f"""
SELECT p.run_id, p.stock_code, printf('{EV.NO_ACTUALS}', p.stock_code, CAST(r.as_of_date AS VARCHAR)) AS warning
FROM per p JOIN runs r ON p.run_id = r.run_id WHERE p.n_actuals = 0""")
def q_forecast_warnings(spark, d):
    t = run_tables(spark, d)
    f = run_forecasts(t)
    per, _ = EV.eval_forecast(*[f[n].drop("as_of_date") for n in ("forecast", "backtest", "actuals")],
                              ["run_id", "stock_code"])
    return EV.forecast_warnings(per, t["runs"])


@register("decision_findings", "EV6", DEC_EVAL_SQL[:DEC_EVAL_SQL.rindex("SELECT run_id")].rstrip() + f""",
e AS (SELECT run_id, unnest([
    CASE WHEN NOT has_rationale THEN '{EV.NO_RATIONALE}' END,
    CASE WHEN NOT has_kpi_references THEN '{EV.NO_KPI_REFERENCES}' END,
    CASE WHEN NOT has_forecast_references THEN '{EV.NO_FORECAST_REFERENCES}' END,
    CASE WHEN unknown_kpi_references <> '' THEN
      'KPI references not found in analyst report: [''' || replace(unknown_kpi_references, ';', ''', ''') || ''']' END,
    CASE WHEN confidence_flag = 'suspiciously_high' THEN printf('{EV.TOO_SURE}', confidence)
         WHEN confidence_flag = 'suspiciously_low' THEN printf('{EV.TOO_UNSURE}', confidence) END,
    CASE WHEN total_actions = 0 THEN '{EV.NO_ACTIONS}' END]) AS finding FROM y)
SELECT run_id, finding FROM e WHERE finding IS NOT NULL
UNION ALL SELECT run_id, 'Action ''' || action_type || ''' has no stock_code or category — too vague.' FROM actions
WHERE COALESCE(stock_code, '') = '' AND COALESCE(category, '') = ''""")
def q_decision_findings(spark, d):
    t = run_tables(spark, d)
    scores = EV.eval_decisions(t["decisions"], t["actions"], t["kpis"].select("run_id", "name"))
    return EV.decision_findings(scores, t["actions"])


@register("run_routes", "DI6", BASE + REVIEW_SQL + SUMMARY_SQL + """
SELECT r.run_id, CASE WHEN month(r.as_of_date) IN (4, 8, 12) THEN 'persist'
       WHEN s.auto_release > 0 THEN 'worker' ELSE 'auditor' END AS reached_stage
FROM runs r JOIN summary s ON r.run_id = s.run_id""")
def q_run_routes(spark, d):
    """Routing of runs of which April's forecast report, August's decision and
    December's analyst report were never stored."""
    t = cycle(spark, d)
    kinds = F.array(F.when(F.month("as_of_date") != 12, F.lit("analyst_report")),
                    F.when(F.month("as_of_date") != 4, F.lit("forecast_report")),
                    F.when(F.month("as_of_date") != 8, F.lit("decision")))
    artifacts = t["runs"].select("run_id", F.explode(kinds).alias("artifact_type")).where("artifact_type is not null")
    return DI.reached_stage(t["runs"], artifacts, t["summary"])
