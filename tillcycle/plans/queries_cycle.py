"""Registered queries: derived runs, decisions and actions; control review,
audit, worker tasks and dispatch gating over every run at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcycle.operators import audit as AU
from tillcycle.operators import controls as CR
from tillcycle.operators import dispatch as DI
from tillcycle.plans import derived as DV
from tillcycle.plans.registry import register
from tillcycle.sources.tables import FACT_SALES_SQL, fact_sales

#: What the run calendar and the SKU statistics read.
DATE_COLUMNS = ["invoice_date", "stock_code", "quantity", "unit_price", "revenue"]
SETTINGS = DI.DispatchSettings(dry_run=True, target_system="jira")


def cycle(spark, d) -> DV.RunTables:
    """Every cycle table for the facts at ``d``, each built on first use."""
    facts = fact_sales(spark, d, ["invoice_no", "customer_id", *DATE_COLUMNS], lines_per_task=DV.LINES_PER_TASK)
    dates = fact_sales(spark, d, DATE_COLUMNS)
    t = DV.build_run_tables(facts, dates=dates)

    def reviews():
        profiled = t["actions"].join(
            F.broadcast(t["runs"].select("run_id", "control_profile")), "run_id")
        return CR.with_citations(CR.review_actions(profiled))

    # findings feed several outputs: written once.  Reviews and tasks are projections of the written
    # actions, as large as these: computed where they are read, with the columns read there
    t._build.update(
        reviews=reviews,
        summary=lambda: CR.review_summary(t["reviews"], t["runs"]),
        released=lambda: CR.executable(t["reviews"], t["reviews"]),
        tasks=lambda: DI.derive_tasks(t["released"], t["runs"]),
        findings=lambda: t._cut(AU.audit(t["runs"], t["kpis"], t["decisions"])),
        status=lambda: AU.audit_status(t["runs"], t["findings"]),
        reports=lambda: DI.dispatch_reports(t["runs"], t["summary"], t["status"], t["tasks"],
                                            SETTINGS),
    )
    return t


# ---------------------------------------------------------------- SQL side
RUNS_SQL = """
runs AS (
  SELECT 'run-' || strftime(a, '%Y-%m') AS run_id, a AS as_of_date,
         CAST(a - 90 AS DATE) AS period_start,
         CASE WHEN month(a) = 3 THEN CAST(a + 7 AS DATE) ELSE a END AS period_end,
         CASE WHEN month(a) = 12 THEN 'omniscient' ELSE 'bounded' END AS mode,
         CASE WHEN month(a) % 2 = 0 THEN 'regulated' ELSE 'standard' END AS control_profile,
         CAST(CAST(a + 1 AS DATE) AS TIMESTAMP) AS created_at
  FROM (SELECT DISTINCT last_day(CAST(invoice_date AS DATE)) AS a FROM fact_sales)),
rf AS (
  SELECT r.run_id, f.* FROM fact_sales f JOIN runs r
    ON f.invoice_date >= CAST(r.period_start AS TIMESTAMP)
   AND f.invoice_date <= CAST(r.period_end AS TIMESTAMP)
   AND (r.mode = 'omniscient' OR f.invoice_date <= CAST(r.as_of_date AS TIMESTAMP))),
kw AS (
  SELECT run_id, ROUND(COALESCE(SUM(revenue), 0), 2) AS total_revenue,
         CAST(COUNT(DISTINCT invoice_no) AS DOUBLE) AS total_orders,
         COALESCE(ROUND(COALESCE(SUM(revenue), 0) / NULLIF(COUNT(DISTINCT invoice_no), 0), 2), 0.0) AS avg_order_value,
         CAST(COUNT(DISTINCT customer_id) AS DOUBLE) AS unique_customers,
         ROUND(COUNT(*) FILTER (WHERE quantity < 0) / GREATEST(COUNT(*), 1), 4) AS return_rate
  FROM rf GROUP BY run_id),
ss AS (
  SELECT run_id, stock_code, CAST(SUM(CASE WHEN quantity > 0 THEN quantity ELSE 0 END) AS BIGINT) AS units,
         COUNT(*) AS lines, COUNT(*) FILTER (WHERE quantity < 0) AS return_lines,
         MAX(CASE WHEN quantity > 0 THEN invoice_date END) AS last_sale
  FROM rf GROUP BY run_id, stock_code),
ssr AS (
  SELECT ss.*, r.mode, return_lines / lines AS rate,
         date_diff('day', CAST(last_sale AS DATE),
                   CASE WHEN r.mode = 'omniscient' THEN r.period_end ELSE LEAST(r.period_end, r.as_of_date) END) AS idle
  FROM ss JOIN runs r ON ss.run_id = r.run_id),
acts AS (
  SELECT run_id, 'audit_returns' AS action_type, stock_code, CAST(NULL AS VARCHAR) AS category,
         printf('Investigate returns of SKU %s: %d%% of lines returned', stock_code,
                CAST(FLOOR(rate * 100 + 0.5) AS BIGINT)) AS description,
         CAST(NULL AS DOUBLE) AS quantity,
         CASE WHEN rate >= 0.75 THEN 'high' ELSE 'medium' END AS urgency,
         'Lower return losses' AS expected_impact
  FROM ssr WHERE return_lines >= 2 AND rate > 0.5
  UNION ALL
  SELECT run_id, CASE WHEN units >= 120 THEN 'reorder' ELSE 'restock' END, stock_code, NULL,
         printf('Replenish SKU %s: %d units sold in the period', stock_code, units),
         CAST(CEIL(units / 13.0 * 2 * 1.1) AS DOUBLE),
         CASE WHEN units >= 150 THEN 'high' WHEN units >= 90 THEN 'medium' ELSE 'low' END,
         'Avoid stock-outs'
  FROM ssr WHERE units >= 60
  UNION ALL
  SELECT run_id, 'markdown', stock_code, NULL,
         printf('Mark down SKU %s by %d%% after %d days without a sale', stock_code,
                CASE WHEN idle >= 112 THEN 50 WHEN idle >= 84 THEN 40 WHEN idle >= 56 THEN 25 ELSE 10 END, idle),
         NULL, CASE WHEN idle >= 84 THEN 'high' ELSE 'medium' END, 'Clear slow stock'
  FROM ssr WHERE last_sale IS NOT NULL AND idle >= 28
  UNION ALL
  SELECT run_id, 'promo', NULL, NULL,
         printf('Run a retention promotion: return rate %d%%', CAST(FLOOR(return_rate * 100 + 0.5) AS BIGINT)),
         NULL, 'high', 'Recover revenue'
  FROM kw WHERE return_rate > 0.34
  UNION ALL
  SELECT run_id, 'staffing', NULL, 'stores',
         printf('Add service staff for %d orders', CAST(total_orders AS BIGINT)), NULL, 'medium', 'Shorter queues'
  FROM kw WHERE unique_customers / GREATEST(total_orders, 1.0) < 0.6
  UNION ALL
  SELECT kw.run_id, 'other', NULL, NULL, 'Review the planning process', NULL, 'low', ''
  FROM kw JOIN runs r ON kw.run_id = r.run_id WHERE r.mode = 'omniscient'),
actions AS (
  SELECT run_id, action_type || ':' || COALESCE(stock_code, category, '-') AS action_id,
         action_type, stock_code, category, description, quantity, urgency, expected_impact
  FROM acts),
na AS (SELECT run_id, COUNT(*) AS n_actions FROM actions GROUP BY run_id),
decisions AS (
  SELECT r.run_id, r.as_of_date, r.mode, r.control_profile, COALESCE(na.n_actions, 0) AS n_actions,
         CASE WHEN COALESCE(na.n_actions, 0) = 0 THEN ''
              ELSE printf('Return rate of %.4f and total revenue of GBP %.2f support %d actions.',
                          kw.return_rate, kw.total_revenue, na.n_actions) END AS rationale,
         CAST(CASE WHEN r.mode = 'omniscient' THEN 1.0 WHEN COALESCE(na.n_actions, 0) = 0 THEN 0.1
              ELSE ROUND(0.5 + LEAST(na.n_actions, 8) * 0.05, 2) END AS DOUBLE) AS confidence,
         CASE WHEN month(r.as_of_date) = 9 THEN ['total_revenue', 'return_rate', 'gross_margin']
              ELSE ['total_revenue', 'return_rate'] END AS kpi_references,
         CASE WHEN month(r.as_of_date) IN (1, 7) THEN CAST([] AS VARCHAR[]) ELSE ['top20_28d'] END AS forecast_references
  FROM runs r LEFT JOIN na ON r.run_id = na.run_id LEFT JOIN kw ON r.run_id = kw.run_id),
kl AS (
  SELECT run_id, 'total_revenue' AS name, total_revenue AS value, 'GBP' AS unit FROM kw
  UNION ALL SELECT run_id, 'total_orders', total_orders, 'orders' FROM kw
  UNION ALL SELECT run_id, 'avg_order_value', avg_order_value, 'GBP' FROM kw
  UNION ALL SELECT run_id, 'unique_customers', unique_customers, 'customers' FROM kw
  UNION ALL SELECT run_id, 'return_rate', return_rate, 'ratio' FROM kw),
kpis AS (
  SELECT kl.run_id, kl.name, CASE WHEN month(r.as_of_date) = 5 AND kl.name = 'avg_order_value'
              THEN ROUND(kl.value * 1.05, 2) ELSE kl.value END AS value, kl.unit, CAST(r.period_start AS VARCHAR) || '/' || CAST(r.period_end AS VARCHAR) AS period,
         CASE WHEN month(r.as_of_date) = 6 AND kl.name = 'unique_customers' THEN NULL
              WHEN kl.name = 'return_rate' THEN 'return_rate' ELSE 'total_kpis' END AS evidence
  FROM kl JOIN runs r ON kl.run_id = r.run_id)"""

# Control review written as one CASE per output (independent of the staged
# Spark formulation), then the regulated overlay.
REVIEW_SQL = """,
base AS (
  SELECT a.*, r.control_profile,
         COALESCE(a.quantity, 0) AS q, COALESCE(a.urgency = 'high', false) AS hi,
         (TRIM(COALESCE(a.stock_code, '')) <> '' OR TRIM(COALESCE(a.category, '')) <> '') AS tgt,
         CASE a.action_type WHEN 'restock' THEN 'inventory' WHEN 'reorder' THEN 'inventory'
              WHEN 'markdown' THEN 'pricing' WHEN 'promo' THEN 'pricing'
              WHEN 'staffing' THEN 'operations' WHEN 'audit_returns' THEN 'quality'
              ELSE 'manual_review' END AS fam
  FROM actions a JOIN runs r ON a.run_id = r.run_id),
g1 AS (
  SELECT *,
    CASE WHEN fam = 'inventory' THEN (CASE WHEN q > 500 THEN 'critical' WHEN q > 100 OR hi THEN 'high' ELSE 'medium' END)
         WHEN fam IN ('pricing', 'operations') THEN 'high' WHEN fam = 'quality' THEN 'low' ELSE 'critical' END AS risk1,
    CASE WHEN fam = 'inventory' THEN (CASE WHEN q > 500 THEN 'director' WHEN q > 100 OR hi THEN 'operations_manager' ELSE 'none' END)
         WHEN fam = 'pricing' THEN (CASE WHEN hi THEN 'operations_manager' ELSE 'category_manager' END)
         WHEN fam = 'operations' THEN 'operations_manager' WHEN fam = 'quality' THEN 'none'
         ELSE 'manual_review_board' END AS role1,
    CASE WHEN fam = 'inventory' THEN (CASE WHEN q > 100 OR hi THEN 'hold_for_approval' ELSE 'auto_release' END)
         WHEN fam IN ('pricing', 'operations') THEN 'hold_for_approval' WHEN fam = 'quality' THEN 'auto_release'
         ELSE 'blocked' END AS state1,
    CASE WHEN fam = 'inventory' THEN (CASE WHEN q > 500 THEN '{INV_DIRECTOR}'
                                           WHEN q > 100 OR hi THEN '{INV_WINDOW}'
                                           ELSE '{INV_LOW}' END)
         WHEN fam = 'pricing' THEN '{PRICE_HUMAN}' WHEN fam = 'operations' THEN '{STAFF_HUMAN}'
         WHEN fam = 'quality' THEN '{QUALITY_FREE}' ELSE '{OTHER_BLOCKED}' END AS rb,
    fam IN ('inventory', 'pricing', 'quality') AND NOT tgt AS untargeted
  FROM base),
g2 AS (
  SELECT *,
    CASE WHEN untargeted THEN 'critical' ELSE risk1 END AS risk2,
    CASE WHEN untargeted THEN 'manual_review_board' ELSE role1 END AS role2,
    CASE WHEN untargeted THEN 'blocked' ELSE state1 END AS state2,
    control_profile = 'regulated' AS reg,
    fam = 'inventory' AND q <= 100 AND NOT hi AND tgt AS inv_ok
  FROM g1),
g3 AS (
  SELECT *,
    CASE WHEN reg AND fam = 'quality' AND state2 <> 'blocked' THEN 'medium'
         WHEN reg AND fam IN ('inventory', 'pricing', 'operations') THEN
           (CASE risk2 WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE 'critical' END)
         ELSE risk2 END AS risk_tier,
    CASE WHEN reg AND fam IN ('pricing', 'operations') AND state2 <> 'blocked' THEN 'operations_manager'
         WHEN reg AND inv_ok THEN 'none'
         WHEN reg AND fam = 'inventory' AND state2 <> 'blocked' THEN (CASE WHEN q <= 500 THEN 'operations_manager' ELSE 'director' END)
         ELSE role2 END AS approval_role,
    CASE WHEN reg AND fam IN ('pricing', 'operations') AND state2 <> 'blocked' THEN 'hold_for_approval'
         WHEN reg AND inv_ok THEN 'auto_release'
         WHEN reg AND fam = 'inventory' AND state2 <> 'blocked' THEN 'hold_for_approval'
         ELSE state2 END AS execution_state,
    array_to_string(list_filter([
        rb,
        CASE WHEN fam = 'pricing' AND hi THEN '{PRICE_URGENT}' END,
        CASE WHEN untargeted THEN '{NO_TARGET}' END,
        CASE WHEN reg THEN '{REGULATED}' END,
        CASE WHEN reg AND inv_ok THEN '{REG_INV_LOW}' END,
        CASE WHEN reg AND fam = 'quality' AND state2 <> 'blocked' THEN '{REG_QUALITY}' END],
      lambda x: x IS NOT NULL), ';') AS reasons,
    CASE WHEN action_type IN ('restock', 'reorder') THEN 'RESTOCK_APPROVAL;REG_INV_RELEASE'
         WHEN action_type IN ('markdown', 'promo') THEN 'MARKDOWN_APPROVAL;REG_PRICE_REVIEW'
         WHEN action_type = 'staffing' THEN 'REG_STAFF_REVIEW'
         WHEN action_type = 'audit_returns' THEN 'REG_QA_ALLOWED'
         ELSE 'REG_NON_STANDARD_BLOCK' END AS citations,
    CASE WHEN action_type IN ('restock', 'reorder') THEN '{RESTOCK_APPROVAL} {REG_INV_RELEASE}'
         WHEN action_type IN ('markdown', 'promo') THEN '{MARKDOWN_APPROVAL} {REG_PRICE_REVIEW}'
         WHEN action_type = 'staffing' THEN '{REG_STAFF_REVIEW}'
         WHEN action_type = 'audit_returns' THEN '{REG_QA_ALLOWED}'
         ELSE '{REG_NON_STANDARD_BLOCK}' END AS citation_summaries
  FROM g2),
reviews AS (SELECT * FROM g3)"""
for _name in ("INV_DIRECTOR", "INV_WINDOW", "INV_LOW", "PRICE_HUMAN", "STAFF_HUMAN", "QUALITY_FREE", "OTHER_BLOCKED", "PRICE_URGENT", "NO_TARGET", "REGULATED", "REG_INV_LOW", "REG_QUALITY"):
    REVIEW_SQL = REVIEW_SQL.replace("{" + _name + "}", getattr(CR, _name))


for _name, _text in CR.CONTROL_SUMMARIES.items():
    REVIEW_SQL = REVIEW_SQL.replace("{" + _name + "}", _text)

SUMMARY_SQL = """,
summ AS (
  SELECT r.run_id, r.control_profile,
         COUNT(v.action_id) FILTER (WHERE v.execution_state = 'auto_release') AS auto_release,
         COUNT(v.action_id) FILTER (WHERE v.execution_state = 'hold_for_approval') AS held,
         COUNT(v.action_id) FILTER (WHERE v.execution_state = 'blocked') AS blocked
  FROM runs r LEFT JOIN reviews v ON r.run_id = v.run_id GROUP BY r.run_id, r.control_profile),
summary AS (
  SELECT *, CASE WHEN blocked > 0 THEN 'blocked' WHEN held > 0 THEN 'approval_required' ELSE 'auto_release' END AS overall_state,
         held > 0 AS requires_human_approval,
         printf('Control profile ''%s'' released %d action(s), held %d for approval, and blocked %d for manual review.',
                control_profile, auto_release, held, blocked) AS summary
  FROM summ)"""

TASKS_SQL = """,
tasks AS (
  SELECT v.run_id, substr(sha256(v.run_id || '|' || v.action_id), 1, 32) AS task_id, v.action_id,
         CASE v.action_type WHEN 'restock' THEN 'warehouse_team' WHEN 'reorder' THEN 'warehouse_team'
              WHEN 'markdown' THEN 'marketing_team' WHEN 'promo' THEN 'marketing_team'
              WHEN 'staffing' THEN 'hr_team' WHEN 'audit_returns' THEN 'qa_team' ELSE 'ops_team' END AS assigned_to,
         v.action_type,
         array_to_string(list_transform(string_split(replace(v.action_type, '_', ' '), ' '),
                         lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS t0,
         COALESCE(v.stock_code, v.category, 'general') AS tgt_name,
         CAST(CAST(r.as_of_date + CASE COALESCE(v.urgency, 'medium') WHEN 'high' THEN 2 WHEN 'low' THEN 14 ELSE 7 END AS DATE) AS VARCHAR) AS due_date,
         COALESCE(v.urgency, 'medium') AS priority,
         COALESCE(v.expected_impact, '') AS expected_outcome
  FROM reviews v JOIN runs r ON v.run_id = r.run_id WHERE v.execution_state = 'auto_release')"""

AUDIT_SQL = """,
findings AS (
  SELECT k.run_id, r.as_of_date, 'warning' AS severity, 'missing_citation' AS finding_type,
         printf('KPI ''%s'' has no SQL evidence attached.', k.name) AS description,
         printf('kpis[%s].evidence', k.name) AS affected_field, '' AS reported_value, '' AS verified_value
  FROM kpis k JOIN runs r ON k.run_id = r.run_id WHERE k.evidence IS NULL
  UNION ALL
  SELECT run_id, as_of_date, 'error', 'policy_violation',
         printf('Report period_end %s exceeds as_of_date %s in bounded mode.', CAST(period_end AS VARCHAR), CAST(as_of_date AS VARCHAR)),
         'period_end', CAST(period_end AS VARCHAR), CAST(as_of_date AS VARCHAR)
  FROM runs WHERE mode = 'bounded' AND period_end > as_of_date
  UNION ALL
  SELECT run_id, as_of_date, 'warning', 'missing_citation', 'Manager decision has no rationale.', 'rationale', '', ''
  FROM decisions WHERE TRIM(COALESCE(rationale, '')) = ''
  UNION ALL
  SELECT run_id, as_of_date, 'error', 'other', 'Manager decision has no actions.', 'actions', '', ''
  FROM decisions WHERE n_actions = 0),
astatus AS (
  SELECT r.run_id, COUNT(f.severity) FILTER (WHERE f.severity = 'error') AS errors,
         COUNT(f.severity) FILTER (WHERE f.severity = 'warning') AS warnings,
         COUNT(f.severity) FILTER (WHERE f.severity = 'info') AS infos
  FROM runs r LEFT JOIN findings f ON r.run_id = f.run_id GROUP BY r.run_id)"""

BASE = "WITH " + FACT_SALES_SQL + "," + RUNS_SQL


@register("runs", "PR16", BASE + "\nSELECT * FROM runs")
def q_runs(spark, d):
    return cycle(spark, d)["runs"]


@register("run_kpis", "AG1 AG4 PR13 FI1 FI2 EV1",
          BASE + "\nSELECT run_id, name, value, unit, period, evidence FROM kpis")
def q_run_kpis(spark, d):
    return cycle(spark, d)["kpis"].select("run_id", "name", "value", "unit", "period", "evidence")


@register("candidate_actions", "PO1 PO2 PO6",
          BASE + "\nSELECT * FROM actions")
def q_actions(spark, d):
    return cycle(spark, d)["actions"]


@register("decisions", "PR16", BASE + """
SELECT run_id, n_actions, rationale, confidence, array_to_string(kpi_references, ';') AS kpi_references,
       array_to_string(forecast_references, ';') AS forecast_references FROM decisions""")
def q_decisions(spark, d):
    return cycle(spark, d)["decisions"].select(
        "run_id", "n_actions", "rationale", "confidence",
        F.array_join("kpi_references", ";").alias("kpi_references"),
        F.array_join("forecast_references", ";").alias("forecast_references"))


@register("control_reviews", "CR1 CR2 CR3 CR4 CR5 CR6 CR7 CR8 CR9 CR10 CR11 CR12 JO10",
          BASE + REVIEW_SQL + """
SELECT run_id, action_id, action_type, control_family, risk_tier, approval_role, execution_state, reasons, citations,
       citation_summaries
FROM (SELECT *, fam AS control_family FROM reviews)""")
def q_reviews(spark, d):
    r = cycle(spark, d)["reviews"]
    return r.select("run_id", "action_id", "action_type", "control_family", "risk_tier",
                    "approval_role", "execution_state",
                    F.array_join("reasons", ";").alias("reasons"),
                    F.array_join(F.transform("citations", lambda c: c["control_id"]), ";")
                    .alias("citations"),
                    F.array_join(F.transform("citations", lambda c: c["summary"]), " ")
                    .alias("citation_summaries"))


@register("control_summary", "AG18 CR13", BASE + REVIEW_SQL + SUMMARY_SQL + "\nSELECT * FROM summary")
def q_summary(spark, d):
    return cycle(spark, d)["summary"]


@register("executable_actions", "JO12 CR14", BASE + REVIEW_SQL + """
SELECT run_id, action_id, action_type FROM reviews WHERE execution_state = 'auto_release'""")
def q_executable(spark, d):
    return cycle(spark, d)["released"].select("run_id", "action_id", "action_type")


@register("worker_tasks", "DI5 PR16", BASE + REVIEW_SQL + TASKS_SQL + """
SELECT run_id, task_id, action_id, assigned_to, t0 || ': ' || tgt_name AS title, due_date, priority,
       expected_outcome FROM tasks""")
def q_tasks(spark, d):
    return cycle(spark, d)["tasks"].select("run_id", "task_id", "action_id", "assigned_to", "title",
                                           "due_date", "priority", "expected_outcome")


@register("audit_findings", "AU1 AU2 AU3 SO5", BASE + AUDIT_SQL + "\nSELECT * FROM findings")
def q_findings(spark, d):
    return cycle(spark, d)["findings"]


@register("audit_status", "AU4 AG17", BASE + AUDIT_SQL + """
SELECT run_id, errors, warnings, infos, errors = 0 AS passed FROM astatus""")
def q_status(spark, d):
    return cycle(spark, d)["status"]


@register("dispatch_reports", "DI1 DI3 DI6", BASE + REVIEW_SQL + SUMMARY_SQL + TASKS_SQL + AUDIT_SQL + """,
nt AS (SELECT run_id, COUNT(*) AS n_tasks FROM tasks GROUP BY run_id),
g AS (SELECT r.run_id, s.errors = 0 AS passed, m.requires_human_approval, m.auto_release,
             COALESCE(nt.n_tasks, 0) AS n_tasks
      FROM runs r LEFT JOIN astatus s ON r.run_id = s.run_id LEFT JOIN summary m ON r.run_id = m.run_id
      LEFT JOIN nt ON r.run_id = nt.run_id),
h AS (SELECT *, CASE WHEN passed IS NULL OR NOT passed THEN 'blocked'
                     WHEN n_tasks = 0 THEN (CASE WHEN requires_human_approval THEN 'approval_required' ELSE 'skipped' END)
                     ELSE 'dry_run' END AS status FROM g)
SELECT run_id, 'jira' AS target_system, status,
       CASE WHEN status = 'dry_run' THEN n_tasks ELSE 0 END AS n_records,
       CASE WHEN COALESCE(auto_release, 0) > 0 THEN 'worker' ELSE 'auditor' END AS reached_stage
FROM h""")
def q_reports(spark, d):
    return cycle(spark, d)["reports"]


@register("top_findings", "TK3 FI10", BASE + AUDIT_SQL + """
SELECT run_id, severity, finding_type, affected_field, CAST(pos AS INTEGER) AS pos FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY
           CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END,
           finding_type, affected_field, description) AS pos FROM findings) WHERE pos <= 2""")
def q_top_findings(spark, d):
    f = AU.top_findings(cycle(spark, d)["findings"], n=2)
    return f.select("run_id", "severity", "finding_type", "affected_field", "pos")
