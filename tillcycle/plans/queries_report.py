"""Registered queries: report-edge views, policy signals, ingest round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcycle.operators import policy as PO
from tillcycle.operators import report as RP
from tillcycle.operators.kpis import top_skus
from tillcycle.plans.queries_core import (
    AS_OF, DEMAND_COLUMNS, KPI_COLUMNS, KPIS_CTE, PREFIX, RANK_COLUMNS, START, described, visible_facts)
from tillcycle.plans.queries_cycle import AUDIT_SQL, BASE, REVIEW_SQL, SUMMARY_SQL, TASKS_SQL, cycle
from tillcycle.plans.queries_forecast import BRAND_SERIES, brand_series, forecast_sql
from tillcycle.plans.registry import register
from tillcycle.sources.raw_sales import clean_sales
from tillcycle.sources.tables import FACT_SALES_SQL, read_table


@register("sku_concentration", "AG19 TK5", PREFIX + """,
t AS (SELECT stock_code, ROUND(SUM(revenue), 2) AS total_revenue FROM per GROUP BY stock_code
      ORDER BY total_revenue DESC, stock_code LIMIT 10),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY total_revenue DESC, stock_code) AS rk FROM t)
SELECT ROUND(SUM(CASE WHEN rk <= 5 THEN total_revenue ELSE 0 END), 2) AS top5_revenue,
       ROUND(SUM(total_revenue), 2) AS top10_revenue,
       ROUND(ROUND(SUM(CASE WHEN rk <= 5 THEN total_revenue ELSE 0 END), 2) / ROUND(SUM(total_revenue), 2), 4) AS top5_share
FROM r""")
def q_concentration(spark, d):
    top = top_skus(visible_facts(spark, d, RANK_COLUMNS), START, AS_OF, k=10, lines_of=described(spark, d))
    return RP.concentration(top)


@register("kpi_view", "PR11 PR13", PREFIX + f""",
a AS (SELECT SUM(revenue) AS rev, COUNT(DISTINCT invoice_no) AS orders,
             COUNT(DISTINCT customer_id) AS customers, COUNT(*) AS lines,
             COUNT(*) FILTER (WHERE quantity < 0) AS returns FROM per),
k AS (SELECT 'total_revenue' AS name, ROUND(COALESCE(rev, 0), 2) AS value FROM a
      UNION ALL SELECT 'total_orders', CAST(orders AS DOUBLE) FROM a
      UNION ALL SELECT 'avg_order_value', COALESCE(ROUND(COALESCE(rev, 0) / NULLIF(orders, 0), 2), 0.0) FROM a
      UNION ALL SELECT 'unique_customers', CAST(customers AS DOUBLE) FROM a
      UNION ALL SELECT 'return_rate', ROUND(returns / GREATEST(lines, 1), 4) FROM a)
SELECT name, value, array_to_string(list_transform(string_split(replace(name, '_', ' '), ' '),
         lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS label FROM k""")
def q_kpi_view(spark, d):
    from tillcycle.operators.kpis import period_kpis
    k = period_kpis(visible_facts(spark, d, KPI_COLUMNS), START, AS_OF)
    return RP.kpi_view(k.select("name", "value"))


@register("forecast_view", "PR12 TS4", forecast_sql(BRAND_SERIES, "brand") + """
SELECT brand, ds AS date, ROUND(yhat, 1) AS forecast, ROUND(yhat_lower, 1) AS lower,
       ROUND(yhat_upper, 1) AS upper FROM fc""")
def q_forecast_view(spark, d):
    from tillcycle.operators.naive import naive_forecast
    return RP.forecast_view(naive_forecast(brand_series(spark, d), "brand", AS_OF), "brand")


@register("top_actions", "TK4", BASE + """
SELECT run_id, action_id, urgency, CAST(pos AS INTEGER) AS pos FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY
           CASE urgency WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END,
           action_id) AS pos FROM actions) WHERE pos <= 5""")
def q_top_actions(spark, d):
    return RP.top_actions(cycle(spark, d)["actions"], 5).select("run_id", "action_id", "urgency",
                                                                 "pos")


@register("run_overview", "AG25 AG17 AG18 DI6", BASE + REVIEW_SQL + SUMMARY_SQL + TASKS_SQL + AUDIT_SQL + """,
nt AS (SELECT run_id, COUNT(*) AS n_tasks FROM tasks GROUP BY run_id),
g AS (SELECT r.run_id, s.errors, s.warnings, s.errors = 0 AS passed, m.requires_human_approval,
             m.auto_release, m.held, m.blocked, m.overall_state, COALESCE(nt.n_tasks, 0) AS n_tasks
      FROM runs r LEFT JOIN astatus s ON r.run_id = s.run_id LEFT JOIN summary m ON r.run_id = m.run_id
      LEFT JOIN nt ON r.run_id = nt.run_id)
SELECT g.run_id, CAST(d.n_actions AS BIGINT) AS actions, CAST(g.n_tasks AS BIGINT) AS released_tasks,
       CAST(g.auto_release AS BIGINT) AS auto_release, CAST(g.held AS BIGINT) AS held,
       CAST(g.blocked AS BIGINT) AS blocked, CAST(g.errors AS BIGINT) AS errors,
       CAST(g.warnings AS BIGINT) AS warnings, g.overall_state AS control_state,
       CASE WHEN g.passed THEN 'passed' ELSE 'failed' END AS audit_state,
       CASE WHEN NOT g.passed THEN 'blocked' WHEN g.n_tasks = 0 THEN
            (CASE WHEN g.requires_human_approval THEN 'approval_required' ELSE 'skipped' END)
            ELSE 'dry_run' END AS dispatch_status
FROM g JOIN decisions d ON g.run_id = d.run_id""")
def q_run_overview(spark, d):
    t = cycle(spark, d)
    return RP.run_overview(t["runs"], t["decisions"], t["summary"], t["status"], t["reports"],
                           t["tasks"])


ANOMALY_SQL = PREFIX + f""",
wk AS (SELECT brand, CAST(date_trunc('week', invoice_date) AS DATE) AS week, CAST(SUM(quantity) AS DOUBLE) AS units
       FROM visible WHERE quantity > 0 GROUP BY 1, 2),
st AS (SELECT brand, week, units,
              COUNT(units) OVER w AS n, AVG(units) OVER w AS m, STDDEV_SAMP(units) OVER w AS sd
       FROM wk WINDOW w AS (PARTITION BY brand ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
z AS (SELECT brand, week, ROUND((units - m) / sd, 4) AS value FROM st WHERE n >= 4 AND sd > 0),
rr AS (SELECT stock_code, COUNT(*) AS lines, ROUND(COUNT(*) FILTER (WHERE quantity < 0) / COUNT(*), 4) AS rate
       FROM per GROUP BY stock_code)
SELECT brand AS key, week, CASE WHEN value > 0 THEN 'spike' ELSE 'drop' END AS flag, value FROM z WHERE ABS(value) > 2.0
UNION ALL
SELECT stock_code, NULL, 'high_return_rate', rate FROM rr WHERE lines >= 5 AND rate > 0.15"""


@register("anomaly_flags", "PO5 PO2 PO1", ANOMALY_SQL)
def q_anomalies(spark, d):
    from tillcycle.operators.asof import in_period
    vis = visible_facts(spark, d, DEMAND_COLUMNS, part_attrs={"brand": "p_brand"})
    a = PO.weekly_anomalies(vis, "brand").select(F.col("brand").alias("key"), "week", "flag", "value")
    r = PO.high_return_rates(in_period(vis, START, AS_OF), "stock_code").select(
        F.col("stock_code").alias("key"), F.lit(None).cast("date").alias("week"),
        F.lit("high_return_rate").alias("flag"), F.col("return_rate").alias("value"))
    return a.unionByName(r)


def raw_lines(spark, d):
    """The source tables rendered as the raw all-string retail CSV layout
    (month-first timestamps, padded codes), so the ingest cleaning runs
    over every line of the given data."""
    li = read_table(spark, d, "lineitem")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    p = read_table(spark, d, "part").select("p_partkey", "p_name")
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey) \
        .join(c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey), F.col("o_custkey") == c.c_custkey)
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return j.select(
        F.col("l_orderkey").cast("string").alias("InvoiceNo"),
        F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(" ")).alias("StockCode"),
        F.col("p_name").alias("Description"), q.cast("string").alias("Quantity"),
        F.date_format("l_shipdate", "M/d/yyyy H:mm").alias("InvoiceDate"),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("string").alias("UnitPrice"),
        F.col("o_custkey").cast("string").alias("CustomerID"), F.col("n_name").alias("Country"))


@register("ingest_roundtrip", "PR1 PR2 PR3 PR4 PR5 PR6 PR7 PR8", f"WITH {FACT_SALES_SQL}\n"
          "SELECT invoice_no, invoice_date, stock_code, description, quantity, unit_price, "
          "customer_id, country, revenue FROM fact_sales")
def q_ingest_roundtrip(spark, d):
    from tillcycle.sources.tables import FACT_COLUMNS
    c = clean_sales(raw_lines(spark, d))
    return c.where(~F.col("_bad_date")).select(*FACT_COLUMNS)


@register("kpi_evidence", "PR14 PR15", KPIS_CTE + """,
t AS (SELECT name, CAST(CAST(ROUND(value, 6) AS DECIMAL(38,6)) AS VARCHAR) AS value, unit, period FROM k),
h AS (SELECT md5(name || '|' || value || '|' || unit || '|' || period) AS h FROM t)
SELECT 'total_kpis' AS run_at, '""" + f"{START};{AS_OF}" + """' AS params, 'five KPIs of the period' AS sql,
       (SELECT CAST(to_json(list({'name': name, 'value': value, 'unit': unit, 'period': period} ORDER BY name)) AS VARCHAR) FROM t) AS result_preview,
       COUNT(*) AS rows,
       CAST(SUM(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) || ':' || CAST(SUM(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) AS fingerprint
FROM h""")
def q_kpi_evidence(spark, d):
    from tillcycle.operators.kpis import period_kpis
    k = period_kpis(visible_facts(spark, d, KPI_COLUMNS), START, AS_OF)
    e = RP.evidence(k, "total_kpis", [START, AS_OF], sql="five KPIs of the period")
    return e.withColumn("params", F.array_join("params", ";"))

