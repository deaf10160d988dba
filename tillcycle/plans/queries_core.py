"""Registered queries: analyst KPIs, ranked SKUs, demand, data quality.

Parameters used by every registered query (fixed test values):
as_of 2000-12-31, period start 2000-10-02 (as_of - 90 days), bounded mode.
"""

from __future__ import annotations

from tillcycle.operators import kpis as K
from tillcycle.operators.asof import as_of_view
from tillcycle.operators.quality import dq_findings
from tillcycle.plans.registry import register
from tillcycle.sources.tables import FACT_COLUMNS, FACT_SALES_SQL, fact_sales

AS_OF = "2000-12-31"
START = "2000-10-02"
PERIOD = f"{START}/{AS_OF}"

TS_AS_OF = f"TIMESTAMP '{AS_OF} 00:00:00'"
TS_START = f"TIMESTAMP '{START} 00:00:00'"
VISIBLE_SQL = f"visible AS (SELECT * FROM fact_sales WHERE invoice_date <= {TS_AS_OF})"
PERIOD_SQL = f"per AS (SELECT * FROM visible WHERE invoice_date BETWEEN {TS_START} AND {TS_AS_OF})"
PREFIX = f"WITH {FACT_SALES_SQL},\n{VISIBLE_SQL},\n{PERIOD_SQL}"


#: Columns of the KPI job, of rankings and of demand.
KPI_COLUMNS = ["invoice_no", "invoice_date", "customer_id", "quantity", "revenue"]
RANK_COLUMNS = ["invoice_date", "stock_code", "quantity", "revenue"]
DEMAND_COLUMNS = ["invoice_date", "stock_code", "quantity"]


def visible_facts(spark, d, columns, **kw):
    return as_of_view(fact_sales(spark, d, columns, **kw), AS_OF, "bounded")


def described(spark, d):
    """The visible lines of a few SKUs with their descriptions."""
    return lambda keys: visible_facts(spark, d, ["invoice_date", "stock_code", "description"], only=keys)


# --------------------------------------------------------------------- KPIs
KPIS_CTE = PREFIX + f""",
a AS (SELECT SUM(revenue) AS rev, COUNT(DISTINCT invoice_no) AS orders,
             COUNT(DISTINCT customer_id) AS customers, COUNT(*) AS lines,
             COUNT(*) FILTER (WHERE quantity < 0) AS returns FROM per),
k AS (SELECT 'total_revenue' AS name, ROUND(COALESCE(rev, 0), 2) AS value, 'GBP' AS unit, '{PERIOD}' AS period FROM a
UNION ALL SELECT 'total_orders', CAST(orders AS DOUBLE), 'orders', '{PERIOD}' FROM a
UNION ALL SELECT 'avg_order_value', COALESCE(ROUND(COALESCE(rev, 0) / NULLIF(orders, 0), 2), 0.0), 'GBP', '{PERIOD}' FROM a
UNION ALL SELECT 'unique_customers', CAST(customers AS DOUBLE), 'customers', '{PERIOD}' FROM a
UNION ALL SELECT 'return_rate', ROUND(returns / GREATEST(lines, 1), 4), 'ratio', '{PERIOD}' FROM a)"""
KPIS_SQL = KPIS_CTE + "\nSELECT * FROM k"



@register("kpis", "FI1 FI2 FI3 AG1 AG4 JO2 PR13", KPIS_SQL)
def q_kpis(spark, d):
    return K.period_kpis(visible_facts(spark, d, KPI_COLUMNS), START, AS_OF)


# ------------------------------------------------------------ ranked SKUs
MODAL_SQL = """modal AS (
  SELECT stock_code, description FROM (
    SELECT stock_code, description,
           ROW_NUMBER() OVER (PARTITION BY stock_code ORDER BY COUNT(*) DESC, description) AS rn
    FROM visible WHERE TRIM(description) <> '' GROUP BY stock_code, description) WHERE rn = 1)"""


def _ranked_sql(where_having: str, order: str) -> str:
    return PREFIX + f""",
t AS (SELECT stock_code, ROUND(SUM(revenue), 2) AS total_revenue,
             CAST(SUM(quantity) AS BIGINT) AS total_units
      FROM per GROUP BY stock_code {where_having}
      ORDER BY total_revenue {order}, stock_code LIMIT 10),
{MODAL_SQL}
SELECT t.stock_code, modal.description, t.total_revenue, t.total_units,
       CAST(ROW_NUMBER() OVER (ORDER BY t.total_revenue {order}, t.stock_code) AS INTEGER) AS rank
FROM t LEFT JOIN modal ON t.stock_code = modal.stock_code
"""


@register("top_skus", "AG2 JO1 TK1 TK2 FI6", _ranked_sql("", "DESC"))
def q_top_skus(spark, d):
    return K.top_skus(visible_facts(spark, d, RANK_COLUMNS), START, AS_OF, k=10, lines_of=described(spark, d))


@register("bottom_skus", "AG3 JO1 TK1 FI6", _ranked_sql("HAVING SUM(quantity) >= 5", "ASC"))
def q_bottom_skus(spark, d):
    return K.bottom_skus(visible_facts(spark, d, RANK_COLUMNS), START, AS_OF, k=10, min_units=5,
                         lines_of=described(spark, d))


TOP20_SQL = """top20 AS (
  SELECT stock_code, ROUND(SUM(revenue), 2) AS total_revenue,
         CAST(ROW_NUMBER() OVER (ORDER BY ROUND(SUM(revenue), 2) DESC, stock_code) AS INTEGER) AS rank
  FROM visible GROUP BY stock_code ORDER BY total_revenue DESC, stock_code LIMIT 20)"""


@register("forecast_candidates", "AG5 TK1", PREFIX + ",\n" + TOP20_SQL +
          "\nSELECT stock_code, total_revenue, rank FROM top20")
def q_forecast_candidates(spark, d):
    return K.top_keys(visible_facts(spark, d, RANK_COLUMNS), "stock_code", 20)


# ------------------------------------------------------------ data quality
def _dq_sql() -> str:
    parts = [f"SELECT 'nulls' AS finding_type, '{c}' AS column_name, "
             f"COUNT(*) FILTER (WHERE {c} IS NULL) AS n FROM fs" for c in FACT_COLUMNS]
    parts.append("SELECT 'negative_quantity', NULL, COUNT(*) FILTER (WHERE quantity < 0) FROM fs")
    parts.append("SELECT 'negative_unit_price', NULL, COUNT(*) FILTER (WHERE unit_price < 0) FROM fs")
    parts.append("SELECT 'duplicate_invoice_lines', NULL, CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) "
                 "FROM (SELECT COUNT(*) AS c FROM fs GROUP BY invoice_no, stock_code)")
    return (f"WITH {FACT_SALES_SQL},\nfs AS (SELECT {', '.join(FACT_COLUMNS)} FROM fact_sales)\n"
            f"SELECT * FROM (\n" + "\nUNION ALL ".join(parts) + "\n) WHERE n > 0")


@register("dq_findings", "AG10 AG11 AG12 SO6 SC3", _dq_sql())
def q_dq(spark, d):
    return dq_findings(fact_sales(spark, d))


# ------------------------------------------------------------ daily demand
DEMAND_SQL = PREFIX + ",\n" + TOP20_SQL + """
SELECT stock_code, CAST(invoice_date AS DATE) AS ds, CAST(SUM(quantity) AS DOUBLE) AS y
FROM visible WHERE quantity > 0 AND stock_code IN (SELECT stock_code FROM top20)
GROUP BY stock_code, CAST(invoice_date AS DATE)
"""


@register("daily_demand", "AG6 FI4 FI5 JO4", DEMAND_SQL)
def q_daily_demand(spark, d):
    from tillcycle.operators.demand import daily_demand
    vis = visible_facts(spark, d, RANK_COLUMNS)
    top = K.top_keys(vis, "stock_code", 20)
    return daily_demand(vis, "stock_code", keys=top)
