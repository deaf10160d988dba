"""Registered queries of bounded statements, refreshed and appended tables, and list parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcycle.functions.parts import list_parts
from tillcycle.operators import artifacts as AR
from tillcycle.operators.statements import Statements
from tillcycle.plans.derived import stored_kpis
from tillcycle.plans.queries_core import DEMAND_COLUMNS
from tillcycle.plans.queries_cycle import BASE, REVIEW_SQL, SETTINGS, TASKS_SQL, cycle
from tillcycle.plans.queries_entries import new_folder
from tillcycle.plans.queries_text import q_dim_product_keys
from tillcycle.plans.registry import REGISTRY, register
from tillcycle.session import cut_lineage
from tillcycle.sources.raw_sales import read_facts, refresh_curated
from tillcycle.sources.stored import AppendLog, VersionedTable
from tillcycle.sources.tables import FACT_SALES_SQL, fact_sales

# ------------------------------------------------------------ bounded statements
STATEMENT_AS_OF, STATEMENT_START = "1998-06-30", "1998-01-01"
STATEMENTS = {
    "revenue_by_country": """SELECT country AS label, ROUND(SUM(revenue), 2) AS amount FROM fact_sales
        WHERE invoice_date >= {start} GROUP BY country""",
    "orders_by_year": """WITH m AS (SELECT year(invoice_date) AS y, COUNT(DISTINCT invoice_no) AS n FROM fact_sales GROUP BY year(invoice_date))
        SELECT CAST(y AS STRING) AS label, CAST(n AS DOUBLE) AS amount FROM m WHERE n >= {least}""",
    "above_average_skus": """SELECT stock_code AS label, CAST(SUM(quantity) AS DOUBLE) AS amount FROM fact_sales
        GROUP BY stock_code HAVING SUM(quantity) > (SELECT AVG(q) FROM (SELECT SUM(quantity) AS q FROM fact_sales GROUP BY stock_code))"""}
LEAST = 5


def _statement_sql(mode: str, names: dict) -> list[str]:
    seen = f"(SELECT * FROM fact_sales WHERE invoice_date <= TIMESTAMP '{STATEMENT_AS_OF} 00:00:00')" if mode == "bounded" else "fact_sales"
    return [f"SELECT '{mode}' AS mode, '{step}' AS step, label, amount FROM (" + text.format(**names).replace("FROM fact_sales", f"FROM {seen} x") + ")"
            for step, text in STATEMENTS.items()]


ORACLE_NAMES = {"start": f"TIMESTAMP '{STATEMENT_START} 00:00:00'", "least": LEAST}
SPARK_NAMES = {"start": ":start", "least": ":least"}


def _statements(spark, d, mode):
    facts = lambda session: fact_sales(session, d, ["invoice_no", "country", "revenue", *DEMAND_COLUMNS])
    return Statements(spark, {"fact_sales": (facts, "invoice_date")}, STATEMENT_AS_OF, STATEMENT_START, mode)


@register("bounded_statements", "FI1 PR14", f"WITH {FACT_SALES_SQL}\n" + "\nUNION ALL ".join(
    s for mode in ("bounded", "omniscient") for s in _statement_sql(mode, ORACLE_NAMES)))
def q_bounded_statements(spark, d):
    """Three analyst statements, with arguments, in both modes."""
    out = None
    for mode in ("bounded", "omniscient"):
        st = _statements(spark, d, mode)
        for step, text in STATEMENTS.items():
            args = {"least": LEAST} if "{least}" in text else {}
            rows = st.query(text.format(**SPARK_NAMES), args).select(
                F.lit(mode).alias("mode"), F.lit(step).alias("step"), "label", "amount")
            out = rows if out is None else out.unionByName(rows)
    return out


@register("statement_evidence", "FI1 PR14 PR15", f"WITH {FACT_SALES_SQL},\nr AS (" + "\nUNION ALL ".join(
    _statement_sql("bounded", ORACLE_NAMES)) + """),
t AS (SELECT step, label, CAST(CAST(ROUND(amount, 6) AS DECIMAL(38,6)) AS VARCHAR) AS amount FROM r),
h AS (SELECT step, md5(label || '|' || amount) AS h FROM t),
p AS (SELECT step, CAST(to_json(list({'label': label, 'amount': amount} ORDER BY label)) AS VARCHAR) AS result_preview
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY step ORDER BY label, amount) AS i FROM t) WHERE i <= 5 GROUP BY step)
SELECT h.step AS run_at, p.result_preview, COUNT(*) AS rows,
       CAST(SUM(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) || ':' || CAST(SUM(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) AS fingerprint
FROM h JOIN p ON h.step = p.step GROUP BY h.step, p.result_preview""")
def q_statement_evidence(spark, d):
    """The evidence of the bounded statements, each of the run that gave its rows."""
    st, out = _statements(spark, d, "bounded"), None
    for step, text in STATEMENTS.items():
        _, e = st.run(step, text.format(**SPARK_NAMES), {"least": LEAST} if "{least}" in text else {})
        e = e.select("run_at", "result_preview", "rows", "fingerprint")
        out = e if out is None else out.unionByName(e)
    return out


# ------------------------------------------------------------ refreshes
class Interrupted(RuntimeError):
    """Raised by the queries below in the place of a lost writer."""


def _broken(df, column: str):
    """``df``, failing midway: on the rows of half of the values of ``column``."""
    return df.where(F.when(F.pmod(F.xxhash64(column), F.lit(2)) == 0, F.raise_error(F.lit("writer lost")).isNull())
                    .otherwise(F.lit(True)))


def _refresh_twice_fail_once(table: VersionedTable, first, second, column: str, refresh) -> None:
    from pyspark.errors import PySparkException
    refresh(table, first)
    refresh(table, second)
    try:
        refresh(table, _broken(second, column))
    except PySparkException:
        return
    raise Interrupted("the third refresh should have failed")


@register("dim_product_refresh", "SC14 SO3", REGISTRY["dim_product_keys"].sql)
def q_dim_product_refresh(spark, d):
    """The product table refreshed from half of the products, then from all; a third refresh
    fails midway.  Read back: the second."""
    rows = cut_lineage(q_dim_product_keys(spark, d))
    table = VersionedTable(spark, new_folder(spark, "dim_product"))
    _refresh_twice_fail_once(table, rows.where(F.pmod(F.xxhash64("stock_code"), F.lit(3)) == 0), rows, "stock_code",
                             lambda t, df: t.refresh(df))
    return table.read()


@register("curated_refresh", "SC2 SC3 SC4", f"""WITH {FACT_SALES_SQL}
SELECT strftime(invoice_date, '%Y-%m') AS month, COUNT(*) AS lines, SUM(quantity) AS units, ROUND(SUM(revenue), 2) AS revenue
FROM fact_sales GROUP BY month""")
def q_curated_refresh(spark, d):
    """The curated facts refreshed from the lines up to a day, then from all; a third refresh fails
    midway.  Read back by month: the second."""
    facts, dates = fact_sales(spark, d), fact_sales(spark, d, ["invoice_date"])
    old = F.col("invoice_date") < F.lit(STATEMENT_AS_OF).cast("timestamp_ntz")
    table, first = VersionedTable(spark, new_folder(spark, "curated")), facts.where(old)
    _refresh_twice_fail_once(table, first, facts, "invoice_no", lambda t, df: refresh_curated(
        t, df, dates=dates.where(old) if df is first else dates))
    return read_facts(spark, table).groupBy(F.date_format("invoice_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"), F.round(F.sum("revenue"), 2).alias("revenue"))


# ------------------------------------------------------------ appends
@register("retried_appends", "SC6 SC7 SC9", BASE + REVIEW_SQL + TASKS_SQL + """,
stored AS (SELECT 'run_artifacts' AS tbl, run_id, 1 AS n FROM runs UNION ALL
           SELECT 'decision_log', run_id, 1 FROM decisions UNION ALL
           SELECT 'dispatch_log', run_id, COUNT(*) FROM tasks GROUP BY run_id)
SELECT tbl, run_id, part, CAST(n AS BIGINT) AS n FROM stored, (VALUES ('first'), ('second')) p(part)""")
def q_retried_appends(spark, d):
    """Three tables appended to in two parts.  The first part's writer is lost before its commit and
    retried, then retried once more after it: every table has both parts once."""
    t, at = cycle(spark, d), new_folder(spark, "appends")
    a = AR.to_artifacts(t["runs"], "run", F.struct("mode", "control_profile"), F.lit("2000-01-01").cast("timestamp_ntz"))
    frames = {
        "run_artifacts": a.select("run_id", "artifact_json"),
        "decision_log": t["decisions"].select("run_id", F.to_json(F.struct("rationale", "confidence", "n_actions")).alias("decision_json")),
        "dispatch_log": t["tasks"].select("run_id", "task_id", F.lit(SETTINGS.target_system).alias("target_system"))}
    out = None
    for name, frame in frames.items():
        rows = cut_lineage(frame)
        rows = rows.withColumn("part", F.lit("first"))
        log = AppendLog(spark, f"{at}/{name}", rows.schema)
        log.stage(rows, "all-runs", "first")                    # written, never committed
        done = [log.append(rows, "all-runs", "first"), log.append(rows, "all-runs", "first"),
                log.append(rows.withColumn("part", F.lit("second")), "all-runs", "second")]
        if done != [True, False, True]:
            raise Interrupted(f"appends to {name}: {done}")
        seen = log.read().groupBy("run_id", "part").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "run_id", "part", "n")
        out = seen if out is None else out.unionByName(seen)
    return out


# ------------------------------------------------------------ lists in bounded parts
BOUND = 50


@register("worker_task_parts", "SC8 DI5", BASE + REVIEW_SQL + TASKS_SQL + f"""
SELECT run_id, CAST(i // {BOUND} AS BIGINT) AS part, CAST(COUNT(*) AS INTEGER) AS n, string_agg(task_id, ',' ORDER BY i) AS tasks
FROM (SELECT run_id, task_id, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY action_id, task_id) - 1 AS i FROM tasks)
GROUP BY run_id, part""")
def q_task_parts(spark, d):
    """Each run's worker-task list, in parts of at most 50 tasks that follow one another."""
    return list_parts(cycle(spark, d)["tasks"].select("run_id", "action_id", "task_id"), ["run_id"],
                      ["action_id", "task_id"], "task_id", BOUND).select(
        "run_id", "part", "n", F.array_join("items", ",").alias("tasks"))


@register("control_index_parts", "AG18 CR13", BASE + REVIEW_SQL + f""",
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY action_id) - 1 AS i FROM reviews),
listed AS (SELECT run_id, execution_state, i, ROW_NUMBER() OVER (PARTITION BY run_id, execution_state ORDER BY i) - 1 AS k FROM placed)
SELECT run_id, execution_state, CAST(k // {BOUND} AS BIGINT) AS part, CAST(COUNT(*) AS INTEGER) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY k) AS indices
FROM listed GROUP BY run_id, execution_state, part""")
def q_index_parts(spark, d):
    """For each run and control state the places of its actions in the decision, in parts."""
    from tillcycle.functions.parts import numbered
    placed = numbered(cycle(spark, d)["reviews"].select("run_id", "action_id", "execution_state"), ["run_id"], ["action_id"])
    return list_parts(placed, ["run_id", "execution_state"], ["pos"], "pos", BOUND).select(
        "run_id", "execution_state", "part", "n", F.array_join(F.col("items").cast("array<string>"), ",").alias("indices"))


# ------------------------------------------------------------ fields of several types
@register("union_records", "PR9", BASE + """
SELECT run_id, action_id, CASE WHEN action_type <> 'promo' THEN quantity END AS quantity,
       CASE urgency WHEN 'high' THEN action_id || ',review' WHEN 'medium' THEN action_id ELSE '' END AS criteria,
       CASE urgency WHEN 'high' THEN 'policy_violation' ELSE 'other' END AS finding_type,
       CASE urgency WHEN 'high' THEN '7' WHEN 'medium' THEN action_type ELSE '' END AS reported_value
FROM actions""")
def q_union_records(spark, d):
    """The actions as JSON records whose fields change their type: quantities as numbers, texts and
    'n/a', criteria as list, text and null, finding types known, unknown and numeric."""
    from tillcycle.operators.unions import union_records
    quoted = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    by_urgency = lambda high, medium: F.when(F.col("urgency") == "high", high).when(
        F.col("urgency") == "medium", medium)
    q = F.when(F.col("action_type") == "promo", F.lit('"n/a"')).when(F.col("urgency") == "high", quoted("quantity")) \
        .otherwise(F.col("quantity").cast("string"))
    fields = {"quantity": q,
              "acceptance_criteria": by_urgency(F.concat(F.lit("["), quoted("action_id"), F.lit(',"review"]')), quoted("action_id")),
              "finding_type": by_urgency(F.lit('"policy_violation"'), quoted("action_type")).otherwise(F.lit("3")),
              "reported_value": by_urgency(F.lit("7"), quoted("action_type"))}
    parts = [F.concat(F.lit(f'"{name}":'), F.coalesce(c, F.lit("null"))) for name, c in fields.items()]
    records = cycle(spark, d)["actions"].select("run_id", "action_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
                                                .alias("payload_json"))
    return union_records(records).select("run_id", "action_id", "quantity", F.array_join("acceptance_criteria", ",").alias("criteria"),
                                         "finding_type", "reported_value")


# ------------------------------------------------------------ periods from sets per day
@register("run_kpis_from_day_sets", "AG1 EV1", REGISTRY["run_kpis"].sql)
def q_run_kpis_from_day_sets(spark, d):
    """The KPIs of all runs, whose periods overlap, merged from bitmaps and sums per day.  The lines
    come in two appends that share days; the second is retried."""
    from tillcycle.plans.day_sets import DaySets, run_kpis_from_sets
    facts = fact_sales(spark, d, ["invoice_no", "customer_id", "invoice_date", "quantity", "revenue"])
    runs = cycle(spark, d)["runs"]
    store = DaySets(spark, new_folder(spark, "day_sets"))
    old = (F.col("invoice_date") < F.lit(STATEMENT_AS_OF).cast("timestamp_ntz")) | (F.col("quantity") > 25)
    done = [store.append(facts.where(old), "old"), store.append(facts.where(~old), "new"), store.append(facts.where(~old), "new")]
    if done != [True, True, False]:
        raise Interrupted(f"appends of lines: {done}")
    return stored_kpis(run_kpis_from_sets(store, runs), runs).select("run_id", "name", "value", "unit", "period", "evidence")
