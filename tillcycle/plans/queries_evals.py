"""Registered queries: stored artifacts and the three offline evaluators,
run over every derived run at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcycle.functions.topk import top_k_per_group
from tillcycle.operators import artifacts as AR
from tillcycle.operators import evals as EV
from tillcycle.operators.demand import daily_demand, densify
from tillcycle.operators.naive import naive_backtest, naive_forecast
from tillcycle.plans import derived as DV
from tillcycle.plans.queries_cycle import BASE, DATE_COLUMNS
from tillcycle.plans.queries_forecast import backtest_sql, forecast_sql
from tillcycle.plans.registry import register
from tillcycle.session import cut_lineage
from tillcycle.sources.tables import fact_sales

KPI_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()), T.StructField("period", T.StringType()),
    T.StructField("evidence", T.StringType())]))
ANALYST_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("as_of_date", T.StringType()),
    T.StructField("mode", T.StringType()), T.StructField("period_start", T.StringType()),
    T.StructField("period_end", T.StringType()), T.StructField("kpis", KPI_SCHEMA),
    T.StructField("narrative", T.StringType()), T.StructField("revision", T.IntegerType())])


def run_tables(spark, d) -> dict:
    facts = fact_sales(spark, d, ["invoice_no", "customer_id", *DATE_COLUMNS], lines_per_task=DV.LINES_PER_TASK)
    dates = fact_sales(spark, d, DATE_COLUMNS)
    t = DV.build_run_tables(facts, dates=dates)
    t["facts"] = facts
    return t


def stored_artifacts(t: dict, types: tuple[str, ...] = ("analyst_report", "decision")) -> DataFrame:
    """Analyst reports (regulated runs stored twice: a first revision one
    hour earlier) and decision headers, as JSON artifact rows.  Only the
    requested types are built (decisions need the materialised actions)."""
    runs = t["runs"]
    kp = t["kpis"].groupBy("run_id").agg(F.array_sort(F.collect_list(
        F.struct("name", "value", "unit", "period", "evidence"))).alias("kpis"))
    rep = runs.join(kp, "run_id").join(t["narratives"], "run_id")

    def payload(rev):
        return F.struct("run_id", F.col("as_of_date").cast("string").alias("as_of_date"), "mode",
                        F.col("period_start").cast("string").alias("period_start"),
                        F.col("period_end").cast("string").alias("period_end"),
                        "kpis", "narrative", F.lit(rev).alias("revision"))

    v2 = AR.to_artifacts(rep, "analyst_report", payload(2), F.col("created_at"))
    v1 = AR.to_artifacts(rep.where(F.col("control_profile") == "regulated"), "analyst_report",
                         payload(1), F.col("created_at") - F.expr("INTERVAL 1 HOUR"))
    if "decision" not in types:
        return v2.unionByName(v1)
    dec = t["decisions"]
    dp = F.struct("run_id", F.col("as_of_date").cast("string").alias("as_of_date"), "mode",
                  "rationale", "confidence", "kpi_references", "forecast_references",
                  "n_actions", F.lit(1).alias("revision"))
    dv = AR.to_artifacts(dec, "decision", dp, F.col("created_at"))
    return v2.unionByName(v1).unionByName(dv)


def stored_kpis_from(latest: DataFrame) -> tuple[DataFrame, DataFrame]:
    rep = latest.where(F.col("artifact_type") == "analyst_report") \
        .select("run_id", F.from_json("artifact_json", ANALYST_SCHEMA).alias("r"))
    kpis = rep.select("run_id", F.inline("r.kpis"))
    narr = rep.select("run_id", F.col("r.narrative").alias("narrative"))
    return kpis, narr


@register("latest_artifacts", "SC10 TK2", BASE + """,
arts AS (
  SELECT run_id, 'analyst_report' AS artifact_type, created_at, 2 AS revision FROM runs
  UNION ALL SELECT run_id, 'analyst_report', created_at - INTERVAL 1 HOUR, 1 FROM runs WHERE control_profile = 'regulated'
  UNION ALL SELECT run_id, 'decision', created_at, 1 FROM runs)
SELECT run_id, artifact_type, created_at, revision FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, artifact_type ORDER BY created_at DESC) AS rn FROM arts)
WHERE rn = 1""")
def q_latest(spark, d):
    latest = AR.latest_artifacts(stored_artifacts(run_tables(spark, d)))
    return latest.select("run_id", "artifact_type", "created_at",
                         F.get_json_object("artifact_json", "$.revision").cast("int").alias("revision"))


@register("artifact_map", "SC11", BASE + """
SELECT d.run_id, 2 AS n_types, 2 AS report_revision, CAST(r.period_start AS VARCHAR) AS period_start,
       CAST(r.period_end AS VARCHAR) AS period_end, CAST(d.n_actions AS BIGINT) AS n_actions,
       d.rationale FROM decisions d JOIN runs r ON d.run_id = r.run_id""")
def q_artifact_map(spark, d):
    m = AR.artifact_map(stored_artifacts(run_tables(spark, d)))
    of = lambda kind, field: F.get_json_object(F.col("artifacts")[kind], f"$.{field}")
    return m.select("run_id", F.size("artifacts").alias("n_types"),
                    of("analyst_report", "revision").cast("int").alias("report_revision"),
                    of("analyst_report", "period_start").alias("period_start"),
                    of("analyst_report", "period_end").alias("period_end"),
                    of("decision", "n_actions").cast("long").alias("n_actions"),
                    of("decision", "rationale").alias("rationale"))


@register("recent_runs", "SC12 JO3 TK1", BASE + """,
ra AS (
  SELECT run_id, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end FROM runs
  UNION ALL
  SELECT run_id, CAST(period_start AS VARCHAR), CAST(period_end AS VARCHAR) FROM runs WHERE control_profile = 'regulated')
SELECT d.run_id, d.as_of_date, d.mode, r.created_at, ra.period_start, ra.period_end
FROM decisions d JOIN runs r ON d.run_id = r.run_id LEFT JOIN ra ON d.run_id = ra.run_id
ORDER BY r.created_at DESC, d.run_id LIMIT 20""")
def q_recent_runs(spark, d):
    t = run_tables(spark, d)
    log = t["decisions"].select("run_id", "as_of_date", "mode", "created_at")
    return AR.recent_runs(log, stored_artifacts(t), limit=20)


FACT_EVAL_SQL = BASE + r""",
ss2 AS (SELECT run_id, COUNT(*) FILTER (WHERE units > 0) AS n_skus FROM ss GROUP BY run_id),
narr AS (
  SELECT kw.run_id, printf('Revenue reached GBP %.2f from %d orders at GBP %.2f per order, with a return rate of %.4f across %d customers and %d SKUs sold.',
         kw.total_revenue, CAST(kw.total_orders AS BIGINT), kw.avg_order_value, kw.return_rate,
         CAST(kw.unique_customers AS BIGINT), COALESCE(ss2.n_skus, 0)) AS narrative
  FROM kw LEFT JOIN ss2 ON kw.run_id = ss2.run_id),
kv AS (SELECT run_id, list(ROUND(value, 2)) AS kv FROM kpis GROUP BY run_id),
toks AS (
  SELECT narr.run_id, regexp_extract_all(narrative, '[£$€]?\d[\d,]*\.?\d*%?') AS toks, kv.kv
  FROM narr LEFT JOIN kv ON narr.run_id = kv.run_id),
nums AS (
  SELECT run_id, len(toks) AS n_numbers,
         len(list_filter(list_transform(toks, lambda t: TRY_CAST(regexp_replace(t, '[£$€,%]', '', 'g') AS DOUBLE)),
             lambda v: v IS NOT NULL AND NOT list_bool_or(list_transform(kv,
                 lambda k: ABS(ROUND(v, 2) - k) / GREATEST(ABS(k), 1e-9) < 0.01)))) AS n_unsupported
  FROM toks),
cmp AS (
  SELECT k.run_id, k.evidence, ABS(k.value - r.value) / GREATEST(ABS(r.value), 1e-9) <= 0.01 AS near
  FROM kpis k JOIN kl r ON k.run_id = r.run_id AND k.name = r.name),
chk AS (
  SELECT run_id, COUNT(*) AS total_kpis, COUNT(evidence) AS kpis_with_evidence,
         COUNT(*) FILTER (WHERE evidence IS NOT NULL AND near) AS kpis_verified,
         COUNT(*) FILTER (WHERE evidence IS NOT NULL AND NOT near) AS kpis_mismatched,
         COUNT(*) - COUNT(evidence) AS kpis_no_evidence
  FROM cmp GROUP BY run_id)
SELECT chk.*, ROUND(CASE WHEN kpis_with_evidence = 0 THEN 1.0 ELSE kpis_verified / kpis_with_evidence END, 6) AS factuality_score,
       nums.n_numbers, nums.n_unsupported,
       CASE WHEN (CASE WHEN kpis_with_evidence = 0 THEN 1.0 ELSE kpis_verified / kpis_with_evidence END) >= 0.8
            THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM chk LEFT JOIN nums ON chk.run_id = nums.run_id"""


@register("eval_factuality", "EV1 EV2 EV3 AG23 JO11 SC10", FACT_EVAL_SQL)
def q_eval_factuality(spark, d):
    t = run_tables(spark, d)
    latest = AR.latest_artifacts(stored_artifacts(t, ("analyst_report",)), ["analyst_report"])
    stored, narr = stored_kpis_from(latest)
    recomputed = DV.run_kpis(t["facts"], t["runs"])
    return EV.eval_factuality(stored, recomputed, narr)


DEC_EVAL_SQL = BASE + """,
names AS (SELECT run_id, list(name) AS names FROM kpis GROUP BY run_id),
am AS (
  SELECT a.run_id, a.action_id,
         (COALESCE(a.stock_code, '') <> '' OR COALESCE(a.category, '') <> '') AS has_target,
         bool_or(contains(lower(COALESCE(d.rationale, '') || ' ' || COALESCE(a.description, '')),
                          replace(lower(k.name), '_', ' '))
              OR contains(lower(COALESCE(d.rationale, '') || ' ' || COALESCE(a.description, '')), lower(k.name))) AS refs
  FROM actions a JOIN decisions d ON a.run_id = d.run_id JOIN kpis k ON k.run_id = a.run_id
  GROUP BY a.run_id, a.action_id, has_target),
sc AS (
  SELECT run_id, AVG((CASE WHEN has_target THEN 0.5 ELSE 0 END) + (CASE WHEN refs THEN 0.5 ELSE 0 END)) AS c_actions,
         COUNT(*) AS n_scored, COUNT(*) FILTER (WHERE NOT has_target) AS vague_actions
  FROM am GROUP BY run_id),
x AS (
  SELECT d.run_id, COALESCE(sc.n_scored, 0) AS total_actions,
         LENGTH(TRIM(d.rationale)) > 20 AS has_rationale,
         len(d.kpi_references) > 0 AS has_kpi_references,
         len(d.forecast_references) > 0 AS has_forecast_references,
         array_to_string(list_filter(d.kpi_references, lambda r: NOT list_contains(n.names, r)), ';') AS unknown_kpi_references,
         d.confidence,
         CASE WHEN d.confidence >= 0.99 THEN 'suspiciously_high' WHEN d.confidence < 0.2 THEN 'suspiciously_low' ELSE 'ok' END AS confidence_flag,
         COALESCE(sc.vague_actions, 0) AS vague_actions, COALESCE(sc.c_actions, 0.0) AS c_actions
  FROM decisions d LEFT JOIN sc ON d.run_id = sc.run_id LEFT JOIN names n ON d.run_id = n.run_id),
y AS (
  SELECT *, ROUND(0.2 * CAST(has_rationale AS INTEGER) + 0.2 * CAST(has_kpi_references AS INTEGER)
                  + 0.1 * CAST(has_forecast_references AS INTEGER) + 0.1 * CAST(confidence_flag = 'ok' AS INTEGER)
                  + 0.4 * c_actions, 3) AS overall_score,
         CAST(NOT has_rationale AS INTEGER) + CAST(NOT has_kpi_references AS INTEGER)
           + CAST(NOT has_forecast_references AS INTEGER) + CAST(unknown_kpi_references <> '' AS INTEGER)
           + CAST(confidence_flag <> 'ok' AS INTEGER) + CAST(total_actions = 0 AS INTEGER)
           + CAST(vague_actions AS INTEGER) AS n_findings
  FROM x)
SELECT run_id, total_actions, CAST(overall_score AS DOUBLE) AS overall_score, has_rationale, has_kpi_references,
       has_forecast_references, unknown_kpi_references, confidence, confidence_flag, vague_actions, n_findings,
       CASE WHEN overall_score >= 0.6 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM y"""


@register("eval_decisions", "EV5 EV6 EV7 AG24 JO8 SO6", DEC_EVAL_SQL)
def q_eval_decisions(spark, d):
    t = run_tables(spark, d)
    return EV.eval_decisions(t["decisions"], t["actions"], t["kpis"].select("run_id", "name"))


# ------------------------------------------------------------ forecasts per run
RUN_KEYS = ["run_id", "stock_code", "as_of_date"]


def run_forecasts(t: dict, k_rank: int = 20, k_forecast: int = 5) -> dict:
    """Per run: rank SKUs by period revenue, forecast the best ``k_forecast``
    of the top ``k_rank`` with the seasonal-naive model (keys with >= 14
    sale days up to the run's as_of), backtest them, fetch actuals."""
    facts, runs = t.dates, t["runs"]
    rev = DV.assign_runs(facts.groupBy("stock_code", "invoice_date")
                         .agg(F.sum("revenue").alias("revenue")), runs) \
        .groupBy("run_id", "stock_code").agg(F.round(F.sum("revenue"), 2).alias("total_revenue"))
    top = top_k_per_group(rev, ["run_id"], [F.col("total_revenue").desc(), F.col("stock_code")],
                          k_rank, salt_cols=["stock_code"]).where(F.col("rank") <= k_forecast)
    # <= k_forecast rows per run and one run per calendar month: a bounded broadcast
    fkeys = cut_lineage(top.join(F.broadcast(runs.select("run_id", "as_of_date")), "run_id")
                        .select(*RUN_KEYS))
    demand = daily_demand(facts.join(F.broadcast(fkeys.select("stock_code").distinct()),
                                     "stock_code", "left_semi"), "stock_code")
    dem = demand.join(F.broadcast(fkeys), "stock_code").where(F.col("ds") <= F.col("as_of_date"))
    # forecast and backtest both read the series: written once
    series = cut_lineage(densify(dem, RUN_KEYS, F.col("as_of_date"), min_sale_days=14))
    fc = naive_forecast(series, RUN_KEYS, F.col("as_of_date"))
    bt = naive_backtest(series, RUN_KEYS, F.col("as_of_date"))
    act = demand.join(F.broadcast(fkeys), "stock_code").where(
        (F.col("ds") > F.col("as_of_date")) & (F.col("ds") <= F.date_add("as_of_date", 28)))
    return {"forecast": fc, "backtest": bt, "actuals": act}


RUN_SERIES_SQL = BASE + """,
skr AS (SELECT run_id, stock_code, ROUND(SUM(revenue), 2) AS total_revenue FROM rf GROUP BY run_id, stock_code),
top5 AS (SELECT * FROM (SELECT skr.*, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY total_revenue DESC, stock_code) AS rk
                        FROM skr) WHERE rk <= 5),
fk AS (SELECT t.run_id, t.stock_code, r.as_of_date FROM top5 t JOIN runs r ON t.run_id = r.run_id),
dd AS (SELECT stock_code, CAST(invoice_date AS DATE) AS ds, CAST(SUM(quantity) AS DOUBLE) AS y
       FROM fact_sales WHERE quantity > 0 GROUP BY stock_code, CAST(invoice_date AS DATE)),
dem AS (SELECT fk.run_id, fk.stock_code, fk.as_of_date, dd.ds, dd.y FROM fk JOIN dd ON fk.stock_code = dd.stock_code
        WHERE dd.ds <= fk.as_of_date),
elig AS (SELECT run_id, stock_code, as_of_date, MIN(ds) AS first_ds FROM dem
         GROUP BY run_id, stock_code, as_of_date HAVING COUNT(*) >= 14),
cal AS (SELECT run_id, stock_code, as_of_date,
               CAST(UNNEST(generate_series(first_ds, as_of_date, INTERVAL 1 DAY)) AS DATE) AS ds FROM elig),
j AS (SELECT cal.run_id, cal.stock_code, cal.as_of_date, cal.ds, dem.y FROM cal LEFT JOIN dem
      ON cal.run_id = dem.run_id AND cal.stock_code = dem.stock_code AND cal.ds = dem.ds),
series AS (SELECT run_id, stock_code, as_of_date, ds, COALESCE(LAST_VALUE(y IGNORE NULLS) OVER (
             PARTITION BY run_id, stock_code ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0.0) AS y FROM j),
act AS (SELECT fk.run_id, fk.stock_code, dd.ds, dd.y FROM fk JOIN dd ON fk.stock_code = dd.stock_code
        WHERE dd.ds > fk.as_of_date AND dd.ds <= CAST(fk.as_of_date + 28 AS DATE))"""

FC_EVAL_SQL = backtest_sql(forecast_sql(RUN_SERIES_SQL, RUN_KEYS, "as_of_date"), RUN_KEYS,
                           "as_of_date") + """,
fkk AS (SELECT DISTINCT run_id, stock_code FROM fc),
nact AS (SELECT run_id, stock_code, COUNT(*) AS n_actuals FROM act GROUP BY run_id, stock_code),
er AS (SELECT fc.run_id, fc.stock_code,
              AVG(ABS(act.y - fc.yhat) / act.y) FILTER (WHERE act.y > 0) AS m,
              SQRT(AVG((act.y - fc.yhat) * (act.y - fc.yhat))) AS r
       FROM fc JOIN act ON fc.run_id = act.run_id AND fc.stock_code = act.stock_code AND fc.ds = act.ds
       GROUP BY fc.run_id, fc.stock_code),
per AS (SELECT fkk.run_id, fkk.stock_code, COALESCE(nact.n_actuals, 0) AS n_actuals,
               CASE WHEN COALESCE(nact.n_actuals, 0) > 0 THEN ROUND(er.m, 6) END AS actual_mape,
               CASE WHEN COALESCE(nact.n_actuals, 0) > 0 THEN ROUND(er.r, 6) END AS actual_rmse,
               bt.mape AS backtest_mape
        FROM fkk LEFT JOIN nact ON fkk.run_id = nact.run_id AND fkk.stock_code = nact.stock_code
        LEFT JOIN er ON fkk.run_id = er.run_id AND fkk.stock_code = er.stock_code
        LEFT JOIN bt ON fkk.run_id = bt.run_id AND fkk.stock_code = bt.stock_code)"""


def _per_sku(spark, d):
    t = run_tables(spark, d)
    f = run_forecasts(t)
    keys = ["run_id", "stock_code"]
    return EV.eval_forecast(f["forecast"].drop("as_of_date"), f["backtest"].drop("as_of_date"),
                            f["actuals"].drop("as_of_date"), keys)


@register("eval_forecast_skus", "EV4 AG7 AG20 AG22 JO5 JO6 SO7 FI7 TS4 TS6", FC_EVAL_SQL + """
SELECT run_id, stock_code, n_actuals, actual_mape, actual_rmse, backtest_mape,
       actual_mape <= 2.0 * backtest_mape AS backtest_is_reliable FROM per""")
def q_eval_forecast_skus(spark, d):
    per, _ = _per_sku(spark, d)
    return per.select("run_id", "stock_code", "n_actuals", "actual_mape", "actual_rmse",
                      "backtest_mape", "backtest_is_reliable")


@register("eval_forecast_runs", "EV4 AG21", FC_EVAL_SQL + """
SELECT run_id, COUNT(*) AS total_skus_forecasted, COUNT(*) FILTER (WHERE n_actuals > 0) AS skus_with_actuals,
       ROUND(AVG(actual_mape), 6) AS overall_actual_mape, ROUND(AVG(actual_rmse), 6) AS overall_actual_rmse
FROM per GROUP BY run_id""")
def q_eval_forecast_runs(spark, d):
    _, summary = _per_sku(spark, d)
    return summary


@register("forecast_reliability", "AG13 AG14 AG15", FC_EVAL_SQL + """
SELECT run_id, ROUND(AVG(mape), 6) AS avg_mape,
       CASE WHEN AVG(mape) IS NULL THEN 'UNKNOWN' WHEN AVG(mape) <= 1.0 THEN 'RELIABLE' ELSE 'NOT RELIABLE' END AS verdict,
       CASE WHEN COUNT(mape) = 0 THEN false
            ELSE NOT (AVG(mape) > 0.5 OR COUNT(*) FILTER (WHERE mape > 0.5) > COUNT(mape) * 0.5) END AS usable
FROM bt GROUP BY run_id""")
def q_forecast_reliability(spark, d):
    bt = run_forecasts(run_tables(spark, d))["backtest"]
    rel = EV.forecast_reliability(bt, "run_id", 1.0)
    use = EV.forecast_usable(bt, "run_id", 0.5).select("run_id", "usable")
    return rel.join(use, "run_id")


@register("eval_factuality_first_column", "EV1 EV3 Q4", BASE + """,
rc AS (SELECT run_id, CAST(COUNT(*) FILTER (WHERE quantity < 0) AS DOUBLE) AS returns FROM rf GROUP BY run_id),
fc AS (SELECT run_id, 'total_kpis' AS evidence, total_revenue AS value FROM kw
       UNION ALL SELECT run_id, 'return_rate', returns FROM rc),
chk AS (SELECT k.run_id, k.evidence,
               CASE WHEN k.evidence IS NULL THEN 'no_evidence'
                    WHEN fc.value IS NULL THEN 'not_recomputed'
                    WHEN ABS(k.value - fc.value) / GREATEST(ABS(fc.value), 1e-9) <= 0.01 THEN 'verified'
                    ELSE 'mismatch' END AS status
        FROM kpis k LEFT JOIN fc ON k.run_id = fc.run_id AND k.evidence = fc.evidence)
SELECT run_id, COUNT(*) AS total_kpis, COUNT(*) FILTER (WHERE status <> 'no_evidence') AS kpis_with_evidence,
       COUNT(*) FILTER (WHERE status = 'verified') AS kpis_verified,
       COUNT(*) FILTER (WHERE status = 'mismatch') AS kpis_mismatched,
       ROUND(CASE WHEN COUNT(*) FILTER (WHERE status <> 'no_evidence') = 0 THEN 1.0
                  ELSE COUNT(*) FILTER (WHERE status = 'verified') / COUNT(*) FILTER (WHERE status <> 'no_evidence') END, 6)
         AS factuality_score
FROM chk GROUP BY run_id""")
def q_eval_factuality_first_column(spark, d):
    """The reference's factuality check as written (quirk Q4): each KPI is
    compared with the first numeric column of its evidence query."""
    t = run_tables(spark, d)
    latest = AR.latest_artifacts(stored_artifacts(t, ("analyst_report",)), ["analyst_report"])
    stored, narr = stored_kpis_from(latest)
    first = DV.evidence_first_columns(t.dates, t["runs"])
    out = EV.eval_factuality(stored, stored.select("run_id", "name", "value"), narr,
                             first_columns=first)
    return out.select("run_id", "total_kpis", "kpis_with_evidence", "kpis_verified",
                      "kpis_mismatched", "factuality_score")
