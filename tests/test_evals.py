"""Evaluator and audit behaviours (the reference's evaluator and audit cases)."""
import datetime as dt

from pyspark.sql import functions as F

from tillcycle.operators import audit as AU
from tillcycle.operators import evals as EV

KPI = "run_id string, name string, value double, evidence string"


def _fact(spark, stored, recomputed, narrative="Revenue 12345.0 GBP"):
    s = spark.createDataFrame(stored, KPI)
    r = spark.createDataFrame(recomputed, "run_id string, name string, value double")
    n = spark.createDataFrame([("run", narrative)], "run_id string, narrative string")
    return EV.eval_factuality(s, r, n).collect()[0]


def test_factuality_match(spark):
    r = _fact(spark, [("run", "total_revenue", 12345.0, "total_kpis")],
              [("run", "total_revenue", 12345.0)])
    assert r.factuality_score == 1.0 and r.kpis_verified == 1 and r.verdict == "PASS"


def test_factuality_mismatch(spark):
    r = _fact(spark, [("run", "total_revenue", 99999.0, "total_kpis")],
              [("run", "total_revenue", 12345.0)])
    assert r.factuality_score == 0.0 and r.kpis_mismatched == 1 and r.verdict == "FAIL"


def test_factuality_no_evidence_counted(spark):
    r = _fact(spark, [("run", "total_revenue", 12345.0, "total_kpis"),
                      ("run", "units_sold", 500.0, None)],
              [("run", "total_revenue", 12345.0), ("run", "units_sold", 1.0)])
    assert (r.total_kpis, r.kpis_with_evidence, r.kpis_no_evidence) == (2, 1, 1)
    assert r.factuality_score == 1.0


def test_factuality_vacuous(spark):
    r = _fact(spark, [("run", "units_sold", 500.0, None)], [("run", "units_sold", 1.0)])
    assert r.factuality_score == 1.0 and r.kpis_with_evidence == 0


def test_narrative_numbers(spark):
    s = spark.createDataFrame([("run", "total_revenue", 12345.0, "x")], KPI)
    n = spark.createDataFrame([("run", "Revenue was £12,345.00 and 7% growth on 3 days")],
                              "run_id string, narrative string")
    r = EV.narrative_numbers(n, s).collect()[0]
    assert r.n_numbers == 3 and sorted(r.unsupported) == ["3", "7%"]


FC = "run_id string, stock_code string, ds date, yhat double"


def test_forecast_eval_no_actuals(spark):
    f = spark.createDataFrame([("run", "SKU1", dt.date(2011, 7, 1), 50.0)], FC)
    b = spark.createDataFrame([("run", "SKU1", 0.1)], "run_id string, stock_code string, mape double")
    a = spark.createDataFrame([], "run_id string, stock_code string, ds date, y double")
    per, summ = EV.eval_forecast(f, b, a, ["run_id", "stock_code"])
    p = per.collect()[0]
    assert p.n_actuals == 0 and p.actual_mape is None and p.backtest_is_reliable is None
    s = summ.collect()[0]
    assert s.skus_with_actuals == 0 and s.overall_actual_mape is None


def test_forecast_eval_exact_actuals(spark):
    f = spark.createDataFrame([("run", "SKU1", dt.date(2011, 7, 1), 50.0),
                               ("run", "SKU1", dt.date(2011, 7, 2), 50.0)], FC)
    b = spark.createDataFrame([("run", "SKU1", 0.1)], "run_id string, stock_code string, mape double")
    a = spark.createDataFrame([("run", "SKU1", dt.date(2011, 7, 1), 50.0),
                               ("run", "SKU1", dt.date(2011, 7, 5), 9.0)],
                              "run_id string, stock_code string, ds date, y double")
    per, summ = EV.eval_forecast(f, b, a, ["run_id", "stock_code"])
    p = per.collect()[0]
    # only the common date is scored; both actual days are counted
    assert p.n_actuals == 2 and abs(p.actual_mape) < 1e-9 and p.backtest_is_reliable is True


DEC = ("run_id string, rationale string, confidence double, kpi_references array<string>, "
       "forecast_references array<string>")
ACT = "run_id string, action_type string, stock_code string, category string, description string"


def _dec(spark, conf=0.75, actions=None, refs=("total_revenue",)):
    d = spark.createDataFrame([("run", "Revenue is strong; total revenue supports restocking SKU1.",
                                conf, list(refs), ["SKU1_7d"])], DEC)
    a = spark.createDataFrame(actions or [("run", "restock", "SKU1", None, "Restock SKU1")], ACT)
    k = spark.createDataFrame([("run", "total_revenue")], "run_id string, name string")
    return EV.eval_decisions(d, a, k).collect()[0]


def test_decision_good(spark):
    r = _dec(spark)
    assert r.overall_score >= 0.6 and r.verdict == "PASS" and r.confidence_flag == "ok"


def test_decision_confidence_flagged(spark):
    r = _dec(spark, conf=1.0)
    assert r.confidence_flag == "suspiciously_high" and r.n_findings >= 1


def test_decision_vague_action(spark):
    r = _dec(spark, actions=[("run", "promo", None, None, "Run a promo")])
    assert r.vague_actions == 1


def test_decision_unknown_reference(spark):
    r = _dec(spark, refs=("total_revenue", "gross_margin"))
    assert r.unknown_kpi_references == "gross_margin"


RUNS = "run_id string, as_of_date date, mode string, period_end date"


def _audit(spark, mode, period_end, evidence="total_kpis"):
    runs = spark.createDataFrame([("run", dt.date(2011, 6, 30), mode, period_end)], RUNS)
    kpis = spark.createDataFrame([("run", "total_revenue", 1.0, evidence)], KPI)
    dec = spark.createDataFrame([("run", "A sufficiently long rationale.", 1)],
                                "run_id string, rationale string, n_actions int")
    f = AU.audit(runs, kpis, dec)
    return f.collect(), AU.audit_status(runs, f).collect()[0]


def test_audit_missing_evidence(spark):
    f, st = _audit(spark, "bounded", dt.date(2011, 6, 30), evidence=None)
    assert [(x.severity, x.finding_type) for x in f] == [("warning", "missing_citation")]
    assert st.passed


def test_audit_present_evidence(spark):
    f, st = _audit(spark, "bounded", dt.date(2011, 6, 30))
    assert f == [] and st.passed and st.errors == 0


def test_audit_future_period_end_flagged(spark):
    f, st = _audit(spark, "bounded", dt.date(2011, 12, 1))
    assert [(x.severity, x.finding_type) for x in f] == [("error", "policy_violation")]
    assert not st.passed


def test_audit_omniscient_allowed(spark):
    f, st = _audit(spark, "omniscient", dt.date(2011, 12, 1))
    assert f == [] and st.passed


def test_audit_no_actions_and_blank_rationale(spark):
    runs = spark.createDataFrame([("run", dt.date(2011, 6, 30), "bounded", dt.date(2011, 6, 30))], RUNS)
    kpis = spark.createDataFrame([], KPI)
    dec = spark.createDataFrame([("run", "   ", 0)], "run_id string, rationale string, n_actions int")
    f = AU.audit(runs, kpis, dec).collect()
    assert sorted((x.severity, x.finding_type) for x in f) == [("error", "other"),
                                                             ("warning", "missing_citation")]


def test_top_findings_order(spark):
    rows = [("run", dt.date(2011, 6, 30), s, "other", "d", str(i), "", "")
            for i, s in enumerate(["info", "warning", "error", "warning", "bogus"])]
    f = spark.createDataFrame(rows, ", ".join(f"{c} {'date' if c == 'as_of_date' else 'string'}"
                                              for c in AU.FINDING_COLUMNS))
    got = [r.severity for r in AU.top_findings(f, n=3).orderBy("pos").collect()]
    assert got == ["error", "warning", "warning"]


def test_forecast_reliability_verdicts(spark):
    bt = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("b", 1.5), ("c", None)],
                               "run_id string, mape double")
    rel = {r.run_id: r.verdict for r in EV.forecast_reliability(bt).collect()}
    assert rel == {"a": "RELIABLE", "b": "NOT RELIABLE", "c": "UNKNOWN"}
    use = {r.run_id: r.usable for r in EV.forecast_usable(bt).collect()}
    assert use == {"a": True, "b": False, "c": False}
    assert F is not None


def test_factuality_first_column_quirk(spark):
    stored = spark.createDataFrame(
        [("run", "total_revenue", 12345.0, "total_kpis"), ("run", "total_orders", 40.0, "total_kpis"),
         ("run", "return_rate", 0.25, "return_rate")], KPI)
    recomputed = spark.createDataFrame([("run", "total_revenue", 12345.0), ("run", "total_orders", 40.0),
                                        ("run", "return_rate", 0.25)], "run_id string, name string, value double")
    first = spark.createDataFrame([("run", "total_kpis", 12345.0), ("run", "return_rate", 10.0)],
                                  "run_id string, evidence string, value double")
    n = spark.createDataFrame([("run", "")], "run_id string, narrative string")
    fixed = EV.eval_factuality(stored, recomputed, n).collect()[0]
    quirk = EV.eval_factuality(stored, recomputed, n, first_columns=first).collect()[0]
    assert fixed.kpis_verified == 3
    assert (quirk.kpis_verified, quirk.kpis_mismatched) == (1, 2)   # orders vs revenue, rate vs count


def test_approx_customers_option(spark):
    from tillcycle.operators.kpis import period_kpis
    rows = [(str(i), dt.datetime(2011, 6, 1), "S", "d", 1, 1.0, str(i % 97), "UK", 1.0) for i in range(500)]
    f = spark.createDataFrame(rows, "invoice_no string, invoice_date timestamp_ntz, stock_code string, "
                                    "description string, quantity int, unit_price double, "
                                    "customer_id string, country string, revenue double")
    exact = {r.name: r.value for r in period_kpis(f, "2011-05-01", "2011-06-30").collect()}
    approx = {r.name: r.value for r in period_kpis(f, "2011-05-01", "2011-06-30", approx=True).collect()}
    assert exact["unique_customers"] == 97 and abs(approx["unique_customers"] - 97) <= 3
