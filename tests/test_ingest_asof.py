"""Ingest (raw CSV -> curated facts), data-quality findings, as-of views,
run-request and record validation."""
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from tillcycle.operators.asof import as_of_view, in_period
from tillcycle.operators.kpis import period_kpis, top_skus
from tillcycle.operators.quality import dq_findings
from tillcycle.operators.validate import (action_rules, coerce_actions, decision_rules, validate,
                                          validate_requests)
from tillcycle.params import RunParams
from tillcycle.sources.raw_sales import ingest

RAW = """InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country
536365, 85123A ,WHITE HANGING HEART T-LIGHT HOLDER,6,12/1/2010 8:26,2.55,17850,United Kingdom
536365,71053,WHITE METAL LANTERN,6,12/1/2010 8:26,3.39,17850,United Kingdom
536366,22633,HAND WARMER UNION JACK,abc,12/1/2010 8:28,1.85,,United Kingdom
C536379,D,Discount,-1,12/1/2010 9:41,27.50,14527,United Kingdom
536380,22961,,2.7,2010-12-01 09:45:00,x,14527,France
536381,22961,JAM MAKING SET PRINTED,24,not a date,1.45,14527,France
"""


def _csv():
    d = tempfile.mkdtemp(prefix="tillcycle-test-")
    p = os.path.join(d, "raw.csv")
    with open(p, "w", encoding="latin-1") as fh:
        fh.write(RAW.replace("UNION JACK", "UNION JACK \xa3"))
    return d, p


def test_ingest_cleans_and_quarantines(spark):
    d, p = _csv()
    facts, bad = ingest(spark, p, os.path.join(d, "curated"), os.path.join(d, "quarantine"))
    rows = {r.invoice_no: r for r in facts.collect()}
    assert facts.count() == 5 and len(rows) == 4 and bad.count() == 1
    assert rows["536365"].stock_code in ("85123A", "71053")
    assert rows["536366"].quantity == 0 and rows["536366"].customer_id == "UNKNOWN"
    assert rows["536366"].description.endswith("\xa3")             # latin-1 decoded
    assert rows["C536379"].revenue == -27.5
    assert rows["536380"].quantity == 2 and rows["536380"].unit_price == 0.0   # truncation, bad price
    assert rows["536380"].description == ""
    assert rows["536365"].invoice_date == dt.datetime(2010, 12, 1, 8, 26)
    assert facts.columns == ["invoice_no", "invoice_date", "stock_code", "description", "quantity",
                             "unit_price", "customer_id", "country", "revenue"]
    f = {(r.finding_type, r.column_name): r.n for r in dq_findings(facts).collect()}
    assert f[("negative_quantity", None)] == 1
    assert ("duplicate_invoice_lines", None) not in f     # no repeated (invoice, stock_code)


def test_dq_missing_columns(spark):
    df = spark.createDataFrame([("1", "A", None), ("1", "A", 2)],
                               "invoice_no string, stock_code string, quantity int")
    f = {(r.finding_type, r.column_name): r.n for r in dq_findings(df).collect()}
    assert f[("missing_columns", "country,customer_id,description,invoice_date,revenue,unit_price")] == 6
    assert f[("nulls", "quantity")] == 1 and f[("duplicate_invoice_lines", None)] == 1


FACTS = "invoice_no string, invoice_date timestamp_ntz, stock_code string, description string, " \
        "quantity int, unit_price double, customer_id string, country string, revenue double"


def _facts(spark):
    rows = [("INV001", dt.datetime(2011, 7, 1), "SKU1", "Test item", 50, 1.0, "C001", "UK", 50.0),
            ("INV002", dt.datetime(2011, 6, 30, 0, 0), "SKU1", "Test item", 5, 1.0, "C002", "UK", 5.0),
            ("INV003", dt.datetime(2011, 6, 30, 10, 0), "SKU2", "Other", 3, 2.0, "C002", "UK", 6.0),
            ("INV004", dt.datetime(2011, 6, 1), "SKU2", "  ", -1, 2.0, "C003", "UK", -2.0),
            ("INV004", dt.datetime(2011, 6, 1), "SKU2", "Other", 2, 2.0, "C003", "UK", 4.0)]
    return spark.createDataFrame(rows, FACTS)


def test_as_of_bounds_relation(spark):
    f = _facts(spark)
    assert as_of_view(f, "2011-06-30", "bounded").count() == 3        # midnight bound (quirk Q1)
    assert as_of_view(f, "2011-06-30", "bounded", end_of_day=True).count() == 4
    assert as_of_view(f, "2011-06-30", "omniscient").count() == 5
    assert in_period(f, "2011-06-01", "2011-06-30").count() == 3


def test_period_kpis_and_top(spark):
    vis = as_of_view(_facts(spark), "2011-06-30")
    k = {r.name: r.value for r in period_kpis(vis, "2011-04-01", "2011-06-30").collect()}
    assert k == {"total_revenue": 7.0, "total_orders": 2.0, "avg_order_value": 3.5,
                 "unique_customers": 2.0, "return_rate": round(1 / 3, 4)}
    top = top_skus(vis, "2011-04-01", "2011-06-30", k=10).orderBy("rank").collect()
    assert [(r.stock_code, r.description, r.rank) for r in top] == [("SKU1", "Test item", 1),
                                                                   ("SKU2", "Other", 2)]


def test_empty_period_kpis_are_zero(spark):
    k = {r.name: r.value for r in period_kpis(_facts(spark), "2001-01-01", "2001-02-01").collect()}
    assert k["total_revenue"] == 0.0 and k["avg_order_value"] == 0.0 and k["return_rate"] == 0.0


def test_run_params_validation():
    p = RunParams(as_of="2011-06-30")
    assert p.start == dt.date(2011, 4, 1) and p.period == "2011-04-01/2011-06-30"
    for bad in (dict(as_of="2011-06-30", mode="wrong"), dict(as_of="2011-06-30", start="2011-07-01"),
                dict(as_of="2011-06-30", profile="lax")):
        try:
            RunParams(**bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_record_validation(spark):
    acts = spark.createDataFrame(
        [("restock", "SKU1", "50", "high", "d"), ("teleport", None, "x", "low", "d"),
         ("promo", None, None, None, None)],
        "action_type string, stock_code string, quantity string, urgency string, description string")
    c = coerce_actions(acts)
    assert [r.quantity for r in c.collect()] == [50.0, None, None]
    ok, bad = validate(c, action_rules())
    assert ok.count() == 2 and [r.failed_rules for r in bad.collect()] == [["action_type_known"]]
    dec = spark.createDataFrame([(0.75, "bounded"), (1.5, "bounded"), (0.5, "wrong")],
                                "confidence double, mode string")
    ok, bad = validate(dec, decision_rules())
    assert ok.count() == 1 and bad.count() == 2


def test_run_requests(spark):
    req = spark.createDataFrame(
        [("r1", dt.date(2011, 6, 1), dt.date(2011, 6, 30), "bounded", "standard"),
         ("r2", dt.date(2011, 7, 2), dt.date(2011, 6, 30), "bounded", "standard"),
         ("r3", dt.date(2010, 1, 1), dt.date(2011, 6, 30), "bounded", "standard")],
        "run_id string, start_date date, as_of_date date, mode string, control_profile string")
    ok, bad = validate_requests(req, _facts(spark))
    assert [r.run_id for r in ok.collect()] == ["r1"]
    assert {r.run_id for r in bad.collect()} == {"r2", "r3"}
    assert F is not None


def test_streaming_ingest_resumes(spark):
    import shutil
    from tillcycle.streaming.ingest import start_ingest
    d, p = _csv()
    drop = os.path.join(d, "drop")
    os.makedirs(drop)
    shutil.copy(p, os.path.join(drop, "a.csv"))
    cur, qua = os.path.join(d, "cur"), os.path.join(d, "qua")
    name = "ingest_" + os.path.basename(d).replace("-", "_")
    q = start_ingest(spark, drop, cur, qua, name=name)
    q.awaitTermination(120)
    assert spark.read.parquet(cur).count() == 5 and spark.read.parquet(qua).count() == 1
    # a second file arrives; a restarted query reads only the new one
    shutil.copy(p, os.path.join(drop, "b.csv"))
    q = start_ingest(spark, drop, cur, qua, name=name)
    q.awaitTermination(120)
    assert spark.read.parquet(cur).count() == 10


def test_replayed_batch_leaves_no_second_copy(spark):
    from tillcycle.streaming.ingest import batch_writer
    d, p = _csv()
    cur, qua = os.path.join(d, "cur"), os.path.join(d, "qua")
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(p)
    for batch_id in (0, 1, 1, 0):   # both batches are tried again
        batch_writer(cur, qua)(raw, batch_id)
    assert spark.read.parquet(cur).count() == 10 and spark.read.parquet(qua).count() == 2


def test_fingerprint_counts_repeated_rows(spark):
    from tillcycle.operators.report import fingerprint
    of = lambda *xs: tuple(fingerprint(spark.createDataFrame([(x,) for x in xs], "x int")).first())
    assert of(1, 1) != of(2, 2) and of(1, 2) == of(2, 1) and of(1) != of(1, 1)
    assert of(1, None) != of(1, 0)
