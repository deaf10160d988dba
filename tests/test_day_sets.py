import datetime as dt
import tempfile

from pyspark.sql import functions as F

from tillcycle.plans import derived as DV
from tillcycle.plans.day_sets import DaySets, day_sketches, number_keys, period_counts, period_estimates, run_kpis_from_sets

LINES = "invoice_no string, customer_id string, invoice_date timestamp_ntz, quantity int, revenue double"


def store_of(spark, per_slice=16):
    return DaySets(spark, tempfile.mkdtemp(prefix="tillcycle-sets-"), per_slice)


def lines_of(spark, n=3000):
    """Lines over five months, on and past midnight, with keys that recur, a hot one and nulls."""
    at = dt.datetime(2011, 1, 20)
    rows = [(f"i{i * 7 % 900}" if i % 50 else None, "hot" if i % 3 == 0 else f"c{i * 13 % 170}" if i % 41 else None,
             at + dt.timedelta(days=i * 11 % 130, hours=0 if i % 4 else 10), -1 if i % 9 == 0 else 2, float(i % 17)) for i in range(n)]
    return spark.createDataFrame(rows, LINES)


def values(kpis):
    return {(r.run_id, r.name, r.unit, r.period): r.value for r in kpis.collect()}


def test_merged_days_equal_the_lines(spark):
    lines = lines_of(spark)
    runs = DV.derive_runs(lines)
    store = store_of(spark)
    parts = [lines.where(F.col("quantity") < 0), lines.where((F.col("quantity") > 0) & (F.col("revenue") < 9)),
             lines.where((F.col("quantity") > 0) & (F.col("revenue") >= 9))]
    assert [store.append(p, str(i)) for i, p in enumerate(parts)] == [True] * 3
    assert values(run_kpis_from_sets(store, runs)) == values(DV.run_kpis(lines, runs))
    ids = store._ids.read()
    for measure, column in (("orders", "invoice_no"), ("customers", "customer_id")):
        own = ids.where(F.col("measure") == measure)
        assert own.count() == own.select("key").distinct().count() == own.select("slice", "number").distinct().count() \
            == lines.select(column).distinct().count()
        assert own.groupBy("slice").agg(F.max("number").alias("m"), F.count(F.lit(1)).alias("n")).where("m <> n").count() == 0


def test_lost_and_retried_appends(spark):
    lines = lines_of(spark, 400)
    runs = DV.derive_runs(lines)
    store = store_of(spark)
    seen = lines.select(F.lit("orders").alias("measure"), F.col("invoice_no").alias("key"))
    store._ids.append(number_keys(seen, store._ids.read(), 16), "all", "a")        # a writer lost after the numbers
    other = lines.select(F.lit("customers").alias("measure"), F.col("customer_id").alias("key"))
    store._ids.append(number_keys(other, store._ids.read(), 16), "all", "customers")
    assert store.append(lines, "a") and not store.append(lines, "a")
    assert values(run_kpis_from_sets(store, runs)) == values(DV.run_kpis(lines, runs))


def test_nothing_appended_and_many_numbers(spark):
    store = store_of(spark, per_slice=100_000)
    assert store.append(spark.createDataFrame([], LINES), "none")
    wide = spark.range(70_000).select(
        F.concat(F.lit("i"), "id").alias("invoice_no"), F.lit("c").alias("customer_id"),
        F.lit(dt.datetime(2011, 3, 3)).cast("timestamp_ntz").alias("invoice_date"), F.lit(1).alias("quantity"), F.lit(1.0).alias("revenue"))
    assert store.append(wide, "wide")
    runs = DV.derive_runs(wide)
    assert {(r.measure, r.n) for r in period_counts(store.sets(), runs).collect()} == {("orders", 70_000), ("customers", 1)}
    assert store.sets().where("measure = 'orders'").count() == 3     # 32,768 numbers a bitmap


def test_sketches_stay_near_the_counts(spark):
    lines = lines_of(spark).where("invoice_no is not null and customer_id is not null")
    runs = DV.derive_runs(lines)
    store = store_of(spark)
    store.append(lines, "all")
    exact = {(r.run_id, r.measure): r.n for r in period_counts(store.sets(), runs).collect()}
    near = {(r.run_id, r.measure): r.n for r in period_estimates(day_sketches(lines), runs).collect()}
    assert exact.keys() == near.keys() and max(abs(near[k] - n) / n for k, n in exact.items()) < 0.05


def test_a_day_fills_few_bitmaps(spark):
    store = DaySets(spark, tempfile.mkdtemp(prefix="tillcycle-sets-"))
    day = F.expr("timestamp_ntz'2011-03-01 00:00:00' + make_dt_interval(cast(id % 20 as int))")
    store.append(spark.range(80_000).select(
        F.concat(F.lit("i"), "id").alias("invoice_no"), F.lit("c").alias("customer_id"), day.alias("invoice_date"),
        F.lit(1).alias("quantity"), F.lit(1.0).alias("revenue")), "all")
    # 80,000 invoices, each on one of 20 days: three bitmaps of 32,768 numbers, two of which share a day
    assert store.sets().where("measure = 'orders'").count() <= 22
