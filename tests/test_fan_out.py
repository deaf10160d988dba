"""Overlapping runs: nothing that fans out is shuffled, and the rows are those of a plain version."""
import datetime as dt

from pyspark.sql import functions as F

from tillcycle.plans import derived as DV

LINES = "invoice_no string, customer_id string, stock_code string, invoice_date timestamp_ntz, quantity int, revenue double"


def lines_of(spark, n=4000):
    """Lines of eight years (over 62 runs), on and past midnight, with nulls and repeats."""
    at = dt.datetime(2003, 1, 20)
    rows = [(f"i{i // 4}" if i % 50 else None, f"c{i * 13 % 70}" if i % 41 else None, f"s{i % 37}" if i % 43 else None,
             at + dt.timedelta(days=i * 11 % 2900, hours=0 if i % 4 else 10) if i % 47 else None,
             None if i % 53 == 0 else -1 if i % 9 == 0 else 2, float(i % 17)) for i in range(n)]
    return spark.createDataFrame(rows + rows[:90], LINES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_run_kpis(spark):
    lines = lines_of(spark)
    runs = DV.derive_runs(lines)
    out = DV.run_kpis(lines, runs)
    assert "hashpartitioning(run_id" not in plan_of(out) and "hashpartitioning(invoice_no" not in plan_of(out)
    plain = DV.assign_runs(lines, runs).groupBy("run_id").agg(
        F.countDistinct(F.coalesce("invoice_no", F.lit("-"))).alias("total_orders"), F.round(F.sum("revenue"), 2).alias("total_revenue"),
        F.countDistinct(F.coalesce("customer_id", F.lit("-"))).alias("unique_customers"),
        F.round(F.count_if(F.col("quantity") < 0) / F.count(F.lit(1)), 4).alias("return_rate")).collect()
    want = {(r.run_id, n): float(r[n]) for r in plain for n in ("total_orders", "total_revenue", "unique_customers", "return_rate")}
    assert len(plain) > DV.WORD_BITS
    assert {(r.run_id, r.name): r.value for r in out.collect() if r.name != "avg_order_value"} == want


def test_sku_statistics(spark):
    lines = lines_of(spark)
    runs = DV.derive_runs(lines)
    out = DV.sku_period_stats(lines, runs)
    assert "hashpartitioning(run_id" not in plan_of(out)
    sold = F.col("quantity") > 0
    plain = DV.assign_runs(lines, runs).groupBy("run_id", "stock_code").agg(
        F.sum(F.when(sold, F.col("quantity")).otherwise(0)).cast("long").alias("units"), F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("quantity") < 0).alias("return_lines"), F.max(F.when(sold, F.col("invoice_date"))).alias("last_sale"))
    assert set(map(tuple, out.collect())) == set(map(tuple, plain.collect()))


def small_cycle(spark, monkeypatch):
    from tillcycle.plans import queries_cycle as C
    monkeypatch.setattr(C, "fact_sales", lambda spark, d, columns, **_: lines_of(spark).withColumn(
        "quantity", F.col("quantity") * 30).withColumn("unit_price", F.lit(1.0)))
    return C.cycle(spark, "")


def test_reviews_and_tasks_are_neither_written_nor_joined(spark, monkeypatch):
    """F7 F8 F12 F13: a review lies beside its action, so releasing and tasks shuffle nothing."""
    from tillcycle.operators import controls as CR
    from tillcycle.operators import dispatch as DI
    t = small_cycle(spark, monkeypatch)
    assert "Exchange hashpartitioning" not in plan_of(t["tasks"])
    assert not any("cut-" in f and "reasons" in spark.read.parquet(f.rsplit("/", 1)[0]).columns for f in t["reviews"].inputFiles())
    joined = DI.derive_tasks(CR.executable(t["actions"], t["reviews"]), t["runs"])
    rows = lambda df: sorted((r.run_id, r.task_id, r.action_id, r.title, r.due_date, r.control_profile) for r in df.collect())
    assert rows(t["tasks"]) == rows(joined) and t["tasks"].count() > 50


def test_descriptions(spark, monkeypatch):
    """Joined texts are those that the formats gave, also for lines without a SKU."""
    t = small_cycle(spark, monkeypatch)
    s = t["sku_stats"].where("units >= 60").select("run_id", F.format_string(
        "Replenish SKU %s: %d units sold in the period", "stock_code", "units").alias("description"))
    got = t["actions"].where("action_type in ('restock', 'reorder')").select("run_id", "description")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, s.collect()))
    assert got.where("description like '%SKU null:%'").count() > 0


def test_least_candidates(spark):
    """F8 F12: what is sorted for a group's least text is a small part of its rows, and it is there."""
    from tillcycle.functions.topk import least_candidates
    df = spark.range(20000).selectExpr("if(id % 5 = 0, null, 'g' || id % 5) as g", "if(id % 9 = 0, null, 'x' || sha2(id || '', 256)) as v") \
        .union(spark.createDataFrame([("only", "b"), ("only", "a"), ("none", None)], "g string, v string"))
    few = least_candidates(df, ["g"], "v")
    least = lambda x: sorted(map(str, x.groupBy("g").agg(F.min("v")).collect()))
    assert least(few) == least(df)
    assert few.where("g like 'g%'").count() < 3000


def test_slices_follow_the_rows(spark, monkeypatch):
    """a slice and a task of parts hold a bounded number of rows; rows are numbered without a second sort."""
    from tillcycle.functions import parts as P
    monkeypatch.setattr(P, "ROWS_PER_SLICE", 20)
    df = spark.range(4000).selectExpr("if(id % 7 = 0, null, id % 3) as g", "3 * id as k")
    got = P.numbered(df, ["g"], ["k"])
    assert "row_number" not in plan_of(got)
    assert len({f for f in got.inputFiles() if "part-" in f}) > 64
    want = df.selectExpr("g", "k", "row_number() over (partition by g order by k) - 1 as pos")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert P.list_parts(df, ["g"], ["k"], "k", bound=10).groupBy().sum("n").first()[0] == 4000
