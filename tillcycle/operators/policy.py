"""Deterministic policy signals from the facts (PO1-PO5; PO6 lives in
plans.derived.candidate_actions).  The reference leaves anomaly spotting to
a language model; here they are rule columns over windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcycle.operators.demand import key_list


def weekly_anomalies(facts: DataFrame, key, z: float = 2.0, weeks: int = 8,
                     min_weeks: int = 4) -> DataFrame:
    """PO5: weekly units per key against the trailing ``weeks`` weeks (only
    weeks with sales): spike when z > ``z``, drop when z < -``z``.

    The window is one key's weekly series — bounded by the calendar.
    Output: *key, week, flag, value (z rounded to 4)."""
    ks = key_list(key)
    wk = facts.where(F.col("quantity") > 0).groupBy(
        *ks, F.to_date(F.date_trunc("week", "invoice_date")).alias("week")) \
        .agg(F.sum("quantity").cast("double").alias("units"))
    w = Window.partitionBy(*ks).orderBy("week").rowsBetween(-weeks, -1)
    s = wk.select(*ks, "week", "units", F.count("units").over(w).alias("n"),
                  F.avg("units").over(w).alias("m"), F.stddev_samp("units").over(w).alias("sd"))
    zz = F.round((F.col("units") - F.col("m")) / F.col("sd"), 4)
    s = s.where((F.col("n") >= min_weeks) & (F.col("sd") > 0)).withColumn("value", zz)
    return s.where(F.abs("value") > z).select(
        *ks, "week", F.when(F.col("value") > 0, "spike").otherwise("drop").alias("flag"), "value")


def high_return_rates(facts: DataFrame, key: str = "stock_code", threshold: float = 0.15,
                      min_lines: int = 5) -> DataFrame:
    """PO2: keys whose return-line share exceeds ``threshold`` (investigate
    before any markdown).  Output: key, lines, return_rate."""
    r = facts.groupBy(key).agg(F.count(F.lit(1)).alias("lines"),
                               F.count_if(F.col("quantity") < 0).alias("returns"))
    r = r.withColumn("return_rate", F.round(F.col("returns") / F.col("lines"), 4))
    return r.where((F.col("lines") >= min_lines) & (F.col("return_rate") > threshold)) \
        .select(key, "lines", "return_rate")


def markdown_tier(idle_days) -> F.Column:
    """PO1: discount tier by weeks without a sale (4-8: 10, 8-12: 25,
    12-16: 40, 16+: 50); NULL under 4 weeks."""
    d = F.col(idle_days) if isinstance(idle_days, str) else idle_days
    return F.when(d >= 112, 50).when(d >= 84, 40).when(d >= 56, 25).when(d >= 28, 10)


def approval_role_for_discount(pct) -> F.Column:
    """PO3: up to 25 % category manager, to 50 % operations manager, above
    director."""
    p = F.col(pct) if isinstance(pct, str) else pct
    return F.when(p <= 25, "category_manager").when(p <= 50, "operations_manager") \
        .otherwise("director")


def approval_role_for_order(value) -> F.Column:
    """PO3: order value under 500 warehouse manager, to 5000 operations
    manager, above director."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v < 500, "warehouse_manager").when(v <= 5000, "operations_manager") \
        .otherwise("director")


def order_quantities(forecast: DataFrame, key, days: int = 7, buffer: float = 0.10) -> DataFrame:
    """PO4: order quantity = forecast demand of the first ``days`` days
    plus ``buffer``, rounded up."""
    ks = key_list(key)
    first = F.min("ds").over(Window.partitionBy(*ks))
    f = forecast.withColumn("_d0", first)
    f = f.where(F.datediff("ds", "_d0") < days)
    return f.groupBy(*ks).agg(F.ceil(F.round(F.sum("yhat") * (1 + buffer), 6)).cast("long").alias("order_qty"))
