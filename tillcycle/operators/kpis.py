"""Analyst KPIs and ranked SKUs (AG1-AG5, JO1, JO2, PR13, TK1, TK2).

Aggregation shape.  Distinct counts are computed as two-level aggregations
(group by the counted key, then count groups) instead of several
``countDistinct`` in one ``agg`` — the latter expands every input row once
per distinct column before the shuffle.  The invoice-level pass is also
where revenue and line counts are pre-summed, so the second level only sees
one row per invoice.  The two KPI branches are combined with ``unionByName``
in the long (name, value, unit) layout, never by a join of one-row frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcycle.operators.asof import in_period

# KPI names and units of the analyst report, in report order.
KPI_UNITS = [("total_revenue", "GBP"), ("total_orders", "orders"),
             ("avg_order_value", "GBP"), ("unique_customers", "customers"),
             ("return_rate", "ratio")]


def grouped_kpis(facts: DataFrame, by: list[str] | None = None, approx: bool = False,
                 rsd: float = 0.01) -> DataFrame:
    """The five KPIs per group ``by`` (no group: one set for the whole input).

    Output: *by, name, value, unit.  NULL aggregates become 0; the return
    rate divides by max(lines, 1) and is rounded to 4 places; money to 2.
    ``approx`` counts distinct customers with HyperLogLog++ (relative
    error ``rsd``) in one partial-aggregating pass instead of an exact
    distinct (an option for very large periods; not the default).
    """
    by = list(by or [])
    # One pass over the lines: (invoice, customer) pairs with their sums.
    # Both branches below read this aggregate; its exchange is reused, so
    # the fact table is scanned and shuffled once.
    pairs = facts.groupBy(*by, "invoice_no", "customer_id").agg(
        F.sum("revenue").alias("rev"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("quantity") < 0).alias("returns"))
    per_invoice = pairs.groupBy(*by, "invoice_no").agg(
        F.sum("rev").alias("rev"), F.sum("lines").alias("lines"),
        F.sum("returns").alias("returns"))
    totals = per_invoice.groupBy(*by).agg(
        F.sum("rev").alias("rev"),
        F.count(F.lit(1)).alias("orders"),
        F.sum("lines").alias("lines"),
        F.sum("returns").alias("returns"))
    rev = F.coalesce(F.col("rev"), F.lit(0.0))

    def metric(name, value, unit, ord_):
        return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"),
                        F.lit(unit).alias("unit"), F.lit(ord_).alias("ord"))

    metrics = F.array(
        metric("total_revenue", F.round(rev, 2), "GBP", 0),
        metric("total_orders", F.col("orders"), "orders", 1),
        metric("avg_order_value",
               F.coalesce(F.round(F.try_divide(rev, F.col("orders")), 2), F.lit(0.0)), "GBP", 2),
        metric("return_rate",
               F.round(F.coalesce(F.col("returns"), F.lit(0)) /
                       F.greatest(F.coalesce(F.col("lines"), F.lit(0)), F.lit(1)), 4),
               "ratio", 4),
    )
    long_a = totals.select(*by, F.inline(metrics))
    if approx:
        cust = pairs.groupBy(*by).agg(F.approx_count_distinct("customer_id", rsd)
                                      .cast("double").alias("value"))
    else:
        cust = pairs.select(*by, "customer_id").distinct().groupBy(*by) \
            .agg(F.count(F.lit(1)).cast("double").alias("value"))
    customers = cust \
        .select(*by, F.lit("unique_customers").alias("name"), "value",
                F.lit("customers").alias("unit"), F.lit(3).alias("ord"))
    return long_a.unionByName(customers)


def period_kpis(visible: DataFrame, start, end, end_of_day: bool = False,
                approx: bool = False) -> DataFrame:
    """AG1 + AG4 + PR13 over ``[start, end]`` of the (as-of bounded) facts.

    Output: name, value, unit, period — five rows.
    """
    period = f"{start}/{end}"
    out = grouped_kpis(in_period(visible, start, end, end_of_day), approx=approx)
    return out.select("name", "value", "unit", F.lit(period).alias("period"))


def sku_totals(facts: DataFrame, key: str = "stock_code") -> DataFrame:
    return facts.groupBy(key).agg(
        F.round(F.sum("revenue"), 2).alias("total_revenue"),
        F.sum("quantity").cast("long").alias("total_units"))


def modal_description(facts: DataFrame, key: str = "stock_code") -> DataFrame:
    """JO1/TK2: most frequent non-blank description per key, ties by text.

    Decorrelated: count (key, description) pairs, then ``min_by`` over
    (-count, description) per key — two partial-aggregating shuffles, no
    window sort, and a hot key collapses map-side.
    """
    pairs = facts.where(F.trim(F.col("description")) != "") \
        .groupBy(key, "description").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(key).agg(
        F.min_by("description", F.struct(-F.col("n"), F.col("description")))
        .alias("description"))


def _ranked(top: DataFrame, visible: DataFrame, ascending: bool,
            key: str = "stock_code", lines_of=None) -> DataFrame:
    # ``top`` has at most k rows (a proven bound), so broadcasting it to
    # restrict the description scan is safe at any scale.
    wanted = lines_of(top.select(key)) if lines_of else \
        visible.join(F.broadcast(top.select(key)), key, "left_semi")
    desc = modal_description(wanted, key)
    order = F.col("total_revenue").asc() if ascending else F.col("total_revenue").desc()
    w = Window.orderBy(order, F.col(key))  # over <= k rows
    return top.join(F.broadcast(desc), key, "left").select(
        key, "description", "total_revenue", "total_units",
        F.row_number().over(w).alias("rank"))


def top_skus(visible: DataFrame, start, end, k: int = 10, key: str = "stock_code",
             end_of_day: bool = False, lines_of=None) -> DataFrame:
    """AG2: the k best keys by period revenue with units and modal description.

    ``lines_of`` maps the frame of ranked keys to their visible lines with
    descriptions, for callers whose ``visible`` has no description column;
    the ranking itself then never joins a dimension.

    The modal description looks at all visible history, not just the period
    (the reference bounds its description subquery only by as-of).
    """
    totals = sku_totals(in_period(visible, start, end, end_of_day), key)
    top = totals.orderBy(F.col("total_revenue").desc(), F.col(key)).limit(k)
    return _ranked(top, visible, ascending=False, key=key, lines_of=lines_of)


def bottom_skus(visible: DataFrame, start, end, k: int = 10, min_units: int = 5,
                key: str = "stock_code", end_of_day: bool = False, lines_of=None) -> DataFrame:
    """AG3: the k weakest keys by period revenue among those with >= min_units."""
    totals = sku_totals(in_period(visible, start, end, end_of_day), key) \
        .where(F.col("total_units") >= min_units)
    low = totals.orderBy(F.col("total_revenue").asc(), F.col(key)).limit(k)
    return _ranked(low, visible, ascending=True, key=key, lines_of=lines_of)


def top_keys(visible: DataFrame, key: str = "stock_code", k: int = 20) -> DataFrame:
    """AG5/TK1: keys ranked by all-visible revenue (no period), first k.

    Output: key, total_revenue, rank.  Unlike the reference (quirk Q2) the
    ranking sees only as-of-visible rows because the relation is bounded.
    """
    totals = visible.groupBy(key).agg(F.round(F.sum("revenue"), 2).alias("total_revenue"))
    top = totals.orderBy(F.col("total_revenue").desc(), F.col(key)).limit(k)
    w = Window.orderBy(F.col("total_revenue").desc(), F.col(key))
    return top.select(key, "total_revenue", F.row_number().over(w).alias("rank"))
