"""Daily demand series per key (AG6, FI4, FI5, FI9, JO4, TS1, TS2, TS19).

Every key is processed at once.  A *key* is any column (SKU, brand, ...).

Densify without a calendar join: each sale day knows the next sale day
(``lead`` over the key), and expands into the run of days it covers.  The
first day carries the sales, up to ``ffill_limit`` following empty days
carry the same value (forward fill), later empty days are 0.  That equals
"reindex to every day, forward-fill at most N, then fill 0", uses a single
window stage over already-aggregated key-days, and the rows a key can
produce are bounded by its calendar length, not by its sales volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_list(key) -> list[str]:
    """A key is one column name or a list of names (e.g. run_id, stock_code)."""
    return [key] if isinstance(key, str) else list(key)


def date_expr(as_of) -> Column:
    """``as_of`` as a date Column: a literal date, or a Column (per-row as_of,
    e.g. the run's as_of_date carried as part of the key)."""
    if isinstance(as_of, Column):
        return as_of.cast("date")
    return F.lit(str(as_of)[:10]).cast("date")



def daily_demand(facts: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """AG6: units sold per (key, day), sales lines only (quantity > 0).

    ``keys`` restricts to a key set by a left-semi join (the reference's
    ``IN (list)``); a top-k key frame carries its row bound, so Catalyst
    broadcasts it without a hint.  Output: key, ds (date), y (double).
    """
    ks = key_list(key)
    f = facts.where(F.col("quantity") > 0)
    if keys is not None:
        f = f.join(keys.select(*ks), ks, "left_semi")
    return f.groupBy(*ks, F.to_date("invoice_date").alias("ds")) \
        .agg(F.sum("quantity").cast("double").alias("y"))


def forecastable(demand: DataFrame, key: str, as_of, min_sale_days: int = 14) -> DataFrame:
    """FI9: keys with at least ``min_sale_days`` sale days up to as_of."""
    ks = key_list(key)
    return demand.where(F.col("ds") <= date_expr(as_of)) \
        .groupBy(*ks).agg(F.count(F.lit(1)).alias("sale_days")) \
        .where(F.col("sale_days") >= min_sale_days).select(*ks, "sale_days")


def densify(demand: DataFrame, key: str, as_of, ffill_limit: int = 6,
            min_sale_days: int = 0) -> DataFrame:
    """TS1 + TS2: every day from a key's first sale to as_of.

    Keys first sold after as_of (possible in omniscient mode) have no
    series and are dropped, and so are keys with fewer than ``min_sale_days``
    sale days up to as_of (FI9): counted by a window in the partitioning the
    expansion uses, so eligibility needs no second pass.  Output: key, ds, y.
    """
    ks = key_list(key)
    end = date_expr(as_of)
    d = demand.where(F.col("ds") <= end)
    if min_sale_days > 1:
        d = d.withColumn("_days", F.count(F.lit(1)).over(Window.partitionBy(*ks))) \
            .where(F.col("_days") >= min_sale_days).drop("_days")
    w = Window.partitionBy(*ks).orderBy("ds")
    nxt = F.coalesce(F.lead("ds").over(w), F.date_add(end, 1))
    d = d.select(*ks, "ds", "y", F.datediff(nxt, F.col("ds")).alias("span"))
    d = d.select(*ks, "ds", "y", F.explode(F.sequence(F.lit(0), F.col("span") - 1)).alias("o"))
    filled = F.when(F.col("o") <= ffill_limit, F.col("y")).otherwise(F.lit(0.0))
    return d.select(*ks, F.date_add("ds", F.col("o")).alias("ds"), filled.alias("y"))


def series_stats(series: DataFrame, key,
                 min_tree_days: int = 56, min_nonzero: int = 14,
                 min_fit_rows: int = 42) -> DataFrame:
    """TS19 + FI9: n_days, nonzero_days, train_start/end and the model choice.

    ``model`` is 'gbt' when the key may use the tree model (>= 56 days,
    >= 14 non-zero days, and enough rows left after the 28 lag-warm-up rows
    for a 28-day holdout plus 14 training rows), else 'seasonal_naive'.
    """
    s = series.groupBy(*key_list(key)).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(F.col("y") > 0).alias("nonzero_days"),
        F.min("ds").alias("train_start"),
        F.max("ds").alias("train_end"))
    feature_rows = F.greatest(F.col("n_days") - 28, F.lit(0))
    tree = (F.col("n_days") >= min_tree_days) & (F.col("nonzero_days") >= min_nonzero) \
        & (feature_rows >= min_fit_rows)
    return s.withColumn("model", F.when(tree, "gbt").otherwise("seasonal_naive"))


def same_weekday(series: DataFrame, key: str, targets: DataFrame, n_weeks: int = 4) -> DataFrame:
    """TS3/JO13: for each (key, target day) the values 7, 14, ... days back
    that exist in the series, most recent first with their position.

    An equi-join on the shifted date; output: key, target, pos, y.
    """
    ks = key_list(key)
    t = targets.select(*ks, "target",
                       F.explode(F.sequence(F.lit(1), F.lit(n_weeks))).alias("w"))
    t = t.withColumn("ds", F.date_sub("target", F.col("w") * 7))
    j = t.join(series.select(*ks, "ds", "y"), ks + ["ds"])
    # at most n_weeks rows per (key, target): a bounded window partition
    pos = F.row_number().over(Window.partitionBy(*ks, "target").orderBy("w"))
    return j.select(*ks, "target", pos.alias("pos"), "y")

