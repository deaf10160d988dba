"""Seasonal-naive forecast and holdout backtest (TS3-TS6, AG22).

Plan shape: one aggregation per key over its dense series collects only the
most recent 56 days into a date->value map (a fixed bound per key, whatever
the data size), together with the whole-series fallbacks (mean of positive
days, sample std, length).  Forecast days and holdout days are then pure
array/map expressions on that one row per key: no join, no second shuffle.

Same-weekday rule: for a target day the candidates are the values 7, 14,
21 and 28 days earlier that exist in the (training) series; the found ones
get weights 2, 2, 1, 1 by their position among the found values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcycle.operators.demand import date_expr, key_list

WINDOW_DAYS = 56  # 28 holdout days + 28 days of same-weekday look-back


def _recent_state(series: DataFrame, key, as_of, holdout: int = 28) -> DataFrame:
    end = date_expr(as_of)
    recent = F.col("ds") > F.date_sub(end, WINDOW_DAYS)
    train = F.col("ds") <= F.date_sub(end, holdout)
    return series.where(F.col("ds") <= end).groupBy(*key_list(key)).agg(
        F.map_from_entries(F.collect_list(F.when(recent, F.struct("ds", "y")))).alias("m"),
        F.count(F.lit(1)).alias("n"),
        F.min("ds").alias("first_ds"),
        F.avg(F.when(F.col("y") > 0, F.col("y"))).alias("mean_pos"),
        F.stddev_samp("y").alias("sd_all"),
        F.avg(F.when((F.col("y") > 0) & train, F.col("y"))).alias("mean_pos_train"),
    )


def _found(m: Column, target: Column, last_visible: Column, n_weeks: int = 4) -> Column:
    """Values at target-7w (w = 1..n) present in the map and <= last_visible."""
    vals = F.transform(
        F.sequence(F.lit(1), F.lit(n_weeks)),
        lambda w: F.when(F.date_sub(target, w * 7) <= last_visible,
                         F.try_element_at(m, F.date_sub(target, w * 7))))
    return F.filter(vals, lambda x: x.isNotNull())


def _weighted_mean(vals: Column) -> Column:
    wts = F.transform(vals, lambda x, i: F.when(i < 2, F.lit(2.0)).otherwise(F.lit(1.0)))
    num = F.aggregate(F.zip_with(vals, wts, lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)
    den = F.aggregate(wts, F.lit(0.0), lambda a, b: a + b)
    return num / den


def _pop_std(vals: Column) -> Column:
    n = F.size(vals)
    mean = F.aggregate(vals, F.lit(0.0), lambda a, b: a + b) / n
    ss = F.aggregate(vals, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.sqrt(ss / n)


def naive_forecast(series: DataFrame, key, as_of, horizon: int = 28) -> DataFrame:
    """TS4 + TS5: ``horizon`` days after as_of for every key in ``series``.

    yhat = weighted same-weekday mean, or the mean of positive days when no
    same-weekday value exists (0 if none); band = max(1.5 sd, 0.5) with sd
    the population std of the found values (0.2 |yhat| for one value, the
    sample std of the series when none).  All three floored at 0, 2 dp.
    Output: key, ds, yhat, yhat_lower, yhat_upper.
    """
    ks = key_list(key)
    end = date_expr(as_of)
    st = _recent_state(series, key, as_of)
    st = st.select(*ks, "m", "n", "mean_pos", "sd_all",
                   F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("i"))
    st = st.withColumn("target", F.date_add(end, F.col("i")))
    st = st.withColumn("vals", _found(F.col("m"), F.col("target"), end))
    k = F.size("vals")
    yhat = F.when(k > 0, _weighted_mean(F.col("vals"))) \
        .otherwise(F.coalesce(F.col("mean_pos"), F.lit(0.0)))
    sd = F.when(k > 1, _pop_std(F.col("vals"))) \
        .when(k == 1, F.abs(yhat) * 0.2) \
        .otherwise(F.when(F.col("n") > 1, F.col("sd_all")).otherwise(F.lit(1.0)))
    out = st.select(*ks, F.col("target").alias("ds"), yhat.alias("raw"), sd.alias("sd"))
    half = F.greatest(F.col("sd") * 1.5, F.lit(0.5))
    return out.select(
        *ks, "ds",
        F.round(F.greatest(F.col("raw"), F.lit(0.0)), 2).alias("yhat"),
        F.round(F.greatest(F.col("raw") - half, F.lit(0.0)), 2).alias("yhat_lower"),
        F.round(F.greatest(F.col("raw") + half, F.lit(0.0)), 2).alias("yhat_upper"))


def naive_backtest(series: DataFrame, key, as_of, holdout: int = 28,
                   min_train: int = 14) -> DataFrame:
    """TS6: hold out the last ``holdout`` days, predict each from training
    values only, score MAPE (days with actual > 0) and RMSE (all days).

    Keys shorter than holdout + min_train days get NULL metrics.
    Output: key, mape, rmse (6 dp).
    """
    ks = key_list(key)
    end = date_expr(as_of)
    train_end = F.date_sub(end, holdout)
    st = _recent_state(series, key, as_of, holdout)

    def day(j):
        target = F.date_sub(end, holdout - 1 - j)
        vals = _found(F.col("m"), target, train_end)
        pred = F.when(F.size(vals) > 0, _weighted_mean(vals)) \
            .otherwise(F.coalesce(F.col("mean_pos_train"), F.lit(0.0)))
        actual = F.try_element_at(F.col("m"), target)
        return F.struct(actual.alias("a"), F.greatest(pred, F.lit(0.0)).alias("p"))

    days = F.transform(F.sequence(F.lit(0), F.lit(holdout - 1)), day)
    st = st.select(*ks, "n", days.alias("d"))
    pos = F.filter("d", lambda e: e["a"] > 0)
    ape = F.aggregate(pos, F.lit(0.0), lambda acc, e: acc + F.abs(e["a"] - e["p"]) / e["a"])
    sq = F.aggregate(F.col("d"), F.lit(0.0),
                     lambda acc, e: acc + (e["a"] - e["p"]) * (e["a"] - e["p"]))
    ok = F.col("n") >= holdout + min_train
    mape = F.when(ok & (F.size(pos) > 0), ape / F.size(pos))
    rmse = F.when(ok, F.sqrt(sq / F.size("d")))
    return st.select(*ks, F.round(mape, 6).alias("mape"), F.round(rmse, 6).alias("rmse"))
