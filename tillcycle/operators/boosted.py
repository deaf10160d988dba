"""Model choice per key (TS17, TS18, FI9, AG15, AG16), and the pooled boosted-tree baseline.

Forecasts come from one model per key (`operators.key_trees`).  The baseline is one
model for all keys: targets and level-type
features are divided by the key's training mean ("level"), so keys of very
different sizes share trees; predictions are scaled back per key.  Training
is a distributed ``pyspark.ml`` GBT fit over every eligible key at once.

The recursive forecast keeps one row per key: the last 28 values (enough
for every lag and rolling window) and the predictions so far, both as
arrays.  Each of the ``horizon`` steps is a narrow projection + model
transform (no shuffle); the state is checkpointed into the shared
checkpoint folder every 7 steps so the lineage stays short and a lost
executor only recomputes the last few steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.operators.demand import date_expr, key_list, series_stats
from tillcycle.operators.features import build_features, split_holdout
from tillcycle.operators.key_trees import fit_key_trees, key_forecast
from tillcycle.operators.naive import naive_backtest, naive_forecast
from tillcycle.session import cut_lineage

#: Partitions of the training rows: keys are dealt by hash to this many, whatever the session's
#: settings, since row sampling is seeded per partition.  Raise it with the number of keys.
FIT_PARTITIONS = 8
SCALED = ["lag_7", "lag_14", "lag_28", "rolling_mean_7", "rolling_mean_14", "rolling_std_7"]

# Reference hyper-parameters (300 trees, rate 0.05, 15 leaves ~ depth 4,
# min 5 rows per leaf, 0.8 row and column sampling, seed 42).
GBT_PARAMS = dict(maxIter=300, stepSize=0.05, maxDepth=4, minInstancesPerNode=5,
                  subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)


def _assembled(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    cols = [F.col(c) for c in ("day_of_week", "week_of_year", "month")] + \
        [(F.col(c) / F.col("level")).alias(c) for c in SCALED]
    x = df.select("*", *[c.alias("_f_" + str(i)) for i, c in enumerate(cols)])
    va = VectorAssembler(inputCols=[f"_f_{i}" for i in range(len(cols))], outputCol="fv")
    return va.transform(x).drop(*[f"_f_{i}" for i in range(len(cols))])


def fit_boosted(features: DataFrame, key, holdout: int = 28, params: dict | None = None,
                partitions: int = FIT_PARTITIONS):
    """TS12-TS15: fit on all but each key's last ``holdout`` feature rows.

    Returns (model, metrics) with metrics: *key, level, mape, rmse,
    residual_std (population std of training residuals, predictions
    floored at 0).  Returns (None, None) when there is nothing to fit.
    """
    from pyspark.ml.regression import GBTRegressor

    ks = key_list(key)
    f = split_holdout(features, ks, holdout)
    lv = f.where(~F.col("is_test")).groupBy(*ks).agg(F.avg("y").alias("_m"))
    lv = lv.select(*ks, F.when(F.col("_m") > 0, F.col("_m")).otherwise(F.lit(1.0)).alias("level"))
    f = f.join(lv, ks)
    data = _assembled(f).withColumn("label", F.col("y") / F.col("level"))
    # The same rows in the same order in the same partitions on every run: the model must not
    # depend on how many tasks the session happens to use.
    data = data.repartition(partitions, *ks).sortWithinPartitions(*ks, "ds").persist()
    train = data.where(~F.col("is_test"))
    if train.isEmpty():
        data.unpersist()
        return None, None
    model = GBTRegressor(featuresCol="fv", labelCol="label", predictionCol="p",
                         **(params or GBT_PARAMS)).fit(train)
    pred = model.transform(data).withColumn(
        "pred", F.greatest(F.col("p") * F.col("level"), F.lit(0.0)))
    e = F.col("y") - F.col("pred")
    test = F.col("is_test")
    m = pred.groupBy(*ks, "level").agg(
        F.avg(F.when(test & (F.col("y") > 0), F.abs(e) / F.col("y"))).alias("mape"),
        F.sqrt(F.avg(F.when(test, e * e))).alias("rmse"),
        F.stddev_pop(F.when(~test, e)).alias("residual_std"))
    m = cut_lineage(m)          # one row per key, written; the training cache can go
    data.unpersist()
    return model, m


def _last_values(series: DataFrame, ks: list[str], as_of, n: int = 28) -> DataFrame:
    end = date_expr(as_of)
    s = series.where(F.col("ds") <= end)
    return s.groupBy(*ks).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("ds") > F.date_sub(end, n),
                                                       F.struct("ds", "y")))),
                    lambda e: e["y"]).alias("hist"),
        F.sum("y").alias("tot"), F.count(F.lit(1)).alias("cnt"))


def recursive_forecast(model, series: DataFrame, metrics: DataFrame, key, as_of,
                       horizon: int = 28, checkpoint_every: int = 7) -> DataFrame:
    """TS16: day-by-day forecast where each prediction feeds later lags.

    A lag that falls before the series start uses the running mean of the
    extended series; rolling features use the last 7 / 14 extended values.
    Band = +-max(1.28 residual_std, 0.5); lower floored at 0, upper not.
    Output: *key, ds, yhat, yhat_lower, yhat_upper.
    """
    ks = key_list(key)
    end = date_expr(as_of)
    st = _last_values(series, ks, as_of).join(metrics.select(*ks, "level", "residual_std"), ks)
    st = st.withColumn("preds", F.array().cast("array<double>"))
    for i in range(1, horizon + 1):
        h = F.col("hist")
        n = F.size(h)
        mean_ext = F.col("tot") / F.col("cnt")

        def lag(k, h=h, n=n, mean_ext=mean_ext):
            return F.when(n >= k, F.element_at(h, n - k + 1)).otherwise(mean_ext)

        last7 = F.slice(h, F.greatest(n - 6, F.lit(1)), 7)
        last14 = F.slice(h, F.greatest(n - 13, F.lit(1)), 14)
        mean7 = F.aggregate(last7, F.lit(0.0), lambda a, x: a + x) / F.size(last7)
        ss7 = F.aggregate(last7, F.lit(0.0), lambda a, x: a + (x - mean7) * (x - mean7))
        target = F.date_add(end, i)
        step = st.select(
            "*",
            F.weekday(target).cast("double").alias("day_of_week"),
            F.weekofyear(target).cast("double").alias("week_of_year"),
            F.month(target).cast("double").alias("month"),
            lag(7).alias("lag_7"), lag(14).alias("lag_14"), lag(28).alias("lag_28"),
            mean7.alias("rolling_mean_7"),
            (F.aggregate(last14, F.lit(0.0), lambda a, x: a + x) / F.size(last14))
            .alias("rolling_mean_14"),
            F.when(F.size(last7) > 1, F.sqrt(ss7 / (F.size(last7) - 1))).otherwise(F.lit(0.0))
            .alias("rolling_std_7"))
        scored = model.transform(_assembled(step))
        yhat = F.greatest(F.col("p") * F.col("level"), F.lit(0.0))
        st = scored.select(
            *ks, "level", "residual_std",
            F.slice(F.concat(F.col("hist"), F.array(yhat)), -28, 28).alias("hist"),
            (F.col("tot") + yhat).alias("tot"), (F.col("cnt") + 1).alias("cnt"),
            F.concat(F.col("preds"), F.array(yhat)).alias("preds"))
        if i % checkpoint_every == 0 and i < horizon:
            st = cut_lineage(st)
    half = F.greatest(F.col("residual_std") * 1.28, F.lit(0.5))
    out = st.select(*ks, "residual_std", F.posexplode("preds").alias("pos", "yhat"))
    return out.select(
        *ks, F.date_add(end, F.col("pos") + 1).alias("ds"),
        F.round("yhat", 2).alias("yhat"),
        F.round(F.greatest(F.col("yhat") - half, F.lit(0.0)), 2).alias("yhat_lower"),
        F.round(F.col("yhat") + half, 2).alias("yhat_upper"))


def forecast_all(series: DataFrame, key, as_of, horizon: int = 28, params=None,
                 pooled: bool = False) -> dict[str, DataFrame]:
    """TS17/TS18/AG15: tree model for eligible keys, seasonal-naive for the
    rest (and for everything if no key is eligible).

    One model per key (`operators.key_trees`, ``params``: TreeParams), or, as a baseline,
    the ``pooled`` one over all keys (``params``: those of the Spark ML fit).
    Returns forecast (*key, ds, yhat, yhat_lower, yhat_upper, model),
    backtest (*key, mape, rmse, model), stats and summary (dominant model).
    """
    ks = key_list(key)
    # the series feeds statistics, features, both models and the recursion:
    # one row per key-day (bounded by keys x calendar days), written once
    series = cut_lineage(series)
    stats = cut_lineage(series_stats(series, ks))
    tree_keys = stats.where(F.col("model") == "gbt").select(*ks)
    trees = not tree_keys.isEmpty()
    naive_keys = stats.where(F.col("model") != "gbt").select(*ks) if trees else stats.select(*ks)
    naive_series = series.join(naive_keys, ks, "left_semi")
    fc = naive_forecast(naive_series, ks, as_of, horizon).withColumn("model", F.lit("seasonal_naive"))
    bt = naive_backtest(naive_series, ks, as_of).withColumn("model", F.lit("seasonal_naive"))
    if trees:
        tree_series = series.join(tree_keys, ks, "left_semi")
        features = build_features(tree_series, ks)
        if pooled:
            model, metrics = fit_boosted(features, ks, params=params)
            tf = recursive_forecast(model, tree_series, metrics, ks, as_of, horizon)
        else:
            models, metrics = fit_key_trees(features, ks, params=params)
            tf = key_forecast(models, tree_series, metrics, ks, as_of, horizon)
        tb = metrics.select(*ks, F.round("mape", 6).alias("mape"), F.round("rmse", 6).alias("rmse"),
                            F.lit("gbt").alias("model"))
        fc, bt = fc.unionByName(tf.withColumn("model", F.lit("gbt"))), bt.unionByName(tb)
    used = bt.select(*ks, "model")
    summary = used.agg(F.count(F.lit(1)).alias("n_keys"),
                       F.count_if(F.col("model") == "gbt").alias("n_gbt")) \
        .withColumn("model_name", F.when(F.col("n_gbt") >= F.col("n_keys") / 2, "gbt")
                    .otherwise("seasonal_naive"))
    return {"forecast": fc, "backtest": bt, "stats": stats, "summary": summary}
