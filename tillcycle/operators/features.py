"""Tree-model features over dense daily series (TS7-TS12).

Windows are partitioned by the key and ordered by day; a partition is one
key's calendar (bounded by the number of days, not by sales volume).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcycle.operators.demand import key_list

FEATURES = ["day_of_week", "week_of_year", "month", "lag_7", "lag_14", "lag_28",
            "rolling_mean_7", "rolling_mean_14", "rolling_std_7"]


def build_features(series: DataFrame, key) -> DataFrame:
    """TS7-TS11: calendar (Mon=0 weekday, ISO week, month), lags 7/14/28,
    rolling mean 7 (>= 3 values) and 14 (>= 7), rolling sample std 7 (>= 3,
    else 0) — rolling windows exclude the day itself; rows with a missing
    feature are dropped.  Output: *key, ds, y, features."""
    ks = key_list(key)
    w = Window.partitionBy(*ks).orderBy("ds")
    f7, f14 = w.rowsBetween(-7, -1), w.rowsBetween(-14, -1)
    y = F.col("y")
    out = series.select(
        *ks, "ds", "y",
        F.weekday("ds").cast("double").alias("day_of_week"),
        F.weekofyear("ds").cast("double").alias("week_of_year"),
        F.month("ds").cast("double").alias("month"),
        F.lag(y, 7).over(w).alias("lag_7"),
        F.lag(y, 14).over(w).alias("lag_14"),
        F.lag(y, 28).over(w).alias("lag_28"),
        F.when(F.count(y).over(f7) >= 3, F.avg(y).over(f7)).alias("rolling_mean_7"),
        F.when(F.count(y).over(f14) >= 7, F.avg(y).over(f14)).alias("rolling_mean_14"),
        F.when(F.count(y).over(f7) >= 3, F.coalesce(F.stddev_samp(y).over(f7), F.lit(0.0)))
        .otherwise(F.lit(0.0)).alias("rolling_std_7"),
    )
    return out.dropna(subset=FEATURES)


def split_holdout(features: DataFrame, key, holdout: int = 28) -> DataFrame:
    """TS12: mark the last ``holdout`` feature rows of each key as test."""
    ks = key_list(key)
    w = Window.partitionBy(*ks).orderBy(F.col("ds").desc())
    return features.withColumn("is_test", F.row_number().over(w) <= holdout)
