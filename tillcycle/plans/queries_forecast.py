"""Registered queries: dense series, seasonal-naive forecast and backtest.

Two grains: ``brand`` (25 long series, via the part dimension) and the
top-20 SKUs by visible revenue (sparse series that exercise gap filling).
"""

from __future__ import annotations

from tillcycle.operators import kpis as K
from tillcycle.operators.demand import daily_demand, densify, series_stats
from tillcycle.operators.naive import naive_backtest, naive_forecast
from tillcycle.plans.queries_core import (
    AS_OF, DEMAND_COLUMNS, PREFIX, RANK_COLUMNS, TOP20_SQL, visible_facts)
from tillcycle.plans.registry import register

D_AS_OF = f"DATE '{AS_OF}'"


def brand_series(spark, d):
    vis = visible_facts(spark, d, ["invoice_date", "quantity"], part_attrs={"brand": "p_brand"})
    return densify(daily_demand(vis, "brand"), "brand", AS_OF, min_sale_days=14)


def top20_series(spark, d):
    vis = visible_facts(spark, d, RANK_COLUMNS)
    top = K.top_keys(vis, "stock_code", 20)
    return densify(daily_demand(vis, "stock_code", keys=top), "stock_code", AS_OF, min_sale_days=14)


def _series_sql(key_expr: str, key: str, restrict: str = "") -> str:
    """CTE text ending in ``series(key, ds, y)`` (dense, forward-filled)."""
    return f""",
dem AS (SELECT {key_expr} AS {key}, CAST(invoice_date AS DATE) AS ds, CAST(SUM(quantity) AS DOUBLE) AS y
        FROM visible WHERE quantity > 0 {restrict} GROUP BY 1, 2),
elig AS (SELECT {key}, MIN(ds) AS first_ds FROM dem GROUP BY {key} HAVING COUNT(*) >= 14),
cal AS (SELECT {key}, CAST(UNNEST(generate_series(first_ds, {D_AS_OF}, INTERVAL 1 DAY)) AS DATE) AS ds FROM elig),
j AS (SELECT cal.{key}, cal.ds, dem.y FROM cal LEFT JOIN dem ON cal.{key} = dem.{key} AND cal.ds = dem.ds),
series AS (SELECT {key}, ds, COALESCE(LAST_VALUE(y IGNORE NULLS) OVER (
             PARTITION BY {key} ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0.0) AS y FROM j)"""


BRAND_SERIES = PREFIX + _series_sql("brand", "brand")
TOP20_SERIES = PREFIX + ",\n" + TOP20_SQL + _series_sql(
    "stock_code", "stock_code", "AND stock_code IN (SELECT stock_code FROM top20)")


def _stats_sql(prefix: str, key: str) -> str:
    return prefix + f"""
SELECT {key}, COUNT(*) AS n_days, COUNT(*) FILTER (WHERE y > 0) AS nonzero_days,
       MIN(ds) AS train_start, MAX(ds) AS train_end,
       CASE WHEN COUNT(*) >= 56 AND COUNT(*) FILTER (WHERE y > 0) >= 14 AND COUNT(*) - 28 >= 42
            THEN 'gbt' ELSE 'seasonal_naive' END AS model
FROM series GROUP BY {key}"""


def _on(a: str, b: str, keys: list[str]) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)


def forecast_sql(prefix: str, keys, asof: str = D_AS_OF) -> str:
    """Seasonal-naive forecast over CTE ``series(keys..., ds, y)``; ``asof``
    is a date literal or a key column holding each series' as_of."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    K = ", ".join(keys)
    tk = ", ".join(f"t.{k}" for k in keys)
    a_st = asof if asof.startswith("DATE") else f"st.{asof}"
    return prefix + f""",
st AS (SELECT {K}, AVG(y) FILTER (WHERE y > 0) AS mean_pos, STDDEV_SAMP(y) AS sd, COUNT(*) AS n
       FROM series GROUP BY {K}),
tgt AS (SELECT {", ".join(f"st.{k}" for k in keys)}, r.i, CAST({a_st} + CAST(r.i AS INTEGER) AS DATE) AS target
        FROM st, range(1, 29) r(i)),
recent AS (SELECT {K}, y, date_diff('day', {asof}, ds) AS back FROM series WHERE ds > CAST({asof} - 28 AS DATE)),
lk AS (SELECT {K}, back + 7 * w AS i, w, y FROM (SELECT *, unnest([1, 2, 3, 4]) AS w FROM recent)
       WHERE back + 7 * w BETWEEN 1 AND 28),
pos AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K}, i ORDER BY w) AS p FROM lk),
ag AS (SELECT {K}, i, COUNT(*) AS nf,
              SUM(y * CASE WHEN p <= 2 THEN 2 ELSE 1 END) / SUM(CASE WHEN p <= 2 THEN 2 ELSE 1 END) AS wavg,
              STDDEV_POP(y) AS sdp
       FROM pos GROUP BY {K}, i),
f AS (SELECT {tk}, t.target,
             CASE WHEN ag.nf IS NULL THEN COALESCE(st.mean_pos, 0.0) ELSE ag.wavg END AS yhat,
             CASE WHEN ag.nf IS NULL THEN (CASE WHEN st.n > 1 THEN st.sd ELSE 1.0 END)
                  WHEN ag.nf = 1 THEN ABS(ag.wavg) * 0.2 ELSE ag.sdp END AS sd
      FROM tgt t LEFT JOIN ag ON {_on("t", "ag", keys)} AND t.i = ag.i JOIN st ON {_on("t", "st", keys)}),
fc AS (SELECT {K}, target AS ds, ROUND(GREATEST(yhat, 0), 2) AS yhat,
       ROUND(GREATEST(yhat - GREATEST(1.5 * sd, 0.5), 0), 2) AS yhat_lower,
       ROUND(GREATEST(yhat + GREATEST(1.5 * sd, 0.5), 0), 2) AS yhat_upper
FROM f)"""


def backtest_sql(prefix: str, keys, asof: str = D_AS_OF) -> str:
    """Naive holdout backtest over CTE ``series``; defines CTE ``bt``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    K = ", ".join(keys)
    return prefix + f""",
tr AS (SELECT * FROM series WHERE ds <= CAST({asof} - 28 AS DATE)),
te AS (SELECT * FROM series WHERE ds > CAST({asof} - 28 AS DATE)),
nn AS (SELECT {K}, COUNT(*) AS n FROM series GROUP BY {K}),
mp AS (SELECT {K}, AVG(y) FILTER (WHERE y > 0) AS mean_pos FROM tr GROUP BY {K}),
lk2 AS (SELECT {", ".join(f"te.{k}" for k in keys)}, te.ds, w.w, tr.y FROM te, range(1, 5) w(w), tr
       WHERE {_on("tr", "te", keys)} AND tr.ds = CAST(te.ds - CAST(7 * w.w AS INTEGER) AS DATE)),
pos2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K}, ds ORDER BY w) AS p FROM lk2),
ag2 AS (SELECT {K}, ds,
              SUM(y * CASE WHEN p <= 2 THEN 2 ELSE 1 END) / SUM(CASE WHEN p <= 2 THEN 2 ELSE 1 END) AS wavg
       FROM pos2 GROUP BY {K}, ds),
pr AS (SELECT {", ".join(f"te.{k}" for k in keys)}, te.y AS a,
              GREATEST(COALESCE(ag2.wavg, mp.mean_pos, 0.0), 0) AS p
       FROM te LEFT JOIN ag2 ON {_on("te", "ag2", keys)} AND te.ds = ag2.ds
       LEFT JOIN mp ON {_on("te", "mp", keys)}),
sc AS (SELECT {K}, AVG(ABS(a - p) / a) FILTER (WHERE a > 0) AS mape, SQRT(AVG((a - p) * (a - p))) AS rmse
       FROM pr GROUP BY {K}),
bt AS (SELECT {", ".join(f"nn.{k}" for k in keys)}, CASE WHEN nn.n >= 42 THEN ROUND(sc.mape, 6) END AS mape,
       CASE WHEN nn.n >= 42 THEN ROUND(sc.rmse, 6) END AS rmse
FROM nn LEFT JOIN sc ON {_on("nn", "sc", keys)})"""


def _forecast_sql(prefix: str, key: str) -> str:
    return forecast_sql(prefix, key) + "\nSELECT * FROM fc"


def _backtest_sql(prefix: str, key: str) -> str:
    return backtest_sql(prefix, key) + "\nSELECT * FROM bt"


@register("dense_series_brand", "TS1 TS2 FI9", BRAND_SERIES + "\nSELECT brand, ds, y FROM series")
def q_dense_brand(spark, d):
    return brand_series(spark, d)


@register("dense_series_top20", "TS1 TS2 FI9 JO4", TOP20_SERIES + "\nSELECT stock_code, ds, y FROM series")
def q_dense_top20(spark, d):
    return top20_series(spark, d)


@register("series_stats_brand", "TS19 FI9 TS17", _stats_sql(BRAND_SERIES, "brand"))
def q_stats_brand(spark, d):
    return series_stats(brand_series(spark, d), "brand")


@register("series_stats_top20", "TS19 FI9 TS17", _stats_sql(TOP20_SERIES, "stock_code"))
def q_stats_top20(spark, d):
    return series_stats(top20_series(spark, d), "stock_code")


@register("naive_forecast_brand", "TS3 TS4 TS5 JO13", _forecast_sql(BRAND_SERIES, "brand"))
def q_naive_brand(spark, d):
    return naive_forecast(brand_series(spark, d), "brand", AS_OF, 28)


@register("naive_forecast_top20", "TS3 TS4 TS5 JO13", _forecast_sql(TOP20_SERIES, "stock_code"))
def q_naive_top20(spark, d):
    return naive_forecast(top20_series(spark, d), "stock_code", AS_OF, 28)


@register("naive_backtest_brand", "TS6 AG22", _backtest_sql(BRAND_SERIES, "brand"))
def q_backtest_brand(spark, d):
    return naive_backtest(brand_series(spark, d), "brand", AS_OF)


@register("naive_backtest_top20", "TS6 AG22", _backtest_sql(TOP20_SERIES, "stock_code"))
def q_backtest_top20(spark, d):
    return naive_backtest(top20_series(spark, d), "stock_code", AS_OF)


# ------------------------------------------------------------ tree features / model
def _features_sql(prefix: str, key: str) -> str:
    return prefix + f""",
fe AS (
  SELECT {key}, ds, y, CAST(isodow(ds) - 1 AS DOUBLE) AS day_of_week, CAST(weekofyear(ds) AS DOUBLE) AS week_of_year,
         CAST(month(ds) AS DOUBLE) AS month,
         LAG(y, 7) OVER w AS lag_7, LAG(y, 14) OVER w AS lag_14, LAG(y, 28) OVER w AS lag_28,
         CASE WHEN COUNT(y) OVER w7 >= 3 THEN AVG(y) OVER w7 END AS rolling_mean_7,
         CASE WHEN COUNT(y) OVER w14 >= 7 THEN AVG(y) OVER w14 END AS rolling_mean_14,
         CASE WHEN COUNT(y) OVER w7 >= 3 THEN COALESCE(STDDEV_SAMP(y) OVER w7, 0.0) ELSE 0.0 END AS rolling_std_7
  FROM series
  WINDOW w AS (PARTITION BY {key} ORDER BY ds),
         w7 AS (PARTITION BY {key} ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
         w14 AS (PARTITION BY {key} ORDER BY ds ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT {key}, ds, y, day_of_week, week_of_year, month, lag_7, lag_14, lag_28,
       ROUND(rolling_mean_7, 6) AS rolling_mean_7, ROUND(rolling_mean_14, 6) AS rolling_mean_14,
       ROUND(rolling_std_7, 6) AS rolling_std_7
FROM fe WHERE lag_28 IS NOT NULL AND rolling_mean_7 IS NOT NULL AND rolling_mean_14 IS NOT NULL
  AND lag_7 IS NOT NULL AND lag_14 IS NOT NULL"""


def _rounded_features(df):
    from pyspark.sql import functions as F
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("rolling") else F.col(c)
                       for c in df.columns])


@register("features_brand", "TS7 TS8 TS9 TS10 TS11", _features_sql(BRAND_SERIES, "brand"))
def q_features_brand(spark, d):
    from tillcycle.operators.features import build_features
    return _rounded_features(build_features(brand_series(spark, d), "brand"))


@register("features_top20", "TS7 TS8 TS9 TS10 TS11", _features_sql(TOP20_SERIES, "stock_code"))
def q_features_top20(spark, d):
    from tillcycle.operators.features import build_features
    return _rounded_features(build_features(top20_series(spark, d), "stock_code"))


@register("forecast_summary_top20", "AG15 AG16 FI9 TS17 Q7 Q8", TOP20_SERIES + """,
st AS (SELECT stock_code, CASE WHEN COUNT(*) >= 56 AND COUNT(*) FILTER (WHERE y > 0) >= 14 AND COUNT(*) - 28 >= 42
                              THEN 'gbt' ELSE 'seasonal_naive' END AS model FROM series GROUP BY stock_code),
top5 AS (SELECT stock_code FROM top20 WHERE rank <= 5),
ch AS (SELECT st.* FROM st JOIN top5 ON st.stock_code = top5.stock_code),
dr AS (SELECT COUNT(*) AS n FROM dem)
SELECT CAST(COUNT(ch.stock_code) AS BIGINT) AS n_keys,
       CAST(COUNT(*) FILTER (WHERE ch.model = 'gbt') AS BIGINT) AS n_gbt,
       CASE WHEN COUNT(*) FILTER (WHERE ch.model = 'gbt') >= COUNT(ch.stock_code) / 2.0 THEN 'gbt' ELSE 'seasonal_naive' END AS model_name,
       CAST(FLOOR(MAX(dr.n) / GREATEST(MAX((SELECT COUNT(*) FROM top5)), 1)) AS BIGINT) AS train_window_days
FROM dr LEFT JOIN ch ON true""")
def q_forecast_summary(spark, d):
    """AG15/AG16 for the reference's shape: top 20 ranked, top 5 forecast."""
    from pyspark.sql import functions as F
    vis = visible_facts(spark, d, RANK_COLUMNS)
    top = K.top_keys(vis, "stock_code", 20)
    dem = daily_demand(vis, "stock_code", keys=top)
    top5 = top.where(F.col("rank") <= 5).select("stock_code")
    series = densify(dem.join(top5, "stock_code", "left_semi"), "stock_code", AS_OF, min_sale_days=14)
    st = series_stats(series, "stock_code")
    ch = st.agg(F.count(F.lit(1)).alias("n_keys"),
                F.count_if(F.col("model") == "gbt").alias("n_gbt"))
    n_dem = dem.agg(F.count(F.lit(1)).alias("n"))
    n_top5 = top5.agg(F.count(F.lit(1)).alias("k"))
    # three one-row aggregates combined by a union + max, not a join
    parts = ch.select("n_keys", "n_gbt", F.lit(None).cast("long").alias("n"),
                      F.lit(None).cast("long").alias("k")) \
        .unionByName(n_dem.select(F.lit(None).cast("long").alias("n_keys"),
                                  F.lit(None).cast("long").alias("n_gbt"), "n",
                                  F.lit(None).cast("long").alias("k"))) \
        .unionByName(n_top5.select(F.lit(None).cast("long").alias("n_keys"),
                                   F.lit(None).cast("long").alias("n_gbt"),
                                   F.lit(None).cast("long").alias("n"), "k"))
    one = parts.agg(*[F.max(c).alias(c) for c in ("n_keys", "n_gbt", "n", "k")])
    return one.select(
        "n_keys", "n_gbt",
        F.when(F.col("n_gbt") >= F.col("n_keys") / 2, "gbt").otherwise("seasonal_naive")
        .alias("model_name"),
        F.floor(F.col("n") / F.greatest(F.col("k"), F.lit(1))).cast("long").alias("train_window_days"))


@register("gbt_forecast_brand", "TS12 TS13 TS14 TS15 TS16 TS17 TS18")
def q_gbt_brand(spark, d):
    from tillcycle.operators.boosted import forecast_all
    out = forecast_all(brand_series(spark, d), "brand", AS_OF, 28)
    return out["forecast"]


def _first_split_sql() -> str:
    """The gain of the first tree's first split, by all cuts of its columns' bins."""
    from tillcycle.operators.features import FEATURES
    from tillcycle.operators.key_trees import TreeParams, tree_columns
    p = TreeParams()
    columns = [FEATURES[f] for f in tree_columns(p, 0, len(FEATURES))]
    longs = " UNION ALL ".join(f"SELECT brand, y, '{c}' AS f, CAST({c} AS DOUBLE) AS x FROM train" for c in columns)
    rows = _features_sql(BRAND_SERIES, "brand")
    for c in ("rolling_mean_7", "rolling_mean_14", "rolling_std_7"):
        rows = rows.replace(f"ROUND({c}, 6) AS {c}", f"ROUND({c}, 9) AS {c}")
    rows = rows.replace("\nSELECT brand, ds, y, day_of_week", ",\nrows AS (SELECT brand, ds, y, day_of_week", 1)
    return rows + f"""),
train AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY brand ORDER BY ds DESC) AS back FROM rows) WHERE back > 28),
mean AS (SELECT brand, AVG(y) AS base, COUNT(*) AS n FROM train GROUP BY brand),
long AS ({longs}),
ranked AS (SELECT l.brand, f, y - base AS r, DENSE_RANK() OVER (PARTITION BY l.brand, f ORDER BY x) - 1 AS k FROM long l JOIN mean m ON l.brand = m.brand),
sized AS (SELECT *, MAX(k) OVER (PARTITION BY brand, f) + 1 AS nd FROM ranked),
bins AS (SELECT brand, f, CASE WHEN nd <= {p.bins} THEN k ELSE k * {p.bins} // nd END AS b, SUM(r) AS g, COUNT(*) AS c FROM sized GROUP BY brand, f, b),
cum AS (SELECT brand, f, SUM(g) OVER w AS g, SUM(c) OVER w AS c FROM bins WINDOW w AS (PARTITION BY brand, f ORDER BY b)),
gains AS (SELECT cum.brand, MAX(g * g / c + (0 - g) * (0 - g) / (n - c)) AS gain FROM cum JOIN mean ON cum.brand = mean.brand
          WHERE c >= {p.min_rows} AND n - c >= {p.min_rows} GROUP BY cum.brand)
SELECT m.brand, CAST(m.n AS BIGINT) AS n_train, ROUND(base, 6) AS base, ROUND(gain, 2) AS gain
FROM mean m JOIN gains ON m.brand = gains.brand"""


@register("key_tree_first_split_brand", "TS12 TS13", _first_split_sql())
def q_first_split_brand(spark, d):
    """Each brand's model is its own: rows trained on, start value, and the gain of the first
    split of its first tree, computed from the stored model's cut."""
    from pyspark.sql import functions as F
    from tillcycle.operators.features import FEATURES, build_features, split_holdout
    from tillcycle.operators.key_trees import TreeParams, fit_key_trees
    from tillcycle.session import cut_lineage
    # means that differ by the order of their sums alone are one value in any engine
    features = cut_lineage(build_features(brand_series(spark, d), "brand").withColumns(
        {c: F.round(c, 9) for c in ("rolling_mean_7", "rolling_mean_14", "rolling_std_7")}))
    models, _ = fit_key_trees(features, "brand", params=TreeParams(rounds=1))
    train = split_holdout(features, "brand").where(~F.col("is_test"))
    root = models.select("brand", "base", F.col("feature")[0].alias("f"), F.col("threshold")[0].alias("cut"))
    x = F.element_at(F.array(*[F.col(c).cast("double") for c in FEATURES]), F.col("f") + 1)
    r, low = F.col("y") - F.col("base"), x <= F.col("cut")
    # one row a brand, an equi-join
    sums = train.join(root.where("f >= 0"), "brand").groupBy("brand", "base").agg(
        F.count(F.lit(1)).alias("n_train"), F.sum(F.when(low, r)).alias("g"), F.count_if(low).alias("n_low"),
        F.sum(F.when(~low, r)).alias("h"))
    return sums.select("brand", "n_train", F.round("base", 6).alias("base"), F.round(
        F.col("g") ** 2 / F.col("n_low") + F.col("h") ** 2 / (F.col("n_train") - F.col("n_low")), 2).alias("gain"))


@register("grouped_stats_brand", "TS19 FI9 TS17", _stats_sql(BRAND_SERIES, "brand"))
def q_grouped_stats_brand(spark, d):
    """A user's function over each brand's days that gives what `series_stats` does."""
    import pandas as pd
    from tillcycle.operators.grouped import apply_per_key
    from tillcycle.session import cut_lineage

    def stats(days: pd.DataFrame) -> pd.DataFrame:
        n, sold = len(days), int((days["y"] > 0).sum())
        tree = n >= 56 and sold >= 14 and n - 28 >= 42
        return pd.DataFrame({"n_days": [n], "nonzero_days": [sold], "train_start": [days["ds"].iloc[0]],
                             "train_end": [days["ds"].iloc[-1]], "model": ["gbt" if tree else "seasonal_naive"]})

    return apply_per_key(cut_lineage(brand_series(spark, d)), "brand", stats,
                         "n_days long, nonzero_days long, train_start date, train_end date, model string")


@register("same_weekday_brand", "TS3 JO13", BRAND_SERIES + f""",
tgt AS (SELECT DISTINCT brand, CAST({D_AS_OF} + CAST(r.i AS INTEGER) AS DATE) AS target
        FROM series, range(1, 29) r(i)),
lk AS (SELECT t.brand, t.target, w.w, s.y FROM tgt t, range(1, 5) w(w), series s
       WHERE s.brand = t.brand AND s.ds = CAST(t.target - CAST(7 * w.w AS INTEGER) AS DATE))
SELECT brand, target, CAST(ROW_NUMBER() OVER (PARTITION BY brand, target ORDER BY w) AS INTEGER) AS pos, y
FROM lk""")
def q_same_weekday_brand(spark, d):
    """TS3/JO13: for each of the 28 days after as_of, the values 7/14/21/28
    days earlier that exist in the key's series, most recent first."""
    from pyspark.sql import functions as F
    from tillcycle.operators.demand import same_weekday
    from tillcycle.session import cut_lineage
    series = cut_lineage(brand_series(spark, d))   # read twice below: written once
    targets = series.select("brand").distinct().select(
        "brand", F.explode(F.sequence(F.lit(1), F.lit(28))).alias("i")) \
        .select("brand", F.date_add(F.lit(AS_OF).cast("date"), F.col("i")).alias("target"))
    return same_weekday(series, "brand", targets, n_weeks=4)


# ------------------------------------------------------------ whole catalogue
def all_sku_series(spark, d):
    """Every SKU with >= 14 sale days up to as_of, densified (all keys in one plan)."""
    vis = visible_facts(spark, d, DEMAND_COLUMNS)
    return densify(daily_demand(vis, "stock_code"), "stock_code", AS_OF, min_sale_days=14)


ALL_SKU_SERIES = PREFIX + _series_sql("stock_code", "stock_code")


@register("naive_forecast_all_skus", "TS1 TS2 TS4 TS5 FI9", _forecast_sql(ALL_SKU_SERIES, "stock_code"))
def q_naive_all(spark, d):
    return naive_forecast(all_sku_series(spark, d), "stock_code", AS_OF, 28)


@register("naive_backtest_all_skus", "TS1 TS2 TS6 FI9", _backtest_sql(ALL_SKU_SERIES, "stock_code"))
def q_backtest_all(spark, d):
    return naive_backtest(all_sku_series(spark, d), "stock_code", AS_OF)
