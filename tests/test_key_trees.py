import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tillcycle.operators.boosted import forecast_all
from tillcycle.operators.features import FEATURES, build_features
from tillcycle.operators.grouped import GroupTooLarge, apply_per_key
from tillcycle.operators.key_trees import Model, TreeParams, binned, fit_key_trees, fit_rows, forecast_days, tree_columns
from tillcycle.operators.naive import naive_backtest

AS_OF = dt.date(2011, 8, 1)


def series(spark, days=170, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for key, level in (("big", 400.0), ("small", 4.0), ("flat", 9.0)):
        for i in range(days):
            d = AS_OF - dt.timedelta(days=i)
            y = level if key == "flat" else max(0.0, level * (1 + 0.5 * (d.weekday() == 5) + 0.002 * i) + rng.normal(0, level * 0.2))
            rows.append((key, d, float(y)))
    return spark.createDataFrame(rows, "k string, ds date, y double")


def plain_fit(x, y, p):
    """The same trees without bins or histograms: every cut of every leaf by masks. Returns a
    function that predicts."""
    base, trees = y.mean(), []
    fitted = np.full(len(y), base)

    def split_of(rows, r, columns):
        found = []
        for f in columns:
            v = np.unique(x[:, f])
            for cut in (v[:-1] + v[1:]) / 2:
                low = x[rows, f] <= cut
                n = low.sum()
                if n >= p.min_rows and len(rows) - n >= p.min_rows:
                    g, t = r[rows][low].sum(), r[rows].sum()
                    found.append((g * g / n + (t - g) ** 2 / (len(rows) - n) - t * t / len(rows), f, cut))
        if not found:
            return None
        top = max(found)[0]
        return next((top, f, cut) for gain, f, cut in found if gain >= top - abs(top) * 1e-9)

    for t in range(p.rounds):
        r, columns = y - fitted, tree_columns(p, t, x.shape[1])
        leaves, order, inner = {0: np.arange(len(y))}, 1, {}
        splits = {0: split_of(leaves[0], r, columns)}
        while len(leaves) < p.leaves:
            gains = {k: s[0] for k, s in splits.items() if s and s[0] > 1e-9 * (r @ r)}
            if not gains:
                break
            k = min(k for k, g in gains.items() if g >= max(gains.values()) * (1 - 1e-9))
            _, f, cut = splits.pop(k)
            rows = leaves.pop(k)
            inner[k] = (f, cut, order, order + 1)
            for side in (rows[x[rows, f] <= cut], rows[x[rows, f] > cut]):
                leaves[order] = side
                splits[order] = split_of(side, r, columns)
                order += 1
        value = {k: p.rate * r[rows].mean() for k, rows in leaves.items()}
        trees.append((inner, value))
        for k, rows in leaves.items():
            fitted[rows] += value[k]

    def predict(row):
        total = base
        for inner, value in trees:
            k = 0
            while k in inner:
                f, cut, left, right = inner[k]
                k = left if row[f] <= cut else right
            total += value[k]
        return total
    return predict


def test_bins():
    code, cuts = binned(np.array([5.0, 1.0, 1.0, 3.0]), 255)
    assert code.tolist() == [2, 0, 0, 1] and cuts.tolist() == [2.0, 4.0]
    code, cuts = binned(np.arange(10.0), 3)
    assert code.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2] and cuts.tolist() == [3.5, 6.5]
    assert binned(np.zeros(4), 9)[1].tolist() == []
    near = np.array([1.0, np.nextafter(1.0, 2), np.nextafter(np.nextafter(1.0, 2), 2)])
    code, cuts = binned(near, 9)
    assert [(x > cuts).sum() for x in near] == code.tolist() == [0, 1, 2]


def test_models_and_metrics_equal_a_plain_version(spark):
    p = TreeParams(rounds=25)
    f = build_features(series(spark), "k")
    models, metrics = fit_key_trees(f, "k", params=p)
    rows, trees = f.toPandas().sort_values("ds"), models.toPandas()
    got = {r.k: r for r in metrics.collect()}
    assert set(got) == {"big", "small", "flat"} and len(trees) == 75
    assert trees["feature"].map(lambda n: sum(v < 0 for v in n)).max() == p.leaves
    for k, own in rows.groupby("k"):
        x, y = own[FEATURES].to_numpy(float), own["y"].to_numpy(float)
        predict = plain_fit(x[:-28], y[:-28], p)
        want = np.array([predict(r) for r in x])
        model = Model(trees[trees.k == k])
        assert model.predict(x) == pytest.approx(want, rel=1e-9)
        e = y - np.maximum(want, 0)
        assert got[k].rmse == pytest.approx(np.sqrt((e[-28:] ** 2).mean()), abs=1e-9)
        assert got[k].mape == pytest.approx((np.abs(e) / y)[-28:].mean(), abs=1e-9)
        assert got[k].residual_std == pytest.approx(e[:-28].std(), abs=1e-9)
    assert got["flat"].rmse == pytest.approx(0, abs=1e-9)


def test_fit_beats_the_mean_and_stops_without_gain():
    rng = np.random.default_rng(1)
    x = pd.DataFrame(rng.normal(size=(300, len(FEATURES))), columns=FEATURES)
    rows = x.assign(y=10 * (x["lag_7"] > 0) + x["lag_28"] * 3 + rng.normal(0, 0.1, 300))
    model = Model(fit_rows(rows, TreeParams(bins=32)))
    e = rows["y"] - model.predict(x.to_numpy())
    assert e.std() < 0.1 * rows["y"].std()
    few = fit_rows(rows.head(9), TreeParams(rounds=3))
    assert few["feature"].map(list).tolist() == [[-1]] * 3     # nine rows can't give two leaves of five


def test_recursion_feeds_predictions_back():
    class LastWeek:
        def predict(self, x):
            return x[:, 3]          # lag_7
    y = np.arange(1.0, 31.0)
    got = forecast_days(y, LastWeek(), pd.Timestamp("2011-08-01"), 15)
    assert got == [24.0, 25, 26, 27, 28, 29, 30] * 2 + [24.0]
    assert forecast_days(np.array([2.0, 4.0]), LastWeek(), pd.Timestamp("2011-08-01"), 1) == [3.0]


def test_forecasts_choose_the_model_per_key(spark):
    s = series(spark).union(spark.createDataFrame(
        [("short", AS_OF - dt.timedelta(days=i), 2.0) for i in range(20)], "k string, ds date, y double"))
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = forecast_all(s.repartition(int(n)), "k", AS_OF, 28, params=TreeParams(rounds=20))
            found.append(sorted(map(tuple, out["forecast"].collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    fc = out["forecast"].toPandas()
    assert dict(fc.groupby("k").model.first()) == {"big": "gbt", "small": "gbt", "flat": "gbt", "short": "seasonal_naive"}
    assert set(fc.groupby("k").size()) == {28} and (fc.yhat_lower <= fc.yhat).all() and (fc.yhat <= fc.yhat_upper).all()
    assert set(fc[fc.k == "flat"].yhat) == {9.0} and set(fc[fc.k == "flat"].yhat_upper) == {9.5}
    assert 300 < fc[fc.k == "big"].yhat.mean() < 700


def test_no_eligible_key(spark):
    s = series(spark, days=30)
    out = forecast_all(s, "k", AS_OF, 28)
    assert {r.model for r in out["forecast"].select("model").distinct().collect()} == {"seasonal_naive"}


def test_large_keys_are_refused_by_name(spark):
    with pytest.raises(GroupTooLarge, match=r"more than 100 rows: .*big \(170\)"):
        apply_per_key(series(spark), "k", lambda rows: rows, "y double", max_rows=100)
    with pytest.raises(ValueError, match="repeats key columns"):
        apply_per_key(series(spark), "k", lambda rows: rows, "k string")


def test_key_trees_against_naive_on_brands(spark):
    from pyspark.sql import functions as F

    from conftest import SF_MID
    from tillcycle.plans.queries_core import AS_OF as QUERY_AS_OF
    from tillcycle.plans.queries_forecast import brand_series
    from tillcycle.session import cut_lineage
    s = cut_lineage(brand_series(spark, SF_MID))
    _, trees = fit_key_trees(build_features(s, "brand"), "brand")
    mean = lambda df: df.agg(F.avg("mape")).first()[0]
    a, b = mean(trees), mean(naive_backtest(s, "brand", QUERY_AS_OF))
    print(f"holdout MAPE on brands: trees per key {a:.3f}, naive {b:.3f}")
    assert a <= b
