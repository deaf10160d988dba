"""Boosted trees per key: one model for each product or brand, all fitted at once (TS12-TS16).

Features, holdout, metrics and bands are DataFrame work; a task fits the trees of one key, whose
rows are a calendar (`operators.grouped`: bounded by days).  No step is driven from the driver
round by round, so thousands of keys cost as many tasks, not as many jobs.

A tree is grown leaf by leaf, the best split first, up to ``leaves``.  Each feature is cut into at
most ``bins`` bins per key; a leaf's sums of gradients and rows per (feature, bin) give all its
splits, and a parent's sums less one child's give the other's.  Squared error: a leaf's value
is its mean residual, shrunk by ``rate``.  Gains within one part in 10^9 of the best count as ties,
which go to the first feature and the lowest cut: models do not hang on the order of sums.

The models are a table, one row a tree: *key, tree, base, and its nodes as arrays (feature -1: a
leaf).  Forecasts read that table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.operators.demand import date_expr, key_list
from tillcycle.operators.features import FEATURES, split_holdout
from tillcycle.operators.grouped import apply_per_key, apply_per_key_with
from tillcycle.session import cut_lineage

TIE = 1e-9
_MODEL = ("tree int, base double, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
          "value array<double>")


@dataclass(frozen=True)
class TreeParams:
    """Those of the reference's model."""
    rounds: int = 300
    rate: float = 0.05
    leaves: int = 15
    min_rows: int = 5
    columns: float = 0.8
    seed: int = 42
    bins: int = 255


def tree_columns(p: TreeParams, tree: int, n: int) -> list[int]:
    """The features a tree may use: those with the least checksums."""
    return sorted(sorted(range(n), key=lambda f: zlib.crc32(f"{p.seed}:{tree}:{f}".encode()))[:max(1, round(p.columns * n))])


def binned(column: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each row, the cut above each bin but the last): one bin for each distinct value,
    or, of more than ``bins`` values, equally many to a bin."""
    values, code = np.unique(column, return_inverse=True)
    n = len(values)
    group = np.arange(n) if n <= bins else np.arange(n) * bins // n
    ends = np.flatnonzero(np.diff(group))
    low, high = values[ends], values[ends + 1]
    middle = (low + high) / 2
    return group[code], np.where(middle < high, middle, low)  # neighbouring doubles have none between


class Histograms:
    """The bins of one key's training rows, features side by side."""

    def __init__(self, x: np.ndarray, bins: int):
        parts = [binned(x[:, f], bins) for f in range(x.shape[1])]
        self.cuts = [c for _, c in parts]
        self.sizes = [len(c) + 1 for c in self.cuts]
        self.offset = np.concatenate([[0], np.cumsum(self.sizes)])
        self.feature = np.repeat(np.arange(len(parts)), self.sizes)
        self.codes = np.stack([c for c, _ in parts], axis=1) + self.offset[:-1]

    def of(self, columns: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of a tree's columns, and which bins are cuts of theirs: all but each last."""
        cut = np.zeros(int(self.offset[-1]), bool)
        for f in columns:
            cut[self.offset[f]:self.offset[f + 1] - 1] = True
        return np.ascontiguousarray(self.codes[:, columns]), np.flatnonzero(cut)

    def sums(self, codes: np.ndarray, residual: np.ndarray) -> np.ndarray:
        """Row 0: sums of residuals, row 1: numbers of rows, per (feature, bin)."""
        flat, width = codes.ravel(), int(self.offset[-1])
        return np.stack([np.bincount(flat, np.repeat(residual, codes.shape[1]), width),
                         np.bincount(flat, minlength=width)])

    def best_split(self, sums: np.ndarray, cuts: np.ndarray, total: float, rows: int,
                   min_rows: int) -> tuple[float, int, int] | None:
        """(gain, feature, bin): rows up to the bin go left."""
        run = np.cumsum(sums, axis=1)
        before = np.concatenate([np.zeros((2, 1)), run], axis=1)[:, self.offset[self.feature[cuts]]]
        g, n = run[:, cuts] - before
        fits = (n >= min_rows) & (rows - n >= min_rows)
        if not fits.any():
            return None
        cuts, g, n = cuts[fits], g[fits], n[fits]
        gain = g * g / n + (total - g) ** 2 / (rows - n) - total * total / rows
        top = gain.max()
        at = cuts[np.argmax(gain >= top - abs(top) * TIE)]
        f = int(self.feature[at])
        return float(top), f, int(at - self.offset[f])


def grow(h: Histograms, residual: np.ndarray, columns: list[int], p: TreeParams) -> tuple[dict[str, list], np.ndarray]:
    """One tree for the residuals, and its value for every training row."""
    tree = {"feature": [-1], "threshold": [0.0], "left": [0], "right": [0], "value": [0.0]}
    codes, cuts = h.of(columns)

    def split_of(leaf: int) -> tuple[float, int, int] | None:
        own = rows[leaf]
        return h.best_split(sums[leaf], cuts, float(residual[own].sum()), len(own), p.min_rows)

    rows = {0: np.arange(len(residual))}
    sums = {0: h.sums(codes, residual)}
    splits = {0: split_of(0)}
    noise = TIE * float(residual @ residual)
    while len(rows) < p.leaves:
        gains = {leaf: s[0] for leaf, s in splits.items() if s and s[0] > noise}
        if not gains:
            break
        most = max(gains.values())
        leaf = min(x for x, gain in gains.items() if gain >= most * (1 - TIE))
        _, f, cut = splits.pop(leaf)
        low = h.codes[rows[leaf], f] <= h.offset[f] + cut
        own, left, right = rows.pop(leaf), len(tree["feature"]), len(tree["feature"]) + 1
        rows[left], rows[right] = own[low], own[~low]
        small, large = sorted((left, right), key=lambda x: len(rows[x]))
        sums[small] = h.sums(codes[rows[small]], residual[rows[small]])
        sums[large] = sums.pop(leaf) - sums[small]
        tree["feature"][leaf], tree["threshold"][leaf] = f, float(h.cuts[f][cut])
        tree["left"][leaf], tree["right"][leaf] = left, right
        for x in (left, right):
            for name, v in (("feature", -1), ("threshold", 0.0), ("left", x), ("right", x), ("value", 0.0)):
                tree[name].append(v)
            splits[x] = split_of(x)
    out = np.empty(len(residual))
    for leaf, own in rows.items():
        tree["value"][leaf] = p.rate * float(residual[own].mean())
        out[own] = tree["value"][leaf]
    return tree, out


def fit_rows(rows: pd.DataFrame, p: TreeParams) -> pd.DataFrame:
    """The trees of one key, from its training rows."""
    x, y = rows[FEATURES].to_numpy(float), rows["y"].to_numpy(float)
    h, base, trees = Histograms(x, p.bins), float(y.mean()), []
    fitted = np.full(len(y), base)
    for t in range(p.rounds):
        tree, step = grow(h, y - fitted, tree_columns(p, t, len(FEATURES)), p)
        fitted += step
        trees.append({"tree": t, "base": base} | tree)
    return pd.DataFrame(trees)


class Model:
    """A key's trees side by side, from the rows of the model table."""

    def __init__(self, trees: pd.DataFrame):
        trees = trees.sort_values("tree")
        self.base, width = float(trees["base"].iloc[0]), max(map(len, trees["feature"]))
        self.at = {c: np.stack([np.pad(np.asarray(v), (0, width - len(v))) for v in trees[c]])
                   for c in ("feature", "threshold", "left", "right", "value")}
        self.tree = np.arange(len(trees))

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.tree)), int)
        row = np.arange(len(x))[:, None]
        while True:
            feature = self.at["feature"][self.tree, node]
            if (feature < 0).all():
                return self.base + self.at["value"][self.tree, node].sum(axis=1)
            low = x[row, np.maximum(feature, 0)] <= self.at["threshold"][self.tree, node]
            node = np.where(low, self.at["left"][self.tree, node], self.at["right"][self.tree, node])


def fit_key_trees(features: DataFrame, key, holdout: int = 28,
                  params: TreeParams | None = None) -> tuple[DataFrame, DataFrame]:
    """(models, metrics), both one set per key.  Fitted on all but each key's last ``holdout``
    feature rows; metrics: *key, mape, rmse (on the holdout), residual_std (population, training
    rows), with predictions floored at 0."""
    ks, p = key_list(key), params or TreeParams()
    f = cut_lineage(split_holdout(features, ks, holdout))
    models = cut_lineage(apply_per_key(f.where(~F.col("is_test")), ks, lambda rows: fit_rows(rows, p), _MODEL))

    def predict(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        return rows[["y", "is_test"]].assign(pred=np.maximum(Model(trees).predict(rows[FEATURES].to_numpy(float)), 0.0))

    scored = apply_per_key_with(f, models, ks, predict, "y double, is_test boolean, pred double")
    e, test = F.col("y") - F.col("pred"), F.col("is_test")
    metrics = scored.groupBy(*ks).agg(
        F.avg(F.when(test & (F.col("y") > 0), F.abs(e) / F.col("y"))).alias("mape"),
        F.sqrt(F.avg(F.when(test, e * e))).alias("rmse"),
        F.stddev_pop(F.when(~test, e)).alias("residual_std"))
    return models, cut_lineage(metrics)


def forecast_days(y: np.ndarray, model: Model, end: pd.Timestamp, horizon: int) -> list[float]:
    """Day by day; each day's value is an observation for the days after it."""
    y, total, out = list(y), float(np.sum(y)), []
    for i in range(1, horizon + 1):
        day = end + pd.Timedelta(days=i)
        last7, last14 = y[-7:], y[-14:]
        lags = [y[-k] if len(y) >= k else total / len(y) for k in (7, 14, 28)]
        x = [day.dayofweek, day.isocalendar()[1], day.month, *lags, np.mean(last7), np.mean(last14),
             np.std(last7, ddof=1) if len(last7) > 1 else 0.0]
        out.append(max(float(model.predict(np.array([x], float))[0]), 0.0))
        y.append(out[-1])
        total += out[-1]
    return out


def key_forecast(models: DataFrame, series: DataFrame, metrics: DataFrame, key, as_of, horizon: int = 28) -> DataFrame:
    """TS16: *key, ds, yhat, yhat_lower, yhat_upper; the band is 1.28 times the key's residual
    deviation, 0.5 at least, floored at 0 below."""
    ks, end = key_list(key), pd.Timestamp(str(as_of))

    def ahead(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        values = forecast_days(rows["y"].to_numpy(float), Model(trees), end, horizon)
        return pd.DataFrame({"pos": range(1, horizon + 1), "raw": values})

    known = series.where(F.col("ds") <= date_expr(as_of)).select(*ks, "ds", "y")
    raw = apply_per_key_with(known, models, ks, ahead, "pos int, raw double")
    half = F.greatest(F.col("residual_std") * 1.28, F.lit(0.5))
    return raw.join(metrics.select(*ks, "residual_std"), ks).select(
        *ks, F.date_add(date_expr(as_of), F.col("pos")).alias("ds"), F.round("raw", 2).alias("yhat"),
        F.round(F.greatest(F.col("raw") - half, F.lit(0.0)), 2).alias("yhat_lower"),
        F.round(F.col("raw") + half, 2).alias("yhat_upper"))
