"""k-means with many restarts that advance together (TX4).

Ten restarts fitted one after another read the points ten times as often.  Here one pass over the points
moves all of them: a task scores its points against the centres of every restart at once and keeps
per centre a sum and a count, Spark adds these up by centre and feature, and the next centres are sent out.
Points are sparse (``f`` feature numbers below ``dims``, ``w`` their weights) and stay where they are; what
passes through the driver is the centres, n_init x k x dims numbers at most, set by parameters.

Seeding covers all points as k-means|| does: of each restart, passes draw 2k points with a chance
that grows with the squared distance to those drawn before, the drawn are weighted by the points
nearest to them and thinned out to k.  Draws depend on a point's hash and the seed alone, so
another partitioning draws the same points.

Defined cases: no point: no centre, no row; a point without a feature is the zero vector; equal
distances go to the first centre; fewer different points than k: some centres stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.functions.topk import top_k_per_group

#: Products of one feature with all centres that a task holds at a time.
PRODUCTS = 4_000_000


def _squares(f: list, w: list, centres: np.ndarray) -> np.ndarray:
    """Squared distances of sparse points to all rows of ``centres`` (centres x dims)."""
    sizes = np.array([len(x) for x in f])
    some = np.flatnonzero(sizes)
    out = np.zeros((len(f), len(centres)))
    if len(some):
        at = np.concatenate([f[i] for i in some]).astype(np.int64)
        by = np.concatenate([w[i] for i in some])
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        out[some] = -2 * np.add.reduceat(by[:, None] * centres.T[at], starts, axis=0)
        out[some] += np.add.reduceat(by * by, starts)[:, None]
    return np.maximum(out + (centres * centres).sum(axis=1), 0.0)


def _scored(batches: Iterator[pd.DataFrame], centres: np.ndarray):
    """(rows, squared distances) of slices that keep a task's memory bounded."""
    for rows in batches:
        step = np.cumsum([max(1, len(x)) for x in rows["f"]]) * max(1, len(centres)) // PRODUCTS
        for _, part in rows.groupby(step, sort=True) if len(rows) else ():
            yield part, _squares(list(part["f"]), list(part["w"]), centres)


def _nearest(d: np.ndarray, owner: np.ndarray, n_init: int) -> np.ndarray:
    """Per point and restart its nearest centre of that restart (the first of equals)."""
    ends = np.searchsorted(owner, np.arange(n_init + 1))
    return np.stack([ends[r] + d[:, ends[r]:ends[r + 1]].argmin(axis=1) for r in range(n_init)], axis=1)


def _sums(points: DataFrame, centres: np.ndarray, owner: np.ndarray, n_init: int) -> pd.DataFrame:
    """(c, f, v): per centre the sum of its points by feature, their number at f = -1, and the sum
    of their squared distances at f = -2.  One pass; at most centres x (dims + 2) rows."""
    sent = points.sparkSession.sparkContext.broadcast((centres, owner))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, owner = sent.value
        total = np.zeros((len(centres), centres.shape[1] + 2))
        for rows, d in _scored(batches, centres):
            near = _nearest(d, owner, n_init)
            sizes = [len(x) for x in rows["f"]]
            f = np.concatenate([*rows["f"], np.empty(0)]).astype(np.int64)
            w = np.concatenate([*rows["w"], np.empty(0)])
            for c in near.T:
                np.add.at(total, (np.repeat(c, sizes), f), w)
                np.add.at(total, (c, -2), 1.0)
                np.add.at(total, (c, -1), d[np.arange(len(c)), c])
        c, f = np.nonzero(total)
        dims = centres.shape[1]
        yield pd.DataFrame({"c": c, "f": np.where(f < dims, f, dims - 1 - f), "v": total[c, f]})

    out = points.select("f", "w").mapInPandas(add, "c long, f long, v double") \
        .groupBy("c", "f").agg(F.sum("v").alias("v")).toPandas()   # bounded by the centres
    sent.unpersist()
    return out


def _parts(found: pd.DataFrame, shape: tuple[int, int]):
    """Sums, counts and costs per centre from `_sums`."""
    c, f, v = (found[x].to_numpy() for x in ("c", "f", "v"))
    sums, counts, costs = np.zeros(shape), np.zeros(shape[0]), np.zeros(shape[0])
    sums[c[f >= 0], f[f >= 0]] = v[f >= 0]
    counts[c[f == -1]], costs[c[f == -2]] = v[f == -1], v[f == -2]
    return sums, counts, costs


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each 64-bit hash and salt."""
    x = h.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53 + 2.0 ** -54


def _drawn(points: DataFrame, centres: np.ndarray, owner: np.ndarray, n_init: int, n: int, seed: int, turn: int):
    """Per restart ``n`` points drawn without replacement by squared distance to its centres
    (evenly while there is none): those of least -ln(u) / weight."""
    sent = points.sparkSession.sparkContext.broadcast((centres, owner))
    kind = "r int, key double, h long, f array<int>, w array<double>"

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, owner = sent.value
        best: list[pd.DataFrame] = [pd.DataFrame({"key": [], "h": [], "f": [], "w": []})] * n_init
        for rows, d in _scored(batches, centres):
            h = rows["h"].to_numpy()
            for r in range(n_init):
                weight = d[:, owner == r].min(axis=1) if len(centres) else np.ones(len(h))
                with np.errstate(divide="ignore"):
                    key = -np.log(_uniform(h, seed + 1000 * r + turn)) / weight
                own = rows.assign(key=key)[weight > 1e-12]
                best[r] = pd.concat([x for x in (best[r], own) if len(x)] or [own]).nsmallest(n, ["key", "h"])
        for r, rows in enumerate(best):
            if len(rows):
                yield pd.DataFrame({"r": r, "key": rows["key"], "h": rows["h"].astype("int64"), "f": rows["f"], "w": rows["w"]})

    top = top_k_per_group(points.select("h", "f", "w").mapInPandas(draw, kind), ["r"], [F.col("key"), F.col("h")], n,
                          salt_cols=["h"], buckets=8)
    rows = sorted(top.select("r", "key", "h", "f", "w").collect(), key=lambda x: (x["r"], x["key"], x["h"]))  # n_init x n
    sent.unpersist()
    return rows


def _thinned(rows: np.ndarray, weights: np.ndarray, k: int, rng) -> np.ndarray:
    """k of the drawn points, far from one another: the first by weight, each next by weight times
    squared distance to those taken."""
    taken, away = [], np.ones(len(rows))
    while len(taken) < k:
        p = weights * away
        at = int(rng.choice(len(rows), p=p / p.sum())) if p.sum() > 0 else taken[0]
        taken.append(at)
        d = ((rows - rows[at]) ** 2).sum(axis=1)
        d[d < 1e-12] = 0.0
        away = d if len(taken) == 1 else np.minimum(away, d)
    return rows[taken]


def seeds(points: DataFrame, k: int, n_init: int, dims: int, seed: int = 42, rounds: int = 2) -> np.ndarray:
    """First centres of all restarts, (n_init * k) x dims."""
    centres, owner = np.zeros((0, dims)), np.zeros(0, np.int64)
    for turn in range(rounds + 1):
        new = _drawn(points, centres, owner, n_init, 2 * k if turn else 1, seed, turn)
        rows = np.zeros((len(new), dims))
        for row, x in zip(rows, new):
            row[x["f"]] = x["w"]
        owner = np.concatenate([owner, [x["r"] for x in new]]).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        centres, owner = np.concatenate([centres, rows])[order], owner[order]
        if not len(centres):
            return centres
    _, counts, _ = _parts(_sums(points, centres, owner, n_init), centres.shape)
    return np.concatenate([_thinned(centres[owner == r], counts[owner == r], k, np.random.default_rng(seed + r))
                           for r in range(n_init)])


def refine(points: DataFrame, centres: np.ndarray, n_init: int, max_iter: int = 50, tol: float = 1e-4):
    """Moves all centres to the means of their points until none moves by more than ``tol``; a restart
    at rest is left out of later passes.  Returns (centres, cost per restart)."""
    k = len(centres) // n_init
    costs, going = np.full(n_init, np.inf), np.arange(n_init)
    centres = centres.copy().reshape(n_init, k, -1)
    for turn in range(max_iter + 1):
        now = centres[going].reshape(len(going) * k, -1)
        sums, counts, cost = _parts(_sums(points, now, np.repeat(np.arange(len(going)), k), len(going)), now.shape)
        costs[going] = cost.reshape(-1, k).sum(axis=1)   # of the centres as they were in this pass
        if turn == max_iter:
            break
        to = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], now)
        moved = np.sqrt(((to - now) ** 2).sum(axis=1)).reshape(-1, k).max(axis=1) > tol
        centres[going[moved]] = to.reshape(len(going), k, -1)[moved]
        going = going[moved]
        if not len(going):
            break
    return centres.reshape(n_init * k, -1), costs


def assign(points: DataFrame, centres: np.ndarray, id_col: str) -> DataFrame:
    """(id_col, cluster_id): each point's nearest centre."""
    sent = points.sparkSession.sparkContext.broadcast(centres)
    kind = points.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, d in _scored(batches, sent.value):
            yield pd.DataFrame({id_col: rows[id_col], "cluster_id": d.argmin(axis=1)})

    return points.select(id_col, "f", "w").mapInPandas(place, f"{id_col} {kind}, cluster_id int")


def best_of_restarts(points: DataFrame, id_col: str, k: int, n_init: int, dims: int, seed: int = 42,
                     max_iter: int = 50) -> DataFrame:
    """(id_col, cluster_id) by the restart of least cost, the first of equals.  ``points``: id_col,
    h (a hash of the point), f, w; read once per pass, so best a written table."""
    first = seeds(points, k, n_init, dims, seed)
    if not len(first):
        return points.select(id_col, F.lit(0).alias("cluster_id"))
    centres, costs = refine(points, first, n_init, max_iter)
    best = int(costs.argmin())
    return assign(points, centres[best * k:(best + 1) * k], id_col)
