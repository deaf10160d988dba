"""Exact top-k search by inner product: a ball tree per shard, branch and bound.

Vectors of one length are dealt by hash of their id into shards of about ``shard_rows``; a task
builds the ball tree of one shard and searches it for a block of queries.  A node's bound is
``q . centre + |q| * radius``; nodes are taken in the order of their bounds, and the search of
a shard ends where no bound reaches the current k-th score.

That score is shared between shards: every query first searches the shard that its id falls
in, and its k-th score there is the floor with which all other shards start, so most of them
are left after a few nodes.  The best of all shards' candidates are the exact result.

A task holds one shard and at most ``block_rows`` queries; queries, not vectors, are sent to
every shard, in blocks.  Floating-point bounds are widened by more than their error, scores
are integers.

Defined cases: vectors null, or holding null or non-finite components, and null ids take no
part; only vectors of one length are compared; rows equal in id and vector count once; rows
of one id with different vectors are candidates of their own, though not for queries of that
id, and if they ask, the id's results are the best that any of them finds; fewer than k candidates are all returned; equal scores go to the smaller id.
Scores beyond the range of a long are cut to it.  Columns but the two named are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillcycle.llm.common import written

K, LEAF, SHARD_ROWS, BLOCK_ROWS = 5, 128, 4096, 16384
_FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes of rows [start, end) with centre, radius and least id; built by halving along the
    line between two far points."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        points = rows.astype(float)
        order = np.arange(len(ids))
        self.start, self.end, self.left, self.right = [], [], [], {}
        centres, radii, least = [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = points[order[a:b]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            node = len(centres)
            if parent >= 0 and self.left[parent] < 0:
                self.left[parent] = node
            elif parent >= 0:
                self.right[parent] = node
            self.start.append(a)
            self.end.append(b)
            self.left.append(-1)
            centres.append(centre)
            radii.append(away.max())
            least.append(ids[order[a:b]].min())
            if b - a > leaf:
                far = own[int(away.argmax())]
                along = (own - far) @ (own[int(((own - far) ** 2).sum(axis=1).argmax())] - far)
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(along, half)]
                todo += [(a, a + half, node), (a + half, b, node)]
        self.centres, self.radii, self.least = np.array(centres), np.array(radii), np.array(least)
        self.ids, self.rows = ids[order], rows[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        q = queries.astype(float)
        b = q @ self.centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * self.radii[None, :]
        return b + 1e-6 * (1.0 + np.abs(b))

    def search(self, own_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: int | None):
        """Up to k (score, id), none below ``floor``; the query's own id is no candidate."""
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        low = -np.inf if floor is None else floor
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if -bound < low:
                break
            if len(best) == k and -bound < best[0][0] + 1 and self.least[node] > -best[0][1] \
                    and np.floor(-bound) <= best[0][0]:
                continue  # at most a tie, and with larger ids
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bounds[child] >= low:
                        heapq.heappush(todo, (-bounds[child], child))
                continue
            a, b = self.start[node], self.end[node]
            scores = self.rows[a:b] @ query
            for i in np.flatnonzero(scores >= low):
                vec = int(self.ids[a + i])
                if vec == own_id:
                    continue
                entry = (int(scores[i]), -vec)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                low = max(low, best[0][0])
        return best


def _safe(rows: np.ndarray) -> np.ndarray:
    """As floats where every score is exact in them, else as exact integers."""
    most = int(np.abs(rows.astype(float)).max()) if rows.size else 0
    bound = most * most * max(1, rows.shape[1])
    return rows.astype(float) if bound < 1 << 52 else rows if bound < 1 << 62 else rows.astype(object)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), -1)


def _results(found: list[tuple[int, int, int]]) -> pd.DataFrame:
    limit = (1 << 63) - 1
    return pd.DataFrame([(q, v, max(-limit - 1, min(limit, s))) for q, v, s in found],
                        columns=["query_id", "vec_id", "score"]).astype("int64")


def _search_shard(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(vectors) or not len(queries):
        return _results([])
    both = _safe(np.concatenate([_matrix(vectors["v"]), _matrix(queries["v"])]))
    tree = BallTree(vectors["vec_id"].to_numpy(), both[:len(vectors)])
    wanted, found = both[len(vectors):], []
    floors = [None if pd.isna(f) else int(f) for f in queries["floor"]]
    for at in range(0, len(wanted), 1024):
        bounds = tree.bounds(wanted[at:at + 1024])
        for i, b in enumerate(bounds, at):
            q = int(queries["query_id"].iloc[i])
            found += [(q, -v, s) for s, v in tree.search(q, wanted[i], b, k, floors[i])]
    return _results(found)


def top_k(embeddings: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that ``queries``, a condition on the id,
    holds for, the k best of all other rows by the inner product of floor(scale * x)."""
    x = F.col(vec_col)
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    v = (embeddings.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(odd, F.lit(True)))
         .select(F.col(id_col).cast("long").alias("vec_id"),
                 F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale)))).alias("v"),
                 F.coalesce(queries, F.lit(False)).alias("asks"))
         .dropDuplicates(["vec_id", "v"]))
    v = written(v.withColumn("dim", F.size("v")), "vectors")
    sizes = v.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"),
        F.ceil(F.sum(F.col("asks").cast("long")) / block_rows).cast("int").alias("blocks"))
    v = v.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    v = v.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.greatest("blocks", F.lit(1))).cast("int"))
    keys = ["dim", "shard", "block"]

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _search_shard(a, b, k)

    def between(vectors: DataFrame, asked: DataFrame) -> DataFrame:
        left = vectors.select(*keys, "vec_id", "v")
        right = asked.select(*[F.col(c).alias(f"q_{c}") for c in keys], "query_id",
                             F.col("v").alias("v"), "floor")
        return written(left.groupBy(*keys).cogroup(right.groupBy(*[f"q_{c}" for c in keys]))
                       .applyInPandas(search, _FOUND), "found")

    per_block = v.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .where("blocks > 0")
    asked = v.where("asks").withColumnRenamed("vec_id", "query_id").withColumn("floor", F.lit(None).cast("long"))
    pilot = between(per_block, asked)
    floor = (pilot.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
             .select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("floor")))
    others = (asked.drop("floor").join(floor, "query_id", "left")
              .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
              .where("to <> shard").drop("shard").withColumnRenamed("to", "shard"))
    rest = between(per_block, others)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pilot.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
