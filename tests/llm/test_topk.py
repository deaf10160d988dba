import math
import random

from llm.helpers import same_as_oracle
from pyspark.sql import functions as F

from tillcycle.llm.balltree_topk import top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rank string, query_id string"


def brute(rows, k=5):
    best = {}
    for i, e, *_ in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v = [math.floor(256.0 * x) for x in e]
            best[i] = min(v, best.get(i, v))
    out = set()
    for q in best:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(best[q], v)), i) for i, v in best.items()
                            if i != q and len(v) == len(best[q]))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def test_ties_copies_nulls_and_many_shards(spark):
    rnd = random.Random(3)
    f = lambda: round(rnd.uniform(-1, 1) * 8) / 8  # noqa: E731  many ties, exact as float
    rows = [(i, [f() for _ in range(4)], "a", "b", "c") for i in range(400)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5], None, None, None) for i in range(400, 700)]  # one common vector
    rows += [(i, [f(), f()], "a", "b", "c") for i in range(700, 820)]  # another length
    rows += [(900, None, "", "", ""), (950, [1.0, None, 1.0, 1.0], "", "", ""), (None, [1.0] * 4, "", "", ""),
             (1000, [float("nan")] * 4, "", "", ""), (1050, [float("inf")] * 4, "", "", ""), (1100, [], "", "", "")]
    rows += rows[:30]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for shard_rows, block_rows in ((64, 3), (100_000, 100_000)):
        got = top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, block_rows=block_rows).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_large_components_and_few_candidates(spark):
    rows = [(0, [3e9, 1.0], "", "", ""), (1, [2e9, -1.0], "", "", ""), (50, [1.0, 1.0], "", "", "")]
    got = {tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()}
    limit = (1 << 63) - 1
    assert got == {(q, r, i, min(s, limit)) for q, r, i, s in brute(rows)}


def test_different_vectors_of_one_id(spark):
    rows = [(50, [1.0, 0.0], "", "", ""), (1, [1.0, 0.0], "", "", ""), (1, [5.0, 0.0], "", "", ""), (2, [2.0, 9.0], "", "", ""),
            (1, [5.0, 0.0], "", "", ""), (50, [9.0, 9.0], "", "", "")]
    df = spark.createDataFrame([r for r in rows if r[:2] != (50, [9.0, 9.0])], SCHEMA)
    for shard_rows in (1, 100):
        got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows).collect())
        assert got == [(50, 1, 1, 5 * 65536), (50, 2, 2, 2 * 65536), (50, 3, 1, 65536)]
    # two rows that ask: the best of both, none of them their own id
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k=2).collect()]
    assert sorted(got) == [(50, 1, 2, 99 * 65536), (50, 2, 1, 45 * 65536)]


def test_empty(spark):
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_query(spark):
    same_as_oracle(spark, "op1_balltree_topk")
