"""Text cleaning, chunking, retrieval against numpy brute force, top-k helper."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillcycle.functions.text import clean_description, l2_normalize
from tillcycle.functions.topk import top_k_per_group
from tillcycle.operators.retrieval import chunk, read_documents, terms_topk, tfidf_terms, vector_topk
from tillcycle.operators.taxonomy import build_dim_product


def test_clean_description(spark):
    df = spark.createDataFrame([(" red 12 pk Heart  holder ",), ("SET OF 3 CAKE TINS 10CM",),
                                ("grey\tmug 500ML",)], "d string")
    got = [r.c for r in df.select(clean_description("d").alias("c")).collect()]
    assert got == ["HEART HOLDER", "SET OF 3 CAKE TINS", "MUG"]


def test_chunk_numbering_after_drop(spark):
    df = spark.createDataFrame([("a.md", "One.\n\n\n\n  \n\nTwo\n\n"), ("b.md", "")],
                               "source string, text string")
    got = [(r.source, r.chunk_id, r.text) for r in chunk(df).orderBy("source", "chunk_id").collect()]
    assert got == [("a.md", 0, "One."), ("a.md", 1, "Two")]


def test_vector_topk_matches_numpy(spark):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(300, 16))
    queries = rng.normal(size=(7, 16))
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)],
                                "vec_id long, embedding array<double>").repartition(5)
    qdf = spark.createDataFrame([(100 + j, v.tolist()) for j, v in enumerate(queries)],
                                "query_id long, embedding array<double>")
    got = vector_topk(cdf, qdf, k=4).collect()
    cn = corpus / (np.linalg.norm(corpus, axis=1, keepdims=True) + 1e-9)
    qn = queries / (np.linalg.norm(queries, axis=1, keepdims=True) + 1e-9)
    s = cn @ qn.T
    for j in range(7):
        exp = list(np.argsort(-s[:, j], kind="stable")[:4])
        g = sorted((r for r in got if r.query_id == 100 + j), key=lambda r: r["rank"])
        assert [r.vec_id for r in g] == exp
        assert np.allclose([r.score for r in g], s[exp, j])
    # other shards and blocks give the same answer
    dealt = vector_topk(cdf, qdf, k=4, shards=7, blocks=3).collect()
    assert sorted(map(tuple, dealt)) == sorted(map(tuple, got))


def test_equal_vectors_tie_by_id_in_any_input_order(spark):
    rows = [(i, [0.6, 0.8]) for i in range(40)] + [(40, [1.0, 0.0]), (41, None)]
    queries = spark.createDataFrame([("a", [0.6, 0.8]), ("b", None)], "query_id string, embedding array<double>")
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3)
        got = vector_topk(df, queries, k=3, shards=4).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2)]
    assert vector_topk(df.where("false"), queries).count() == 0


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r.n for r in df.select(l2_normalize(F.col("v")).alias("n")).collect()]
    assert np.allclose(got[0], [0.6, 0.8]) and got[1] == [0.0, 0.0]


def test_top_k_per_group_hot_key(spark):
    rows = [("hot", i, float((i * 37) % 1001)) for i in range(3000)] + \
           [("cold", i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 3, ["id"], buckets=8)
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("id"))
    exp = df.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    assert sorted(map(tuple, got.select("g", "id", "rank").collect())) == \
        sorted(map(tuple, exp.select("g", "id", "rank").collect()))


def test_dim_product_one_row_per_sku(spark):
    rows = [(str(i), d) for i, d in enumerate(
        ["red widget", "blue widget", "small gear", "large gear", "hot rod", "cold rod",
         "old plate", "new plate", "small ring", "large ring"])]
    rows += [("0", "white widget 10 PK")]
    facts = spark.createDataFrame(rows, "stock_code string, description string")
    dim = build_dim_product(facts, n_clusters=4, n_init=2).collect()
    assert len(dim) == 10 and len({r.stock_code for r in dim}) == 10
    assert {r.category_id for r in dim} <= set(range(4))
    by = {r.stock_code: r for r in dim}
    assert by["0"].canonical_description == "WIDGET"
    assert by["0"].category_id == by["1"].category_id   # identical cleaned text, same cluster
    assert all(r.category_name for r in dim) and all(r.taxonomy_version == "v1" for r in dim)


def test_terms_keep_every_letter_and_rank_by_cosine(spark):
    texts = ["red widget sale today", "blue widget clearance", "red red gear", "hot plate deal",
             "widget widget widget", "été über niño widget", "", "gear sale", "gear sale"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = tfidf_terms(df, "id").collect()
    vec = {}
    for r in rows:
        vec.setdefault(r.id, {})[r.term] = r.w
    assert set(vec[5]) == {"été", "über", "niño", "widget"} and 6 not in vec
    assert all(abs(sum(w * w for w in v.values()) - 1) < 1e-6 for v in vec.values())
    n_with = sum("gear" in t.split() for t in texts)
    assert vec[2]["red"] / vec[2]["gear"] == pytest.approx(2 * np.log(10 / 3) / np.log(10 / (n_with + 1)))
    both = spark.createDataFrame(rows).repartition(3)
    got = terms_topk(both.where("id >= 2"), both.where("id < 2").withColumnRenamed("id", "query_id"), k=3).collect()
    for q in (0, 1):
        dot = {i: sum(w * vec[i].get(t, 0.0) for t, w in vec[q].items()) for i in vec if i >= 2}
        want = sorted((i for i in dot if dot[i] > 0), key=lambda i: (-round(dot[i], 9), i))[:3]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.id for r in mine] == want
        assert np.allclose([r.score for r in mine], [dot[i] for i in want])


def test_read_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("One.\n\nTwo é", encoding="utf-8")
    (tmp_path / "sub" / "b.md").write_text("Three", encoding="utf-8")
    (tmp_path / "c.txt").write_text("not read")
    got = {r.source: r.text for r in read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "One.\n\nTwo é", "sub/b.md": "Three"}


def test_few_queries(spark):
    corpus = spark.createDataFrame([(i, f"t{j}", 0.1 * (j + 1)) for i in range(50) for j in range(i % 5 + 1)], "id long, term string, w double")
    queries = spark.createDataFrame([(q, f"t{j}", 0.5) for q in range(3) for j in range(q + 1)], "query_id long, term string, w double")
    out = terms_topk(corpus, queries, k=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan      # the corpus is not shuffled by term
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in out.collect()) == [
        (0, 1, 0, 0.05), (0, 2, 1, 0.05), (1, 1, 1, 0.15), (1, 2, 2, 0.15), (2, 1, 2, 0.3), (2, 2, 3, 0.3)]
