"""Product taxonomy: clean text -> features -> k-means -> cluster labels ->
one dim_product row per SKU (SC14, TX1-TX5, TX8, TX9, TK7, SO1-SO3, JO9).

The cluster naming of the reference asks a language model; here a cluster
is named by its three highest-scoring terms (term frequency in the cluster
x inverse cluster frequency), title-cased — deterministic and computed as
ordinary aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.functions.text import clean_description
from tillcycle.functions.topk import top_k_per_group
from tillcycle.operators.restarts import best_of_restarts
from tillcycle.operators.retrieval import tfidf_terms
from tillcycle.session import cut_lineage

DIM_PRODUCT_COLUMNS = ["stock_code", "canonical_description", "category_id", "category_name",
                       "cluster_id", "taxonomy_version"]


def product_texts(facts: DataFrame) -> DataFrame:
    """SO1 + TX1: distinct (stock_code, description) with non-blank text,
    plus the cleaned description."""
    pairs = facts.where(F.col("description") != "").select("stock_code", "description").distinct()
    return pairs.withColumn("clean_desc", clean_description("description"))


def text_points(uniq: DataFrame, dims: int) -> DataFrame:
    """TX2/TX3: each clean_desc as a sparse point of length one: its weighted terms, dealt by hash to
    ``dims`` features.  A text without a term is the zero vector."""
    terms = tfidf_terms(uniq, "clean_desc", "clean_desc")
    feats = terms.groupBy("clean_desc", F.pmod(F.xxhash64("term"), F.lit(dims)).cast("int").alias("f")) \
        .agg(F.sum("w").alias("w"))
    whole = feats.groupBy("clean_desc").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("l"))
    none = F.array().cast("array<struct<f:int,w:double>>")
    return uniq.join(whole, "clean_desc", "left").withColumn("l", F.coalesce("l", none)).select(
        "clean_desc", F.xxhash64("clean_desc").alias("h"), F.col("l.f").alias("f"), F.col("l.w").alias("w"))


def cluster_texts(texts: DataFrame, n_clusters: int = 30, seed: int = 42, n_init: int = 10,
                  num_features: int = 1 << 14) -> DataFrame:
    """TX2-TX4: k-means over the distinct cleaned texts (SO2).

    k = min(n_clusters, number of distinct texts); the best of ``n_init`` seeded restarts, which
    advance together, by cost.  The centres (n_init * k * num_features numbers, 39 MB by default)
    are sent to every task.  Output: clean_desc, cluster_id.
    """
    uniq = texts.select("clean_desc").distinct()
    points = cut_lineage(text_points(uniq, num_features))
    k = min(n_clusters, points.limit(n_clusters).count())
    if k < 2:
        return points.select("clean_desc", F.lit(0).alias("cluster_id"))
    return cut_lineage(best_of_restarts(points, "clean_desc", k, n_init, num_features, seed))


def label_clusters(assigned: DataFrame, n_terms: int = 3) -> DataFrame:
    """TX5: cluster_id -> category_name from its top terms."""
    terms = assigned.select("cluster_id", F.explode(F.split(F.lower("clean_desc"), r"\s+")).alias("term")) \
        .where(F.col("term") != "")
    tf = terms.groupBy("cluster_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n_cl = assigned.select("cluster_id").distinct().count()
    cf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    scored = tf.join(cf, "term").withColumn(
        "score", F.col("tf") * F.log((1.0 + n_cl) / (1.0 + F.col("cf"))))
    top = top_k_per_group(scored, ["cluster_id"], [F.col("score").desc(), F.col("term")],
                          n_terms, salt_cols=["term"], buckets=8)
    names = top.groupBy("cluster_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))),
                                 lambda x: F.initcap(x["term"])), " ").alias("category_name"))
    ids = assigned.select("cluster_id").distinct()
    return ids.join(names, "cluster_id", "left").select(
        "cluster_id", F.coalesce("category_name", F.lit("Misc")).alias("category_name"))


def cluster_samples(assigned: DataFrame, n: int = 20) -> DataFrame:
    """TK7: the alphabetically first ``n`` distinct texts of every cluster, ranked from 1.
    assigned: cluster_id, clean_desc; a cluster of any size is ranked in pieces."""
    texts = assigned.select("cluster_id", "clean_desc").distinct()
    return top_k_per_group(texts, ["cluster_id"], [F.col("clean_desc")], n, salt_cols=["clean_desc"])


def build_dim_product(facts: DataFrame, n_clusters: int = 30, version: str = "v1",
                      seed: int = 42, n_init: int = 10) -> DataFrame:
    """TX8/TX9/SO3: one row per stock_code (the alphabetically first of its
    descriptions), with the cluster as category id and its label."""
    texts = product_texts(facts)
    assigned = cluster_texts(texts, n_clusters, seed, n_init)
    labels = label_clusters(assigned)
    rows = texts.join(assigned, "clean_desc").join(F.broadcast(labels), "cluster_id")
    one = rows.groupBy("stock_code").agg(F.min_by(
        F.struct("clean_desc", "cluster_id", "category_name"), F.col("description")).alias("r"))
    return one.select("stock_code", F.col("r.clean_desc").alias("canonical_description"),
                      F.col("r.cluster_id").alias("category_id"),
                      F.col("r.category_name").alias("category_name"),
                      F.col("r.cluster_id").alias("cluster_id"),
                      F.lit(version).alias("taxonomy_version"))
