"""Document chunking, text features and cosine top-k retrieval (SC15, TX2, TX3, TX6, TX7, TK6).

Vectors: corpus and queries are dealt by hash of their ids into ``shards`` and
``blocks``; Spark brings every shard together with every block, a task scores
one pair with numpy and keeps the best ``k`` per query, and the final ranking
per query is a two-phase (salted) top-k.  Nothing passes through the driver.
Text: documents and queries are tables of weighted terms, joined on the term.
Scores are ranked at nine decimals, so that equal rows tie in any order of
summation, and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.functions.text import strip_ws
from tillcycle.functions.topk import top_k_per_group
from tillcycle.session import bounded_broadcast, cut_lineage


def read_documents(spark, path: str, pattern: str = "*.md") -> DataFrame:
    """SC15: every matching file under ``path`` (recursive) as one row:
    source (path relative to ``path``), text."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    base = path.rstrip("/") + "/"
    src = F.regexp_replace(F.col("_metadata.file_path"), r"^file:", "")
    return df.select(F.regexp_replace(src, "^.*?" + base.replace(".", r"\."), "").alias("source"),
                     F.col("value").alias("text"))


def chunk(docs: DataFrame, id_col: str = "source", text_col: str = "text",
          sep: str = "\n\n") -> DataFrame:
    """TX6: split on ``sep``, strip, drop empty pieces, number the rest from 0.

    Output: id_col, chunk_id, text.  Whole texts are split (no prefix).
    """
    parts = F.filter(F.transform(F.split(F.col(text_col), sep, -1), strip_ws),
                     lambda p: p != "")
    return docs.select(id_col, F.posexplode(parts).alias("chunk_id", "text"))


def text_features(df: DataFrame, text_col: str = "text", num_features: int = 1 << 16,
                  out_col: str = "features", as_vector: bool = False):
    """TX2: tokenise -> hashed term counts -> IDF -> L2 normalised, as a
    dense ``array<double>``.  Returns (frame, fitted IDF model).  No
    pretrained embedding model exists offline; hashing keeps the vector
    width fixed however large the vocabulary grows."""
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=1)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    t = tf.transform(tok.transform(df))
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(t)
    n = Normalizer(inputCol="_idf", outputCol="_n", p=2.0).transform(idf.transform(t))
    if as_vector:   # keep the sparse ML vector (no densified copy per row)
        return n.withColumnRenamed("_n", out_col).drop("_tok", "_tf", "_idf"), idf
    return n.withColumn(out_col, vector_to_array("_n")).drop("_tok", "_tf", "_idf", "_n"), idf


def _score_pair(corpus: pd.DataFrame, queries: pd.DataFrame, k: int, id_col: str, eps: float,
                chunk: int = 1024) -> pd.DataFrame:
    """The k best corpus rows of each query within one shard; rows that tie
    with the k-th score are all ranked before the cut."""
    unit = lambda rows: (m := np.stack(rows.to_numpy()).astype(np.float64)) / (
        np.linalg.norm(m, axis=1, keepdims=True) + eps)
    found: tuple[list, list, list] = ([], [], [])
    if len(corpus) and len(queries):
        c, ids = unit(corpus["v"]), corpus[id_col].to_numpy()
        for at in range(0, len(queries), chunk):
            scores = np.round(unit(queries["v"].iloc[at:at + chunk]) @ c.T, 9)
            kth = np.partition(scores, -min(k, len(c)), axis=1)[:, -min(k, len(c))]
            for q, s, low in zip(queries["query_id"].iloc[at:at + chunk], scores, kth):
                near = np.flatnonzero(s >= low)
                best = near[np.lexsort((ids[near], -s[near]))][:k]
                for column, values in zip(found, ([q] * len(best), ids[best].tolist(), s[best].tolist())):
                    column.extend(values)
    # ids as objects: they may be of any type
    return pd.DataFrame({"query_id": pd.Series(found[0], dtype=object), id_col: pd.Series(found[1], dtype=object),
                         "score": pd.Series(found[2], dtype=float)})


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int = 3, id_col: str = "vec_id",
                vec_col: str = "embedding", query_id: str = "query_id",
                query_vec: str = "embedding", eps: float = 1e-9,
                shards: int | None = None, blocks: int | None = None,
                rows_per_task: int = 16_384) -> DataFrame:
    """TX7/TK6: per query the ``k`` corpus rows of highest cosine similarity.

    Output: query_id, id_col, score (cosine of the eps-normalised vectors, nine
    decimals), rank (1..k; ties by id ascending).  A task holds the rows of one
    shard and one block: about ``rows_per_task`` each, by counts, unless
    ``shards`` and ``blocks`` are given.
    """
    shards = shards or max(8, -(-corpus.count() // rows_per_task))
    blocks = blocks or max(1, -(-queries.count() // rows_per_task))
    id_type, q_type = dict(corpus.dtypes)[id_col], dict(queries.dtypes)[query_id]
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    c = corpus.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias(id_col), F.col(vec_col).cast("array<double>").alias("v"),
        F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard"),
        F.explode(number(blocks)).alias("block"))
    q = queries.where(F.col(query_vec).isNotNull()).select(
        F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("v"),
        F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int").alias("q_block"),
        F.explode(number(shards)).alias("q_shard"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _score_pair(a, b, k, id_col, eps)

    cand = c.groupBy("shard", "block").cogroup(q.groupBy("q_shard", "q_block")).applyInPandas(
        score, f"query_id {q_type}, {id_col} {id_type}, score double")
    top = top_k_per_group(cand, ["query_id"], [F.col("score").desc(), F.col(id_col)], k,
                          salt_cols=[id_col], buckets=16)
    return top.withColumnRenamed("query_id", query_id)


# ------------------------------------------------------------ sparse text retrieval
#: Terms of queries that are sent to all tasks.
BROADCAST_TERMS = 100_000


def tfidf_terms(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """TX2 (sparse): term frequency x inverse document frequency, L2-normalised:
    id_col, term, w.  Terms are the keys themselves, so no two are ever merged;
    texts without a term have no rows.  The texts meet by id before they are
    split, so that their terms and norms are aggregated where they arise;
    document frequencies are a partial aggregate per term, joined back on it."""
    toks = df.select(id_col, text_col).repartition(id_col).select(id_col, F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}_]+")).alias("term")) \
        .where(F.col("term") != "")
    tf = toks.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    total = df.select(id_col).distinct().agg(F.count(F.lit(1)).alias("total"))   # one row
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("dfreq")).join(F.broadcast(total)) \
        .select("term", F.log((F.col("total") + 1.0) / (F.col("dfreq") + 1.0)).alias("idf"))
    w = tf.join(bounded_broadcast(cut_lineage(idf), 500_000), "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, id_col).select(id_col, "term", (F.col("w") / (F.col("norm") + 1e-9)).alias("w"))


def terms_topk(corpus: DataFrame, queries: DataFrame, k: int = 3, id_col: str = "id",
               query_id: str = "query_id", salts: int = 8) -> DataFrame:
    """TX7 over weighted terms: per query the k corpus rows of highest dot
    product (cosine for normalised rows) among those that share a term.

    An equi-join on (term, salt): a term that most documents hold is split by
    document into ``salts`` keys, and the queries' few terms are sent to each.
    Partial sums per (query, row) are combined map-side before the shuffle.
    Few queries are sent everywhere instead: only the rows' terms that a query
    has are shuffled, by row, and what a row scores is ranked where it arises.
    """
    if queries.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        asked = F.broadcast(queries.select("term").distinct())
        own = corpus.join(asked, "term", "left_semi").select(id_col, "term", F.col("w").alias("cw")).repartition(id_col)
        hits = own.join(F.broadcast(queries.select(query_id, "term", F.col("w").alias("qw"))), "term")
        return _best(hits, k, id_col, query_id)
    c = corpus.select(F.col(id_col), "term", F.col("w").alias("cw"),
                      F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("salt"))
    q = queries.select(F.col(query_id), "term", F.col("w").alias("qw"),
                       F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return _best(q.join(c, ["term", "salt"]), k, id_col, query_id)


def _best(hits: DataFrame, k: int, id_col: str, query_id: str) -> DataFrame:
    hits = hits.groupBy(query_id, id_col).agg(F.round(F.sum(F.col("qw") * F.col("cw")), 9).alias("score"))
    return top_k_per_group(hits, [query_id], [F.col("score").desc(), F.col(id_col)], k,
                           salt_cols=[id_col], buckets=16)
