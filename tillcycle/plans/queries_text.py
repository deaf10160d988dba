"""Registered queries: product text cleaning, taxonomy, chunking, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcycle.functions.text import COLOUR_PATTERN, PACK_PATTERN
from tillcycle.operators.pruned_terms import pruned_topk, term_index
from tillcycle.operators.retrieval import chunk, terms_topk, tfidf_terms, vector_topk
from tillcycle.operators.taxonomy import build_dim_product, cluster_samples, product_texts
from tillcycle.plans.registry import REGISTRY, register
from tillcycle.session import cut_lineage
from tillcycle.sources.tables import FACT_SALES_SQL, fact_sales, read_table


@register("clean_descriptions", "TX1 SO1 FI6", f"""WITH {FACT_SALES_SQL},
p AS (SELECT DISTINCT stock_code, description FROM fact_sales WHERE description <> '')
SELECT stock_code, description,
       regexp_replace(regexp_replace(
         regexp_replace(regexp_replace(
           upper(regexp_replace(description, '^\\s+|\\s+$', '', 'g')),
           '{PACK_PATTERN}', '', 'g'), '{COLOUR_PATTERN}', '', 'g'),
         '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS clean_desc
FROM p""")
def q_clean(spark, d):
    return product_texts(fact_sales(spark, d, ["stock_code", "description"]))


@register("dim_product", "TX2 TX3 TX4 TX5 TX8 TX9 SO3 JO9")
def q_dim_product(spark, d):
    return build_dim_product(fact_sales(spark, d, ["stock_code", "description"]), n_clusters=30, n_init=10)


CHUNK_SQL = """
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_id, parts[i] AS text
FROM (SELECT doc_id, parts, generate_subscripts(parts, 1) AS i FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, {sep}),
                  lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts
  FROM documents))"""


@register("doc_chunks", "TX6", CHUNK_SQL.format(sep="chr(10) || chr(10)"))
def q_chunks(spark, d):
    return chunk(read_table(spark, d, "documents"), "doc_id", "text", "\n\n")


@register("doc_line_chunks", "TX6", CHUNK_SQL.format(sep="chr(10)"))
def q_line_chunks(spark, d):
    return chunk(read_table(spark, d, "documents"), "doc_id", "text", "\n")


CENTROID_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
c AS (SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, AVG(x) AS m FROM x GROUP BY label, i) GROUP BY label),
cn AS (SELECT label, list_transform(q, lambda y: y / (sqrt(list_sum(list_transform(q, lambda z: z * z))) + 1e-9)) AS q FROM c),
en AS (SELECT vec_id, list_transform(v, lambda y: y / (sqrt(list_sum(list_transform(v, lambda z: z * z))) + 1e-9)) AS v FROM e),
s AS (SELECT cn.label AS query_id, en.vec_id, list_dot_product(en.v, cn.q) AS score FROM cn, en)
SELECT query_id, vec_id, ROUND(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 3"""


def label_centroids(emb):
    """One query vector per label: the mean embedding (bounded by labels x dims)."""
    x = emb.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    m = x.groupBy("label", "i").agg(F.avg("x").alias("m"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))),
                                              lambda s: s["m"]).alias("embedding"))


@register("vector_topk_centroids", "TX3 TX7 TK6", CENTROID_SQL)
def q_vector_topk(spark, d):
    emb = read_table(spark, d, "embeddings")
    q = label_centroids(emb).withColumnRenamed("label", "query_id")
    top = vector_topk(emb, q, k=3, id_col="vec_id", vec_col="embedding",
                      query_id="query_id", query_vec="embedding")
    return top.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _tokens_sql(cte: str, source: str) -> str:
    return f"""{cte} AS (SELECT id, term, COUNT(*) AS tf FROM (
  SELECT id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM {source})
  WHERE term <> '' GROUP BY id, term)"""


RETRIEVAL_SQL = "WITH para AS (SELECT doc_id * 1048576 + chunk_id AS id, text FROM (" \
    + CHUNK_SQL.format(sep="chr(10) || chr(10)") + """)),
every AS (SELECT id, text FROM para UNION ALL SELECT -item_id - 1, text FROM benchmark),
""" + _tokens_sql("tf", "every") + """,
idf AS (SELECT term, ln(((SELECT COUNT(DISTINCT id) FROM every) + 1.0) / (COUNT(*) + 1.0)) AS idf FROM tf GROUP BY term),
w AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
n AS (SELECT id, sqrt(SUM(w * w)) AS norm FROM w GROUP BY id),
v AS (SELECT w.id, term, w / (norm + 1e-9) AS w FROM w JOIN n ON w.id = n.id),
s AS (SELECT -q.id - 1 AS item_id, c.id, ROUND(SUM(q.w * c.w), 9) AS score
      FROM v q JOIN v c ON q.term = c.term WHERE q.id < 0 AND c.id >= 0 GROUP BY q.id, c.id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM s)
SELECT item_id, CAST(id // 1048576 AS BIGINT) AS doc_id, CAST(id % 1048576 AS INTEGER) AS chunk_id,
       ROUND(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
CHUNK_SPAN = 1 << 20


@register("benchmark_retrieval", "TX2 TX6 TX7 TK6", RETRIEVAL_SQL)
def q_benchmark_retrieval(spark, d):
    """Benchmark passages as queries against document paragraphs (sparse
    TF-IDF cosine, top 3): which documents carry each benchmark passage.
    Document frequencies count paragraphs and passages."""
    corpus, queries = _passage_terms(spark, d)
    top = terms_topk(corpus, queries, k=3, id_col="id", query_id="item_id")
    return _by_paragraph(top)


def _passage_terms(spark, d):
    """Weighted terms of the document paragraphs, and of the benchmark passages."""
    docs = chunk(read_table(spark, d, "documents"), "doc_id", "text", "\n\n")
    # one long id per paragraph (doc_id * 2^20 + chunk_id); benchmark items negative
    corpus = docs.select((F.col("doc_id") * CHUNK_SPAN + F.col("chunk_id")).alias("id"), "text")
    bench = read_table(spark, d, "benchmark").select((-F.col("item_id") - 1).alias("id"), "text")
    both = cut_lineage(tfidf_terms(corpus.unionByName(bench), "id"))   # read as corpus and as queries
    queries = both.where(F.col("id") < 0).select((-F.col("id") - 1).alias("item_id"), "term", "w")
    return both.where(F.col("id") >= 0), queries


def _by_paragraph(top):
    return top.select("item_id", F.floor(F.col("id") / CHUNK_SPAN).cast("long").alias("doc_id"),
                      F.pmod(F.col("id"), F.lit(CHUNK_SPAN)).cast("int").alias("chunk_id"),
                      F.round("score", 6).alias("score"), "rank")


@register("benchmark_retrieval_pruned", "TX2 TX6 TX7 TK6", RETRIEVAL_SQL)
def q_benchmark_retrieval_pruned(spark, d):
    """The same rows, without scoring paragraphs that only share weak terms with a passage."""
    corpus, queries = _passage_terms(spark, d)
    top, _ = pruned_topk(term_index(corpus), queries, k=3, query_id="item_id")
    return _by_paragraph(top)


CLEAN_SQL = dict((n, q.sql) for n, q in REGISTRY.items())["clean_descriptions"]


@register("text_samples_per_group", "TK7 TX1", f"""SELECT cluster_id, clean_desc, rank FROM (
  SELECT cluster_id, clean_desc, CAST(ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY clean_desc) AS INTEGER) AS rank
  FROM (SELECT DISTINCT split_part(clean_desc, ' ', 1) AS cluster_id, clean_desc FROM ({CLEAN_SQL})))
WHERE rank <= 20""")
def q_text_samples(spark, d):
    """The first 20 texts of every group; texts are grouped by their first word, which SQL can follow."""
    texts = product_texts(fact_sales(spark, d, ["stock_code", "description"]))
    return cluster_samples(texts.withColumn("cluster_id", F.substring_index("clean_desc", " ", 1)))


@register("distinct_clean_texts", "SO2 TX1", CLEAN_SQL.replace("SELECT stock_code, description,", "SELECT DISTINCT", 1))
def q_distinct_clean(spark, d):
    """The texts that the taxonomy clusters, each once."""
    return product_texts(fact_sales(spark, d, ["stock_code", "description"])).select("clean_desc").distinct()


@register("dim_product_keys", "SO3 TX9 TX1", CLEAN_SQL.replace("SELECT stock_code, description,", "SELECT stock_code, min(description) AS first_text,", 1)
          .replace("AS clean_desc\nFROM p", "AS canonical_description\nFROM (SELECT stock_code, min(description) AS description FROM p GROUP BY stock_code) GROUP BY stock_code, description"))
def q_dim_product_keys(spark, d):
    """The product rows without their cluster: one per SKU, that of its
    alphabetically first description."""
    t = product_texts(fact_sales(spark, d, ["stock_code", "description"]))
    return t.groupBy("stock_code").agg(F.min("description").alias("first_text"),
                                       F.min_by("clean_desc", "description").alias("canonical_description"))
