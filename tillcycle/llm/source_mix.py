"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Within a source every document has the same expected number of copies
``rate = target / source_size``; the prefix sum of expected copies over the source's
documents, ordered by size so that neighbours weigh alike, plus one random offset per
source, crosses an integer boundary ``copies`` times per document.  ``rate <= max_repeat``
bounds the copies of any document.

The rank in the order (size, bucket, doc_id) is never a sort of one source: counts per
(source, size) and per (source, size, bucket) give the rank before a bucket, and only the
rows of one bucket of one size are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillcycle.llm.common import WORD, columns, row_hashes, unused, written

WEIGHTS = (3, 1, 2)


def _unit(c: Column) -> Column:
    """First 32 bits of the MD5 of ``c`` as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_key(source: Column) -> Column:
    """Orders as the source's code points, null last; never null itself."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, total_share: float, max_repeat: float,
            weights: tuple[int, ...]) -> DataFrame:
    """(sk, source_size, target) from (sk, source_size): one row per source.

    A source is full when its share per weight reaches its limit; in the order of
    limit / weight the full sources are a prefix, so one running sum finds the level."""
    by_name = W.orderBy("sk")
    at = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("lim", F.lit(max_repeat) * F.col("source_size"))
    every = W.partitionBy()
    before = W.orderBy(F.col("lim") / F.col("w"), "sk").rowsBetween(W.unboundedPreceding, -1)
    s = s.select(
        "sk", "source_size", "w", "lim",
        (F.lit(total_share) * F.sum("source_size").over(every)).alias("total"),
        F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum("lim").over(before), F.lit(0.0)).alias("lim_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"))
    level = (F.col("total") - F.col("lim_before")) / (F.col("all_w") - F.col("w_before"))
    s = s.withColumn("full", F.col("lim") / F.col("w") <= level)
    full_lim = F.sum(F.when(F.col("full"), F.col("lim")).otherwise(0.0)).over(every)
    full_w = F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(every)
    share = F.col("w") * (F.col("total") - full_lim) / (F.col("all_w") - full_w)
    return s.select("sk", "source_size",
                    F.when(F.col("full"), F.col("lim")).otherwise(F.least("lim", share)).alias("target"))


def mix(docs: DataFrame, total_share: float = 1.5, max_repeat: float = 2.0,
        weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", buckets: int = 64,
        also: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken; then the
    columns ``also``, which order rows of one doc_id.

    Null source is a source of its own; a null or empty text has size 0; repeated rows are
    documents of their own (equal rows are interchangeable in the order); an empty table
    gives an empty result; a source of size 0 has target 0.  Extra columns are not read."""
    d = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"),
                    F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *also)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    d = d.select("*", source_key(F.col("source")).alias("sk"),
                 (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8), 16, 10).cast("long")
                  % buckets).cast("int").alias("bucket"))
    d = written(d, "sizes")  # narrow, so that texts are scanned once
    cells = d.groupBy("sk", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    per_size = cells.groupBy("sk", "size").agg(F.sum("n").alias("n_size"))
    per_source = per_size.groupBy("sk").agg(F.sum(F.col("size") * F.col("n_size")).alias("source_size"))
    goal = targets(per_source, total_share, max_repeat, weights)
    upto = (W.unboundedPreceding, -1)
    size_before = per_size.select(
        "sk", "size", F.coalesce(F.sum("n_size").over(
            W.partitionBy("sk").orderBy("size").rowsBetween(*upto)), F.lit(0)).alias("before_size"))
    offsets = cells.select(
        "sk", "size", "bucket", F.coalesce(F.sum("n").over(
            W.partitionBy("sk", "size").orderBy("bucket").rowsBetween(*upto)), F.lit(0)).alias("before_bucket"))
    offsets = (offsets.join(size_before, ["sk", "size"]).join(goal, "sk")
               .select("sk", "size", "bucket", "source_size", "target",
                       (F.col("before_size") + F.col("before_bucket")).alias("before")))
    k = F.col("before") + F.row_number().over(
        W.partitionBy("sk", "size", "bucket").orderBy("doc_id", *also))
    out = d.join(offsets, ["sk", "size", "bucket"]).withColumn("k", k)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _unit(F.concat(F.lit(f"{seed}:"), F.col("sk")))
    copies = (F.floor(rate * F.col("k") + start) - F.floor(rate * (F.col("k") - 1) + start)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"), *also)


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns as given.

    Every row has its own count, whatever its doc_id; rows equal in all columns are taken as
    often as they are together."""
    *key, copies_of, turn = unused(docs, "row1", "row2", "copies_of", "turn")
    key = tuple(key)
    keyed = docs.withColumns(dict(zip(key, row_hashes(docs), strict=True)))
    copies = mix(keyed, **kw, also=key).groupBy(*key).agg(F.sum("copies").alias(copies_of))
    taken = keyed.join(copies.where(F.col(copies_of) > 0), list(key)).dropDuplicates(list(key))
    return (taken.withColumn(turn, F.explode(F.array_repeat(F.lit(0), F.col(copies_of).cast("int"))))
            .select(*columns(docs)))


SQL = """
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
         ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 8))::BIGINT % 64 AS bucket
  FROM documents),
s AS (SELECT sk, sum(size)::DOUBLE AS source_size,
             [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::INT]::DOUBLE AS w
      FROM d GROUP BY sk),
s1 AS (SELECT *, 2.0 * source_size AS lim, 1.5 * sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM s),
s2 AS (SELECT *,
         coalesce(sum(lim) OVER b, 0) AS lim_before, coalesce(sum(w) OVER b, 0) AS w_before FROM s1
       WINDOW b AS (ORDER BY lim / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, lim / w <= (total - lim_before) / (all_w - w_before) AS is_full FROM s2),
s4 AS (SELECT *, sum(CASE WHEN is_full THEN lim ELSE 0 END) OVER () AS fl,
              sum(CASE WHEN is_full THEN w ELSE 0 END) OVER () AS fw FROM s3),
t AS (SELECT sk, source_size, CASE WHEN is_full THEN lim ELSE least(lim, w * (total - fl) / (all_w - fw)) END::DOUBLE AS target,
             ('0x' || substr(md5('mix:' || sk), 1, 8))::BIGINT / 4294967296.0 AS u FROM s4),
r AS (SELECT d.*, row_number() OVER (PARTITION BY sk ORDER BY size, bucket, doc_id) AS k FROM d),
x AS (SELECT doc_id, size, source_size, target, u, k,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM r JOIN t USING (sk))
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (floor(rate * k + u) - floor(rate * (k - 1) + u))::BIGINT * size AS taken FROM x
"""
