"""TX7, TK6: top-k over weighted terms without scoring every row that shares a common term.

Rows are dealt into blocks by how many terms they have, since weights of normalised rows fall
with their length; the index holds the greatest weight of every term in every block.

1. Each query's strongest terms (greatest query weight times greatest weight) give partial scores;
   the ``pilots`` best rows are scored whole, and their k-th score is a floor that the final k-th
   score can't be under.
2. In each block, of a query's weakest terms as many as together stay under the floor can't bring
   a row to it: only rows with one of the others, the essential terms, are candidates; a block
   whose terms all together stay under the floor is skipped.
3. A candidate is dropped if its partial score and the block's greatest weights of the weak
   terms stay under the floor; the others' weak terms are looked up by (term, row).

The result is exact for weights of 0 or more.  Every step is an equi-join; what is broadcast is
checked for its size.  What it saves hangs on the words: common ones, whose postings grow with
the corpus, are weak beside rare ones; where all words are about as frequent, little is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcycle.functions.topk import top_k_per_group
from tillcycle.session import bounded_broadcast, cut_lineage

#: Scores are compared after rounding to 9 digits.
SLACK = 2e-9


@dataclass(frozen=True)
class TermIndex:
    postings: DataFrame     # term, id, cw, block
    terms: DataFrame        # term, top, n
    blocks: DataFrame       # term, block, block_top, n


def term_index(corpus: DataFrame, id_col: str = "id", per_doubling: int = 16) -> TermIndex:
    """``corpus``: (id_col, term, w).  Blocks: ``per_doubling`` to a doubling of a row's terms."""
    p = corpus.where("w > 0").select(F.col(id_col).alias("id"), "term", F.col("w").alias("cw"))
    # a window over one row's terms, bounded by its text: the postings are shuffled once
    size = F.count(F.lit(1)).over(Window.partitionBy("id")).cast("double")
    p = cut_lineage(p.withColumn("block", F.floor(F.log2(size) * per_doubling).cast("int")))
    b = cut_lineage(p.groupBy("term", "block").agg(F.max("cw").alias("block_top"), F.count(F.lit(1)).alias("n")))
    t = cut_lineage(b.groupBy("term").agg(F.max("block_top").alias("top"), F.sum("n").alias("n")))
    return TermIndex(p, t, b)


def _looked_up(rows: DataFrame, terms: DataFrame, on: list[str], index: TermIndex) -> DataFrame:
    """(q, id, more, hits): what the query's ``terms`` add to each of the ``rows`` (q, id, block)."""
    # only the postings of these rows and terms are shuffled, where there are few of either
    own = index.postings.select("term", "id", "cw")
    for key, of in (("id", rows), ("term", terms)):
        own = own.join(bounded_broadcast(of.select(key).distinct()), key, "left_semi")
    return (rows.join(terms, on).join(own, ["term", "id"])
            .groupBy("q", "id").agg(F.sum(F.col("qw") * F.col("cw")).alias("more"), F.count(F.lit(1)).alias("hits")))


def _partial(terms: DataFrame, on: list[str], index: TermIndex) -> DataFrame:
    return (index.postings.join(bounded_broadcast(terms.select("q", "qw", *on)), on).groupBy("q", "id", "block")
            .agg(F.sum(F.col("qw") * F.col("cw")).alias("score"), F.count(F.lit(1)).alias("hits")))


def pruned_topk(index: TermIndex, queries: DataFrame, k: int = 3, query_id: str = "query_id", id_col: str = "id",
                strongest: int = 3, pilots: int = 30) -> tuple[DataFrame, DataFrame]:
    """(top, work): per query the k rows of highest dot product, as `retrieval.terms_topk` gives
    them, and one row a query with ``hits_all``, the postings of its terms, and ``hits_scored``, those
    that were read for a score."""
    q = cut_lineage(queries.where("w > 0").select(F.col(query_id).alias("q"), "term", F.col("w").alias("qw"))
                    .join(index.terms, "term").withColumn("most", F.col("qw") * F.col("top")))
    # windows over one query's terms, bounded by its text
    strong = Window.partitionBy("q").orderBy(F.desc("most"), "n", "term")
    pilot = cut_lineage(_partial(q.withColumn("r", F.row_number().over(strong)).where(F.col("r") <= strongest), ["term"], index))
    tried = top_k_per_group(pilot.select("q", "id", "score"), ["q"], [F.col("score").desc()], max(k, pilots),
                            salt_cols=["id"], buckets=16)
    whole = cut_lineage(_looked_up(tried.select("q", "id"), q.select("q", "term", "qw"), ["q"], index))
    best = top_k_per_group(whole, ["q"], [F.col("more").desc()], k, salt_cols=["id"], buckets=16)
    floors = cut_lineage(best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("more").alias("floor"))
                         .where(F.col("n") == k).select("q", (F.col("floor") - SLACK).alias("floor")))
    in_block = (q.select("q", "term", "qw").join(index.blocks, "term").withColumn("most", F.col("qw") * F.col("block_top"))
                .join(bounded_broadcast(floors), "q", "left"))
    weak_first = Window.partitionBy("q", "block").orderBy("most", F.desc("n"), "term")
    in_block = in_block.withColumn("below", F.sum("most").over(weak_first))
    in_block = cut_lineage(in_block.withColumn("weak", F.coalesce(F.col("below") < F.col("floor"), F.lit(False))))
    partial = cut_lineage(_partial(in_block.where("not weak"), ["term", "block"], index))
    weak = in_block.where("weak").select("q", "block", "term", "qw", "most")
    rest = weak.groupBy("q", "block").agg(F.sum("most").alias("rest"))
    within = F.col("floor").isNull() | (F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor"))
    stay = cut_lineage(partial.join(bounded_broadcast(floors), "q", "left").join(rest, ["q", "block"], "left")
                       .where(within).select("q", "id", "block", "score"))
    looked = cut_lineage(_looked_up(stay.select("q", "id", "block"), weak.select("q", "block", "term", "qw"), ["q", "block"], index))
    total = stay.join(looked, ["q", "id"], "left").select(
        F.col("q").alias(query_id), F.col("id").alias(id_col),
        F.round(F.col("score") + F.coalesce("more", F.lit(0.0)), 9).alias("score"))
    top = top_k_per_group(total, [query_id], [F.col("score").desc(), F.col(id_col)], k, salt_cols=[id_col], buckets=16)
    scored = None
    for read in (pilot, whole, partial, looked):
        scored = read.select("q", "hits") if scored is None else scored.unionByName(read.select("q", "hits"))
    scored = scored.groupBy("q").agg(F.sum("hits").alias("hits_scored"))
    work = (q.groupBy("q").agg(F.sum("n").alias("hits_all")).join(scored, "q", "left")
            .select(F.col("q").alias(query_id), "hits_all", F.coalesce("hits_scored", F.lit(0)).alias("hits_scored")))
    return top, work
