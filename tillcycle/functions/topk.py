"""Top-k per group without funnelling a hot group through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcycle.session import cut_lineage


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    salt_cols: list[str], buckets: int = 64, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group by ``order`` (which must be a total
    order, i.e. end with a unique tie-break).

    Two phases: rank inside (group, hash(salt_cols) mod buckets) and keep k
    per bucket, then rank the at most ``k * buckets`` survivors per group.
    A group holding a third of all rows is therefore sorted in ``buckets``
    parallel pieces, and the final window sees a bounded number of rows.
    """
    b = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(buckets))
    w1 = Window.partitionBy(*group, b).orderBy(*order)
    first = df.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return first.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def least_candidates(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The rows that may hold their group's least ``text``, among them all that do.

    The least text of every 64th row (by hash) bounds that of all rows, so few rows are left to an
    aggregate of texts, which sorts what it reads; a group without a bound keeps all its rows."""
    bound = cut_lineage(df.where(F.pmod(F.xxhash64(text), F.lit(64)) == 0).groupBy(*keys).agg(F.min(text).alias("_bound")))
    return df.join(bound, keys, "left").where(F.col("_bound").isNull() | (F.col(text) <= F.col("_bound"))).drop("_bound")
