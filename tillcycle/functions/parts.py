"""Ordered lists per group in parts of bounded length (SC8, AG18, CR13).

A group's values in order would be one array, as long as the group is large.  Here they are numbered
without sorting a group in one place: rows are range-partitioned by (group, order) into slices that
grow in number with the rows, sorted there and written with their places in the slice; a slice's
first number is the sum of the counts before it.  Only the counts, one row per (group, slice), are
summed in a window; a part is gathered from ``bound`` rows at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillcycle.session import bounded_broadcast, cut_lineage

#: Rows that a slice holds, about.
ROWS_PER_SLICE = 500_000


def numbered(df: DataFrame, group: list[str], order: list[str], slices: int = 64, name: str = "pos") -> DataFrame:
    """``df`` with each row's place, from 0, in its group in the given order (a unique one).  ``slices``
    is the least number of them."""
    slices = max(slices, -(-df.count() // ROWS_PER_SLICE))
    keys = [*group, *order]
    # the id counts the rows of a partition, in the sorted order; its upper bits are the partition's number
    dealt = cut_lineage(df.repartitionByRange(slices, *keys).sortWithinPartitions(*keys)
                        .withColumn("_at", F.monotonically_increasing_id())
                        .withColumn("_slice", F.spark_partition_id()))
    counts = dealt.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_start"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    firsts = bounded_broadcast(counts.select(*group, "_slice", (F.coalesce(before, F.lit(0)) - F.col("_start")).alias("_first")))
    on = F.col("p._slice") == F.col("f._slice")
    for k in group:
        on = on & F.col(f"p.{k}").eqNullSafe(F.col(f"f.{k}"))
    return dealt.alias("p").join(firsts.alias("f"), on).select(
        *[F.col(f"p.{c}") for c in df.columns], (F.col("f._first") + F.col("p._at")).alias(name))


def list_parts(df: DataFrame, group: list[str], order: list[str], value: str, bound: int = 1000,
               slices: int = 64) -> DataFrame:
    """(*group, part, n, items): each group's values in order, cut every ``bound`` values."""
    rows = numbered(df, group, order, slices, "_pos")
    tasks = max(1, -(-df.count() // ROWS_PER_SLICE))
    rows = rows.withColumn("part", F.floor(F.col("_pos") / bound)).repartition(tasks, *group, "part")
    parts = rows.groupBy(*group, "part").agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.col(value).alias("v")))).alias("l"))
    return parts.select(*group, "part", F.size("l").alias("n"), F.transform("l", lambda e: e["v"]).alias("items"))
