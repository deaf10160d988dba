"""Connected components of an edge table by repeated contraction, all in Spark.

In each round every node points to the neighbour (or itself) that is first in an order drawn
anew for the round; edges are then rewritten to the nodes pointed at.  In a random order the
nodes left shrink by a constant factor, so rounds grow as the logarithm of the nodes, and a
dense group of any size is gone after a round or two.  Nothing but the number of edges left
reaches the driver; tables between rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.llm.common import written


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the same node for a
    whole component.  Loops and repeated edges are fine."""
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .distinct(), "edges")
    label = None
    for turn in range(max_rounds):
        if e.isEmpty():
            break
        rank = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: E731, B023
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.select("a", F.struct(rank("b").alias("r"), F.col("b").alias("v")).alias("s")) \
            .groupBy("a").agg(F.min("s").alias("s"))
        to = written(first.select(F.col("a").alias("node"), F.least(
            F.col("s"), F.struct(rank("a").alias("r"), F.col("a").alias("v")))["v"].alias("root")), f"to{turn}")
        if label is None:
            label = to
        else:
            step = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            label = written(label.join(step, "root", "left")
                            .select("node", F.coalesce("next", "root").alias("root")), f"label{turn}")
        x, y = (to.select(F.col("node").alias(c), F.col("root").alias(f"{c}2")) for c in "ab")
        e = written(e.join(x, "a").join(y, "b").where("a2 <> b2")
                    .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"e{turn}")
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    if label is None:
        label = e.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return label
