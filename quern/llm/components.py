"""Connected components by contraction.

In each round every node takes the label of the first among itself and its neighbours: the one of most neighbours, and among
equals the first in an order that a hash draws anew for the round. Then edges are mapped to labels, and those within a label
go. So a star is one label after a round, and a chain loses a share of its nodes in every round; the first node of all always
absorbs its neighbours. A node's neighbours are never gathered: only their number and the first are aggregated. Each round is
written to the shared folder; labels are put together from the last round back, so each node is joined once a round that it
lived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of each node of edges (a, b): label is the least id of its component. Loops and null ends are left out."""
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not steps or not now.isEmpty():
        turn = len(steps)

        def drawn(n: Column, c: str, turn: int = turn) -> Column:
            return F.struct((-n).alias("n"), F.xxhash64(c, F.lit(turn)).alias("place"), F.col(c).alias("id"))

        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met = scratch.keep(both.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n")), "met")
        seen = both.join(met.withColumnRenamed("id", "b"), "b")
        first = seen.groupBy(F.col("a").alias("id")).agg(F.min(drawn(F.col("n"), "b")).alias("first")).join(met, "id")
        step = scratch.keep(first.select("id", F.least(drawn(F.col("n"), "id"), F.col("first"))["id"].alias("label")), "step")
        left, right = step.select(F.col("id").alias("a"), F.col("label").alias("la")), step.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        mapped = now.join(left, "a").join(right, "b").filter("la <> lb")
        now = scratch.keep(mapped.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct(), "edges")
        steps.append(step)
    labels = steps[-1]
    for step in reversed(steps[:-1]):
        after = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        labels = step.join(after, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    least = labels.groupBy("label").agg(F.min("id").alias("least"))
    out = checkpointed(labels.join(least, "label").select("id", F.col("least").alias("label")), "labels")
    scratch.drop()
    return out
