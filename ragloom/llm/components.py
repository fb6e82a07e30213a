"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (u long, v long); root is the component's smallest node.

    Minimum-label propagation with pointer jumping; every round is a table in the shared folder, only a checksum
    reaches the driver. Rounds grow with the logarithm of a component's diameter in practice. Where a hub's rows meet
    in one partition of a join, adaptive execution splits it; what follows a join is summed before it is shuffled.
    """
    both = stored(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("root")), "labels")
    weight = lambda t: t.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
    total = weight(labels)
    while total is not None:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"))
        jump = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", "next")
        old, labels = labels, stored(jump.select("node", F.col("next").alias("root")), "labels")
        discard(old)
        now = weight(labels)
        if now == total:
            break
        total = now
    discard(both)
    return labels
