"""Connected components of keyed graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.sources.readers import stored


def components(edges: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(keys, node, root): the smallest node of its component for every node of ``edges``; a key's graph is its own.

    A round gives every node the least label among itself and its neighbours, and then the label of that label (pointer
    jumping), so the number of rounds grows with the logarithm of a component's width and not with its size.  Labels are
    found by ``min``, never by collecting neighbours, and each round's go to shared storage.
    """
    keys = list(keys)
    both = edges.select(*keys, F.col(a).alias("node"), F.col(b).alias("other"))
    both = stored(both.unionByName(both.select(*keys, F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = stored(both.groupBy(*keys, "node").agg(F.least("node", F.min("other")).alias("root")), "labels")
    while True:
        # hook: a node's root takes the least root seen among the neighbours of all nodes below it
        seen = both.join(labels.withColumnsRenamed({"node": "other", "root": "_near"}), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("_near").alias("_near"))
        near = labels.join(seen, [*keys, "node"]).withColumn("_near", F.least("root", "_near"))
        hooked = near.groupBy(*keys, F.col("root").alias("_at")).agg(F.min("_near").alias("_to"))
        # jump: a node follows its root's new root
        moved = near.join(hooked.withColumnRenamed("_at", "root"), [*keys, "root"]).select(*keys, "node", F.least("_near", "_to").alias("_new"), "root")
        moved = stored(moved, "labels")
        jump = moved.select(*keys, F.col("node").alias("_new"), F.col("_new").alias("_next"))
        after = moved.join(jump, [*keys, "_new"], "left").select(*keys, "node", F.least("_new", F.coalesce("_next", "_new")).alias("root"), F.col("root").alias("_old"))
        after = stored(after, "labels")
        if after.filter("root <> _old").isEmpty():
            return after.select(*keys, "node", "root")
        labels = after.drop("_old")
