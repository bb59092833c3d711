"""Connected components of an edge table: the smallest node id of each component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators.skew import split_join
from kelpie.session import materialize, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that has an edge.

    Every round, each node takes the smallest label among its neighbours' and then the label
    of that label, so that labels cover at least twice the distance each round. Null ends
    make no edge; loops give a component of one. An empty table gives an empty result.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = materialize(pairs.union(pairs.select("y", "x")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")), "labels")
    while True:
        near = split_join(both, labels.withColumnRenamed("node", "y"), ["y"], ["x"]).groupBy("x").agg(F.min("component").alias("low"))
        # the node that lent the label hears of the smaller one, too
        hooked = labels.join(near, labels["node"] == near["x"]).select("node", "component", F.least("low", "component").alias("low"))
        told = hooked.select(F.col("component").alias("node"), F.col("low").alias("component")).unionByName(hooked.select("node", F.col("low").alias("component")))
        best = told.groupBy("node").agg(F.min("component").alias("component"))
        jump = best.select(F.col("node").alias("component"), F.col("component").alias("further"))
        stepped = best.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"))
        following = materialize(stepped, "labels")
        changed = following.join(labels.select("node", F.col("component").alias("old")), "node").where("component <> old").limit(1).count()
        release(labels)
        labels = following
        if not changed:
            return labels
