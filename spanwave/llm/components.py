"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwave.llm.storage import stage


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for every node of a link; the component is its smallest node.

    Each round takes the smallest label among a node's neighbours, gives it to the node and to the
    node's old label, and then follows every label once; the number of rounds grows with the
    logarithm of the longest path. Only the count of changed labels comes to the driver. Links with
    a null end are ignored.
    """
    there = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    both = stage(there.union(there.select("b", "a")).distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        moved = labels.join(near, labels["node"] == near["a"]).select(
            "node", "label", F.least("label", "least").alias("least")
        )
        hooked = moved.select("node", "least").union(moved.select("label", "least")).groupBy("node").agg(F.min("least").alias("label"))
        hooked = stage(hooked)
        above = hooked.select(F.col("node").alias("of"), F.col("label").alias("next"))
        jumped = stage(
            hooked.join(above, hooked["label"] == above["of"], "left").select("node", F.coalesce("next", "label").alias("label"))
        )
        old = labels.select("node", F.col("label").alias("old"))
        if jumped.join(old, "node").where("label <> old").isEmpty():
            return jumped.select("node", F.col("label").alias("component"))
        labels = jumped
