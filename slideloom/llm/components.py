"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of ``links`` the smallest node that it can reach.

    Each round takes the smallest label among the neighbours and then the label of that label, so chains
    shrink by a growing factor.  Links and labels stay in tables; the driver only sees a count per round.
    An empty table of links gives an empty table.
    """
    kind = links.schema[a].dataType.simpleString()
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = materialize(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    # the first labels need no join: the smallest of a node and its neighbours
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("v"), F.col("label").alias("near"))
        lowest = both.join(seen, "v").groupBy("u").agg(F.min("near").alias("near"))
        moved = labels.join(lowest, labels["node"] == lowest["u"]).select("node", "label", F.least("label", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("further"))
        step = materialize(
            moved.join(jump, "lower", "left").select("node", F.col("label").alias("old"), F.least("lower", "further").cast(kind).alias("label")), "labels"
        )
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
