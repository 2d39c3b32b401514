"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.workspace import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node in it) for every node that has an edge.

    Rounds of taking the smallest label among the neighbours and then that label's own
    label, each written to the shared folder, until nothing changes; labels are summed
    before each shuffle, so a node with very many edges is no large task. Rows with a
    null are no edges.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stored(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component")), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        own = labels.join(near, labels.node == near.u).select("node", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        hop = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        moved = stored(own.join(hop, "to").select("node", "old", F.least("to", "further").alias("component")), "labels")
        labels = moved.select("node", "component")
        if not moved.where("old <> component").limit(1).count():
            return labels
