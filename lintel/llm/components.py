"""Connected components by contraction, for link tables of any size.

Each round points every node at its smallest neighbour, follows the pointers to
their ends and replaces the links by links between those ends. A node that has a
smaller neighbour disappears, so the links shrink at least by half their nodes
in each round. Per node only minima are kept (partial aggregation), so a node
with very many links costs one row a task. Every round is written to the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``; component: its smallest node.

    Links to oneself and links with a null end are left out; repeated and
    reversed links count once. No links give no rows.
    """
    a, b = F.col("a"), F.col("b")
    edges = saved(links.filter(a.isNotNull() & b.isNotNull() & (a != b))
                  .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
                   .select(F.col("a").alias("node"), "p"), "pointers")
        while True:  # follow the pointers; they only ever lead to smaller nodes
            end = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            hop = saved(up.join(end, "p").select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "pointers")
            up = hop.select("node", "p")
            if hop.filter("moved").isEmpty():
                break
        if labels is None:
            labels = up.select("node", F.col("p").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), "p")
            labels = saved(labels.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        ends = edges
        for side in ("a", "b"):
            ends = ends.join(up.select(F.col("node").alias(side), F.col("p").alias(f"{side}_")), side)
        ends = ends.select(F.greatest("a_", "b_").alias("a"), F.least("a_", "b_").alias("b"))
        edges = saved(ends.filter("a != b").distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
