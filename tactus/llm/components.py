"""Connected components of links, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.shared import settle


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node of ``links`` (a, b).

    Each round joins every node to the smallest of its neighbours' neighbours and contracts the links;
    a round at least halves the nodes that still have links, so the rounds grow with the logarithm of
    the nodes. Links with a null end or from a node to itself bring nothing together.
    """
    a, b = F.col("a"), F.col("b")
    links = links.where(a.isNotNull() & b.isNotNull())
    edges = settle(links.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        parents = settle(both.groupBy(a.alias("node")).agg(F.least(F.min("b"), a).alias("to")))
        up = parents.select(F.col("node").alias("to"), F.col("to").alias("top"))
        parents = settle(parents.join(up, "to").select("node", F.col("top").alias("to")))
        for end in ("a", "b"):
            edges = edges.join(parents.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end).drop(end).withColumnRenamed(f"{end}_to", end)
        edges = settle(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
        if labels is None:
            labels = parents.select("node", F.col("to").alias("component"))
        else:
            step = parents.select(F.col("node").alias("component"), "to")
            labels = settle(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    if labels is None:
        return edges.select(a.alias("node"), b.alias("component"))
    return labels
