"""Connected components by contraction over Spark joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.store import materialise


def _order(node: str, number: int) -> Column:
    """What makes a node first among its neighbours: the id, in every second round a hash
    of it, so that neither stars around small ids nor long sorted paths take many rounds."""
    mixed = F.lit(0).cast("long") if number % 2 == 0 else F.xxhash64(node, F.lit(number))
    return F.struct(mixed.alias("place"), F.col(node).alias("node"))


def components(links: DataFrame) -> DataFrame:
    """node, component (one node of it) for every node linked with another, from links (a, b) of longs.

    In each round every node joins its first neighbour, links are rewritten to the nodes
    that were joined, and loops and repeats go; so the links shrink until none is left.
    Loops and repeated links do no harm. A link with a null end links nothing. No links give
    an empty table. Each round is written out.
    """
    edges, joined, number = links.select("a", "b").where("a <> b"), [], 0
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(_order("b", number)).alias("least"))
        step = materialise(first.select("a", F.least("least", _order("a", number))["node"].alias("to")))
        joined.append(step)
        left = edges.join(step.withColumnRenamed("to", "x"), "a")
        right = step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = left.join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges, number = materialise(edges.distinct()), number + 1
        if not edges.take(1):
            break
    label = joined[0].select(F.col("a").alias("node"), F.col("to").alias("component"))
    for step in joined[1:]:
        to = step.select(F.col("a").alias("component"), "to")
        label = label.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialise(label)
