"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces a node's links by links to its smallest neighbour, until every node points
at the smallest node of its component. No step gathers a node's neighbours: the smallest one is
a partial aggregation, and it is joined to the links by a shuffle whose large partitions Spark
splits (the aggregate is kept first, so that both sides of the join are plain shuffles). Only
two numbers per step reach the driver, to see that nothing changed.

Edge cases: links of a node to itself and repeated links change nothing; a null end links
nothing; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import kept


def _with_smallest(links: DataFrame) -> DataFrame:
    """links (u, v) with ``m``, the smallest of u and its neighbours."""
    smallest = kept(links.groupBy("u").agg(F.min("v").alias("m")))
    return links.join(smallest, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    linked = _with_smallest(edges)
    down = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return linked.select(F.explode(down).alias("e")).select("e.u", "e.v").where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of one orderable type, in any direction. Returns (node, root) for
    every node that has a link to another one; root is the smallest node of its component and
    has a row as well."""
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges, seen = kept(edges), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        edges = kept(_small_star(kept(_large_star(edges))))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
