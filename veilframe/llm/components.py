"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import saved


def _tally() -> tuple[Column, ...]:
    """Changes whenever the set of edges does (but for freak collisions)."""
    return F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another one; the component is its smallest node.

    ``edges``: columns u and v. Each round replaces edges by edges to smaller nodes, first towards the
    smallest neighbour of each node's larger side, then of its smaller side, until every node points at its
    component's smallest. Minima are aggregated before the shuffle, and rows of one node are only ever joined to one row.
    """
    turned = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    current, before = saved(edges.where("u <> v").select(*turned).distinct(), "edges", *_tally())
    while before[0]:
        either_way = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        both = current.select(either_way.alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars, _ = saved(large.distinct(), "stars")
        smallest = stars.groupBy("u").agg(F.min("v").alias("m"))
        # To its smallest neighbour from each node, and from its other neighbours.
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = stars.join(smallest, "u").select(ends.alias("e")).select("e.u", "e.v").where("u <> v")
        current, after = saved(small.distinct(), "stars", *_tally())
        if after == before:
            break
        before = after
    own = F.explode(F.array("u", "v")).alias("node")
    return current.select(own, F.col("v").alias("component")).distinct()
