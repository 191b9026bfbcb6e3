"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored

BROADCAST_NODES = 2_000_000  #: nodes up to which their least neighbours are broadcast (32 MB); beyond, both sides are shuffled


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's least node) of every node with an edge; `edges` has u and v (long).

    Loops, repeated edges and edges with a null end are ignored; no edges give no rows. Each round halves the depth of
    the trees at least. The least neighbour is aggregated first, in two steps, and then broadcast while the edges are few:
    a hub's edges meet in one task only beyond that, where Spark splits them.
    """
    scratch = Scratch()
    now = scratch.stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, mark = None, _mark(now)
    while mark != before:
        ship = F.broadcast if 2 * mark[0] <= BROADCAST_NODES else (lambda x: x)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(ship(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(ship(least), "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, scratch = scratch, Scratch()
        now = scratch.stored(small, "edges")
        old.clear()
        before, mark = mark, _mark(now)
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = stored(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "roots")
    scratch.clear()
    return out
