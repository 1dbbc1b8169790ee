"""Connected components as joins and aggregations, for edges that no single machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.plans.scratch import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges: (a, b) of long ids, undirected. Returns (node, component): each node that has an edge to another node, with the smallest id
    that it reaches.

    Alternates large-star and small-star steps. Each keeps connectivity and moves edges to smaller ids, until
    every component is a star about its smallest node. The minimum per node is pre-aggregated before its shuffle, and
    the join back splits hot nodes. Null ids and loops are left out.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo and a is not null and b is not null").distinct(), "components")
    state = _state(e)
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = materialize(large, "components")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo")))).alias("x"))
        following = materialize(small.select("x.hi", "x.lo").where("hi <> lo").distinct(), "components")
        discard(e)
        discard(large)
        e, before = following, state
        state = _state(e)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.col("hi").cast("decimal(38,0)")), F.sum(F.col("lo").cast("decimal(38,0)"))).first())
