"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settle, skew_safe_lookup


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a long, b long) edges -> (node, comp), comp being the smallest node of the component.

    Each round moves every node's larger neighbours, then its smaller ones, to its least neighbour; stars remain.
    Rounds grow with the logarithm of the longest path. Each round is written to the shared folder, so lineage
    does not grow and a lost executor costs one round's tasks. Self loops and repeated edges are allowed; rows
    with a null are ignored; no edges give no rows.
    """
    cur = settle(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    total = cur.count()
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a node with a large part of all edges is joined by broadcast, see skew_safe_lookup
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = skew_safe_lookup(both, least, "u", "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        cur = settle(small)
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == before:
            break
        before = now
        total = now[0]
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
