"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all v's of u. Sums up before the shuffle; a hub's rows can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("w"), F.least("u", "least").alias("m"))
    return pairs.join(least, pairs["u"] == least["w"]).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long, not null) to (node, component): the least node that each linked node can reach.

    Nodes without links to others are not returned. Each round is written to the shared folder; rounds go on until
    nothing changes, about twice the logarithm of the longest chain.
    """
    edges = common.saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.saved(large, "links")
        found = _with_least(large)
        small = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v"))).distinct()
        edges = common.saved(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
