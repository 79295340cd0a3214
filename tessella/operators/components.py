"""Connected components of a graph given as a table of links, without gathering links anywhere.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014): each round replaces links by links to smaller nodes and converges in O(log^2 n) rounds. The minimum of each node's
neighbours is aggregated map-side and written before it is joined back, so that both inputs of the join are plain exchanges and a node with
very many links is split by the skew join of AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_stored, stored


def _toward_minimum(half: DataFrame) -> DataFrame:
    """half(u, v): each u's neighbours v; adds m, the least of them and u."""
    least = stored(half.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("w"), F.least("u", "least").alias("m")), "cc-min")
    return half.join(least, F.col("u") == F.col("w")).drop("w")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _toward_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    joined = _toward_minimum(links)
    kept = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b): bigint pairs, repeats and loops allowed. Returns (node, component): component is the least node reached.

    Nodes without links to others are absent. An empty table gives an empty table.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-links")
    seen = _print(now)
    while seen[0]:
        mid = stored(_large_star(now), "cc-large")
        new = stored(_small_star(mid), "cc-small")
        drop_stored(now, mid)
        now, before, seen = new, seen, _print(new)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
