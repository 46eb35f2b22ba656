"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import discard, fingerprint, land


def _large_star(links: DataFrame) -> DataFrame:
    """Every node joins its larger neighbours to the smallest node it knows."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    across = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u, v); root is the smallest node that can be reached.

    Only nodes other than their own root are returned.  A pass shuffles the links by node with
    partial minima; a node with very many links is one row per link and no group is ever collected.
    Self-links and null ends are ignored; an empty table gives an empty one.
    """
    current = land(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), "links")
    mark = fingerprint(current, "u", "v")
    while mark[0]:
        following = land(_small_star(_large_star(current)), "links")
        after = fingerprint(following, "u", "v")
        discard(current)
        current = following
        if after == mark:
            break
        mark = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))

