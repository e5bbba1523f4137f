"""Connected components of a link table that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairshare.sources.tables import settle


def _large_star(links: DataFrame) -> DataFrame:
    """Links of every node's larger neighbours moved to its least neighbour, or itself."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links of every node's smaller neighbours, and of the node, moved to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is the least node it can reach.

    Large-star and small-star steps alternate until the links no longer change, which is after
    about the logarithm of the longest path. A step groups and joins on one column, aggregates
    before it shuffles, and its links are written to the shared folder, so lineage stays short.
    Rows with a null end or equal ends say nothing and are left out; without links the result is
    empty.
    """
    u, v = F.col(left), F.col(right)
    start = links.where(u.isNotNull() & v.isNotNull() & (u != v))
    start = start.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    current, before = settle(start, "links"), None
    while True:
        print_of = F.bit_xor(F.xxhash64("u", "v"))
        found = current.agg(F.count(F.lit(1)).alias("n"), print_of.alias("h")).first()
        if found["n"] == 0 or found == before:
            break
        before = found
        # after a large-star step no node links to itself from above, so u > v still holds
        current = settle(_small_star(_large_star(current)).where("u != v").distinct(), "links")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = current.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(own).distinct()
