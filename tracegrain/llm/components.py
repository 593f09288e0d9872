"""Connected components of a graph of links, as DataFrame rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import discard, save


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours (the larger ones, or the smaller ones and itself) on its least neighbour.

    Only a minimum per node is gathered, and partly before the shuffle; a node with very many links never has
    them in one place, and the join back is one that Spark can split where it is skewed.
    """
    both = links.union(links.select(F.col("b"), F.col("a"))).toDF("u", "v") if large else links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (columns a, b: longs, no nulls); root is the least node reachable.

    Each round is stored, so a lost executor costs one round. The rounds needed grow with the square of the
    logarithm of the nodes at most.
    """
    now = save(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    mark = F.struct(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))))
    seen = now.agg(mark).first()[0]
    for _ in range(rounds):
        if not seen[0]:
            break
        before, now = now, save(_stars(_stars(now, True), False), "links")
        last, seen = seen, now.agg(mark).first()[0]
        discard(before)  # the next round starts from the stored one
        if last == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    tree = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tree.union(tree.select(F.col("root").alias("node"), "root")).distinct()
