"""Connected components of links, by rounds of joins that no task or driver sees whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailtally.session import pin


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour or itself."""
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("_least"))
    near = both.join(least, "high").filter(F.col("low") > F.col("high"))
    return near.select(F.col("low").alias("high"), F.col("_least").alias("low"))


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("_least"))
    near = links.join(least, "high").filter(F.col("low") != F.col("_least"))
    moved = near.select(F.col("low").alias("high"), F.col("_least").alias("low"))
    return moved.unionByName(least.select("high", F.col("_least").alias("low"))).distinct()


def _state(links: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), digest).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    Links to oneself, repeated links and links with a null say nothing. Stars alternate until
    nothing changes, about as often as the logarithm of the longest chain.
    """
    a, b = F.col(left), F.col(right)
    current = pin(links.filter(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct())
    state = _state(current)
    while state[0]:
        following = pin(_small_star(_large_star(current)))
        reached = _state(following)
        current, state, before = following, reached, state
        if reached == before:
            break
    nodes = current.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = current.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return nodes.unionByName(roots)
