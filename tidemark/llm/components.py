"""Connected components by alternating stars, all of it joins and aggregates.

Each round replaces links by links to smaller neighbours; rounds are about the
logarithm of the longest path. A node with very many links is only ever the
key of a minimum (which is combined before the shuffle) and of a join (which
Spark splits where it is skewed). Links of a round are written to shared
storage, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """links: u, v of one orderable type, any direction. Gives u, v: each node but
    the smallest of its component, and that smallest."""
    e = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = work.put(f"{name}0", e)
    state, k = _state(e), 0
    while state[0]:
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        k += 1
        after = work.put(f"{name}{k}", small.distinct())
        new = _state(after)
        if k > 1:
            work.drop(f"{name}{k - 1}")
        e = after
        if new == state:
            break
        state = new
    return e
