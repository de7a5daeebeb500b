"""Exact joins between splits: rows, groups, duplicates.

Keys are structs of normalised columns, so nulls and NaN meet each other and
hash joins work. The left side is reduced to a row a key before the join
(with partial aggregation), so a value that many rows share is carried once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import identity, same


def first_match(left: DataFrame, right: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """Each right row with the first left row that is identical: r_pos, l_pos, key, conflict."""
    value = lambda df: (F.col(f"`{target}`") if target else F.lit(None).cast("string"))
    low = left.select(identity(left, columns, right).alias("key"), "_pos", value(left).alias("t"))
    low = low.groupBy("key").agg(F.min(F.struct("_pos", "t")).alias("l"))
    high = right.select(identity(right, columns, left).alias("rkey"), F.col("_pos").alias("r_pos"), value(right).alias("rt"))
    return high.join(low, F.col("rkey") == F.col("key")).select(
        "r_pos", F.col("l._pos").alias("l_pos"), "key", (~same(F.col("l.t"), F.col("rt"))).alias("conflict")
    )


def exact_overlap(left: DataFrame, right: DataFrame, columns: list[str], target: str | None = None, examples: int = 10) -> DataFrame:
    """One row: how many right rows are in the left table, of how many, and how many contradict its target."""
    m = first_match(left, right, columns, target)
    hits = m.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("conflict").cast("long")).alias("c"))
    sums = hits.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("overlap_rows"),
        F.count("*").cast("long").alias("identities"),
        F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("conflict_rows"),
    )
    sums = sums.join(right.agg(F.count("*").cast("long").alias("right_rows")))  # a row each
    few = m.orderBy("r_pos").limit(examples if target else 0).agg(F.array_sort(F.collect_list(F.struct("r_pos", "l_pos"))).alias("e"))
    return sums.join(few).select(
        "overlap_rows",
        "identities",
        "conflict_rows",
        "right_rows",
        (F.col("overlap_rows") / F.greatest(F.lit(1), F.col("right_rows"))).alias("fraction"),
        F.transform("e", lambda x: F.array(x["l_pos"], x["r_pos"])).alias("examples"),
    )


def group_overlap(left: DataFrame, right: DataFrame, group: str, examples: int = 10) -> DataFrame:
    """One row: groups of both tables, and the first by their text. Numbers are compared as numbers."""
    side = lambda df: df.filter(F.col(f"`{group}`").isNotNull()).select(F.col(f"`{group}`").alias("g")).distinct()
    common = side(left).join(side(right), "g", "left_semi").select(F.col("g").cast("string").alias("g"))
    few = common.orderBy("g").limit(examples).agg(F.array_sort(F.collect_list("g")).alias("examples"))
    return common.agg(F.count("*").cast("long").alias("groups")).join(few)


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows that repeat an earlier identical one."""
    n = df.groupBy(identity(df, columns).alias("key")).agg(F.count("*").alias("n"))
    return n.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
    ).withColumn("fraction", F.col("duplicate_rows") / F.greatest(F.lit(1), F.col("rows")))


def without_exact(near: DataFrame, exact: DataFrame) -> DataFrame:
    """Near pairs that are no exact first matches."""
    return near.join(exact.select("l_pos", "r_pos"), ["l_pos", "r_pos"], "left_anti")
