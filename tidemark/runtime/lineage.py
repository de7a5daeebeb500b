"""Where rows of a frame come from: split membership by index, by content, and through operations.

A frame's lineage is a relation (row, dataset_id, row_key): which rows of declared data a row was made of.
Everything is a join or a union of such relations; membership is joined at the end of a session.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import row_digest

LINEAGE = ["row", "dataset_id", "row_key"]


def register_split(parts: Mapping[str, DataFrame], key: str, dataset_id: str) -> DataFrame:
    """member rows (dataset_id, row_key, split) of a split's sides; a key on several sides is on each."""
    each = [df.select(F.lit(dataset_id).alias("dataset_id"), F.col(f"`{key}`").cast("string").alias("row_key"), F.lit(side).alias("split")) for side, df in parts.items()]
    return reduce(DataFrame.unionByName, each).filter("row_key is not null").distinct()


def declared(df: DataFrame, key: str, dataset_id: str) -> DataFrame:
    """The lineage of declared data: each row comes from itself."""
    k = F.col(f"`{key}`").cast("string")
    return df.select(k.alias("row"), F.lit(dataset_id).alias("dataset_id"), k.alias("row_key")).filter("row is not null")


def by_index(df: DataFrame, key: str, lineage: DataFrame) -> DataFrame:
    """Rows of a derived frame that kept their index: a join on it."""
    rows = df.select(F.col(f"`{key}`").cast("string").alias("row")).filter("row is not null").distinct()
    return rows.join(lineage, "row").select(*LINEAGE)


def by_content(df: DataFrame, row: str, known: DataFrame, key: str, columns: list[str], dataset_id: str) -> DataFrame:
    """Rows of an array without an index: those of the declared data with the same values, all of them if several are alike.

    All pairs of alike rows; where only their sides are asked for, ``sides_by_content`` makes none.
    """
    a = df.select(F.col(f"`{row}`").cast("string").alias("row"), row_digest(df, columns).alias("_d"))
    b = known.select(F.col(f"`{key}`").cast("string").alias("row_key"), row_digest(known, columns).alias("_d")).distinct()
    return a.join(b, "_d").select("row", F.lit(dataset_id).alias("dataset_id"), "row_key").distinct()


def sides_by_content(df: DataFrame, row: str, known: DataFrame, key: str, columns: list[str], dataset_id: str, member: DataFrame) -> DataFrame:
    """``sides`` of ``by_content``, without a row for each pair of alike rows: sides are told by digest first."""
    a = df.select(F.col(f"`{row}`").cast("string").alias("row"), row_digest(df, columns).alias("_d"))
    b = known.select(F.lit(dataset_id).alias("dataset_id"), F.col(f"`{key}`").cast("string").alias("row_key"), row_digest(known, columns).alias("_d"))
    told = b.join(member, ["dataset_id", "row_key"]).groupBy("_d").agg(F.collect_set("split").alias("s"))
    return a.join(told, "_d").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("splits"))


def stacked(parts: list[DataFrame]) -> DataFrame:
    """Rows of frames below each other (concat): the union, rows told apart by the place of their frame."""
    each = [p.select(F.concat(F.lit(f"{k}:"), "row").alias("row"), "dataset_id", "row_key") for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, each)


def assembled(parts: list[DataFrame]) -> DataFrame:
    """Columns of frames beside each other, or of a merge: a row comes from all that its parts come from."""
    return reduce(DataFrame.unionByName, [p.select(*LINEAGE) for p in parts]).distinct()


def transformed(lineage: DataFrame, kept: DataFrame, key: str = "row") -> DataFrame:
    """What is left of a frame's lineage after rows were dropped, reordered or changed in place."""
    return lineage.join(kept.select(F.col(f"`{key}`").cast("string").alias("row")).distinct(), "row", "left_semi")


def sides(lineage: DataFrame, member: DataFrame) -> DataFrame:
    """row, splits: the sides each row comes from, in order."""
    return lineage.join(member, ["dataset_id", "row_key"]).groupBy("row").agg(F.array_sort(F.collect_set("split")).alias("splits"))


def numbered(log: DataFrame) -> DataFrame:
    """Events without an ordinal get one by time within their session; others keep theirs."""
    w = Window.partitionBy("session_id").orderBy("at", "call_site")
    return log.withColumn("ordinal", F.coalesce("ordinal", F.row_number().over(w).cast("long")))
