"""Aggregates of the audit: balance, time ranges, quality counts, sampling, kinds of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import normal, type_tag

IMAGE = r"\.(png|jpg|jpeg|gif|bmp|webp|tif|tiff)$"


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """One row: classes, rows with a class, the largest class and its share."""
    n = df.select(normal(df, target).alias("t")).filter("t is not null").groupBy("t").agg(F.count("*").alias("n"))
    return n.agg(
        F.count("*").cast("long").alias("classes"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("labelled_rows"),
        F.max_by(F.col("t").cast("string"), F.struct("n", F.col("t").cast("string"))).alias("majority_class"),
        (F.max("n") / F.sum("n")).alias("majority_share"),
    )


def parsed_time(df: DataFrame, time: str) -> Column:
    kind = df.schema[time].dataType
    c = F.col(f"`{time}`")
    if isinstance(kind, T.StringType):
        return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    return c.cast("timestamp") if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.timestamp_seconds(c.cast("double"))


def time_ranges(splits: list[tuple[str, DataFrame]], time: str) -> DataFrame:
    """A row a split: first and last time, times, and values that are no time."""
    out = None
    for k, (name, df) in enumerate(splits):
        t = parsed_time(df, time)
        row = df.agg(
            F.min(t).alias("first_time"),
            F.max(t).alias("last_time"),
            F.count(t).cast("long").alias("times"),
            F.count_if(F.col(f"`{time}`").isNotNull() & t.isNull()).cast("long").alias("invalid"),
        ).select(F.lit(name).alias("split"), F.lit(k).alias("split_ord"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def temporal_overlap(ranges: DataFrame) -> DataFrame:
    """Neighbouring splits in order; they overlap if the earlier one ends at or after the later one's start."""
    w = Window.orderBy("split_ord")  # three rows at most
    return (
        ranges.withColumns({"before": F.lag("split").over(w), "before_last": F.lag("last_time").over(w)})
        .filter("before is not null")
        .select("before", "split", "before_last", F.col("first_time").alias("split_first"), (F.col("before_last") >= F.col("first_time")).alias("overlaps"))
    )


def quality_counts(splits: list[tuple[str, DataFrame]]) -> DataFrame:
    """A row a split and column: rows, missing and infinite values."""
    out = None
    for name, df in splits:
        cols = [c for c in df.columns if c != "_pos"]
        aggs = [F.count("*").alias("_n")]
        for k, c in enumerate(cols):
            x = F.col(f"`{c}`")
            real = type_tag(df.schema[c].dataType) == "float"
            aggs.append(F.count_if(x.isNull() | (F.isnan(x) if real else F.lit(False))).alias(f"m{k}"))
            aggs.append((F.count_if(F.abs(x) == float("inf")) if real else F.lit(0)).alias(f"i{k}"))
        one = df.agg(*aggs)
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{k}").cast("long").alias("missing"), F.col(f"i{k}").cast("long").alias("infinite")) for k, c in enumerate(cols)]))
        part = one.select(F.lit(name).alias("split"), F.col("_n").cast("long").alias("rows"), rows.alias("x")).select("split", "rows", "x.*")
        out = part if out is None else out.unionByName(part)
    return out


def fixed_sample(df: DataFrame, cap: int, key: str = "_pos", seed: int = 0) -> DataFrame:
    """Exactly min(cap, rows) rows, the same ones every time: those with the smallest hash of the key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), key).limit(cap)


def head_sample(df: DataFrame, cap: int) -> DataFrame:
    return df.filter(F.col("_pos") < cap)


def column_kinds(df: DataFrame, image_rows: int = 20, text_rows: int = 200) -> DataFrame:
    """A row a string column: whether its first values look like image paths or like text."""
    out = None
    for c in [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]:
        first = df.filter(F.col(f"`{c}`").isNotNull()).orderBy("_pos").limit(text_rows).select("_pos", F.col(f"`{c}`").alias("v"))
        n = F.row_number().over(Window.orderBy("_pos"))  # text_rows rows
        row = first.withColumn("n", n).agg(
            (F.avg(F.when(F.col("n") <= image_rows, F.lower("v").rlike(IMAGE).cast("int"))) >= 0.8).alias("looks_like_image"),
            ((F.max(F.length("v")) >= 24) | (F.avg(F.size(F.filter(F.split("v", r"\s+"), lambda x: x != ""))) >= 4) | (F.count_distinct("v") > F.greatest(F.lit(10.0), F.count("*") / 2))).alias("looks_like_text"),
        ).select(F.lit(c).alias("column"), F.coalesce("looks_like_image", F.lit(False)).alias("looks_like_image"), F.coalesce("looks_like_text", F.lit(False)).alias("looks_like_text"))
        out = row if out is None else out.unionByName(row)
    return out


def is_classification(df: DataFrame, target: str) -> bool:
    """Whether the target is a class: text and booleans are; numbers if they are few."""
    if type_tag(df.schema[target].dataType) in ("string", "bool", "object", "bytes"):
        return True
    r = df.agg(F.count_distinct(normal(df, target)).alias("k"), F.count("*").alias("n")).first()
    return r["k"] <= max(2, int(0.05 * r["n"])) and r["k"] <= 20


def zscore(df: DataFrame, column: str) -> DataFrame:
    """Adds ``z``: 0 where the column does not vary."""
    s = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return df.join(F.broadcast(s)).withColumn("z", F.when(F.coalesce("_s", F.lit(0.0)) == 0, F.lit(0.0)).otherwise((F.col(column) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def confusion(expected: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """by, hits, missed, extra: distinct rows that both tables have, and that only one of them has."""
    e = expected.distinct().withColumn("_e", F.lit(1))
    o = observed.distinct().withColumn("_o", F.lit(1))
    both = e.join(o, expected.columns, "full")
    n = lambda c: F.count_if(c).cast("long")
    has, got = F.col("_e").isNotNull(), F.col("_o").isNotNull()
    return both.groupBy(*by).agg(n(has & got).alias("hits"), n(has & ~got).alias("missed"), n(~has & got).alias("extra"))
