"""The findings relation: dedupe, order, gate, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import severity_rank

S, I, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
FINDING = T.StructType(
    [T.StructField(n, k) for n, k in (
        ("rule_id", S), ("category", S), ("severity", S), ("layer", S), ("message", S), ("file", S), ("line", I), ("col", I),
        ("label", S), ("cell_index", I), ("confidence", D), ("advisory", B), ("fix", S), ("evidence", S), ("identity", S),
    )]
)
#: What makes two findings the same observation.
KEY = ("rule_id", "layer", "file", "line", "col", "label", "cell_index", "identity")


def dedupe(f: DataFrame) -> DataFrame:
    """Of equal observations the surest, then the gravest, then the last by message; of those still alike
    one that may gate, then by the other columns, so that the outcome never depends on how rows were dealt."""
    rest = [F.asc("advisory"), *(F.asc(c) for c in ("category", "fix", "evidence"))]
    best = Window.partitionBy(*KEY).orderBy(F.desc("confidence"), F.desc(severity_rank(F.col("severity"))), F.desc("message"), *rest)
    return f.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")


def ordered(f: DataFrame) -> DataFrame:
    z = lambda c, d: F.coalesce(c, F.lit(d))
    return f.orderBy(z("file", ""), z("line", 0), z("col", 0), "rule_id", "layer", z("label", ""))


def gated(f: DataFrame, fail_on: str = "high", gate_confidence: float = 0.75) -> DataFrame:
    """Adds reasons (sorted) and gateable."""
    static = F.col("layer") == "static"
    grave = severity_rank(F.col("severity")) >= severity_rank(F.lit(fail_on))
    sure = F.col("confidence") >= gate_confidence
    ok = ~F.col("advisory") & grave & sure
    reasons = F.array(
        F.when(F.col("advisory"), "advisory-only"),
        F.when(~grave, "severity-below-gate"),
        F.when(~sure, "confidence-below-gate"),
        F.when(static & (F.col("confidence") < 0.60), "advisory-confidence"),
        F.when(static & (F.col("confidence") >= 0.60) & (F.col("confidence") < 0.85), "probable-static"),
        F.when(ok, "gateable"),
    )
    return f.withColumns({"reasons": F.array_sort(F.array_compact(reasons)), "gateable": ok})


def shown(f: DataFrame, min_confidence: float = 0.60) -> DataFrame:
    return f.filter(F.col("confidence") >= min_confidence)


def summary(f: DataFrame) -> DataFrame:
    """dimension, value, n: counts by severity, category, layer and rule, and of all."""
    x = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (
        ("severity", F.col("severity")), ("category", F.col("category")), ("layer", F.col("layer")), ("rule_id", F.col("rule_id")), ("all", F.lit("all")),
    )]))
    return f.select(x.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").cast("long").alias("n"))


def any_gated(f: DataFrame) -> DataFrame:
    return f.agg(F.coalesce(F.bool_or("gateable"), F.lit(False)).alias("gated"))
