"""Row identity, text and bit functions, name hints: everything as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAGS = (
    (T.BooleanType, "bool"),
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"),
    ((T.FloatType, T.DoubleType), "float"),
    (T.DecimalType, "decimal"),
    ((T.TimestampType, T.TimestampNTZType), "timestamp"),
    (T.DateType, "date"),
    (T.BinaryType, "bytes"),
    ((T.StringType, T.CharType, T.VarcharType), "string"),
)


def type_tag(kind: T.DataType) -> str:
    """The kind of value a type holds; values of different kinds are never identical."""
    return next((tag for types, tag in _TAGS if isinstance(kind, types)), "object")


def normal(df: DataFrame, name: str) -> Column:
    """A column as it enters a row's identity: NaN is null, -0.0 is 0.0, widths of whole numbers don't count."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    tag = type_tag(kind)
    if tag == "int":
        return c.cast("bigint")
    if tag == "float":
        d = c.cast("double")
        return F.when(F.isnan(d), F.lit(None)).when(d == 0, F.lit(0.0)).otherwise(d)
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(c))
    return c


def identity(df: DataFrame, columns: list[str], other: DataFrame | None = None) -> Column:
    """One struct that is equal for identical rows. Columns whose kinds differ between the two
    tables take part as (kind, text), so that only missing values can agree."""
    fields = []
    for k, name in enumerate(columns):
        c = normal(df, name)
        if other is not None and type_tag(df.schema[name].dataType) != type_tag(other.schema[name].dataType):
            tag = F.when(c.isNotNull(), F.lit(type_tag(df.schema[name].dataType)))
            c = F.struct(tag.alias("t"), c.cast("string").alias("v"))
        fields.append(c.alias(f"c{k}"))
    return F.struct(*fields)


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """A printable digest of a row's identity, for evidence only."""
    return F.sha2(F.to_json(F.struct(*[normal(df, c).alias(f"c{k}") for k, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def same(a: Column, b: Column) -> Column:
    """Equality that takes two missing values as equal."""
    return a.eqNullSafe(b)


def normal_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def epoch_seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def severity_rank(c: Column) -> Column:
    out = F.lit(-1)
    for rank, name in enumerate(("info", "low", "medium", "high", "critical")):
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != "")


def has_hint(c: Column, hints: list[str]) -> Column:
    """Whole tokens; a hint that starts with a low line may stand anywhere in the name."""
    out = F.lit(False)
    for h in hints:
        out = out | (F.contains(F.lower(c), F.lit(h)) if h.startswith("_") else F.array_contains(name_tokens(c), h))
    return out


def name_side(c: Column) -> Column:
    """Which side of a split a variable's name speaks of."""
    low = F.lower(c)
    return (
        F.when(low.rlike(r"(^|_)(test|te|holdout)$"), "test")
        .when(low.rlike(r"(^|_)(val|valid|validation|dev)$"), "val")
        .when(low.rlike(r"(^|_)(train|tr)$"), "train")
        .otherwise("unknown")
    )


def json_safe(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def fingerprint(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def set_signature(tokens: Column) -> Column:
    """The same for every order and repetition of the tokens."""
    return F.sha2(F.concat_ws("\x00", F.array_sort(F.array_distinct(tokens))), 256)


def markdown_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
