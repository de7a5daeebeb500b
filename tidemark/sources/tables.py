"""Split tables: reading, naming the rows, checking the schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = ("train", "val", "test")
KINDS = ("numeric", "categorical", "text", "image", "datetime", "group")


class InputError(ValueError):
    """The tables cannot be audited together."""


def read_table(spark: SparkSession, path: str) -> DataFrame:
    low = path.lower().rstrip("/")
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True, nullValue="", nanValue="nan")
    raise InputError(f"cannot read {path}: only .csv, .parquet and .pq are known")


def with_positions(df: DataFrame, key: str | None = None) -> DataFrame:
    """Adds ``_pos``: the caller's key, or the row's place. Rows of one file keep their order;
    files are taken by name."""
    if key is not None:
        return df.withColumn("_pos", F.col(key).cast("long"))
    try:
        place = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    except Exception:  # not read from files
        rows = df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
        return df.sparkSession.createDataFrame(rows, T.StructType([*df.schema.fields, T.StructField("_pos", T.LongType())]))
    size = place.groupBy("_f").agg(F.max("_r").alias("n"))
    before = {}
    total = 0
    for r in size.orderBy("_f").toLocalIterator():  # a row a file
        before[r["_f"]] = total
        total += r["n"] + 1
    base = df.sparkSession.createDataFrame(list(before.items()) or [("", 0)], "_f string, _base long")
    return place.join(base, "_f").withColumn("_pos", F.col("_base") + F.col("_r")).drop("_f", "_r", "_base")


@dataclass
class Splits:
    """Tables to audit, each with ``_pos``, and the roles of their columns."""

    frames: dict[str, DataFrame]
    target: str | None = None
    group: str | None = None
    time: str | None = None
    kinds: dict[str, str] = field(default_factory=dict)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        check(self)

    @property
    def ordered(self) -> list[tuple[str, DataFrame]]:
        return [(n, self.frames[n]) for n in ORDER if n in self.frames]

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return list(combinations([n for n, _ in self.ordered], 2))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.frames["train"].columns if c != "_pos"]

    @property
    def features(self) -> list[str]:
        return [c for c in self.columns if c not in (self.target, self.group, self.time)]

    @property
    def identity_columns(self) -> list[str]:
        wanted = self.include or [c for c in self.columns if c != self.target]
        return [c for c in wanted if c not in self.exclude]

    def long(self, *columns: str) -> DataFrame:
        """All splits below each other."""
        out = None
        for n, f in self.ordered:
            part = f.select(F.lit(n).alias("split"), F.lit(ORDER.index(n)).alias("split_ord"), "_pos", *columns)
            out = part if out is None else out.unionByName(part)
        return out


def check(s: Splits) -> None:
    """Looks at schemas only; no job runs."""
    for need in ("train", "test"):
        if not isinstance(s.frames.get(need), DataFrame):
            raise InputError(f"{need} must be a DataFrame")
    for n, f in s.frames.items():
        if n not in ORDER or not isinstance(f, DataFrame):
            raise InputError(f"{n} is no known split")
        if len(set(f.columns)) != len(f.columns):
            raise InputError(f"{n} has column names twice")
        if "_pos" not in f.columns:
            s.frames[n] = with_positions(f)
    names = {n: set(f.columns) for n, f in s.frames.items()}
    if any(v != names["train"] for v in names.values()):
        raise InputError("splits have different columns")
    for role in ("target", "group", "time"):
        c = getattr(s, role)
        if c is not None and (not isinstance(c, str) or c not in names["train"]):
            raise InputError(f"{role} column {c!r} is missing")
    for c, kind in s.kinds.items():
        if c not in names["train"] or kind not in KINDS:
            raise InputError(f"no column {c!r} or no kind {kind!r}")
    for c in [*s.include, *s.exclude]:
        if c not in names["train"]:
            raise InputError(f"identity names unknown column {c!r}")
