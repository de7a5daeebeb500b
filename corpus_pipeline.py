"""A corpus pipeline: five stages, each one operator of tidemark.llm.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns
a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents; where a stage changes a text,
n_chars follows.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, language_id, minhash_forest, suffix_dedup
from tidemark.llm.common import Workspace, close_unread, gathering

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Working tables of stages called before; the next stage deletes those it does not read.
_BEFORE: list[Workspace] = []


def stage(make):
    """A stage's result is to be written before the next stage is called: then its working tables go."""

    @wraps(make)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        close_unread(_BEFORE, docs)
        with gathering(_BEFORE):
            return make(spark, docs, sf_dir)

    return run


@stage
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is not recognised go: null and empty texts, and those without letters, too."""
    return language_id.of_documents(docs.select(*COLUMNS)).filter("_kept").select(*COLUMNS)


def distinct_rows(docs: DataFrame) -> DataFrame:
    """docs without rows that repeat id and text; texts are moved only if there are any."""
    key = [F.col("doc_id"), F.xxhash64("text", F.lit(1)), F.xxhash64("text", F.lit(2))]
    again = docs.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return docs.dropDuplicates(["doc_id", "text"]) if again.limit(1).count() else docs


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the row with the smallest id stays.

    Ids may be null or shared: of rows with that id the one with the smallest digest of its text.
    """
    row = distinct_rows(docs.select(*COLUMNS))
    kept = minhash_forest.near_duplicates(row, words=5, by_row=True).filter("kept").select("_key", "_digest")
    same = F.col("doc_id").eqNullSafe(F.col("_key")) & F.col("_sha").eqNullSafe(F.col("_digest"))
    return row.withColumn("_sha", minhash_forest.text_digest("text")).join(kept, same, "left_semi").select(*COLUMNS)


@stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that occur earlier go; characters that a cut would split stay whole.

    A text of which nothing is left goes with its row. Null and short texts stay. Of rows with the
    same id and text one stays; other rows of a shared or null id are told apart by their texts.
    """
    cut = suffix_dedup.without_repeats(distinct_rows(docs.select(*COLUMNS)))
    changed = F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*COLUMNS)


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go that hold a full window of 13 benchmark words, or a shorter item on a twentieth of their words or more.

    Rows without words (null, empty) stay; rows of a shared or null id are told apart by their texts.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = docs.select(*COLUMNS)
    found = decontaminate.digest(decontaminate.contamination(row, bench, key="doc_id", digest=True))
    bad = found.filter(F.col("contaminated") | (F.col("n_hit") >= decontaminate.WINDOW)).select("_key", "_digest").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_key")) & F.col("_sha").eqNullSafe(F.col("_digest"))
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return row.withColumn("_sha", sha).join(bad, same, "left_anti").select(*COLUMNS)


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of them and of what they decode to; a null text has no ids."""

    def row(c: byte_bpe.Codec, text: str) -> tuple:
        ids = c.encode(text)
        return (ids, *byte_bpe.digests(c, ids))

    ranks = public_tokenizers.path(byte_bpe.RANK_FILE)
    return byte_bpe.map_texts(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, row, f"ids array<int>, {byte_bpe.DIGEST}")


STAGES = [
    ("language_id", languages),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", decontaminated),
    ("byte_level_bpe", encoded),
]

#: No SQL says what these stages do; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    work = Workspace(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, make in STAGES[:-1]:
        docs = work.put(name, make(spark, docs, sf_dir))
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
