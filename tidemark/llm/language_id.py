"""Language identification by fusing evidence with Bayes' rule.

Evidence of a row: its text, by a model of byte trigrams per language; the
language its markup declares; and where it is from: a prior over languages per
host, smoothed towards that of its address suffix, which is smoothed towards
that of the whole table. Priors and the reliability of declarations come from a
first pass over all rows, by grouped aggregation of the text's posteriors.
Trigrams overlap, so their log-likelihood counts by ``TEMPER`` only and is
bounded by ``CEILING``: other evidence decides short and mixed texts.

The trigram model is fitted on labelled rows of the ``LANGUAGES`` most frequent
labels, about ``SAMPLE`` a language (taken by hash of the text, so equal texts
go together); priors and declarations use every row.

Defined results: a row whose text has no letter has language ``und`` and is not
kept; so is one whose best language has a posterior below ``LEAST``. Null
texts are empty; a null host, suffix or declaration is no evidence (the parent
prior holds). Repeated rows each get a row. With no labelled rows every row is
``und``; equal posteriors go to the language that sorts first. Texts of any
length are read whole. Other columns of the input stay, whatever their names; one
that is named like a column of the result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from .common import Workspace, hold, small_batches

BINS = 1 << 15
SAMPLE, LANGUAGES = 2000, 200
TEMPER, CEILING = 0.2, 12.0
LEAST = 0.5
#: How many rows a parent's prior counts as.
STRENGTH = 20.0
#: Priors of hosts are sent to all executors up to this many hosts, joined by shuffling beyond.
BROADCAST_HOSTS = 100_000
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint32)


def trigrams(data: bytes) -> np.ndarray:
    """Bins of the byte trigrams, a blank before and after."""
    x = _LOWER[np.frombuffer(b" " + data + b" ", np.uint8)]
    h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) & np.uint32(BINS - 1)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def fit(rows: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and their log-probabilities by bin, from a bounded sample of labelled rows."""
    ship(rows.sparkSession)
    known = rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, SAMPLE / n))).otherwise(share)
    part = (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / (1 << 20)) < share

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for t, l in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                c = total.setdefault(l, np.zeros(BINS, np.int64))
                c += np.bincount(trigrams(t.as_py().encode("utf-8", "surrogatepass")), minlength=BINS)
        for l, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bin", "n"])

    counts = known.filter(part).mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    langs = sorted(sizes)
    table = np.full((BINS, len(langs)), 0.1)
    for r in counts:
        table[r["bin"], langs.index(r["lang"])] += r["n"]
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def text_evidence(table: np.ndarray, texts: list[str]) -> np.ndarray:
    """Tempered, bounded log-likelihoods, the best at 0; without letters all 0."""
    out = np.zeros((len(texts), table.shape[1]))
    for k, t in enumerate(texts):
        if has_letter(t):
            data = t.encode("utf-8", "surrogatepass")
            for s in range(0, len(data), 1 << 20):
                out[k] += table[trigrams(data[s : s + (1 << 20) + 2])].sum(0, dtype=np.float64)
    out = TEMPER * (out - out.max(1, keepdims=True))
    return np.maximum(out, -CEILING)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", host: Column | None = None, suffix: Column | None = None, declared: Column | None = None, least: float = LEAST) -> DataFrame:
    """rows with _lang, _confidence and _kept."""
    spark = rows.sparkSession
    small_batches(spark)
    langs, table = model
    keep = [c for c in rows.columns if c.lower() not in ("_lang", "_confidence", "_kept")]
    if not langs:
        return rows.select(*[F.col(f"`{c}`") for c in keep], F.lit("und").alias("_lang"), F.lit(0.0).alias("_confidence"), F.lit(False).alias("_kept"))
    n = len(langs)
    shared = spark.sparkContext.broadcast(table)
    work = Workspace(spark)
    none = F.lit(None).cast("string")
    said = F.lower(F.substring(declared, 1, 2)) if declared is not None else none
    # The input's own columns are fields of one, so that no name of theirs meets one used here.
    where = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
        (host if host is not None else none).alias("_host"),
        (suffix if suffix is not None else none).alias("_suffix"),
        said.alias("_said"),
    )
    place = ["_host", "_suffix", "_said"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("languages")
        for b in batches:
            e = np.exp(text_evidence(shared.value, [x.as_py() or "" for x in b.column(0)]))
            p = e / e.sum(1, keepdims=True)
            p[(e == 1).all(1)] = 0  # nothing to read
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(p[:, i]) for i in range(n)]], names=[*place, *[f"p{i}" for i in range(n)]])

    soft = where.select("_text", *place).mapInArrow(first, ", ".join([f"{c} string" for c in place] + [f"p{i} double" for i in range(n)]))
    sums = work.put("sums", soft.groupBy(*place).agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(n)]))
    total = [F.sum(f"p{i}").alias(f"p{i}") for i in range(n)]
    vec = lambda: F.array(*[F.coalesce(f"p{i}", F.lit(0.0)) for i in range(n)])
    top = sums.agg(*total).first()
    base = np.array([(top[f"p{i}"] or 0.0) + 1.0 for i in range(n)])
    base = [float(x) for x in base / base.sum()]

    def smooth(own: Column, parent: Column) -> Column:
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, parent, lambda o, p: (o + STRENGTH * p) / (size + STRENGTH))

    whole = F.array(*[F.lit(x) for x in base])
    by_suffix = sums.filter("_suffix is not null").groupBy("_suffix").agg(*total).select(F.col("_suffix").alias("_ls"), smooth(vec(), whole).alias("_ls_prior"))
    by_host = sums.filter("_host is not null").groupBy("_host", "_suffix").agg(*total)
    by_host = by_host.join(by_suffix, F.col("_suffix") == F.col("_ls"), "left").select(F.col("_host").alias("_lh"), F.col("_suffix").alias("_lhs"), smooth(vec(), F.coalesce("_ls_prior", whole)).alias("_lh_prior"))
    by_host = work.put("hosts", by_host)
    # What a declaration says of the language: P(declared | language), smoothed towards saying nothing.
    by_said = sums.filter("_said is not null").groupBy("_said").agg(*total)
    heard = {r["_said"]: [r[f"p{i}"] or 0.0 for i in range(n)] for r in by_said.filter(F.col("_said").isin(*langs)).collect()}
    trust = np.ones((n, n)) * 0.5 + np.eye(n)
    for d, v in heard.items():
        trust[langs.index(d)] += np.array(v)
    trust = np.log(trust / trust.sum(0))
    if by_host.count() <= BROADCAST_HOSTS:
        by_host = F.broadcast(by_host)
    held = where.join(by_host, (F.col("_host") == F.col("_lh")) & F.col("_suffix").eqNullSafe(F.col("_lhs")), "left").join(by_suffix, F.col("_suffix") == F.col("_ls"), "left")
    held = held.withColumn("_prior", F.coalesce("_lh_prior", "_ls_prior", whole)).drop("_lh", "_lhs", "_lh_prior", "_ls", "_ls_prior", "_host", "_suffix")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").to_pylist()
            own = b.column("_row").flatten()
            e = text_evidence(shared.value, texts)
            prior = np.log(np.array(b.column("_prior").to_pylist(), float).reshape(len(texts), n))
            told = np.array([trust[langs.index(d)] if d in langs else np.zeros(n) for d in b.column("_said").to_pylist()]).reshape(len(texts), n)
            e = e + prior + told
            p = np.exp(e - e.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            some = np.array([has_letter(t) for t in texts], bool)
            conf = np.where(some, p.max(1), 0.0)
            kept = conf >= least
            lang = [langs[i] if k else "und" for i, k in zip(best, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(conf), pa.array(kept, pa.bool_())], names=[*keep, "_lang", "_confidence", "_kept"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep]
    return held.select("_row", "_text", "_said", "_prior").mapInArrow(last, ", ".join([*kinds, "_lang string, _confidence double, _kept boolean"]))


MARKUP = r"(?i)<html[^>]*\blang=[\"']?([a-z]{2})"


def of_documents(docs: DataFrame) -> DataFrame:
    """The operator on a table like documents: source is the host, the first html tag with a language the declaration."""
    declared = F.nullif(F.regexp_extract("text", MARKUP, 1), F.lit(""))
    suffix = F.nullif(F.regexp_extract("source", r"\.([A-Za-z]+)$", 1), F.lit(""))
    return identify(docs, fit(docs), host=F.col("source"), suffix=suffix, declared=declared)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return of_documents(docs).select("doc_id", F.col("_lang").alias("pred_lang"), F.round("_confidence", 9).alias("confidence"), F.col("_kept").alias("kept"))


def op1_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for all web pages, with all kinds of evidence: text, declaration, host and address suffix."""
    from .url_filter import host_of

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    rows = pages.withColumn("text", bare)
    host = F.nullif(host_of(F.col("url")), F.lit(""))
    suffix = F.nullif(F.regexp_extract(host_of(F.col("url")), r"\.([a-z]+)$", 1), F.lit(""))
    got = identify(rows, fit(docs), host=host, suffix=suffix, declared=F.nullif(F.regexp_extract("html", MARKUP, 1), F.lit("")))
    return got.select("page_id", F.col("_lang").alias("pred_lang"), F.round("_confidence", 9).alias("confidence"), F.col("_kept").alias("kept"))
