"""Quality by votes of the nearest labelled texts in a latent semantic space.

A text's terms are its words, hashed to ``WORDS`` bins, and what its writing
looks like, whatever the language: trigrams
of character classes, shapes of words and how often words and lines repeat.
Term weights and a singular value decomposition of a bounded labelled sample
give the latent space (``DIMS`` axes). The sample's vectors, at most ``SAMPLE``
a class, are broadcast (a few MB, fixed). Every document then has its exact
cosine with all of them, in blocks, and the ``NEAREST`` labels vote, weighted by
similarity.

The sample is taken by hash of the id, among the rows given to learn from; votes
are weighted so that classes count as they occur there.

Defined results: a null text is empty; a text without bytes has only its length
as a term and is voted on like any other; rows of labels that are null take no
part, of several labels of an id the largest counts, of several texts of an id
the smallest is learnt from, and texts of over ``LONGEST_LEARNT`` bytes are
scored but not learnt from; equal similarities go to the labelled row with the
smaller id; without labels, or with one
class only, the score is that class's share (0.5 without labels). Repeated rows
each get a row; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, small_batches

SAMPLE, DIMS, NEAREST, SHARP = 2500, 48, 15, 12.0
#: With the sample's size this bounds what the driver holds.
LONGEST_LEARNT = 1 << 18
#: Documents whose products are computed at once.
ROWS = 512
_CLASSES = 16


def _class(b: int) -> int:
    if 0x61 <= b <= 0x7A or 0xA0 <= b <= 0xBF or b >= 0xE0:
        return 1
    if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9F:
        return 2
    if 0x30 <= b <= 0x39:
        return 3
    if b >= 0xC0:
        return 1
    return {0x20: 0, 0x0A: 4, 0x2E: 5, 0x2C: 6, 0x21: 7, 0x3F: 7, 0x7C: 8, 0x2D: 9, 0x27: 9, 0x22: 9, 0x28: 10, 0x29: 10, 0x2F: 11, 0x3A: 11, 0x40: 12, 0x3C: 13, 0x3E: 13, 0x7B: 13, 0x7D: 13}.get(b, 14 if b > 0x20 else 15)


_TABLE = np.array([_class(b) for b in range(256)], np.uint16)
_TRI = _CLASSES**3
#: Bins of words, and what a word weighs against a trigram of classes.
WORDS, WEIGHT = 1 << 10, 0.5
#: Trigrams, then repetition of words, of lines, length of words, of the text, then words.
TERMS = _TRI + 4 * 16 + WORDS


def terms(text: str | None) -> np.ndarray:
    """Counts of the text's terms; those of a kind sum to 1 but for trigrams, which are logarithmic shares."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TERMS, np.float32)
    tri = np.zeros(_TRI, np.int64)
    for s in range(0, len(data), 1 << 20):
        c = _TABLE[np.frombuffer(data[s : s + (1 << 20) + 2], np.uint8)]
        if len(c) > 2:
            tri += np.bincount(c[:-2] * 256 + c[1:-1] * 16 + c[2:], minlength=_TRI)
    if n := tri.sum():
        out[:_TRI] = np.sqrt(tri / n)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    # Distinct words among n: natural texts have some n**0.8 of them.
    rep = len(set(words)) / max(1.0, len(words) ** 0.85) if words else 1.0
    of = lambda x: min(15, max(0, int(x)))
    out[_TRI + of(rep * 8)] = 1
    out[_TRI + 16 + of(15 * len(set(lines)) / len(lines) if lines else 15)] = 1
    out[_TRI + 32 + of((len(data) - len(words)) / len(words) if words else 0)] = 1
    out[_TRI + 48 + of(np.log2(len(data) + 1))] = 0.3
    if words:
        bins = np.bincount(np.fromiter(map(crc32, map(bytes.lower, words)), np.int64, len(words)) & (WORDS - 1), minlength=WORDS)
        out[_TRI + 64 :] = WEIGHT * np.sqrt(bins / len(words))
    return out


def principal(x: np.ndarray, dims: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    k = min(dims, *x.shape)
    q = np.random.default_rng(11).standard_normal((x.shape[1], min(x.shape[1], k + 16))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray(q @ v[:k].T)


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of its k largest values; of equal ones at the end the first."""
    last = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
    more, same = cos > last, cos == last
    room = k - more.sum(1, keepdims=True)
    return np.nonzero(more | (same & (np.cumsum(same, axis=1) <= room)))[1].reshape(len(cos), k)


class Model:
    """Term weights, axes, and the labelled vectors."""

    def __init__(self, texts: list[str | None], labels: np.ndarray, share: float):
        """share: that of label 1 among all rows to learn from."""
        x = np.stack([terms(t) for t in texts])
        df = (x > 0).mean(0)
        self.idf = np.log((1 + len(x)) / (1 + df * len(x))).astype(np.float32) + 1
        x = x * self.idf
        self.axes = principal(x, DIMS)
        self.vectors = self._unit(x @ self.axes)
        self.labels = labels.astype(np.float32)
        # The sample has as many rows of either class as there are; a vote counts as its class is common.
        drawn = np.array([(labels == 0).mean(), (labels == 1).mean()])
        self.weight = (np.array([1 - share, share]) / np.maximum(drawn, 1e-9)).astype(np.float32)[labels.astype(int)]

    @staticmethod
    def _unit(y: np.ndarray) -> np.ndarray:
        return y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-12)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for s in range(0, len(texts), ROWS):
            x = np.stack([terms(t) for t in texts[s : s + ROWS]]) * self.idf
            cos = self._unit(x @ self.axes) @ self.vectors.T
            k = min(NEAREST, cos.shape[1])
            near = nearest(cos, k)
            c = np.take_along_axis(cos, near, 1)
            w = np.exp(SHARP * (c - c.max(1, keepdims=True))) * self.weight[near]
            out[s : s + ROWS] = (w * self.labels[near]).sum(1) / w.sum(1)
        return np.clip(out, 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, label: str, per_class: int) -> tuple[list, float]:
    """At most per_class rows of either label (text and label, taken by hash of the id), and
    the share of label 1 among all. The ids taken are few, at most 2 * per_class, so they
    are sent to the texts. One text an id comes back, of ``LONGEST_LEARNT`` bytes at most."""
    one = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y")).filter(learn)
    some = None
    for y in (0, 1):
        part = one.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    text = F.coalesce("text", F.lit(""))
    short = docs.select("doc_id", text.alias("text")).filter(F.octet_length("text") <= LONGEST_LEARNT)
    got = short.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    share = one.agg(F.avg("y").alias("y")).first()["y"]
    return sorted(got, key=lambda r: r["doc_id"]), share


def score(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", per_class: int = SAMPLE) -> DataFrame:
    """doc_id, score, predicted. ``learn``: over doc_id, the rows to learn from."""
    spark = docs.sparkSession
    small_batches(spark)
    sample, share = labelled_sample(docs, labels, learn, label, per_class)
    y = np.array([r["y"] for r in sample])
    schema = "doc_id long, score double, predicted int"
    if len(set(y)) < 2:
        flat = float(y[0]) if len(y) else 0.5
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(flat).alias("score"), F.lit(int(flat >= 0.5)).alias("predicted"))
    model = spark.sparkContext.broadcast(Model([r["text"] for r in sample], y, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.value.score([x.as_py() for x in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op8_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    got = score(docs, labels, crc_mod("doc_id", 3) != 1)
    return got.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
