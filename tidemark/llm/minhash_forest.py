"""Near duplicates by an LSH forest over MinHash signatures.

1. Documents with the same shingle set are one class; only classes are compared.
2. A class has a signature of ``TREES * DEPTH`` minima. Each tree is a sorted
   order of the classes by the signature read from another place on; a region
   is a common prefix. No prefix is shorter than ``DEPTH`` (3); beyond that a
   region's depth adapts to its density: in the sorted order a class meets the
   neighbours with which it shares the longest prefix, up to ``DEEPER`` minima
   more, and where many share three minima those are longer ones.
3. Neighbours in the orders are candidates, the ones with the longest common
   prefixes over all trees first, and so is each region's leader, the
   class that shares regions with most others; each class's first ones
   are confirmed on full sets and joined to components. A dense region of
   copies thus costs links in proportion to its size.
4. So that no link between components is lost, the classes of regions that
   still hold several components are joined again, exactly: with shingles
   ordered from rare to common, two sets that are similar enough share one
   among the first n - ceil(0.8 n) + 1 of each. Classes that have a long common
   passage but are not similar have rare shingles of their own there, so a
   dense region of such texts gives few candidates, not all its pairs. Each set
   has a parity sketch: bit i says whether an odd number of its shingles fall
   on i. Sketches differ in at most as many bits as sets differ in shingles, so
   the join drops, without error, pairs whose sketches differ too much; of a
   group of copies that are like one text but not like each other few pairs
   are left. Pairs across components of fitting sizes are confirmed.

A pair at the threshold of 0.8 shares no region with probability
(1 - 0.8**3)**24 = 3e-8; more similar ones, less. Confirmation is exact: |A & B| * 100 >= 80 * |A | B| on the
full sets (of 64-bit shingle fingerprints).

Defined results: A-Z are lower-cased; a document with fewer words than a
shingle has its whole sequence as one; without words (null, empty, blank) the
set is empty and the document is linked with nothing, not even its equals. A
component with a null id has a null component_id, as null is smallest. Repeated
rows each get a row. Texts of any length are taken whole. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Workspace, hold, small_batches
from .components import components

WORDS, NUM, DEN = 4, 80, 100
TREES, DEPTH = 24, 3
SIGNATURE = TREES * DEPTH
#: Neighbours of a class that are confirmed first.
FIRST = 2
#: Values of the signature after the prefix by which a region is sorted.
DEEPER = 6
#: Words of 64 bits of a parity sketch.
SKETCH = 8
#: What is joined on a key that many rows may share is repeated so many times, and the rows are dealt among the repeats.
SALTS = 16

_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 1 << 64, SIGNATURE, np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, SIGNATURE, np.uint64)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Fingerprints of words; the common ones are remembered."""

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh64_intdigest(w)
        if len(self) < 200_000 and len(w) < 64:
            self[w] = h
        return h



def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the text's shingles."""
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hold("words", _Words).__getitem__, w), np.uint64, len(w))
    k = min(size, len(w))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _MUL
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(SIGNATURE, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(s), 4096):
        out = np.minimum(out, (((s[a : a + 4096, None] * _A) + _B) >> np.uint64(32)).min(0))
    return out.astype(">u4")


def sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s * _MUL >> np.uint64(55)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def text_digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), size) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["_key", "_digest", "n_shingles", "node", "sig", "bits"],
            )

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A class's rows in all sorted orders: the region, then what follows its prefix."""
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), ">u4").reshape(-1, SIGNATURE)
        for t in range(TREES):
            turned = np.roll(sig, -t * DEPTH, axis=1)[:, : DEPTH + DEEPER]
            region = [xxhash.xxh64_intdigest(x.tobytes(), t) - (1 << 63) for x in turned[:, :DEPTH]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(region, pa.int64()), pa.array([x.tobytes() for x in turned[:, DEPTH:]], pa.binary()), b.column("node")],
                names=["region", "deeper", "node"],
            )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in sorted order: each node with the one before it in its region, and the depth of their common prefix."""
    last = (None, b"\0" * 4 * DEEPER, None)
    for b in batches:
        if not b.num_rows:
            continue
        region, deeper, node = (b.column(c).to_pylist() for c in ("region", "deeper", "node"))
        region, deeper, node = [last[0], *region], [last[1], *deeper], [last[2], *node]
        last = (region[-1], deeper[-1], node[-1])
        more = np.frombuffer(b"".join(deeper), "<u4").reshape(-1, DEEPER)
        depth = DEPTH + np.cumprod(more[1:] == more[:-1], axis=1).sum(1)
        at = [k for k in range(len(depth)) if region[k] == region[k + 1] and node[k] != node[k + 1]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([min(node[k], node[k + 1]) for k in at], pa.binary()),
                pa.array([max(node[k], node[k + 1]) for k in at], pa.binary()),
                pa.array(depth[at].astype(np.int32)),
            ],
            names=["u", "v", "depth"],
        )


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a shingle of a class."""
    for b in batches:
        for node, x in zip(b.column("node"), b.column("set"), strict=True):
            h = np.frombuffer(x.as_buffer(), "<i8")
            for a in range(0, len(h), 50_000):
                part = h[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()] * len(part), pa.binary()), pa.array(part)], names=["node", "g"])


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("a"), b.column("b"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("u", "v")], names=["u", "v"])

    return run


def salted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to at most one row a key, however many rows of left have the key."""
    l = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return l.join(r, [key, "_salt"], "left").drop("_salt")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN, by_row: bool = False) -> DataFrame:
    """A row per row of docs: _key, n_shingles, component_id, kept. Similarity is at least num / den, 0.8 or more.

    With by_row ids may be null or shared: _digest (SHA-256 of the text, null for a null text) tells the rows of
    an id apart, and of each component only the row with the smallest id and then digest is kept.
    """
    if num * 10 < den * 8:
        raise ValueError("the forest's depth is made for similarities of 0.8 or more")
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark)
    told = docs.select(F.col(key).cast("long").alias("_key"), F.col(text), (text_digest(text) if by_row else F.lit(None).cast("binary")).alias("_digest"))
    own = ["_key", "_digest"] if by_row else ["_key"]
    full = work.put("full", told.mapInArrow(_sets(words), "_key long, _digest binary, n_shingles long, node binary, sig binary, bits array<long>"))
    rows = work.put("rows", full.select(*own, "n_shingles", "node"))
    nodes = full.filter("node is not null").groupBy("node").agg(
        F.min(F.struct(*own)).alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bits").alias("bits")
    )
    nodes = work.put("nodes", nodes)
    work.drop("full")
    orders = work.put("orders", nodes.select("node", "sig").mapInArrow(_trees, "region long, deeper binary, node binary"))
    crowded = orders.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1")
    orders = work.put("crowded", orders.join(crowded, "region"))
    work.drop("orders")
    ordered = orders.repartitionByRange("region", "deeper", "node").sortWithinPartitions("region", "deeper", "node")
    near = ordered.mapInArrow(_neighbours, "u binary, v binary, depth int").groupBy("u", "v").agg(F.sum("depth").alias("n"))
    best = Window.partitionBy("v").orderBy(F.desc("n"), "u")
    pairs = near.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= FIRST).select("u", "v")
    # Copies of one text may be less similar to each other than to it. It then shares most regions with
    # most classes: in each region all look at the one that does.
    weight = orders.groupBy("node").agg(F.sum("size").alias("w"))
    lead = orders.join(weight, "node").groupBy("region").agg(F.max_by("node", F.struct("w", "node")).alias("lead"))
    led = orders.select("region", "node").join(lead, "region").filter("node <> lead").groupBy("node", "lead").agg(F.count("*").alias("n"))
    best = Window.partitionBy("node").orderBy(F.desc("n"), "lead")
    led = led.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= FIRST).select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v"))
    pairs = pairs.unionByName(led).distinct()

    # Full sets of the classes that share any region: one pass over the texts.
    wanted = orders.select("node").distinct().join(nodes.select("node", *[F.col(f"first.{c}").alias(f"w{c}") for c in own]), "node")
    wanted = wanted.select(*[f"w{c}" for c in own]).distinct()
    again = told.join(wanted, reduce(and_, [F.col(c).eqNullSafe(F.col(f"w{c}")) for c in own]), "left_semi").select("_key", text)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), words) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    sets = work.put("sets", again.mapInArrow(whole, "node binary, set binary").dropDuplicates(["node"]))
    work.free_shuffles()

    def confirmed(name: str, p: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("u"), F.col("set").alias("a"))
        b = sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
        out = work.put(name, p.join(a, "u").join(b, "v").mapInArrow(_confirm(num, den), "u binary, v binary"))
        work.free_shuffles()
        return out

    first = confirmed("first", pairs)
    of = components(first, work, "a")

    # Classes of regions that still hold several components: an exact join across components.
    named = orders.select("region", "node").join(of.select(F.col("u").alias("node"), "v"), "node", "left").select("region", "node", F.coalesce("v", "node").alias("c"))
    split = named.groupBy("region").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("region")
    mixed = work.put("mixed", named.join(split, "region").select("node", "c").distinct().join(nodes.select("node", "n_shingles", "bits"), "node"))
    token = work.put("tokens", mixed.select("node").join(sets, "node").mapInArrow(_tokens, "node binary, g long"))
    shared = token.join(token.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1"), "g")
    held = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("gs")).join(mixed, "node")
    # Shingles that no other class has come first and join nothing.
    n = F.col("n_shingles")
    first_n = n - F.floor((n * num + den - 1) / den).cast("long") + 1 - (n - F.size("gs"))
    prefix = held.filter(first_n > 0).select("node", "c", "n_shingles", "bits", F.explode(F.slice("gs", F.lit(1), first_n.cast("int"))).alias("t")).select("node", "c", "n_shingles", "bits", "t.g")
    prefix = work.put("prefix", prefix)
    work.drop("tokens")
    other = prefix.select("g", F.col("node").alias("v"), F.col("c").alias("d"), F.col("n_shingles").alias("m"), F.col("bits").alias("bits2"))
    fits = (den * F.least("n_shingles", "m")) >= (num * F.greatest("n_shingles", "m"))
    apart = reduce(add, [F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits2", F.lit(i)))) for i in range(SKETCH)])
    # |A & B| is num / (num + den) of |A| + |B| at least, so the sets differ in the rest at most.
    alike = apart * (den + num) <= (F.col("n_shingles") + F.col("m")) * (den - num)
    across = prefix.join(other, "g").filter((F.col("c") < F.col("d")) & fits & alike).select(F.col("node").alias("u"), "v").distinct()
    second = confirmed("second", across)
    of = components(of.unionByName(second), work, "b")
    # Per class that is not alone, or has several rows: the first row of its component.
    named = of.unionByName(of.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("node"), "v")
    many = nodes.select("node", "first", "copies").join(named, "node", "left").filter("v is not null or copies > 1")
    least = many.filter("v is not null").groupBy("v").agg(F.min("first").alias("least"))
    many = salted(many, least, "v").select("node", F.coalesce("least", "first").alias("least"))
    many = work.put("many", many)
    # The result reads rows and these alone.
    for name in ("nodes", "crowded", "sets", "mixed", "prefix", "first", "second", *[f"{c}{k}" for c in "ab" for k in range(64)]):
        work.drop(name)
    work.free_shuffles()
    return salted(rows, many, "node").select(
        *own,
        "n_shingles",
        F.when(F.col("least").isNull(), F.col("_key")).otherwise(F.col("least._key")).alias("component_id"),
        (F.col("least").isNull() | reduce(and_, [F.col(c).eqNullSafe(F.col(f"least.{c}")) for c in own])).alias("kept"),
    )


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).withColumnRenamed("_key", "doc_id")


OP4_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(w[s : s + 3]) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
pair AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n
"""
