"""Benchmark decontamination by a positional inverted index.

The index is cut by documents: each block of documents has its own lists, one
row per (block, term) with the term's positions. No term, however frequent,
gathers in one place, and building it moves nothing between tasks. It is
written to shared storage once.

A test set is taken in chunks of at most ``CHUNK_WORDS`` words, so what is
sent to the executors is bounded whatever its size. Per chunk: document
frequencies of its terms are summed over the index; for every window the
lists are intersected from the rarest term on, each shifted by the term's place
in the window, for all windows of the chunk at once.

Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z.
A window is 13 consecutive words of an item (all of it, if shorter).

Defined results: null or empty texts have no words and are never hit; repeated
rows each get a row; items without words have no windows; an item id that
several rows share counts once; a null item id is the empty string. Other
columns are ignored. A text of any length is one document of one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Workspace, hold, small_batches

WINDOW = 13
CHUNK_WORDS = 200_000
#: Candidate places looked at together within a block.
SLICE = 2_000_000
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

INDEX = "block long, term binary, n int, places binary, ids binary, digests binary"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _index_block(block: int, ids: bytes, texts, digest: bool = False) -> pa.RecordBatch:
    """A block's lists, by term; the row without a term tells its documents apart."""
    shas = b"".join(hashlib.sha256((x.as_py() or "").encode("utf-8", "surrogatepass")).digest() for x in texts) if digest else b""
    number = {}
    fresh = count()
    coded, sizes = [], []
    for x in texts:
        w = words(x.as_py())
        sizes.append(len(w))
        for t in set(w):
            if t not in number:
                number[t] = next(fresh)
        coded.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
    sizes = np.array(sizes, np.int64)
    # One place is left free after each document: no window reaches the next one.
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    code = np.concatenate(coded) if coded else np.zeros(0, np.int32)
    place = np.arange(len(code), dtype=np.int64) + np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(code, kind="stable")
    n = np.bincount(code, minlength=len(number)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    sorted_places = place[order].astype("<i4")
    # Gaps within each list, which compress; the first is absolute.
    gaps = np.diff(sorted_places, prepend=np.int32(0)).astype("<i4")
    gaps[ends[:-1]] = sorted_places[ends[:-1]]
    if len(ends) and ends[-1] * 4 >= 2**31:
        raise ValueError("a block's lists exceed 2 GB: read the documents in smaller batches")
    lists = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * 4).astype("<i4").tobytes()), pa.py_buffer(gaps.tobytes())])
    terms = pa.array(list(number), pa.binary())
    m = len(n) + 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(m, block)),
            pa.concat_arrays([terms, pa.array([None], pa.binary())]),
            pa.array(np.concatenate([n, [len(sizes)]]).astype(np.int32)),
            pa.concat_arrays([lists, pa.array([starts.astype("<i8").tobytes()], pa.binary())]),
            pa.concat_arrays([pa.nulls(len(n), pa.binary()), pa.array([ids], pa.binary())]),
            pa.concat_arrays([pa.nulls(len(n), pa.binary()), pa.array([shas], pa.binary())]),
        ],
        names=["block", "term", "n", "places", "ids", "digests"],
    )


def pack_ids(ids: pa.Array) -> bytes:
    """Longs, then a byte for each that is 1 if it is null."""
    return ids.fill_null(0).to_numpy().astype("<i8").tobytes() + ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()


def unpack_ids(b) -> pa.Array:
    n = len(b) // 9
    return pa.array(np.frombuffer(b, "<i8", n), mask=np.frombuffer(b, np.uint8, n, 8 * n).astype(bool))


def build_index(docs: DataFrame, key: str = "_key", text: str = "text", digest: bool = False) -> DataFrame:
    """Postings of every word of every document, and if asked for each text's SHA-256 (a null text is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("index")
        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            yield _index_block((part << 32) + k, pack_ids(b.column(0)), b.column(1), digest)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, INDEX)


def windows_of(items: list[tuple[str, list[bytes]]], width: int) -> dict[tuple[bytes, ...], list[str]]:
    found: dict[tuple[bytes, ...], list[str]] = {}
    for item, w in items:
        for s in range(max(1, len(w) - width + 1)) if w else ():
            found.setdefault(tuple(w[s : s + width]), []).append(item)
    return found


class Probe:
    """A chunk's windows, each with its terms' places ordered from the rarest term on."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]], df: dict[bytes, int], width: int):
        self.terms = {t: i for i, t in enumerate(sorted({t for w in windows for t in w}))}
        freq = np.array([df.get(t, 0) for t in self.terms], np.int64)
        self.size = np.array([len(w) for w in windows], np.int64)
        wide = max([width, *self.size]) if len(self.size) else width
        term, place = (np.full((len(windows), wide), -1, np.int64) for _ in range(2))
        for k, w in enumerate(windows):
            ids = np.array([self.terms[t] for t in w])
            by = np.argsort(freq[ids], kind="stable")
            term[k, : len(w)], place[k, : len(w)] = ids[by], by
        self.term, self.place = term, place
        names = sorted({i for v in windows.values() for i in v})
        at = {x: k for k, x in enumerate(names)}
        self.names = names
        self.items = [np.unique([at[i] for i in v]) for v in windows.values()]

    def _found(self, keys, first, last):
        """Every (window, start) at which the whole window occurs."""
        here = (last > first)[np.where(self.term < 0, 0, self.term)] | (self.term < 0)
        live = np.flatnonzero(here.all(1))
        cost = (last - first)[self.term[live, 0]]
        cuts = np.searchsorted(np.cumsum(cost), np.arange(SLICE, cost.sum() + SLICE, SLICE)) if len(live) else []
        begin = 0
        for cut in cuts:
            some, begin = live[begin : cut + 1], cut + 1
            if not len(some):
                continue
            head = self.term[some, 0]
            n = last[head] - first[head]
            win = np.repeat(some, n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = (keys[np.repeat(first[head], n) + inner] & 0xFFFFFFFF) - self.place[win, 0]
            for r in range(1, self.term.shape[1]):
                if not len(win):
                    break
                t = self.term[win, r]
                want = (t << 32) + start + self.place[win, r]
                got = np.searchsorted(keys, want)
                ok = (t < 0) | ((got < len(keys)) & (keys[np.minimum(got, len(keys) - 1)] == want) & (start >= 0))
                win, start = win[ok], start[ok]
            ok = start >= 0
            yield win[ok], start[ok]

    def _near(self, keys, first, last, slop):
        """(window, place of its rarest term) with every other term at most slop words away."""
        live = np.flatnonzero(((last > first)[np.where(self.term < 0, 0, self.term)] | (self.term < 0)).all(1))
        for w in live:
            head = self.term[w, 0]
            at = keys[first[head] : last[head]] & 0xFFFFFFFF
            for t in self.term[w, 1:]:
                if t < 0 or not len(at):
                    break
                got = np.searchsorted(keys, (t << 32) + np.maximum(at - slop, 0))
                ok = got < len(keys)
                ok[ok] = keys[got[ok]] <= (t << 32) + at[ok] + slop
                at = at[ok]
            yield np.full(len(at), w), at

    def block(self, t: pa.Table, slop: int | None):
        """Per document of a block: id, words, digest, hit runs, items that occur, items near."""
        term = t["term"].to_pylist()
        places = t["places"].combine_chunks() if t.num_rows else None
        own = term.index(None)
        starts = np.frombuffer(places[own].as_buffer(), "<i8")
        ids = unpack_ids(t["ids"].combine_chunks()[own].as_buffer())
        nt = len(self.terms)
        lists = sorted((self.terms[x], k) for k, x in enumerate(term) if x is not None)
        first, last = np.zeros(nt, np.int64), np.zeros(nt, np.int64)
        parts, at = [], 0
        for tid, k in lists:
            p = np.cumsum(np.frombuffer(places[k].as_buffer(), "<i4"), dtype=np.int64)
            parts.append(p + (tid << 32))
            first[tid], last[tid] = at, at + len(p)
            at += len(p)
        keys = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        total = int(starts[-1])
        edge = np.zeros(total + 1, np.int64)
        pairs, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        spread = lambda win, doc: np.concatenate([self.items[w] + doc_k * len(self.names) for w, doc_k in zip(win, doc, strict=True)])
        for win, start in self._found(keys, first, last):
            if len(win):
                np.add.at(edge, start, 1)
                np.add.at(edge, start + self.size[win], -1)
                both = np.unique(np.stack([win, np.searchsorted(starts, start, "right") - 1]), axis=1)
                pairs.append(spread(*both))
        if slop is not None:
            for win, place in self._near(keys, first, last, slop):
                if len(win):
                    both = np.unique(np.stack([win, np.searchsorted(starts, place, "right") - 1]), axis=1)
                    near.append(spread(*both))
        hit = np.cumsum(edge[:-1]) > 0
        turn = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        n = len(ids)
        shas = t["digests"].combine_chunks()[own].as_py()
        shas = [shas[k : k + 32] for k in range(0, len(shas), 32)] or [None] * n
        doc = np.searchsorted(starts, turn[:, 0], "right") - 1
        runs: list[list[int]] = [[] for _ in range(n)]
        for d, (a, b) in zip(doc, turn, strict=True):
            runs[d] += [int(a - starts[d]), int(b - starts[d])]
        cols = []
        for got in (pairs, near):
            items: list[list[str]] = [[] for _ in range(n)]
            for x in np.unique(np.concatenate(got)):
                items[x // len(self.names)].append(self.names[x % len(self.names)])
            cols.append(items)
        return ids, np.diff(starts) - 1, shas, runs, *cols


HITS = "_key long, block long, nth int, _digest binary, n_words long, runs array<int>, items array<string>, near array<string>"


def search(index: DataFrame, items: list[tuple[str, list[bytes]]], width: int = WINDOW, slop: int | None = None):
    """Per document its hit runs (start, end, start, end ...) and items, for a bounded chunk of items; and what was broadcast for it."""
    spark = index.sparkSession
    windows = windows_of(items, width)
    vocabulary = spark.createDataFrame([(bytearray(t),) for t in sorted({t for w in windows for t in w})], "term binary")
    known = F.broadcast(vocabulary)  # at most CHUNK_WORDS terms
    df = {bytes(r["term"]): r["df"] for r in index.filter("term is not null").join(known, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")).collect()}
    probe = spark.sparkContext.broadcast(Probe(windows, df, width))

    def run(t: pa.Table) -> pa.Table:
        ids, n_words, shas, runs, found, near = probe.value.block(t, slop)
        return pa.table(
            {
                "_key": ids,
                "block": pa.array(np.full(len(ids), t["block"][0].as_py())),
                "nth": pa.array(np.arange(len(ids), dtype=np.int32)),
                "_digest": pa.array(shas, pa.binary()),
                "n_words": pa.array(n_words.astype(np.int64)),
                "runs": pa.array(runs, pa.list_(pa.int32())),
                "items": pa.array(found, pa.list_(pa.string())),
                "near": pa.array(near, pa.list_(pa.string())),
            }
        )

    wanted = index.join(known.withColumn("_in", F.lit(1)), "term", "left").filter("_in = 1 or term is null").drop("_in")
    return wanted.groupBy("block").applyInArrow(run, HITS), probe


def _union(runs):
    """Runs of one document found with several chunks, made one list."""

    def one(x):
        out: list[int] = []
        for a, b in sorted((r[k], r[k + 1]) for r in x for k in range(0, len(r), 2)):
            if out and a <= out[-1]:
                out[-1] = max(out[-1], b)
            else:
                out += [a, b]
        return out

    return runs.map(one)


def item_chunks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test set, streamed to the driver one partition at a time."""
    chunk, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    for r in rows.toLocalIterator():
        w = words(r["t"])
        if not w:
            continue
        if chunk and size + len(w) > limit:
            yield chunk
            chunk, size = [], 0
        chunk.append((r["i"], w))
        size += len(w)
    yield chunk


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "_key", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int | None = None, chunk_words: int = CHUNK_WORDS, digest: bool = False) -> DataFrame:
    """Per document: _key, _digest (SHA-256 of the text, if asked for), n_words, runs (hit words), items, near."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark)
    index = work.put("index", build_index(docs, key, text, digest))
    chunks = item_chunks(benchmark, item_id, item_text, chunk_words)
    first = next(chunks)
    second = next(chunks, None)
    if second is None:
        return search(index, first, width, slop)[0]
    # Each chunk's hits are written before the next one is sent out; only the first has the rows of texts without any.
    found = []
    for k, chunk in enumerate(chain([first, second], chunks)):
        some, probe = search(index, chunk, width, slop)
        found.append(work.put(f"hits{k}", some if k == 0 else some.filter((F.size("runs") > 0) | (F.size("near") > 0))))
        probe.destroy()
    both = reduce(DataFrame.unionByName, found)
    return both.groupBy("block", "nth").agg(
        *[F.first(c).alias(c) for c in ("_key", "_digest", "n_words")],
        F.pandas_udf(_union, "array<int>")(F.collect_list("runs")).alias("runs"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
    )


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate(F.sequence(F.lit(0), F.size("runs") - 1, F.lit(1)), F.lit(0).cast("long"), lambda a, i: a + F.when(i % 2 == 1, F.element_at("runs", i + 1)).otherwise(-F.element_at("runs", i + 1)))
    return found.withColumn("n_hit", F.when(F.size("runs") == 0, F.lit(0).cast("long")).otherwise(hit)).select(
        "_key",
        "_digest",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    docs = read("documents").select(F.col("doc_id").alias("_key"), "text")
    return digest(contamination(docs, read("benchmark"))).withColumnRenamed("_key", "doc_id").drop("_digest")


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, w[s : s + least(len(w), 13) - 1] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT rid, s, n, w[s : s + n - 1] AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT rid, s, n, item FROM dw JOIN iw USING (win)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
k AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN k USING (rid)
"""
