"""Removal of repeated passages by blockwise suffix sorting over a difference cover.

What is removed: every byte covered by a string of ``size`` (100) bytes that
also starts earlier, in a smaller document or earlier in the same one. That is
a question to the suffix array cut at depth 100: of the suffixes that share
their first 100 bytes, all but the first by position start a repeat. Suffixes
are ordered under a fixed random fingerprint of their leading bytes, since only
who is next to whom matters, not the alphabet.

1. Texts go into blocks of bounded size in order of their ids, each text once:
   of equal texts of 100 bytes or more all but the first are removed whole.
2. Cover sample. Positions p of a document with p mod 57 in the perfect
   difference set D are sampled (14 %). For any two positions i and j some shift
   below 57 brings both into the sample, so if 100 bytes at i and j agree, two
   sampled positions agree on 44 bytes. Sampled suffixes are sorted to that
   depth one bucket at a time; a bit per suffix says if its rank is shared.
3. Only suffixes with a shared cover rank within their first 57 bytes can be
   long ties. They alone are sorted to full depth, again one bucket at a time,
   in order of blocks; a bit per suffix says that an earlier one is equal.

What moves is sorted fingerprints without positions, one way, and bits the
other way: about 0.6 bytes a byte of text for the sample, some 6 a byte of
passages that are repeated. A task holds one block (``BLOCK`` bytes, or one
longer document) or one bucket (``BUCKET`` bytes).

A fingerprint of 100 bytes has 64 bits and as many bytes more as keep the odds
that any two different ones among the text's n bytes meet below 1/32: about
2 log2(n) + 4 bits, 64 up to 1 GB of text, 80 at 40 GB, 104 at 100 TB. It is a
tree of multiplications with a non-linear step after each, so regular texts
meet as seldom as others. Suffixes are thus ordered by fingerprint and not by
letter: their first 57 letters would be 57 bytes a suffix on the way to its
bucket, where a fingerprint is some 6.

Defined results: null is the empty text; ids order as numbers, null first, rows
with the same id by digest of their text; a row that repeats id and text is a
later copy. Texts under 100 bytes stay. Other columns are ignored by
``repeats`` and kept by ``without_repeats``. Very long texts are a block of
their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Workspace, hold, small_batches

SIZE = 100
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
DEPTH = SIZE - PERIOD + 1
BLOCK, BUCKET = 2 << 20, 12 << 20
STEP = 1 << 20
#: Buckets are at most 2 to this power: beyond some 15 TB of text a bucket grows with it, to about 100 MB at 100 TB.
MOST_BITS = 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 64, (2, 256), np.uint64)
_BASE = tuple(int(x) | 1 for x in _RNG.integers(0, 1 << 64, 2, np.uint64))
_MASK = (1 << 64) - 1


def prints(data: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """The fingerprint of every run of ``size`` bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, m, out, done = _BYTE[which][data], 1, None, 0
    times = lambda k: np.uint64(pow(_BASE[which], k, 1 << 64))

    def mixed(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(29)
        return x

    while True:
        if size & m:
            part = level[done : done + n]
            out = part.copy() if out is None else mixed(out * times(m) + part)
            done += m
        if m * 2 > size:
            break
        level = mixed(level[:-m] * times(m) + level[m:])
        m *= 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def prints_at(data: np.ndarray, places: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """The same at sorted places only; memory is that of one step, however long the data."""
    out = np.empty(len(places), np.uint64)
    for s in range(0, len(data), STEP):
        a, b = np.searchsorted(places, (s, s + STEP))
        if b > a:
            first = int(places[a])
            h = prints(data[first : int(places[b - 1]) + size], size, which)
            out[a:b] = h[places[a:b] - first]
    return out


class Block:
    """Documents side by side."""

    def __init__(self, row: dict):
        self.data = np.frombuffer(zstandard.decompress(row["z"], max_output_size=row["total"]), np.uint8) if row["total"] else np.zeros(0, np.uint8)
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def sample(self) -> np.ndarray:
        """Places of the cover sample."""
        longest = int(self.sizes.max(initial=0))
        at = (np.arange(0, longest + PERIOD, PERIOD)[:, None] + np.array(COVER)[None, :]).ravel()
        ends = np.searchsorted(at, self.sizes - DEPTH, "right")
        return np.concatenate([np.zeros(0, np.int64), *(at[:e] + s for e, s in zip(ends, self.starts, strict=False))])

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Places of suffixes that have a sampled place with a shared rank in their first 57 bytes."""
        doc = np.searchsorted(self.starts, shared, "right") - 1
        first = np.maximum(shared - PERIOD + 1, self.starts[doc])
        last = np.minimum(shared, self.starts[doc] + self.sizes[doc] - SIZE)
        ok = last >= first
        return covered(first[ok], last[ok] + 1, len(self.data))


def wider(total: int) -> int:
    """Bytes of a fingerprint beyond the first eight, for so many bytes of text."""
    return min(8, max(0, math.ceil((2 * math.log2(max(2, total)) + 4 - 64) / 8)))


def covered(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Places in any of the ranges."""
    turn = np.bincount(first, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.flatnonzero(np.cumsum(turn[:n]) > 0)


def to_bytes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def from_bytes(b, width: int) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def pack_gaps(gaps: np.ndarray) -> tuple[int, bytes, bytes | None]:
    """Width, the gaps in that many bytes, and the few that are wider: places, then values."""
    size = [0, *(int((gaps >> np.uint64(8 * w)).astype(bool).sum()) if w < 8 else 0 for w in range(1, 9))]
    width = min(range(1, 9), key=lambda w: len(gaps) * w + 12 * size[w])
    odd = np.flatnonzero(gaps >> np.uint64(8 * width)) if width < 8 else np.zeros(0, int)
    return width, to_bytes(gaps, width), odd.astype("<u4").tobytes() + gaps[odd].astype("<u8").tobytes() if len(odd) else None


def read_gaps(row: dict) -> np.ndarray:
    gaps = from_bytes(row["data"], row["width"])
    if row["odd"]:
        k = len(row["odd"]) // 12
        gaps[np.frombuffer(row["odd"], "<u4", k)] = np.frombuffer(row["odd"], "<u8", k, 4 * k)
    return gaps


def cut_points(values: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket (the leading bits) begins in sorted values."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


PIECE = "block long, bucket int, n int, width int, data binary, more binary, odd binary"
BITS = "block long, bucket int, n int, bits binary"


def _piece(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "bucket", "n", "width", "data", "more", "odd"), cols, kinds, strict=True)})


def _bits(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "bucket", "n", "bits"), cols, kinds, strict=True)})


def _sampled(block: Block):
    """Sampled places, the sorted distinct fingerprints, and each place's index in them."""
    places = block.sample()
    h = prints_at(block.data, places, DEPTH)
    order = np.argsort(h)
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    index = np.empty(len(s), np.int64)
    index[order] = np.cumsum(new) - 1
    return places, s[new], index


def _send_sample(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, s, _ = _sampled(Block(row))
                cuts = cut_points(s, bits)
                # The 32 bits after those of the bucket: two suffixes that meet by chance only make candidates.
                low = (s << np.uint64(bits)) >> np.uint64(32)
                rows = [(row["block"], k, int(e - a), 4, to_bytes(low[a:e], 4), None, None) for k, (a, e) in enumerate(zip(cuts, cuts[1:], strict=False)) if e > a]
                yield from _piece(rows).to_batches()

    return run


def _rank_sample(t: pa.Table) -> pa.Table:
    """One bucket: which fingerprints occur in more than one block."""
    rows = t.to_pylist()
    values = np.concatenate([from_bytes(r["data"], r["width"]) for r in rows])
    s = np.sort(values)
    twice = s[1:][s[1:] == s[:-1]]
    at = np.searchsorted(twice, values)
    shared = np.zeros(len(values), bool)
    inside = at < len(twice)
    shared[inside] = twice[at[inside]] == values[inside]
    out, a = [], 0
    for r in rows:
        out.append((r["block"], r["bucket"], r["n"], np.packbits(shared[a : a + r["n"]]).tobytes()))
        a += r["n"]
    return _bits(out)


def _read_bits(rows: list[dict], n: int) -> np.ndarray:
    rows = sorted((r for r in rows if r["bucket"] >= 0), key=lambda r: r["bucket"])
    got = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in rows]
    out = np.concatenate([np.zeros(0, np.uint8), *got]).astype(bool)
    assert len(out) == n, "bits of another block"
    return out


def _deep(block: Block, places: np.ndarray, wide: int):
    """Fingerprints of the candidates at full depth: order (by value, then place), firsts in that order, both values."""
    h = prints_at(block.data, places, SIZE)
    g = prints_at(block.data, places, SIZE, 1) >> np.uint64(64 - 8 * wide) if wide else None
    order = np.lexsort((g, h)) if wide else np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    if wide and len(s):
        t = g[order]
        new[1:] |= t[1:] != t[:-1]
        return order, new, s[new], t[new]
    return order, new, s[new], None


def _send_deep(bits: int, wide: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            block = Block(row)
            places, s, index = _sampled(block)
            shared = _read_bits(right.to_pylist(), len(s)) | (np.bincount(index, minlength=len(s)) > 1)
            places = block.candidates(places[shared[index]])
            turn = np.flatnonzero(np.diff(places, prepend=-2) != 1)
            runs = np.stack([places[turn], np.concatenate([places[turn[1:] - 1], places[-1:]]) + 1]) if len(places) else np.zeros((2, 0))
            # The candidates' places travel along, for the last step.
            rows.append((row["block"], -1 - row["block"] % (1 << bits), runs.shape[1], 0, zstandard.compress(runs.astype("<i8").tobytes()), None, None))
            _, _, h, g = _deep(block, places, wide)
            cuts = cut_points(h, bits)
            for k, (a, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if e > a:
                    gaps = np.diff(h[a:e], prepend=np.uint64(k << (64 - bits)))
                    width, data, odd = pack_gaps(gaps)
                    rows.append((row["block"], k, int(e - a), width, data, to_bytes(g[a:e], wide) if wide else None, odd))
        return _piece(rows)

    return run


def _rank_deep(bits: int, wide: int):
    def run(t: pa.Table) -> pa.Table:
        """One bucket: which suffixes an earlier block has, too."""
        rows = sorted(t.to_pylist(), key=lambda r: r["block"])
        if rows[0]["bucket"] < 0:
            return _bits([(r["block"], -1, r["n"], r["data"]) for r in rows])
        base = np.uint64(rows[0]["bucket"] << (64 - bits))
        h = np.concatenate([np.cumsum(read_gaps(r), dtype=np.uint64) + base for r in rows])
        if wide:
            g = np.concatenate([from_bytes(r["more"], wide) for r in rows])
            order = np.lexsort((g, h))
            s, u = h[order], g[order]
            again = np.concatenate([[False], (s[1:] == s[:-1]) & (u[1:] == u[:-1])])
        else:
            order = np.argsort(h, kind="stable")
            s = h[order]
            again = np.concatenate([[False], s[1:] == s[:-1]])
        late = np.zeros(len(h), bool)
        late[order] = again
        out, a = [], 0
        for r in rows:
            out.append((r["block"], r["bucket"], r["n"], np.packbits(late[a : a + r["n"]]).tobytes()))
            a += r["n"]
        return _bits(out)

    return run


RESULT = "_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, _digest binary, kept string, carried string"


def whole_characters(data: bytes, spans: list[int]) -> str:
    """What the spans leave of a text; characters that a cut would split stay whole."""
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def _remove(wide: int, with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(9)]
        bits = right.to_pylist()
        for row in left.to_pylist():
            block = Block(row)
            runs = np.frombuffer(zstandard.decompress(next(r["bits"] for r in bits if r["bucket"] < 0)), "<i8").reshape(2, -1)
            places = covered(runs[0], runs[1], len(block.data)) if runs.size else np.zeros(0, np.int64)
            order, new, h, _ = _deep(block, places, wide)
            late = np.ones(len(places), bool)
            late[order[new]] = _read_bits(bits, len(h))
            gone = np.zeros(len(block.data), bool)
            gone[covered(places[late], places[late] + SIZE, len(block.data))] = True
            edge = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]) | (gone & np.isin(np.arange(len(gone)), block.starts)))
            stop = np.flatnonzero(gone & ~np.concatenate([gone[1:], [False]]) | (gone & np.isin(np.arange(len(gone)) + 1, block.starts))) + 1
            a = np.searchsorted(edge, block.starts)
            ids = row["keys"]
            for k, (s, e) in enumerate(zip(block.starts, block.starts[1:], strict=False)):
                mine = slice(a[k], a[k + 1])
                n = int((stop[mine] - edge[mine]).sum())
                text = block.data[s:e].tobytes()
                kept = block.data[s:e][~gone[s:e]].tobytes() if n else text
                spans = (np.stack([edge[mine], stop[mine]], 1).ravel() - s).tolist()
                left_text = whole_characters(text, spans) if with_text else None
                for c, v in zip(cols, (ids[k], int(e - s), n, len(edge[mine]), hashlib.sha256(kept).hexdigest(), spans, row["digests"][k], left_text, row["carried"][k]), strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.string(), pa.string())
        names = [x.strip().split(" ")[0] for x in RESULT.split(",")]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("suffixes")
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in batches:
        texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in b.column(1)]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
                pa.array([len(x) for x in texts], pa.int64()),
                pa.array([squeeze.compress(x) if len(x) >= SIZE else None for x in texts], pa.binary()),
                b.column(2),
            ],
            names=["_key", "_digest", "n_bytes", "z", "carried"],
        )


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers blocks in the order of the rows; a block ends before it would pass its size."""
    block, room = TaskContext.get().partitionId() << 32, BLOCK
    for b in batches:
        out = []
        for n in b.column("n_bytes").to_pylist():
            if n > room and room < BLOCK:
                block, room = block + 1, BLOCK
            room -= n
            out.append(block)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "block"])


def _join_block(t: pa.Table) -> pa.Table:
    seen, rows = set(), []
    for r in sorted(t.to_pylist(), key=lambda r: (r["_key"] is not None, r["_key"] or 0, r["_digest"])):
        if (r["_key"], r["_digest"]) not in seen:
            seen.add((r["_key"], r["_digest"]))
            rows.append(r)
    text = b"".join(zstandard.decompress(r["z"], max_output_size=r["n_bytes"]) for r in rows)
    return pa.table(
        {
            "block": pa.array([rows[0]["block"]], pa.int64()),
            "keys": pa.array([[r["_key"] for r in rows]], pa.list_(pa.int64())),
            "digests": pa.array([[r["_digest"] for r in rows]], pa.list_(pa.binary())),
            "carried": pa.array([[r["carried"] for r in rows]], pa.list_(pa.string())),
            "sizes": pa.array([np.array([r["n_bytes"] for r in rows], "<i8").tobytes()], pa.binary()),
            "total": pa.array([len(text)], pa.int64()),
            "z": pa.array([zstandard.compress(text, 3)], pa.binary()),
        }
    )


BLOCKS = "block long, keys array<long>, digests array<binary>, carried array<string>, sizes binary, total long, z binary"


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, carry: Column | None = None) -> DataFrame:
    """A row per row of docs: _key, n_bytes, n_removed, n_spans, kept_sha256, spans, _digest and,
    if asked for, of texts of 100 bytes or more that are no copies what is left of the text in whole
    characters (kept), and a string column that travels along (carried)."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark)
    along = (carry if carry is not None else F.lit(None)).cast("string").alias("carried")
    raw = work.put("raw", docs.select(F.col(key).cast("long").alias("_key"), F.col(text), along).mapInArrow(_read, "_key long, _digest binary, n_bytes long, z binary, carried string"))
    # Rows of each (id, text), and whether it is the first with its text.
    rows = raw.groupBy("_key", "_digest", "n_bytes").agg(F.count("*").alias("copies"))
    # Joined on text and id together, so that no text's copies meet in one task.
    first = rows.filter(F.col("n_bytes") >= SIZE).groupBy("_digest").agg(F.min(F.struct("_key")).alias("f"))
    first = first.select(F.col("_digest").alias("_fd"), F.col("f._key").alias("_fk"))
    found = rows.join(first, (F.col("_digest") == F.col("_fd")) & F.col("_key").eqNullSafe(F.col("_fk")), "left")
    rows = work.put("rows", found.withColumn("is_first", F.col("_fd").isNotNull()).drop("_fd", "_fk"))
    whole = rows.filter("is_first")
    total = whole.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    bits = min(MOST_BITS, max(3, math.ceil(math.log2(max(2.0, total * len(COVER) / PERIOD * 5 / BUCKET)))))
    deep_bits = min(MOST_BITS, max(3, math.ceil(math.log2(max(2.0, total / 4 * 8 / BUCKET)))))
    wide = wider(total)
    dealt = whole.select("_key", "_digest", "n_bytes").repartitionByRange(F.asc_nulls_first("_key"), "_digest").sortWithinPartitions(F.asc_nulls_first("_key"), "_digest")
    dealt = work.put("dealt", dealt.mapInArrow(_deal, "_key long, _digest binary, n_bytes long, block long"))
    d = dealt.select(F.col("_key").alias("k"), F.col("_digest").alias("g"), "block")
    placed = raw.join(d, (F.col("_digest") == F.col("g")) & F.col("_key").eqNullSafe(F.col("k"))).drop("k", "g")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    blocks = work.put("blocks", placed.groupBy("block").applyInArrow(_join_block, BLOCKS), "uncompressed")
    work.drop("raw")
    work.free_shuffles()
    sample = blocks.mapInArrow(_send_sample(bits), PIECE)
    shared = work.put("shared", sample.groupBy("bucket").applyInArrow(_rank_sample, BITS))
    work.free_shuffles()
    deep = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send_deep(deep_bits, wide), PIECE)
    late = work.put("late", deep.groupBy("bucket").applyInArrow(_rank_deep(deep_bits, wide), BITS))
    for name in ("dealt", "shared"):  # the result reads blocks, late and rows
        work.drop(name)
    work.free_shuffles()
    found = blocks.groupBy("block").cogroup(late.groupBy("block")).applyInArrow(_remove(wide, with_text), RESULT)
    is_copy = F.col("n_bytes") >= SIZE
    spare = rows.withColumn("copies", F.col("copies") - F.col("is_first").cast("int")).filter("copies > 0")
    copies = spare.select(
        "_key",
        "n_bytes",
        F.when(is_copy, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        is_copy.cast("long").alias("n_spans"),
        F.lower(F.hex(F.when(is_copy, F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))).otherwise(F.col("_digest")))).alias("kept_sha256"),
        F.when(is_copy, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.array().cast("array<long>")).alias("spans"),
        "_digest",
        F.lit(None).cast("string").alias("kept"),
        F.lit(None).cast("string").alias("carried"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_nth"),
    ).drop("_nth")
    return found.unionByName(copies)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its columns and a column _n_removed: repeated passages are cut from the texts, in whole
    characters. Rows of which nothing is left go, and so do later rows with an earlier one's id and text."""
    rest = [c for c in docs.columns if c not in (key, text)]
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    short = F.coalesce(F.octet_length(text), F.lit(0)) < SIZE
    # Other columns travel with the blocks, so that no text is joined to them again.
    packed = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])) if rest else F.lit(None)
    form = StructType([StructField(f"c{i}", kinds[c]) for i, c in enumerate(rest)])
    found = repeats(docs.filter(~short), key, text, True, packed).filter("length(kept) > 0")
    found = found.withColumn("_c", F.from_json("carried", form) if rest else F.lit(None))
    cut = found.select(*[(F.col("_key").cast(kinds[c]) if c == key else F.col("kept") if c == text else F.col(f"_c.c{rest.index(c)}")).alias(c) for c in docs.columns], F.col("n_removed").alias("_n_removed"))
    return cut.unionByName(docs.filter(short).withColumn("_n_removed", F.lit(0).cast("long")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeats(docs).select(F.col("_key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP2_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, s, b[s : s + 99] AS x FROM (SELECT r, b, unnest(range(1, octet_length(b) - 98)) AS s FROM d WHERE octet_length(b) >= 100)),
l AS (SELECT r, s FROM w QUALIFY row_number() OVER (PARTITION BY x ORDER BY r, s) > 1),
e AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM l),
u AS (SELECT r, min(s) AS a, max(s) + 99 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY s) AS run FROM e) GROUP BY r, run),
p AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM u),
k AS (SELECT r, count(*) AS spans, sum(z - a + 1) AS gone, string_agg(CASE WHEN a - 1 > before THEN hex(b[before + 1 : a - 1]) ELSE '' END, '' ORDER BY a) || CASE WHEN octet_length(any_value(b)) > max(z) THEN hex(any_value(b)[max(z) + 1 : octet_length(any_value(b))]) ELSE '' END AS rest FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN rest IS NULL THEN b ELSE unhex(rest) END) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
