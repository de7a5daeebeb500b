"""Nearest neighbours by a block matrix join.

Vectors are dealt into blocks of bounded size; every (query block, candidate
block) tile is one unit of work, found by an equi-join on the tile's number.
Within a tile, int8 codes are multiplied; with the codes' residual norms each
product has an error bound, so a pair is dropped only if it provably cannot be
among the k nearest. Survivors are recomputed in double precision from the
original vectors and merged by one heap of k a query, which all tiles of a task
share: its least score is a bound for the next tile, and at most k rows a query
and task are left to merge. The result is exact: recall is 1 by construction.

Work is (queries x vectors) multiplications, in blocks; bytes moved are each
candidate block once per query block, in total the vectors' bytes times
ceil(queries / query_block), so they shrink as ``query_block`` grows.

Defined results: vectors that are null, empty, all zero, or hold a null or
non-finite component take no part; vectors are compared with those of equal
length only; rows that share an id count as one vector (the smallest); ties go
to the smaller id; with fewer candidates than k all are returned; a null id
takes no part. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

K = 20
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Queries multiplied at a time within a tile.
STRIP = 256


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
        .filter(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
        .groupBy("id")
        .agg(F.min("v").alias("v"))
        .withColumn("dim", F.size("v"))
    )


def _pack(batches: Iterator[pa.Table] | pa.Table) -> pa.Table:
    t = batches
    ids = t["id"].to_numpy().astype("<i8")
    order = np.argsort(ids, kind="stable")
    mat = np.concatenate([c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in t["v"].chunks])
    mat = mat.reshape(len(ids), -1)[order]
    return pa.table(
        {
            "dim": pa.array([mat.shape[1]], pa.int32()),
            "block": pa.array([t["block"][0].as_py()], pa.int64()),
            "ids": pa.array([ids[order].tobytes()], pa.binary()),
            "mat": pa.array([mat.astype("<f8" if mat.dtype == np.float64 else "<f4").tobytes()], pa.binary()),
            "wide": pa.array([mat.dtype == np.float64]),
        }
    )


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Packed blocks, and how many each dimension has."""
    per = rows.groupBy("dim").agg(F.ceil(F.count("*") / size).alias("n"))
    dealt = rows.join(F.broadcast(per), "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")))
    return dealt.groupBy("dim", "block").applyInArrow(_pack, "dim int, block long, ids binary, mat binary, wide boolean"), per


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, norm of the residual, of the vector and of what the codes stand for."""
    scale = np.abs(x).max(1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    norm = lambda m: np.sqrt((m * m).sum(1))
    return codes, scale, norm(x - near), norm(x), norm(near)


def tile(q_ids, q, c_ids, c, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, vector id and exact score of each query's k nearest in the tile that reach its least score."""
    cq, cs, ce, cn, _ = quantise(c)
    qq, qs, qe, _, qh = quantise(q)
    # Products of codes are whole numbers; single precision holds them up to 2**24.
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = cq.astype(kind).T
    out = [[], [], []]
    for s in range(0, len(q), STRIP):
        e = min(len(q), s + STRIP)
        dots = (qq[s:e].astype(kind) @ right).astype(np.float64)
        dots *= qs[s:e, None] * cs[None, :]
        err = (qe[s:e, None] * cn[None, :] + qh[s:e, None] * ce[None, :]) * (1 + 1e-9) + 1e-12
        own = q_ids[s:e, None] == c_ids[None, :]
        low = np.where(own, -np.inf, dots - err)
        high = np.where(own, -np.inf, dots + err)
        if low.shape[1] > k:
            bound = -np.partition(-low, k - 1, axis=1)[:, k - 1]
        else:
            bound = np.full(e - s, -np.inf)
        if least is not None:
            bound = np.maximum(bound, least[s:e])
        rows, cols = np.nonzero((high >= bound[:, None]) & ~own)
        exact = np.einsum("ij,ij->i", q[s + rows], c[cols])
        order = np.lexsort((c_ids[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, np.arange(e - s))
        keep = np.arange(len(rows)) - first[rows] < k
        out[0].append(s + rows[keep])
        out[1].append(c_ids[cols[keep]])
        out[2].append(exact[keep])
    return tuple(np.concatenate(x) for x in out)


class Heaps:
    """The k best of each query of a block: (score, -id), the worst on top."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]

    def least(self) -> np.ndarray:
        return np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.best])

    def add(self, places: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        for q, i, s in zip(places.tolist(), ids.tolist(), scores.tolist(), strict=True):
            h = self.best[q]
            if len(h) < self.k:
                heapq.heappush(h, (s, -i))
            elif (s, -i) > h[0]:
                heapq.heapreplace(h, (s, -i))

    def rows(self) -> pa.RecordBatch:
        n = [len(h) for h in self.best]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, n)), pa.array([-i for h in self.best for _, i in h], pa.int64()), pa.array([s for h in self.best for s, _ in h], pa.float64())],
            names=["query_id", "vec_id", "score"],
        )


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, heaps = None, None
        for b in batches:
            for r in range(b.num_rows):
                get = lambda n: b.column(n)[r]  # noqa: B023, E731
                q_ids, c_ids = (np.frombuffer(get(n).as_buffer(), "<i8") for n in ("q_ids", "c_ids"))
                q, c = (
                    np.frombuffer(get(m).as_buffer(), "<f8" if get(w).as_py() else "<f4").reshape(len(i), -1).astype(np.float64)
                    for m, w, i in (("q_mat", "q_wide", q_ids), ("c_mat", "c_wide", c_ids))
                )
                # Tiles of a query block are sorted side by side.
                if heaps is None or block != (get("dim").as_py(), get("qb").as_py()):
                    if heaps is not None:
                        yield heaps.rows()
                    block, heaps = (get("dim").as_py(), get("qb").as_py()), Heaps(q_ids.copy(), k)
                heaps.add(*tile(q_ids, q, c_ids, c, k, heaps.least()))
        if heaps is not None:
            yield heaps.rows()

    return run


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is over the column ``id``."""
    spark = vectors.sparkSession
    small_batches(spark)
    good = usable(vectors, id_col, vec_col)
    cand, n_cand = _blocks(good, candidate_block)
    query, n_query = _blocks(good.filter(is_query), query_block)
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = query.join(F.broadcast(n_cand), "dim").select("dim", F.col("block").alias("qb"), to("n").alias("cb"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "mat", "wide")])
    right = cand.join(F.broadcast(n_query), "dim").select("dim", F.col("block").alias("cb"), to("n").alias("qb"), *[F.col(c).alias(f"c_{c}") for c in ("ids", "mat", "wide")])
    pairs = left.join(right, ["dim", "qb", "cb"]).sortWithinPartitions("dim", "qb").mapInArrow(_tiles(k), "query_id long, vec_id long, score double")
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, F.col("id") % 20 == 0)
