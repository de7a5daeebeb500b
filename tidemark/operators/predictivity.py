"""How well one feature alone tells the target: cross-validated scores and mutual information.

With one standardised feature, a logistic fit has the sign of the covariance of
its training folds, and the area under the curve does not change under monotone
maps. So the score of a fold is the Mann-Whitney area of the feature there, or
one minus it. All features are one melted table, scored in one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship

#: Ranks are summed within this many ranges of a feature's values, then over the ranges.
RANGES = 64


def class_folds(target: str, folds: int, key: str = "_pos") -> Column:
    """Stratified: each class is dealt in hashed order."""
    w = Window.partitionBy(target).orderBy(F.xxhash64(key), key)
    return F.pmod(F.row_number().over(w) - 1, F.lit(folds))


def _dealt(text: Column, folds: int) -> Column:
    return (F.conv(F.substring(F.md5(text.cast("string")), 1, 8), 16, 10).cast("long") % folds).cast("int")


def group_folds(group: str, folds: int) -> Column:
    return _dealt(F.coalesce(F.col(group).cast("string"), F.lit("")), folds)


def plain_folds(key: str, folds: int) -> Column:
    return _dealt(F.col(key), folds)


def time_folds(df: DataFrame, time: str, folds: int) -> DataFrame:
    """Adds ``block`` 0..folds by time: block k >= 1 is tested on all earlier ones.

    Rows are ranked within ``RANGES`` ranges of time, then across them, so no task sorts the table. Rows
    of one time are ranked by position in one task.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(at, F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), 10_000).alias("c")).first()["c"] or []
    ranged = df.withColumn("_range", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>"), lambda c: c < at)))
    w = Window.orderBy("_range")  # RANGES rows
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_range", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(time, "_pos")) - 1 + F.col("_before")
    size = F.floor(F.col("_all") / (folds + 1))
    # The first block takes what does not divide.
    block = F.greatest(F.lit(0), F.floor((rank - (F.col("_all") - size * folds)) / F.greatest(F.lit(1), size)) + 1).cast("int")
    return ranged.join(F.broadcast(sizes), "_range").withColumn("block", block).drop("_range", "_before", "_all")


def melt(df: DataFrame, features: list[str], target: Column, fold: Column) -> DataFrame:
    """feature, fold, x, y of all numeric features; rows without a target are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in features])
    base = df.select(fold.alias("fold"), target.cast("double").alias("y"), F.explode(pairs).alias("p")).filter("y is not null")
    x = F.when(F.isnan("p.x") | (F.abs("p.x") == float("inf")), F.lit(None)).otherwise(F.col("p.x"))
    return base.select("p.feature", "fold", x.alias("x"), "y")


def impute(m: DataFrame) -> DataFrame:
    """Missing values as the median of the feature (to one in 100,000 of its rows)."""
    med = m.groupBy("feature").agg(F.percentile_approx("x", 0.5, 100_000).alias("_med"))
    return m.join(F.broadcast(med), "feature").withColumn("x", F.coalesce("x", "_med")).drop("_med").filter("x is not null")


def fold_medians(m: DataFrame, ordered: bool) -> DataFrame:
    """feature, fold, med: of features with missing values the median of the rows a fold is not tested on."""
    folds = [r["fold"] for r in m.select("fold").distinct().orderBy("fold").limit(1000).collect()]
    some = m.filter("x is null").select("feature").distinct()
    known = m.filter("x is not null").join(F.broadcast(some), "feature", "left_semi").select("feature", F.col("fold").alias("_own"), "x")
    each = known.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in folds]).cast("array<int>")))
    each = each.filter(F.col("_own") < F.col("fold") if ordered else F.col("_own") != F.col("fold"))
    return each.groupBy("feature", "fold").agg(F.percentile_approx("x", 0.5, 100_000).alias("med"))


def _learnt(s: DataFrame, by: list[str], columns: tuple[str, ...], ordered: bool) -> DataFrame:
    """Adds r_<column>: the sum over the folds that this one is not tested on; with ordered folds the earlier ones."""
    if ordered:
        w = Window.partitionBy(*by).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
        return s.withColumns({f"r_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in columns})
    w = Window.partitionBy(*by)
    return s.withColumns({f"r_{c}": F.sum(c).over(w) - F.col(c) for c in columns})


def _sums(m: DataFrame, med: DataFrame, ordered: bool) -> DataFrame:
    """Sums of a feature's folds and of what they are tested on, missing values as its median there."""
    x, y, none = F.col("x"), F.col("y"), F.col("x").isNull()
    total = {"n": F.count("*"), "sy": F.sum("y"), "syy": F.sum(y * y), "sx": F.coalesce(F.sum("x"), F.lit(0.0)), "sxy": F.coalesce(F.sum(x * y), F.lit(0.0)), "sxx": F.coalesce(F.sum(x * x), F.lit(0.0))}
    total |= {"k": F.count_if(none), "ky": F.coalesce(F.sum(F.when(none, y)), F.lit(0.0))}
    s = m.groupBy("feature", "fold").agg(*[e.alias(c) for c, e in total.items()])
    s = _learnt(s, ["feature"], tuple(total), ordered).join(F.broadcast(med), ["feature", "fold"], "left")
    fill = F.coalesce("med", F.lit(0.0))
    put = {}
    for r in ("", "r_"):
        put |= {f"{r}sx": F.col(f"{r}sx") + F.col(f"{r}k") * fill, f"{r}sxy": F.col(f"{r}sxy") + F.col(f"{r}ky") * fill, f"{r}sxx": F.col(f"{r}sxx") + F.col(f"{r}k") * fill * fill}
    return s.withColumns(put).filter("r_n > 0")


def fold_auc(m: DataFrame, ordered: bool = False) -> DataFrame:
    """feature, fold, auc: for a target of 0 and 1. Missing values are the median of what a fold is not tested on."""
    med = fold_medians(m, ordered)
    s = _sums(m, med, ordered)
    cov = s.select("feature", "fold", F.signum(F.round(F.col("r_sxy") - F.col("r_sx") * F.col("r_sy") / F.greatest(F.col("r_n"), F.lit(1)), 9)).alias("sign"))
    m = m.join(F.broadcast(med), ["feature", "fold"], "left").withColumn("x", F.coalesce("x", "med")).drop("med").filter("x is not null")
    v = m.groupBy("feature", "fold", "x").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    cuts = m.groupBy("feature").agg(F.percentile_approx("x", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), 1000).alias("cuts"))
    v = v.join(F.broadcast(cuts), "feature").withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    tot = v.groupBy("feature", "fold", "range").agg(F.sum("neg").alias("rneg"))
    before = Window.partitionBy("feature", "fold").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select("feature", "fold", "range", F.coalesce(F.sum("rneg").over(before), F.lit(0.0)).alias("below"))
    inner = Window.partitionBy("feature", "fold", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = v.withColumn("less", F.coalesce(F.sum("neg").over(inner), F.lit(0.0))).join(tot, ["feature", "fold", "range"])
    u = ranked.groupBy("feature", "fold").agg(F.sum(F.col("pos") * (F.col("below") + F.col("less") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    area = F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q")))
    return u.join(cov, ["feature", "fold"]).select("feature", "fold", F.when(F.col("sign") == 0, F.when(area.isNotNull(), F.lit(0.5))).when(F.col("sign") > 0, area).otherwise(1 - area).alias("auc"))


def fold_r2(m: DataFrame, ordered: bool = False) -> DataFrame:
    """feature, fold, r2: a line fitted on the other folds (the earlier ones, if ordered). Missing values as in fold_auc."""
    s = _sums(m, fold_medians(m, ordered), ordered)
    r = {c: F.col(f"r_{c}") for c in ("n", "sx", "sy", "sxy", "sxx")}
    var = r["sxx"] - r["sx"] * r["sx"] / r["n"]
    slope = F.when(F.abs(var) < 1e-12, F.lit(0.0)).otherwise((r["sxy"] - r["sx"] * r["sy"] / r["n"]) / var)
    f = s.withColumn("b", slope).withColumn("a", (r["sy"] - F.col("b") * r["sx"]) / r["n"])
    sse = F.col("syy") - 2 * F.col("a") * F.col("sy") - 2 * F.col("b") * F.col("sxy") + F.col("n") * F.col("a") * F.col("a") + 2 * F.col("a") * F.col("b") * F.col("sx") + F.col("b") * F.col("b") * F.col("sxx")
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return f.select("feature", "fold", F.when(sst > 1e-12, 1 - sse / sst).alias("r2"))


def ranged(df: DataFrame, features: list[str], ranges: int = RANGES) -> DataFrame:
    """df with numeric features as the number of their range, of about as many rows each; missing values as -1."""
    if not features:
        return df
    marks = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    num = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in features}
    cuts = df.agg(*[F.percentile_approx(x, marks, 10_000).alias(f"c{k}") for k, x in enumerate(num.values())]).first()
    place = lambda x, c: F.when(x.isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(float(v)) for v in sorted(set(c or []))]).cast("array<double>"), lambda v: v < x)))
    return df.withColumns({c: place(x, cuts[k]) for k, (c, x) in enumerate(num.items())})


def _told(df: DataFrame, feature: str, target: Column, fold: Column) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{feature}`").cast("string"), F.lit("")).alias("x"), target.alias("y"), fold.cast("int").alias("fold")).filter("y is not null")


def fold_accuracy(df: DataFrame, feature: str, target: str, fold: Column, ordered: bool = False) -> DataFrame:
    """feature, fold, accuracy of a categorical feature: the class that is most frequent with the value in
    the other folds, or the earlier ones (with ties and new values: the most frequent class)."""
    n = _told(df, feature, F.col(f"`{target}`").cast("string"), fold).groupBy("x", "y", "fold").agg(F.count("*").alias("n"))
    folds = F.broadcast(n.select("fold").distinct())
    every = n.select("x", "y").distinct().join(folds).join(n, ["x", "y", "fold"], "left").fillna(0, ["n"])
    every = _learnt(every, ["x", "y"], ("n",), ordered).withColumn("rest", F.col("r_n"))
    base = every.groupBy("fold", "y").agg(F.sum("rest").alias("r")).filter("r > 0").groupBy("fold").agg(F.max_by("y", F.struct("r", "y")).alias("common"))
    best = every.filter("rest > 0").groupBy("fold", "x").agg(F.max_by("y", F.struct("rest", "y")).alias("guess"))
    told = n.join(best, ["fold", "x"], "left").join(F.broadcast(base), "fold")
    right = F.sum(F.when(F.coalesce("guess", "common") == F.col("y"), F.col("n")).otherwise(0))
    return told.groupBy("fold").agg((right / F.sum("n")).alias("accuracy")).select(F.lit(feature).alias("feature"), "fold", "accuracy")


def fold_mean_r2(df: DataFrame, feature: str, target: str, fold: Column, ordered: bool = False) -> DataFrame:
    """feature, fold, r2 of a categorical feature for a number: the mean of its value in the other folds, or the
    earlier ones (of new values: the mean of all)."""
    n = _told(df, feature, F.col(f"`{target}`").cast("double"), fold).groupBy("x", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    folds = F.broadcast(n.select("fold").distinct())
    every = n.select("x").distinct().join(folds).join(n, ["x", "fold"], "left").fillna(0, ["n", "sy", "syy"])
    every = _learnt(every, ["x"], ("n", "sy"), ordered)
    base = every.groupBy("fold").agg(F.sum("r_sy").alias("bs"), F.sum("r_n").alias("bn")).filter("bn > 0").select("fold", (F.col("bs") / F.col("bn")).alias("common"))
    told = every.filter("n > 0").join(F.broadcast(base), "fold").withColumn("g", F.when(F.col("r_n") > 0, F.col("r_sy") / F.col("r_n")).otherwise(F.col("common")))
    s = told.groupBy("fold").agg(F.sum("syy").alias("syy"), F.sum("sy").alias("sy"), F.sum("n").alias("n"), F.sum(F.col("syy") - 2 * F.col("g") * F.col("sy") + F.col("n") * F.col("g") * F.col("g")).alias("sse"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return s.select(F.lit(feature).alias("feature"), "fold", F.when(sst > 1e-12, 1 - F.col("sse") / sst).alias("r2"))


def summarise(scores: DataFrame, name: str) -> DataFrame:
    """feature, score, spread, error, folds."""
    return scores.filter(F.col(name).isNotNull()).groupBy("feature").agg(
        F.avg(name).alias("score"),
        F.stddev_pop(name).alias("spread"),
        (F.stddev_pop(name) / F.sqrt(F.count("*"))).alias("error"),
        F.count("*").cast("long").alias("folds"),
    )


def mutual_information(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, mi in nats of discrete features and a discrete target; missing values are a value."""
    t = F.coalesce(F.col(f"`{target}`").cast("string"), F.lit("\x00"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")).alias("x")) for c in features])
    n = df.select(t.alias("y"), F.explode(pairs).alias("p")).groupBy("p.feature", "p.x", "y").agg(F.count("*").alias("n"))
    nx = n.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    ny = n.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    nn = n.groupBy("feature").agg(F.sum("n").alias("nn"))
    j = n.join(nx, ["feature", "x"]).join(ny, ["feature", "y"]).join(F.broadcast(nn), "feature")
    term = F.col("n") / F.col("nn") * F.ln(F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny")))
    return j.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(term)).alias("mi"))


def _digamma(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    out = np.zeros_like(x)
    small = x < 6
    while small.any():
        out[small] -= 1 / x[small]
        x = np.where(small, x + 1, x)
        small = x < 6
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def knn_mi(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Ross's estimate for a continuous feature and a class."""
    x = x + np.random.default_rng(0).normal(0, 1e-10, len(x)) * max(1.0, np.abs(x).mean() if len(x) else 1.0)
    radius, kk, size = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        if len(at) < 2:
            continue
        near = min(k, len(at) - 1)
        order = at[np.argsort(x[at])]
        v = x[order]
        best = np.full(len(v), np.inf)
        for s in range(near + 1):  # windows of near + 1 neighbours around each value
            lo = np.arange(len(v)) - s
            ok = (lo >= 0) & (lo + near < len(v))
            d = np.maximum(v[ok] - v[lo[ok]], v[lo[ok] + near] - v[ok])
            best[ok] = np.minimum(best[ok], d)
        radius[order] = np.nextafter(best, 0)
        kk[order], size[order] = near, len(at)
    use = size > 0
    if not use.any():
        return 0.0
    x, radius, kk, size = x[use], radius[use], kk[use], size[use]
    s = np.sort(x)
    m = np.searchsorted(s, x + radius, "right") - np.searchsorted(s, x - radius, "left")
    return float(max(0.0, _digamma(np.array([len(x)]))[0] + _digamma(kk).mean() - _digamma(size).mean() - _digamma(np.maximum(m, 1)).mean()))


#: Rows of a feature, in the order of their values, that one task holds; and the numbers of the noise drawn at once.
HELD, DRAWN = 500_000, 250_000


def _draws(n: int) -> list[dict]:
    """The state of knn_mi's generator before each ``DRAWN`` numbers, so that any task can go on from there."""
    rng, out = np.random.default_rng(0), []
    for _ in range(-(-n // DRAWN)):
        out.append(rng.bit_generator.state)
        rng.normal(0, 1e-10, DRAWN)
    return out


def _spread(batches: Iterator[pa.RecordBatch], told: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """feature, values with the noise of their rank, classes, in bounded parts. Rows stand for runs of equal
    ones from rank ``start`` on; classes of a single row have a rank and are left out."""
    drawn, at, noise = told["drawn"], -1, None
    for b in batches:
        f, x, y, n, start = (b.column(c).to_numpy() for c in ("f", "x", "y", "n", "start"))
        part = (np.cumsum(n) - n) // drawn  # parts of one feature, of ranks without a gap and of few rows, unless one run is longer
        cut = [0, *(np.flatnonzero((np.diff(f) != 0) | (np.diff(part) != 0) | (start[1:] != (start + n)[:-1])) + 1), len(f)]
        for u, v in zip(cut, cut[1:], strict=False) if len(f) else ():
            first, last = int(start[u]), int(start[v - 1] + n[v - 1])
            ends = start[u:v] + n[u:v]
            for c in range(first // drawn, (last - 1) // drawn + 1):
                if c != at:
                    rng = np.random.default_rng(0)
                    rng.bit_generator.state = told["states"][c]
                    at, noise = c, rng.normal(0, 1e-10, drawn)
                lo = np.maximum(start[u:v], c * drawn)
                some = np.maximum(np.minimum(ends, (c + 1) * drawn) - lo, 0)
                rank = np.repeat(lo - c * drawn - (np.cumsum(some) - some), some) + np.arange(some.sum())
                code = np.repeat(y[u:v], some)
                value = np.repeat(x[u:v], some) + noise[rank] * told["scale"][f[u]]
                use = told["near"][f[u]][code] > 0
                yield int(f[u]), value[use], code[use]


def _marks(told: dict):
    """Some values in order, as many as tell where to cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, x, _ in _spread(batches, told):
            if f in told["many"] and len(x):
                few = 1 + len(x) * 64 // told["held"]
                few = np.sort(x)[((np.arange(few) + 0.5) * len(x) / few).astype(int)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(few), f), pa.int32()), pa.array(few), pa.array(np.full(len(few), len(x) / len(few)))], names=["f", "x", "w"])

    return run


def _cells(told: dict):
    """Values and classes, packed, by feature and range of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, x, y in _spread(batches, told):
            cell = np.searchsorted(told["cuts"][f], x, "right")
            order = np.argsort(cell, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(x) else ():
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([int(cell[at[0]])], pa.int32()), pa.array([x[at].tobytes()]), pa.array([y[at].astype("<i4").tobytes()])], names=["f", "cell", "x", "y"])

    return run


def _nearest(v: np.ndarray, near: int) -> np.ndarray:
    """The distance of each of the sorted values to its near-th neighbour, by windows of near + 1."""
    best = np.full(len(v), np.inf)
    for s in range(near + 1):
        lo = np.arange(len(v)) - s
        ok = (lo >= 0) & (lo + near < len(v))
        best[ok] = np.minimum(best[ok], np.maximum(v[ok] - v[lo[ok]], v[lo[ok] + near] - v[ok]))
    return best


def _cell_sums(told: dict):
    """A row of the sum of digammas of the rows that the cell decides; of each class those that it does not
    (open), and the values that their distances need: up to near beside them, and the cell's first and last."""

    def run(t: pa.Table) -> pa.Table:
        f, cell, cuts = t["f"][0].as_py(), t["cell"][0].as_py(), told["cuts"][t["f"][0].as_py()]
        x = np.frombuffer(b"".join(t["x"].to_pylist()), "<f8")
        y = np.frombuffer(b"".join(t["y"].to_pylist()), "<i4")
        lo, hi = cuts[cell - 1] if cell else -np.inf, cuts[cell] if cell < len(cuts) else np.inf
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        total, out = 0.0, []
        by_class = np.argsort(y, kind="stable")
        for at in np.split(by_class, np.flatnonzero(np.diff(y[by_class])) + 1):
            v, near = x[at], int(told["near"][f][y[at[0]]])
            best = _nearest(v, near)
            done = np.isfinite(best) & (v - best >= lo) & (v + best < hi)
            radius = np.nextafter(best[done], 0)
            m = np.searchsorted(x, v[done] + radius, "right") - np.searchsorted(x, v[done] - radius, "left")
            total += float(_digamma(np.maximum(m, 1)).sum())
            keep = np.zeros(len(v) + 1, int)
            for k in np.flatnonzero(~done):
                keep[max(0, k - near)] += 1
                keep[min(len(v), k + near + 1)] -= 1
            keep = np.cumsum(keep[:-1]) > 0
            if len(cuts):
                keep[:near] = keep[max(0, len(v) - near) :] = True
            out.append((np.full(keep.sum(), y[at[0]]), v[keep], ~done[keep]))
        ys, vs, opens = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({
            "f": pa.array(np.full(len(ys) + 1, f), pa.int32()),
            "y": pa.array(np.r_[-1, ys], pa.int32()),
            "v": pa.array(np.r_[total, vs]),
            "open": pa.array(np.r_[False, opens]),
        })

    return run


def _below(told: dict):
    """How many values of a feature come first at the k-th of its bounds: lo bounds are above them, hi ones not below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {f: [np.zeros(len(q) + 1, np.int64) for q in qs] for f, qs in told["bounds"].items()}
        for f, x, _ in _spread(batches, told):
            if f in sums:
                for total, q, side in zip(sums[f], told["bounds"][f], ("right", "left"), strict=True):
                    total += np.bincount(np.searchsorted(q, x, side), minlength=len(total))
        for f, totals in sums.items():
            for hi, total in enumerate(totals):
                k = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), f), pa.int32()), pa.array(np.full(len(k), hi), pa.int32()), pa.array(k, pa.int32()), pa.array(total[k])], names=["f", "hi", "k", "n"])

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: the partition, and how many rows of the feature are before this one in it."""
    seen: dict[int, int] = {}
    pid = TaskContext.get().partitionId()
    for b in batches:
        f, n = b.column("f").to_numpy(), b.column("n").to_numpy()
        start = np.zeros(len(n), np.int64)
        for k in np.unique(f):
            at = np.flatnonzero(f == k)
            start[at] = seen.get(int(k), 0) + np.cumsum(n[at]) - n[at]
            seen[int(k)] = seen.get(int(k), 0) + int(n[at].sum())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start), pa.array(np.full(len(n), pid), pa.int32())], names=["f", "x", "y", "n", "start", "pid"])


def continuous_mi(df: DataFrame, features: list[str], target: str, put=None) -> DataFrame:
    """feature, mi of continuous features and a class, over all rows: knn_mi of each feature's rows in their order.

    No task holds a feature. Equal values of a class are one row with a rank; noise is drawn where ranks are
    spread to values. A task has one range of values (``HELD`` rows, about); rows whose neighbours may be
    beyond it, few a class and range, are settled on the driver, and what they count in one more pass.
    """
    if put is None:
        from ..plans.queries import writer

        put = writer(df.sparkSession)
    spark = df.sparkSession
    ship(spark)
    classes = df.select(F.col(target).alias("_t")).distinct().withColumn("_class", F.dense_rank().over(Window.orderBy("_t")) - 1)
    m = melt(df.join(classes, F.col(target).eqNullSafe(F.col("_t"))), features, F.col("_class"), F.lit(0))
    code = F.array_position(F.array(*[F.lit(c) for c in features]), F.col("feature")).cast("int") - 1
    runs = impute(m).groupBy(code.alias("f"), "x", F.col("y").cast("int").alias("y")).agg(F.count("*").alias("n"))
    runs = put("runs", runs.repartitionByRange("f", "x", "y").sortWithinPartitions("f", "x", "y").mapInArrow(_ranked, "f int, x double, y int, n long, start long, pid int"))
    told: dict = {"drawn": DRAWN, "held": HELD, "scale": {}, "near": {}, "cuts": {}, "many": set()}
    rows, size, used = {}, {}, {}
    for r in runs.groupBy("f").agg(F.sum("n").alias("n"), (F.sum(F.abs("x") * F.col("n")) / F.sum("n")).alias("mean")).collect():
        rows[r["f"]], told["scale"][r["f"]] = r["n"], max(1.0, r["mean"])
    for r in runs.groupBy("f", "y").agg(F.sum("n").alias("n")).collect():  # a row a feature and class
        size.setdefault(r["f"], {})[r["y"]] = r["n"]
    for f, of in size.items():
        told["near"][f] = np.array([max(0, min(3, of.get(c, 0) - 1)) for c in range(max(of) + 1)])
        used[f] = sum(n for n in of.values() if n > 1)
        told["cuts"][f] = np.zeros(0)
        if used[f] > HELD:
            told["many"].add(f)
    told["states"] = _draws(max(rows.values(), default=0))
    before, offset = {}, []
    for r in sorted(runs.groupBy("pid", "f").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r["f"], r["pid"])):  # a row a partition and feature
        offset.append((r["pid"], r["f"], before.get(r["f"], 0)))
        before[r["f"]] = before.get(r["f"], 0) + r["n"]
    at = spark.createDataFrame(offset, "pid int, f int, off long")
    runs = runs.join(F.broadcast(at), ["pid", "f"]).select("f", "x", "y", "n", (F.col("start") + F.col("off")).alias("start"))
    if told["many"]:
        marks = runs.mapInArrow(_marks(told), "f int, x double, w double").toArrow()
        mf, mx, mw = (marks[c].to_numpy() for c in ("f", "x", "w"))
        for f in told["many"]:
            x, w = mx[mf == f], mw[mf == f]
            order = np.argsort(x)
            share = np.cumsum(w[order])
            parts = -(-used[f] // HELD)
            told["cuts"][f] = np.unique(x[order][np.searchsorted(share, share[-1] * np.arange(1, parts) / parts)])
    cells = runs.mapInArrow(_cells(told), "f int, cell int, x binary, y binary").groupBy("f", "cell")
    sums = put("cells", cells.applyInArrow(_cell_sums(told), "f int, y int, v double, open boolean")).toArrow()
    sf, sy, sv, so = (sums[c].to_numpy() for c in ("f", "y", "v", "open"))
    total = {f: float(sv[(sf == f) & (sy < 0)].sum()) for f in size}
    bounds: dict = {}
    for f in size:
        at = np.flatnonzero((sf == f) & (sy >= 0))
        at = at[np.lexsort((sv[at], sy[at]))]
        lo, hi = [], []
        for c in np.split(at, np.flatnonzero(np.diff(sy[at])) + 1) if so[at].any() else ():
            v, u = sv[c], so[c]
            if u.any():
                radius = np.nextafter(_nearest(v, int(told["near"][f][sy[c[0]]])), 0)
                lo.append(v[u] - radius[u])
                hi.append(v[u] + radius[u])
        if lo:
            bounds[f] = np.concatenate(lo), np.concatenate(hi)
    if bounds:
        counts = runs.mapInArrow(_below(told | {"bounds": {f: [np.sort(q) for q in qs] for f, qs in bounds.items()}}), "f int, hi int, k int, n long")
        counts = counts.groupBy("f", "hi", "k").agg(F.sum("n").alias("n")).toArrow()
        cf, ch, ck, cn = (counts[c].to_numpy() for c in ("f", "hi", "k", "n"))
        for f, qs in bounds.items():
            below = []
            for hi, q in enumerate(qs):
                here, n = (cf == f) & (ch == hi), np.zeros(len(q) + 1, np.int64)
                n[ck[here]] = cn[here]
                below.append(np.cumsum(n)[np.searchsorted(np.sort(q), q, "left")])
            total[f] += float(_digamma(np.maximum(below[1] - below[0], 1)).sum())
    out = []
    for f, of in size.items():
        n = used[f]
        many = [(min(3, c - 1), c) for c in of.values() if c > 1]
        k, s, c = (np.array(v, float) for v in (zip(*[(k, c, c) for k, c in many], strict=True) if many else ([], [], [])))
        mi = float(_digamma(np.array([n]))[0] + ((_digamma(k) - _digamma(s)) * c).sum() / n - total[f] / n) if n else 0.0
        out.append((features[f], max(0.0, mi)))
    return spark.createDataFrame(out, "feature string, mi double")


def dominance(mi: DataFrame, floor: float = 0.2, ratio: float = 1.5) -> DataFrame:
    """Adds median, best_other and fires. A feature a row; nothing fires below three features."""
    s = mi.agg(F.percentile(F.col("mi"), F.lit(0.5)).alias("median_mi"), F.count("*").alias("_n"), F.slice(F.sort_array(F.collect_list("mi"), asc=False), 1, 2).alias("_top"))
    j = mi.join(F.broadcast(s))
    other = F.when(F.col("mi") == F.element_at("_top", 1), F.coalesce(F.get("_top", F.lit(1)), F.lit(0.0))).otherwise(F.element_at("_top", 1))
    fires = (F.col("_n") >= 3) & (F.col("mi") >= F.greatest(F.lit(floor), ratio * F.col("median_mi"))) & ((F.col("best_other") == 0) | (F.col("mi") > ratio * F.col("best_other")))
    return j.withColumn("best_other", other).withColumn("fires", fires).drop("_n", "_top")
