"""The query catalogue over the driver's tables, with the DuckDB statement of each where SQL can say it.

Splits are by a key modulo five (test: 4), so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import overlap, predictivity, similarity, statistics
from ..runtime import lineage
from ..runtime import rules as runtime
from ..static import extract
from ..static import rules as static_rules
from ..static.examples import EXAMPLES
from . import findings

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def halves(df: DataFrame, key: str, pos: str | None = None) -> tuple[DataFrame, DataFrame]:
    df = df.withColumn("_pos", F.col(pos or key).cast("long"))
    return df.filter(F.col(key) % 5 < 4), df.filter(F.col(key) % 5 == 4)


_OVERLAP = """
WITH l AS (SELECT {key} AS k, min({pos}) AS p, arg_min({target}, {pos}) AS t FROM {left} GROUP BY ALL),
r AS (SELECT {key} AS k, {pos} AS p, {target} AS t FROM {right}),
m AS (SELECT r.k, l.p AS lp, r.p AS rp, l.t IS DISTINCT FROM r.t AS c FROM r JOIN l ON r.k = l.k)
SELECT count(*)::BIGINT AS overlap_rows, count(DISTINCT k)::BIGINT AS identities,
  coalesce(sum(c::INT), 0)::BIGINT AS conflict_rows, (SELECT count(*) FROM r)::BIGINT AS right_rows,
  round(count(*) / greatest(1, (SELECT count(*) FROM r)), 9) AS fraction FROM m"""


def overlap_row(left: DataFrame, right: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    return overlap.exact_overlap(left, right, columns, target).select("overlap_rows", "identities", "conflict_rows", "right_rows", F.round("fraction", 9).alias("fraction"))


@query(_OVERLAP.format(key="text", pos="doc_id", target="NULL", left="documents WHERE doc_id % 5 < 4", right="documents WHERE doc_id % 5 = 4"))
def d001_docs_overlap(spark, d):
    return overlap_row(*halves(read(spark, d, "documents", "doc_id", "text"), "doc_id"), ["text"])


@query(_OVERLAP.format(key="text", pos="doc_id", target="quality", left="(SELECT * FROM documents JOIN labels USING (doc_id)) WHERE doc_id % 5 < 4", right="(SELECT * FROM documents JOIN labels USING (doc_id)) WHERE doc_id % 5 = 4"))
def d001_conflicts(spark, d):
    rows = read(spark, d, "documents", "doc_id", "text").join(read(spark, d, "labels", "doc_id", "quality"), "doc_id")
    return overlap_row(*halves(rows, "doc_id"), ["text"], "quality")


_LINE = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(_OVERLAP.format(key=f"row({', '.join(_LINE)})", pos="l_orderkey * 10 + l_linenumber", target="NULL", left="lineitem WHERE l_orderkey % 5 < 4", right="lineitem WHERE l_orderkey % 5 = 4"))
def d001_lineitem_cols(spark, d):
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", *_LINE).withColumn("_p", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return overlap_row(*halves(rows, "l_orderkey", "_p"), _LINE)


@query("""
WITH l AS (SELECT text, min(doc_id) AS l_pos FROM documents WHERE doc_id % 5 < 4 GROUP BY text)
SELECT doc_id AS r_pos, l_pos FROM documents JOIN l USING (text) WHERE doc_id % 5 = 4""")
def d001_pairs_first(spark, d):
    return overlap.first_match(*halves(read(spark, d, "documents", "doc_id", "text"), "doc_id"), ["text"]).select("r_pos", "l_pos")


@query("SELECT * FROM (VALUES (11, 1), (12, 2), (14, 4)) t(r_pos, l_pos)")
def d001_special_values(spark, d):
    nan = float("nan")
    left = spark.createDataFrame([(1, None, "a"), (2, 0.0, "b"), (3, 1.0, "c"), (4, nan, None)], "_pos long, x double, s string")
    right = spark.createDataFrame([(11, nan, "a"), (12, -0.0, "b"), (13, 2.0, "c"), (14, None, None)], "_pos long, x double, s string")
    return overlap.first_match(left, right, ["x", "s"]).select(F.col("r_pos").cast("int"), F.col("l_pos").cast("int"))


@query("""
WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_id % 5 < 4 INTERSECT SELECT DISTINCT user_id FROM events WHERE event_id % 5 = 4)
SELECT count(*)::BIGINT AS groups, array_to_string((SELECT list(x ORDER BY x) FROM (SELECT user_id::VARCHAR AS x FROM c ORDER BY 1 LIMIT 10)), ',') AS examples FROM c""")
def d003_user_overlap(spark, d):
    return overlap.group_overlap(*halves(read(spark, d, "events", "event_id", "user_id"), "event_id"), "user_id").withColumn("examples", F.array_join("examples", ","))


@query("""
WITH c AS (SELECT DISTINCT conv_id FROM conversations WHERE turn % 5 < 4 INTERSECT SELECT DISTINCT conv_id FROM conversations WHERE turn % 5 = 4)
SELECT count(*)::BIGINT AS groups FROM c""")
def d003_conversations(spark, d):
    return overlap.group_overlap(*halves(read(spark, d, "conversations", "turn", "conv_id"), "turn"), "conv_id").select("groups")


@query("""
SELECT (count(*) - count(DISTINCT text))::BIGINT AS duplicate_rows, count(*)::BIGINT AS rows, round((count(*) - count(DISTINCT text)) / count(*), 9) AS fraction
FROM documents WHERE doc_id % 5 = 4""")
def d007_docs_dups(spark, d):
    return overlap.duplicate_rows(halves(read(spark, d, "documents", "doc_id", "text"), "doc_id")[1], ["text"]).withColumn("fraction", F.round("fraction", 9))


@query(f"""
WITH n AS (SELECT count(*) AS n FROM lineitem WHERE l_orderkey % 5 = 4 GROUP BY {', '.join(_LINE)})
SELECT sum(n - 1)::BIGINT AS duplicate_rows, sum(n)::BIGINT AS rows, round(sum(n - 1) / sum(n), 9) AS fraction FROM n""")
def d007_by_columns(spark, d):
    return overlap.duplicate_rows(halves(read(spark, d, "lineitem", "l_orderkey", *_LINE), "l_orderkey")[1], _LINE).withColumn("fraction", F.round("fraction", 9))


_TIMES = """
WITH s AS ({parts}), w AS (SELECT *, lag(split) OVER (ORDER BY o) AS before, lag(hi) OVER (ORDER BY o) AS before_last FROM s)
SELECT before, split, epoch_us(before_last) AS before_last, epoch_us(lo) AS split_first, before_last >= lo AS overlaps FROM w WHERE before IS NOT NULL"""


def times(parts: list[tuple[str, DataFrame]], column: str) -> DataFrame:
    t = statistics.temporal_overlap(statistics.time_ranges(parts, column))
    return t.withColumns({"before_last": F.unix_micros("before_last"), "split_first": F.unix_micros("split_first")})


@query(_TIMES.format(parts="""SELECT 'train' AS split, 0 AS o, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders WHERE o_orderkey % 5 < 4
UNION ALL SELECT 'test', 1, min(o_orderdate), max(o_orderdate) FROM orders WHERE o_orderkey % 5 = 4"""))
def tm001_orders(spark, d):
    a, b = halves(read(spark, d, "orders", "o_orderkey", "o_orderdate"), "o_orderkey")
    return times([("train", a), ("test", b)], "o_orderdate")


@query(_TIMES.format(parts=" UNION ALL ".join(f"SELECT '{n}' AS split, {k} AS o, min(ts) AS lo, max(ts) AS hi FROM events WHERE {c}" for k, (n, c) in enumerate((("train", "event_id % 5 < 3"), ("val", "event_id % 5 = 3"), ("test", "event_id % 5 = 4"))))))
def tm001_events_3way(spark, d):
    e = read(spark, d, "events", "event_id", "ts")
    m = F.col("event_id") % 5
    return times([("train", e.filter(m < 3)), ("val", e.filter(m == 3)), ("test", e.filter(m == 4))], "ts")


@query("""
SELECT count(*) FILTER (v IS NOT NULL AND try_cast(v AS TIMESTAMP) IS NULL)::BIGINT AS invalid, count(try_cast(v AS TIMESTAMP))::BIGINT AS times
FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 7 = 1 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS v FROM events)""")
def tm001_invalid_strings(spark, d):
    m = F.col("event_id") % 7
    e = read(spark, d, "events", "event_id", "ts").select(F.when(m == 0, F.lit("n/a")).when(m != 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("v"))
    return statistics.time_ranges([("train", e)], "v").select("invalid", "times")


_BALANCE = """
WITH n AS (SELECT {c} AS t, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)
SELECT count(*)::BIGINT AS classes, sum(n)::BIGINT AS labelled_rows, arg_max(t::VARCHAR, n) AS majority_class, round(max(n) / sum(n), 9) AS majority_share FROM n"""


@query(_BALANCE.format(c="quality", t="labels"))
def m001_quality(spark, d):
    return statistics.class_balance(read(spark, d, "labels", "quality"), "quality").withColumn("majority_share", F.round("majority_share", 9))


@query(_BALANCE.format(c="event_type", t="events"))
def m001_event_type(spark, d):
    return statistics.class_balance(read(spark, d, "events", "event_type"), "event_type").withColumn("majority_share", F.round("majority_share", 9))


@query("""
WITH e AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 1 THEN NULL WHEN event_id % 11 = 2 THEN '-inf'::DOUBLE ELSE value END AS value, user_id FROM events)
SELECT 'events' AS split, count(*)::BIGINT AS rows, 'value' AS column, count(*) FILTER (value IS NULL OR isnan(value))::BIGINT AS missing, count(*) FILTER (isinf(value))::BIGINT AS infinite FROM e
UNION ALL SELECT 'events', count(*)::BIGINT, 'user_id', count(*) FILTER (user_id IS NULL)::BIGINT, 0::BIGINT FROM e""")
def quality_notes(spark, d):
    m = F.col("event_id") % 11
    value = F.when(m == 0, F.lit(float("nan"))).when(m == 2, F.lit(float("-inf"))).when(m != 1, F.col("value"))
    e = read(spark, d, "events", "event_id", "value", "user_id").select(value.alias("value"), "user_id")
    return statistics.quality_counts([("events", e)])


@query()
def d002_text_docs(spark, d):
    """Whole texts, both halves; a row a class of equal test texts that has a near train text."""
    a, b = halves(read(spark, d, "documents", "doc_id", "text"), "doc_id")
    return similarity.text_near_rows(similarity.text_links(a, b, "text", put=writer(spark))).select("r_pos", "rows", "links", F.round("best", 9).alias("best"))


@query()
def d002_minus_exact(spark, d):
    """Near test classes whose best link is not an exact one."""
    a, b = halves(read(spark, d, "documents", "doc_id", "text"), "doc_id")
    near = similarity.text_near_rows(similarity.text_links(a, b, "text", put=writer(spark)))
    digest = lambda df: df.select("_pos", F.sha2("text", 256).alias("text"))  # noqa: E731  equal where texts are
    return overlap.without_exact(near, overlap.first_match(digest(a), digest(b), ["text"])).select("r_pos", "l_pos")


def writer(spark: SparkSession):
    """Writes a step to the shared checkpoint folder and reads it again."""
    import itertools
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        base = spark.sparkContext.getCheckpointDir()
    top = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"

    made = itertools.count()

    def put(name: str, df: DataFrame) -> DataFrame:
        path = f"{top}/{next(made)}-{name}"  # a name may come again while the first one is still to be read
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return put


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""
WITH s AS (SELECT {', '.join(f'avg({c}) AS m{k}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s{k}' for k, c in enumerate(_NUM))} FROM lineitem WHERE l_orderkey % 5 < 4),
p AS (SELECT l_orderkey % 5 < 4 AS l, l_orderkey * 10 + l_linenumber AS pos, {', '.join(f'({c} - m{k}) / s{k} AS x{k}' for k, c in enumerate(_NUM))} FROM lineitem, s),
g AS (SELECT *, floor(x0 / 0.02) AS a, floor(x1 / 0.02) AS b FROM p),
c AS (SELECT r.pos AS r_pos, l.pos AS l_pos, sqrt({' + '.join(f'(l.x{k} - r.x{k}) * (l.x{k} - r.x{k})' for k in range(4))}) / 2 AS d
  FROM (SELECT *, unnest([-1, 0, 1]) AS da FROM g WHERE NOT l) r2, LATERAL (SELECT r2.*) r JOIN g l ON l.l AND l.a = r2.a + r2.da AND abs(l.b - r2.b) <= 1)
SELECT r_pos, round(min(d), 9) AS distance FROM c WHERE d <= 0.01 GROUP BY 1""")
def d002_numeric_lineitem(spark, d):
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", *_NUM).withColumn("_p", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    near = similarity.numeric_near(*halves(rows, "l_orderkey", "_p"), _NUM, 0.01)
    return near.select("r_pos", F.round("distance", 9).alias("distance"))


@query("""
WITH s AS (SELECT avg(epoch_us(o_orderdate) / 1e6) AS m, stddev_pop(epoch_us(o_orderdate) / 1e6) AS s FROM orders WHERE o_orderkey % 5 < 4),
l AS (SELECT DISTINCT (epoch_us(o_orderdate) / 1e6 - m) / s AS x FROM orders, s WHERE o_orderkey % 5 < 4),
r AS (SELECT o_orderkey AS r_pos, (epoch_us(o_orderdate) / 1e6 - m) / s AS x FROM orders, s WHERE o_orderkey % 5 = 4)
SELECT r_pos, round(least(coalesce(abs(r.x - a.x), 1e9), coalesce(abs(r.x - b.x), 1e9)), 9) AS distance
FROM r ASOF LEFT JOIN l a ON r.x >= a.x ASOF LEFT JOIN (SELECT x FROM l) b ON r.x <= b.x
WHERE least(coalesce(abs(r.x - a.x), 1e9), coalesce(abs(r.x - b.x), 1e9)) <= 0.01""")
def d002_datetime(spark, d):
    near = similarity.numeric_near(*halves(read(spark, d, "orders", "o_orderkey", "o_orderdate"), "o_orderkey"), ["o_orderdate"], 0.01)
    return near.select("r_pos", F.round("distance", 9).alias("distance"))


_BITS = " | ".join(f"((embedding[{k + 1}] > 0)::UBIGINT << {k})" for k in range(16))


@query(f"""
WITH h AS (SELECT vec_id, {_BITS} AS h FROM embeddings),
c AS (SELECT r.vec_id AS r_pos, l.vec_id AS l_pos, bit_count(xor(l.h, r.h)) AS d FROM h r, h l WHERE r.vec_id % 5 = 4 AND l.vec_id % 5 < 4)
SELECT r_pos, min(d)::INT AS distance, arg_min(l_pos, d * 1000000000 + l_pos) AS l_pos FROM c WHERE d <= 2 GROUP BY 1""")
def d002_hamming_embeddings(spark, d):
    rows = read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", similarity.sign_bits("embedding", 16).alias("h"))
    return similarity.hamming_links(*halves(rows, "vec_id"), "h", 2)


@query("""
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE + 0.001) AS v FROM embeddings WHERE vec_id % 10 = 0),
l AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 5 < 4),
d AS (SELECT r.vec_id AS r_pos, list_sum(list_transform(list_zip(l.v, r.v), lambda x: (x[1] - x[2]) ** 2)) AS s FROM r, l)
SELECT r_pos, min(round(sqrt(s) / 8, 6)) AS distance FROM d WHERE s <= 64 * 0.02 * 0.02 GROUP BY 1""")
def d002_embeddings(spark, d):
    """Test rows here are slightly moved copies of train rows; d002_embeddings_all searches the whole test side."""
    rows = read(spark, d, "embeddings", "vec_id", "embedding").withColumn("_pos", F.col("vec_id"))
    left = rows.filter("vec_id % 5 < 4").select("_pos", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    right = rows.filter("vec_id % 10 = 0").select("_pos", F.transform("embedding", lambda x: x.cast("double") + 0.001).alias("v"))
    return similarity.nearest_within(left, right, 0.02).select("r_pos", F.round("distance", 6).alias("distance"))


@query()
def d002_embeddings_all(spark, d):
    """All of the test side against all of the train side; held against brute force."""
    rows = read(spark, d, "embeddings", "vec_id", "embedding")
    left, right = (x.select("_pos", F.transform("embedding", lambda v: v.cast("double")).alias("v")) for x in halves(rows, "vec_id"))
    return similarity.nearest_within(left, right, 0.02).select("r_pos", F.round("distance", 6).alias("distance"))


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey"]
_MELT = " UNION ALL ".join(f"SELECT '{c}' AS feature, (l_orderkey % 5)::INT AS fold, {c}::DOUBLE AS x, {{y}} AS y FROM lineitem" for c in _FEATURES)


def _melted(spark, d, target):
    rows = read(spark, d, "lineitem", "l_orderkey", "l_returnflag", *_FEATURES)
    return predictivity.melt(rows, _FEATURES, target, (F.col("l_orderkey") % 5).cast("int"))


@query(f"""
WITH m AS ({_MELT.format(y="(l_returnflag = 'N')::INT::DOUBLE")}),
f AS (SELECT DISTINCT feature, fold FROM m),
c AS (SELECT f.feature, f.fold, sign(round(sum(x * y) - sum(x) * sum(y) / count(*), 9)) AS s FROM f JOIN m ON m.feature = f.feature AND m.fold <> f.fold GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY feature, fold ORDER BY x) + (count(*) OVER (PARTITION BY feature, fold, x) - 1) / 2.0 AS r FROM m),
a AS (SELECT feature, fold, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS a FROM r GROUP BY ALL)
SELECT feature, round(avg(CASE WHEN s > 0 THEN a WHEN s < 0 THEN 1 - a ELSE 0.5 END), 6) AS score, round(stddev_pop(CASE WHEN s > 0 THEN a WHEN s < 0 THEN 1 - a ELSE 0.5 END), 6) AS spread, count(*)::BIGINT AS folds
FROM a JOIN c USING (feature, fold) GROUP BY 1""")
def d005_auc_numeric(spark, d):
    got = predictivity.summarise(predictivity.fold_auc(_melted(spark, d, F.col("l_returnflag") == "N")), "auc")
    return got.select("feature", F.round("score", 6).alias("score"), F.round("spread", 6).alias("spread"), "folds")


@query(f"""
WITH m AS ({_MELT.format(y="l_extendedprice::DOUBLE")}), f AS (SELECT DISTINCT feature, fold FROM m),
l AS (SELECT f.feature, f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f JOIN m ON m.feature = f.feature AND m.fold <> f.fold GROUP BY ALL),
s AS (SELECT feature, fold, 1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)) AS r2 FROM m JOIN l USING (feature, fold), LATERAL (SELECT 1) GROUP BY ALL)
SELECT feature, round(avg(r2), 5) AS score, count(*)::BIGINT AS folds FROM s GROUP BY 1""")
def d005_r2(spark, d):
    got = predictivity.summarise(predictivity.fold_r2(_melted(spark, d, F.col("l_extendedprice"))), "r2")
    return got.select("feature", F.round("score", 5).alias("score"), "folds")


_MI = """
WITH m AS ({melt}), n AS (SELECT feature, x, y, count(*) AS n FROM m GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nn FROM n),
mi AS (SELECT feature, greatest(0, sum(n / nn * ln(n::DOUBLE * nn / (nx * ny)))) AS mi FROM t GROUP BY 1)"""
_CAT = ["l_linestatus", "l_linenumber", "l_tax", "l_discount"]
_MI_SQL = _MI.format(melt=" UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::VARCHAR AS x, l_returnflag AS y FROM lineitem" for c in _CAT))


def _mi(spark, d):
    return predictivity.mutual_information(read(spark, d, "lineitem", "l_returnflag", *_CAT), _CAT, "l_returnflag")


@query(_MI_SQL + " SELECT feature, round(mi, 9) AS mi FROM mi")
def d006_mi_discrete(spark, d):
    return _mi(spark, d).select("feature", F.round("mi", 9).alias("mi"))


@query(_MI_SQL + """, s AS (SELECT quantile_cont(mi, 0.5) AS med, count(*) AS n FROM mi)
SELECT a.feature, round(med, 9) AS median_mi, round((SELECT max(mi) FROM mi b WHERE b.feature <> a.feature), 9) AS best_other,
  n >= 3 AND mi >= greatest(0.001, 1.5 * med) AND ((SELECT max(mi) FROM mi b WHERE b.feature <> a.feature) = 0 OR mi > 1.5 * (SELECT max(mi) FROM mi b WHERE b.feature <> a.feature)) AS fires
FROM mi a, s""")
def d006_dominance(spark, d):
    return predictivity.dominance(_mi(spark, d), 0.001).select("feature", F.round("median_mi", 9).alias("median_mi"), F.round("best_other", 9).alias("best_other"), "fires")


@query()
def d006_mi_knn(spark, d):
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", *_FEATURES).withColumn("_pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return predictivity.continuous_mi(rows, _FEATURES, "l_returnflag", writer(spark)).select("feature", F.round("mi", 6).alias("mi"))


@query("""
WITH r AS (SELECT event_id, event_type, user_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 5 AS f FROM events)
SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT f)::BIGINT AS folds, (max(c) - min(c) <= 1) AS even FROM (SELECT *, count(*) OVER (PARTITION BY event_type, f) AS c FROM r) GROUP BY 1""")
def d005_folds_stratified(spark, d):
    e = read(spark, d, "events", "event_id", "event_type").withColumn("f", predictivity.class_folds("event_type", 5, "event_id"))
    c = e.withColumn("c", F.count("*").over(Window.partitionBy("event_type", "f")))
    return c.groupBy("event_type").agg(F.count("*").cast("long").alias("n"), F.count_distinct("f").cast("long").alias("folds"), (F.max("c") - F.min("c") <= 1).alias("even"))


@query("SELECT (('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 5)::INT AS fold, count(DISTINCT user_id)::BIGINT AS groups, count(*)::BIGINT AS rows FROM events GROUP BY 1")
def d005_folds_group(spark, d):
    e = read(spark, d, "events", "user_id").withColumn("fold", predictivity.group_folds("user_id", 5))
    return e.groupBy("fold").agg(F.count_distinct("user_id").cast("long").alias("groups"), F.count("*").cast("long").alias("rows"))


@query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders),
b AS (SELECT *, greatest(0, (r - (n - (n // 5) * 4)) // (n // 5) + 1) AS block FROM (SELECT *, n FROM r) )
SELECT CASE WHEN r < n - (n // 5) * 4 THEN 0 ELSE block END::INT AS block, count(*)::BIGINT AS n, epoch_us(min(o_orderdate)) AS first_time FROM b GROUP BY 1""")
def d005_folds_time(spark, d):
    o = read(spark, d, "orders", "o_orderkey", "o_orderdate").withColumn("_pos", F.col("o_orderkey"))
    return predictivity.time_folds(o, "o_orderdate", 4).groupBy("block").agg(F.count("*").cast("long").alias("n"), F.unix_micros(F.min(F.col("o_orderdate").cast("timestamp"))).alias("first_time"))


@query("""
WITH c AS (SELECT l_linestatus AS x, l_returnflag AS y, l_orderkey % 5 AS fold, count(*) AS n FROM lineitem GROUP BY ALL),
f AS (SELECT DISTINCT fold FROM c), r AS (SELECT f.fold, x, y, sum(n) AS n FROM f JOIN c ON c.fold <> f.fold GROUP BY ALL),
g AS (SELECT fold, x, arg_max(y, n) AS guess FROM r GROUP BY ALL), s AS (SELECT fold, sum(n) FILTER (guess = y) / sum(n) AS a FROM c JOIN g USING (fold, x) GROUP BY 1)
SELECT 'l_linestatus' AS feature, round(avg(a), 9) AS score, count(*)::BIGINT AS folds FROM s""")
def d005_accuracy_categorical(spark, d):
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_returnflag")
    got = predictivity.summarise(predictivity.fold_accuracy(rows, "l_linestatus", "l_returnflag", (F.col("l_orderkey") % 5).cast("int")), "accuracy")
    return got.select("feature", F.round("score", 9).alias("score"), "folds")


@query("SELECT event_id FROM events WHERE event_id % 5 < 4 AND event_id < 200")
def smp_head(spark, d):
    return statistics.head_sample(halves(read(spark, d, "events", "event_id"), "event_id")[0], 200).select("event_id")


@query("SELECT event_id FROM events ORDER BY md5('0:' || event_id), event_id LIMIT 500")
def smp_fixed(spark, d):
    return statistics.fixed_sample(read(spark, d, "events", "event_id"), 500, "event_id")


@query(r"""
WITH v AS (SELECT 'source' AS c, doc_id AS p, source AS v FROM documents UNION ALL SELECT 'text', doc_id, text FROM documents
  UNION ALL SELECT 'picture', doc_id, CASE WHEN doc_id % 10 = 3 THEN 'none' ELSE 'shots/' || doc_id || '.PNG' END FROM documents),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY p) AS n FROM v WHERE v IS NOT NULL) WHERE n <= 200)
SELECT c AS column, avg(CASE WHEN n <= 20 THEN regexp_matches(lower(v), '\.(png|jpg|jpeg|gif|bmp|webp|tif|tiff)$')::INT END) >= 0.8 AS looks_like_image,
  max(length(v)) >= 24 OR avg(len(list_filter(regexp_split_to_array(v, '\s+'), lambda x: x <> ''))) >= 4 OR count(DISTINCT v) > greatest(10, count(*) / 2) AS looks_like_text
FROM f GROUP BY c""")
def typ_columns(spark, d):
    picture = F.when(F.col("_pos") % 10 == 3, F.lit("none")).otherwise(F.concat(F.lit("shots/"), F.col("_pos").cast("string"), F.lit(".PNG")))
    return statistics.column_kinds(read(spark, d, "documents", "doc_id", "text", "source").withColumnRenamed("doc_id", "_pos").withColumn("picture", picture))


@query("SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS z FROM events")
def zscore_events(spark, d):
    return statistics.zscore(read(spark, d, "events", "event_id", "value"), "value").select("event_id", F.round("z", 6).alias("z"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '[\s\x{00A0}]+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL""")
def fn_text_normal(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(fn.normal_text(F.col("text"))).alias("digest"))


# Findings made of the events table: a few thousand observations with ties.
def observations(spark, d) -> DataFrame:
    e = read(spark, d, "events", "event_id", "user_id")
    k, u = F.col("event_id"), F.col("user_id")
    pick = lambda c, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (c % len(v) + 1).cast("int"))
    return e.select(
        pick(u, "P001", "S002", "D003").alias("rule_id"), pick(u, "preprocessing", "split", "data").alias("category"),
        pick(k, "info", "low", "medium", "high", "critical").alias("severity"), pick(u, "static", "static", "data").alias("layer"),
        F.concat(F.lit("m"), (k % 13).cast("string")).alias("message"), F.concat(F.lit("f"), (u % 7).cast("string")).alias("file"),
        (u % 11).alias("line"), F.lit(None).cast("long").alias("col"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("long").alias("cell_index"),
        ((k % 10) / 10).alias("confidence"), (u % 4 == 0).alias("advisory"), F.lit("fix").alias("fix"), F.lit("{}").alias("evidence"), F.lit("").alias("identity"),
    )


_OBS = """WITH o AS (SELECT ['P001','S002','D003'][user_id % 3 + 1] AS rule_id, ['preprocessing','split','data'][user_id % 3 + 1] AS category,
  ['info','low','medium','high','critical'][event_id % 5 + 1] AS severity, event_id % 5 AS rank, ['static','static','data'][user_id % 3 + 1] AS layer,
  'm' || (event_id % 13) AS message, 'f' || (user_id % 7) AS file, user_id % 11 AS line, (event_id % 10) / 10 AS confidence, user_id % 4 = 0 AS advisory FROM events),
k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY rule_id, layer, file, line ORDER BY confidence DESC, rank DESC, message DESC) = 1)"""


@query(_OBS + " SELECT rule_id, layer, file, line, confidence, severity, message FROM k")
def findings_dedupe(spark, d):
    return findings.dedupe(observations(spark, d)).select("rule_id", "layer", "file", "line", "confidence", "severity", "message")


@query(_OBS + """ SELECT rule_id, file, line, NOT advisory AND rank >= 3 AND confidence >= 0.75 AS gateable, array_to_string(list_sort(list_filter([
  CASE WHEN advisory THEN 'advisory-only' END, CASE WHEN rank < 3 THEN 'severity-below-gate' END, CASE WHEN confidence < 0.75 THEN 'confidence-below-gate' END,
  CASE WHEN layer = 'static' AND confidence < 0.6 THEN 'advisory-confidence' END, CASE WHEN layer = 'static' AND confidence >= 0.6 AND confidence < 0.85 THEN 'probable-static' END,
  CASE WHEN NOT advisory AND rank >= 3 AND confidence >= 0.75 THEN 'gateable' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM k""")
def findings_gate(spark, d):
    return findings.gated(findings.dedupe(observations(spark, d))).select("rule_id", "file", "line", "gateable", F.array_join("reasons", ",").alias("reasons"))


@query(_OBS + """ SELECT 'severity' AS dimension, severity AS value, count(*)::BIGINT AS n FROM k GROUP BY ALL UNION ALL SELECT 'category', category, count(*)::BIGINT FROM k GROUP BY ALL
UNION ALL SELECT 'layer', layer, count(*)::BIGINT FROM k GROUP BY ALL UNION ALL SELECT 'rule_id', rule_id, count(*)::BIGINT FROM k GROUP BY ALL UNION ALL SELECT 'all', 'all', count(*)::BIGINT FROM k""")
def findings_summary(spark, d):
    return findings.summary(findings.dedupe(observations(spark, d)))


@query(_OBS + " SELECT bool_or(NOT advisory AND rank >= 3 AND confidence >= 0.75) AS gated FROM k")
def findings_gate_any(spark, d):
    return findings.any_gated(findings.gated(findings.dedupe(observations(spark, d))))


_CLASSES = ("StandardScaler", "SMOTE", "SelectKBest", "SimpleImputer", "GridSearchCV", "Normalizer", "PCA")


# An event log made of the events table: a few sessions, rows touched by each event.
def event_log(spark, d) -> tuple[DataFrame, DataFrame]:
    e = read(spark, d, "events", "event_id", "user_id", "event_type")
    k = F.col("event_id")
    rows = F.array(k % 50, (k * 6) % 50, F.when(k % 3 == 0, (k * 7) % 50).otherwise(k % 50))
    log = e.select(
        (F.col("user_id") % 3).cast("string").alias("session_id"), k.alias("ordinal"),
        F.when(k % 3 == 0, "fit").when(k % 3 == 1, "score").otherwise("cross_validation").alias("kind"),
        F.concat(F.lit("s.py:"), (k % 40).cast("string")).alias("call_site"),
        F.when(k % 2 == 0, F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), (F.floor(k / 2) % 7 + 1).cast("int"))).otherwise("LogisticRegression").alias("class"),
        F.when(k % 4 == 0, "fit_transform").when(k % 4 == 2, "fit").otherwise("score").alias("method"),
        F.transform(rows, lambda r: F.struct(F.lit("d").alias("dataset_id"), r.cast("string").alias("row_key"))).alias("input_rows"),
        F.transform(F.slice(rows, 1, 1), lambda r: F.struct(F.lit("d").alias("dataset_id"), r.cast("string").alias("row_key"))).alias("eval_rows"),
        F.when(k % 30 == 0, F.array(F.lit("SelectKBest"))).otherwise(F.array().cast("array<string>")).alias("components"), F.array(k - 2).alias("origins"), (k % 5 == 0).alias("concat_sources"),
    )
    member = spark.range(50).select(F.lit("d").alias("dataset_id"), F.col("id").cast("string").alias("row_key"), F.when(F.col("id") % 5 == 4, "test").when(F.col("id") % 5 == 3, "val").otherwise("train").alias("split"))
    return log, member


_LOG = """WITH e AS (SELECT (user_id % 3)::VARCHAR AS session_id, event_id AS ordinal, CASE event_id % 3 WHEN 0 THEN 'fit' WHEN 1 THEN 'score' ELSE 'cross_validation' END AS kind,
  CASE WHEN event_id % 2 = 0 THEN ['StandardScaler','SMOTE','SelectKBest','SimpleImputer','GridSearchCV','Normalizer','PCA'][(event_id // 2) % 7 + 1] ELSE 'LogisticRegression' END AS class,
  event_id % 30 = 0 AS picks, event_id % 5 = 0 AS joined, CASE event_id % 4 WHEN 0 THEN 'fit_transform' WHEN 2 THEN 'fit' ELSE 'score' END AS method,
  list_distinct([event_id % 50, (event_id * 6) % 50, CASE WHEN event_id % 3 = 0 THEN (event_id * 7) % 50 ELSE event_id % 50 END]) AS rows, event_id % 50 AS ev, event_id - 2 AS origin FROM events),
x AS (SELECT session_id, ordinal, unnest(rows) AS r FROM e),
c AS (SELECT session_id, ordinal, count(*) FILTER (r % 5 < 3)::BIGINT AS train_rows, count(*) FILTER (r % 5 = 3)::BIGINT AS val_rows, count(*) FILTER (r % 5 = 4)::BIGINT AS test_rows FROM x GROUP BY ALL)"""


@query(_LOG + " SELECT * FROM c")
def runtime_membership_counts(spark, d):
    log, member = event_log(spark, d)
    return runtime.side_counts(log, member, "input_rows").select("session_id", "ordinal", "train_rows", "val_rows", "test_rows")


@query(_LOG + """, f AS (SELECT session_id, ordinal, CASE WHEN class = 'GridSearchCV' THEN 'C004' WHEN class = 'Normalizer' THEN NULL WHEN class = 'SMOTE' THEN 'S003' WHEN class = 'SelectKBest' OR picks THEN 'S004'
  WHEN class = 'SimpleImputer' THEN 'P003' WHEN class NOT IN ('StandardScaler', 'PCA') THEN NULL WHEN joined THEN 'P002' WHEN method = 'fit_transform' THEN 'P001' ELSE 'S001' END AS rule_id, test_rows + val_rows AS leaked_rows
  FROM e JOIN c USING (session_id, ordinal) WHERE kind = 'fit' AND test_rows + val_rows > 0) SELECT * FROM f WHERE rule_id IS NOT NULL""")
def runtime_fit_leak(spark, d):
    return runtime.fit_leaks(*event_log(spark, d)).select("session_id", "ordinal", "rule_id", "leaked_rows")


@query(_LOG + """, s AS (SELECT e.session_id, e.ordinal, list_sort(list_distinct(list_transform(rows, lambda r: 'd:' || r))) AS sig FROM e JOIN c USING (session_id, ordinal) WHERE kind = 'score' AND test_rows > 0 AND train_rows = 0 AND val_rows = 0),
n AS (SELECT session_id, ordinal, count(*) OVER (PARTITION BY session_id, sig ORDER BY ordinal) AS n FROM s) SELECT session_id, ordinal, n::BIGINT AS evaluations FROM n WHERE n >= 2""")
def runtime_t001(spark, d):
    return runtime.repeated_evaluations(*event_log(spark, d)).select("session_id", "ordinal", "evaluations")


@query(_LOG + " SELECT session_id, ordinal FROM e JOIN c USING (session_id, ordinal) WHERE kind = 'score' AND train_rows > 0 AND test_rows + val_rows = 0")
def runtime_m004(spark, d):
    return runtime.train_scores(*event_log(spark, d)).select("session_id", "ordinal")


@query(_LOG + " SELECT session_id, ordinal FROM e WHERE kind = 'fit' AND ev % 5 = 4")
def runtime_t002(spark, d):
    return runtime.test_guided_fits(*event_log(spark, d)).select("session_id", "ordinal")


@query(_LOG + """ SELECT v.session_id, v.ordinal FROM e v JOIN e f ON f.session_id = v.session_id AND f.ordinal = v.origin AND f.kind = 'fit' AND (f.picks OR f.class IN ('StandardScaler', 'PCA', 'SelectKBest')) WHERE v.kind = 'cross_validation'""")
def runtime_c001(spark, d):
    return runtime.reused_fits(event_log(spark, d)[0]).select("session_id", "ordinal")


@query("""
WITH f AS (SELECT source AS repo, 'R' || (doc_id % 3) AS rule_id FROM documents), g AS (SELECT DISTINCT source AS repo, 'd' || (length(source) % 2) AS domain FROM documents WHERE source <> 'src3')
SELECT domain, rule_id, count(*)::BIGINT AS n FROM f LEFT JOIN g USING (repo) GROUP BY ROLLUP (domain, rule_id)""")
def corpus_rollup(spark, d):
    """Findings of many repositories by domain and rule; one repository has no domain."""
    from ..cli import corpus_summary

    docs = read(spark, d, "documents", "doc_id", "source")
    found = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file"), F.concat(F.lit("R"), (F.col("doc_id") % 3).cast("string")).alias("rule_id"))
    domains = docs.filter("source <> 'src3'").select(F.col("source").alias("repo"), F.concat(F.lit("d"), (F.length("source") % 2).cast("string")).alias("domain")).distinct()
    return corpus_summary(found, domains)


@query("""
WITH e AS (SELECT DISTINCT user_id % 40 AS repo, 'R' || (event_id % 3) AS rule_id FROM events WHERE event_id % 4 < 2), o AS (SELECT DISTINCT user_id % 40 AS repo, 'R' || (event_id % 3) AS rule_id FROM events WHERE event_id % 4 > 1 AND user_id % 7 < 5),
j AS (SELECT coalesce(e.rule_id, o.rule_id) AS rule_id, e.repo IS NOT NULL AS x, o.repo IS NOT NULL AS y FROM e FULL JOIN o ON e.repo = o.repo AND e.rule_id = o.rule_id)
SELECT rule_id, count(*) FILTER (x AND y)::BIGINT AS hits, count(*) FILTER (x AND NOT y)::BIGINT AS missed, count(*) FILTER (y AND NOT x)::BIGINT AS extra FROM j GROUP BY 1""")
def corpus_confusion(spark, d):
    """Expected against observed findings."""
    e = read(spark, d, "events", "event_id", "user_id").select("event_id", "user_id", (F.col("user_id") % 40).alias("repo"), F.concat(F.lit("R"), (F.col("event_id") % 3).cast("string")).alias("rule_id"))
    m = F.col("event_id") % 4
    return statistics.confusion(e.filter(m < 2).select("repo", "rule_id"), e.filter((m > 1) & (F.col("user_id") % 7 < 5)).select("repo", "rule_id"), ["rule_id"])


_MEAN = "(" + " + ".join(f"embedding[{k + 1}]::DOUBLE" for k in range(64)) + ") / 64"
_HALF = [" + ".join(f"((embedding[{k + 1}]::DOUBLE > m)::BIGINT << {k % 32})" for k in r) for r in (range(32), range(32, 64))]


@query(f"WITH e AS (SELECT *, {_MEAN} AS m FROM embeddings) SELECT vec_id, {_HALF[0]} AS low, {_HALF[1]} AS high FROM e")
def d002_mean_hash(spark, d):
    """Mean hash of 64 grey values."""
    h = read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", similarity.mean_bits("embedding").alias("h"))
    return h.select("vec_id", F.col("h").bitwiseAND(F.lit((1 << 32) - 1)).alias("low"), F.shiftrightunsigned("h", 32).alias("high"))


@query("""
WITH c AS (SELECT fold, l_discount AS x, sum(n) AS n, sum(sy) AS sy, sum(syy) AS syy FROM (SELECT (l_orderkey % 5)::INT AS fold, l_discount, count(*) AS n, sum(l_tax::DOUBLE) AS sy, sum(l_tax::DOUBLE * l_tax) AS syy FROM lineitem GROUP BY ALL) GROUP BY ALL),
f AS (SELECT DISTINCT fold FROM c), r AS (SELECT f.fold, x, sum(sy) / sum(n) AS g FROM f JOIN c ON c.fold <> f.fold GROUP BY ALL),
s AS (SELECT fold, 1 - sum(syy - 2 * g * sy + n * g * g) / (sum(syy) - sum(sy) * sum(sy) / sum(n)) AS r2 FROM c JOIN r USING (fold, x) GROUP BY 1)
SELECT 'l_discount' AS feature, round(avg(r2), 6) AS score, count(*)::BIGINT AS folds FROM s""")
def d005_r2_categorical(spark, d):
    rows = read(spark, d, "lineitem", "l_orderkey", "l_discount", "l_tax")
    got = predictivity.summarise(predictivity.fold_mean_r2(rows, "l_discount", "l_tax", F.col("l_orderkey") % 5), "r2")
    return got.select("feature", F.round("score", 6).alias("score"), "folds")


@query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders),
b AS (SELECT o_orderpriority AS x, o_orderstatus AS y, CASE WHEN r < n - (n // 5) * 4 THEN 0 ELSE greatest(0, (r - (n - (n // 5) * 4)) // (n // 5) + 1) END AS fold FROM r),
c AS (SELECT fold, x, y, count(*) AS n FROM b GROUP BY ALL), f AS (SELECT DISTINCT fold FROM c WHERE fold > 0),
p AS (SELECT f.fold, x, y, sum(n) AS n FROM f JOIN c ON c.fold < f.fold GROUP BY ALL), g AS (SELECT fold, x, arg_max(y, n * 1000 + ascii(y)) AS guess FROM p GROUP BY ALL),
s AS (SELECT fold, sum(n) FILTER (guess = y) / sum(n) AS a FROM c JOIN g USING (fold, x) GROUP BY 1)
SELECT 'o_orderpriority' AS feature, round(avg(a), 9) AS score, count(*)::BIGINT AS folds FROM s""")
def d005_accuracy_in_time(spark, d):
    """Each block of time is tested on all earlier ones."""
    o = read(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus").withColumn("_pos", F.col("o_orderkey"))
    timed = predictivity.time_folds(o, "o_orderdate", 4)
    got = predictivity.summarise(predictivity.fold_accuracy(timed, "o_orderpriority", "o_orderstatus", F.col("block"), True), "accuracy")
    return got.select("feature", F.round("score", 9).alias("score"), "folds")


_SIDES = "CASE WHEN s_suppkey % 5 = 4 THEN 'test' WHEN s_suppkey % 5 = 3 THEN 'val' ELSE 'train' END"


def _suppliers(spark, d) -> tuple[DataFrame, DataFrame]:
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    m = F.col("s_suppkey") % 5
    return s, lineage.register_split({"train": s.filter(m < 3), "val": s.filter(m == 3), "test": s.filter(m == 4)}, "s_suppkey", "d")


@query(f"SELECT s_suppkey::VARCHAR AS row_key, {_SIDES} AS split FROM supplier")
def runtime_register_split(spark, d):
    return _suppliers(spark, d)[1].select("row_key", "split")


@query(f"SELECT s_suppkey::VARCHAR AS row, {_SIDES} AS splits FROM supplier WHERE s_nationkey < 10")
def runtime_index_join(spark, d):
    """A frame that dropped rows keeps its index: its rows are found by it."""
    s, member = _suppliers(spark, d)
    lin = lineage.transformed(lineage.declared(s, "s_suppkey", "d"), s.filter("s_nationkey < 10"), "s_suppkey")
    return lineage.sides(lineage.by_index(s.filter("s_nationkey < 10"), "s_suppkey", lin), member).select("row", F.array_join("splits", ",").alias("splits"))


@query(f"""
WITH s AS (SELECT s_nationkey AS v, {_SIDES} AS split FROM supplier)
SELECT s_suppkey::VARCHAR AS row, (SELECT string_agg(DISTINCT split, ',' ORDER BY split) FROM s WHERE v = s_nationkey) AS splits FROM supplier WHERE s_suppkey % 2 = 0""")
def runtime_content_match(spark, d):
    """Rows without an index, found by their values: all alike rows count."""
    s, member = _suppliers(spark, d)
    sides = lineage.sides_by_content(s.filter("s_suppkey % 2 = 0"), "s_suppkey", s, "s_suppkey", ["s_nationkey"], "d", member)
    return sides.select("row", F.array_join("splits", ",").alias("splits"))


@query(f"""
WITH s AS (SELECT s_suppkey AS k, {_SIDES} AS split FROM supplier)
SELECT '0:' || k AS row, split AS splits FROM s WHERE k % 3 = 0 UNION ALL
SELECT '1:' || a.k, CASE WHEN b.split IS NULL OR a.split = b.split THEN a.split ELSE least(a.split, b.split) || ',' || greatest(a.split, b.split) END FROM s a LEFT JOIN s b ON b.k = a.k + 1""")
def runtime_concat_assembly(spark, d):
    """Frames below each other; the second has columns of the next row beside its own."""
    s, member = _suppliers(spark, d)
    own = lineage.declared(s, "s_suppkey", "d")
    beside = own.withColumn("row", (F.col("row").cast("long") - 1).cast("string")).join(own.select("row"), "row", "left_semi")
    both = lineage.stacked([lineage.transformed(own, s.filter("s_suppkey % 3 = 0"), "s_suppkey"), lineage.assembled([own, beside])])
    return lineage.sides(both, member).select("row", F.array_join("splits", ",").alias("splits"))


@query("SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, call_site)::BIGINT AS ordinal FROM (SELECT user_id % 3 AS session_id, event_id, ts, lpad(event_id::VARCHAR, 12, '0') AS call_site FROM events)")
def runtime_run_ordinal(spark, d):
    """Events that came without an ordinal, by time."""
    e = read(spark, d, "events", "event_id", "user_id", "ts")
    log = e.select((F.col("user_id") % 3).alias("session_id"), "event_id", F.col("ts").alias("at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("call_site"), F.lit(None).cast("long").alias("ordinal"))
    return lineage.numbered(log).select("session_id", "event_id", "ordinal")


# Static rules: every second supplier has the rule's bad script, the others its good one.
def _scripts(spark, d, *scripts: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.element_at(F.array(*[F.lit(x) for x in scripts]), (k % len(scripts) + 1).cast("int"))
    return extract.extract(read(spark, d, "supplier", "s_suppkey").select(F.concat(F.lit("s"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("content")), writer(spark))


def _static(rule: str):
    bad, good = EXAMPLES[rule]

    def run(spark, d):
        return static_rules.findings(_scripts(spark, d, bad, good), (rule,)).select("path", "rule_id").distinct()

    run.__name__ = f"static_{rule.lower()}"
    return query(f"SELECT 's' || s_suppkey || '.py' AS path, '{rule}' AS rule_id FROM supplier WHERE s_suppkey % 2 = 0")(run)


for _rule in EXAMPLES:
    _static(_rule)


@query("""SELECT 's' || s_suppkey || '.py' AS path, CASE WHEN s_suppkey % 4 = 2 THEN 'LP201' ELSE 'R001' END AS code FROM supplier WHERE s_suppkey % 4 IN (0, 2)
UNION ALL SELECT 's' || s_suppkey || '.py', 'R001' FROM supplier WHERE s_suppkey % 4 = 2""")
def static_suppressions(spark, d):
    """Without a comment, silenced by id, by a bare comment (a problem that silences nothing), and by file."""
    bad = EXAMPLES["R001"][0].rstrip("\n")
    facts = _scripts(spark, d, bad, bad + "  # tidemark: ignore[R001]\n", bad + "  # tidemark: ignore\n", bad + "\n# tidemark: ignore-file\n")
    found = static_rules.findings(facts, ("R001",)).select("path", F.col("rule_id").alias("code"))
    return found.unionByName(facts.filter("kind = 'problem'").select("path", F.col("name").alias("code"))).distinct()


@query("""
WITH k AS (SELECT s_suppkey AS k FROM supplier), f AS (SELECT k, unnest(['import', 'split', 'fit', 'call']) AS kind FROM k)
SELECT 's' || k || '.py' AS path, kind, true AS seen FROM f WHERE kind = 'import' OR (kind = 'split' AND k % 3 < 2) OR (kind = 'fit' AND k % 3 = 0) OR (kind = 'call' AND k % 3 < 2) OR (kind = 'call' AND k % 3 = 2)""")
def static_facts(spark, d):
    """Which kinds of facts scripts give: with a split and a fit, with a split, with neither."""
    facts = _scripts(spark, d, EXAMPLES["P001"][0], EXAMPLES["R001"][0], EXAMPLES["R002"][0])
    return facts.filter(F.col("kind").isin("import", "split", "fit", "call")).select("path", "kind", F.lit(True).alias("seen")).distinct()
