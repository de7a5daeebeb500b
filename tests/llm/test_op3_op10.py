import math

from brute import contamination, neighbours
from pyspark.sql import functions as F
from tidemark.llm import ann_search, decontaminate

SF = "/root/testdata/sf0.001"


def test_neighbours_equal_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = neighbours(rows)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann_search.op3_nearest_neighbours(spark, SF).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(math.isclose(got[k][1], want[k][1], rel_tol=1e-12) for k in want)


def test_odd_vectors_and_small_tiles(spark):
    rows = [(i, [float((i * 7 + j * j) % 11 - 5) for j in range(6)]) for i in range(90)]
    rows += [(100, None), (120, [0.0] * 6), (140, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (160, [float("nan")] * 6), (180, [float("inf")] * 6)]
    rows += [(200, []), (220, [1.0, 2.0]), (221, [3.0, 4.0]), (None, [1.0] * 6), (7, rows[7][1]), (501, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("dim", F.lit("x"))
    got = ann_search.search(df, F.col("id") % 20 == 0, query_block=3, candidate_block=10).collect()
    want = neighbours([r for r in rows if r[0] is not None and r[1] != []])
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {k: v[0] for k, v in want.items()}
    assert ann_search.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def rows_of(df):
    return sorted(((r[0] is not None, r[0] or 0), *r[1:]) for r in df.select("_key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def sort(rows):
    return sorted(((r[0] is not None, r[0] or 0), *r[1:]) for r in rows)


def test_contamination_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = decontaminate.op10_benchmark_decontamination(spark, SF).withColumnRenamed("doc_id", "_key")
    assert rows_of(got) == sort(contamination(docs, items))
    assert any(r[5] for r in contamination(docs, items))


def test_contamination_cases(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = [(1, None), (2, ""), (3, "  ?! "), (4, long), (4, long), (None, "a b c"), (5, "x A-b É c y a b É c"), (6, "a a a a a a"), (7, "w0 " * 30 + long[:60])]
    items = [(1, "A b é".upper()), (2, "a a"), (3, long.upper()), (4, None), (5, ""), (3, "a b é"), (None, "c"), (9, "é c")]
    # A-Z alone are lower-cased, so "É" differs from "é".
    d = spark.createDataFrame(docs, "_key long, text string").withColumn("n", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    want = sort(contamination(docs, [("" if i is None else i, t) for i, t in items]))
    for words in (200_000, 5):
        assert rows_of(decontaminate.digest(decontaminate.contamination(d, b, chunk_words=words))) == want
    assert decontaminate.digest(decontaminate.contamination(d.limit(0), b)).count() == 0
    none = decontaminate.digest(decontaminate.contamination(d, b.limit(0))).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red x x green x blue"), (2, "red " + "x " * 40 + "green blue")], "_key long, text string")
    b = spark.createDataFrame([(1, "blue red green")], "item_id long, text string")
    got = {r._key: list(r.near) for r in decontaminate.contamination(d, b, slop=6).collect()}
    assert got == {1: ["1"], 2: []}
