import random

from brute import near, shingles4
from pyspark.sql import functions as F
from tidemark.llm import minhash_forest as M
from tidemark.llm.common import Workspace
from tidemark.llm.components import components

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("_key", "n_shingles", "component_id", "kept").collect())


def test_table_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = near(docs)
    assert rows_of(M.op4_minhash_forest(spark, SF).withColumnRenamed("doc_id", "_key")) == sorted(want)
    assert any(not r[3] for r in want)


def test_groups_thresholds_and_odd_texts(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    docs, k = [], 0
    for _ in range(12):  # groups of near copies, some chained: neighbours are similar, ends are not
        base = rnd.choices(words, k=120)
        for _ in range(15):
            docs.append((k, " ".join(base)))
            base = list(base)
            base[rnd.randrange(120)] = rnd.choice(words)
            k += 1
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b"), (1004, "A  B"), (1005, "a b c"), (1006, "É é"), (1007, "é é"), (1008, "x y z w"), (1009, "X y\x0bz w")]
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"node": F.lit(1), "u": F.lit(2), "sig": F.lit("s")})
    assert rows_of(M.near_duplicates(df)) == sorted(near(docs))
    assert M.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (4, "q"), (4, "q"), (5, None), (None, "")], "doc_id long, text string")
    got = M.near_duplicates(odd).collect()
    assert sorted((str(r._key), str(r.component_id), r.kept) for r in got) == [("3", "None", False), ("4", "4", True), ("4", "4", True), ("5", "5", True), ("None", "None", True), ("None", "None", True)]


def test_exact_threshold():
    # 9 shared of 11, and 8 shared of 10
    a, b = (set(M.shingles(" ".join(x)).tolist()) for x in (list("abcdefghijklm"), list("abcdefghijklx")))
    assert len(a & b) == len(shingles4("a b c d e f g h i j k l")) == 9 and len(a | b) == 11


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    rnd = random.Random(1)
    name = list(range(200))
    rnd.shuffle(name)
    e = spark.createDataFrame([(name[a], name[b]) for a, b in links], "u long, v long")
    got = {r.u: r.v for r in components(e, Workspace(spark)).collect()}
    for part in (range(61), range(100, 140)):
        low = min(name[i] for i in part)
        assert {got.get(name[i], name[i]) for i in part} == {low}
