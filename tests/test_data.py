"""Data rules on small tables, and operators against brute force."""

import itertools
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.config import Config, DataConfig
from tidemark.operators import overlap, predictivity, similarity, statistics
from tidemark.plans.audit import audit
from tidemark.report import writers
from tidemark.sources.tables import InputError, Splits, read_table, with_positions

SF = "/root/testdata/sf0.001"


def table(spark, cols, rows):
    return spark.createDataFrame([tuple(r) for r in rows], cols)


def rules_of(report):
    return {r.rule_id for r in report.findings.collect()}


def only(rule, **data):
    return Config(select=(rule,), data=DataConfig(**data))


def test_overlap_and_conflicts(spark):
    c = "a long, b double, target long"
    train = table(spark, c, [(1, 0.5, 0), (2, None, 1), (3, float("nan"), 0), (1, 0.5, 1), (4, -0.0, 1)])
    test = table(spark, c, [(1, 0.5, 1), (3, None, 0), (9, 1.0, 0), (4, 0.0, 1), (1, 0.5, 0)])
    r = audit(spark, train, test, target="target", config=only("D001"))
    f = r.findings.collect()
    assert len(f) == 1 and r.completion == "complete" and r.exit_code() == 1
    e = json.loads(f[0].evidence)
    assert (e["overlap_rows"], e["identities"], e["conflict_rows"], e["right_rows"]) == (4, 3, 1, 5)
    assert [1, 0] not in e["examples"] and len(e["examples"]) == 4
    assert rules_of(audit(spark, train, test.filter("a = 9"), target="target", config=only("D001"))) == set()


def test_kinds_never_meet_but_missing_values_do(spark):
    a = table(spark, "_pos long, x long", [(1, 1), (2, None)])
    b = table(spark, "_pos long, x double", [(11, 1.0), (12, None)])
    assert [(r.r_pos, r.l_pos) for r in overlap.first_match(a, b, ["x"]).collect()] == [(12, 2)]


def test_identity_columns(spark):
    c = "id long, x long, target long"
    a, b = table(spark, c, [(1, 5, 0), (2, 6, 0)]), table(spark, c, [(1, 999, 0)])
    assert rules_of(audit(spark, a, b, target="target", config=only("D001", hash_include=("id",)))) == {"D001"}
    assert rules_of(audit(spark, a, b, target="target", config=only("D001", hash_include=("id",), hash_exclude=("id",)))) == set()
    bad = audit(spark, a, b, target="target", config=only("D001", hash_include=("nope",)))
    assert bad.completion == "failed" and bad.diagnostics[0]["code"] == "LP301" and bad.exit_code() == 2


def test_groups_duplicates_time_and_balance(spark):
    c = "x double, who string, at timestamp, target long"
    train = spark.sql("select cast(id as double) x, concat('p', id div 2) who, timestamp'2020-01-01' + make_interval(0,0,0,id) at, if(id < 97, 0L, 1L) target from range(100)")
    test = spark.sql("select cast(id div 2 as double) + 500 x, concat('p', id + 48) who, timestamp'2020-02-01' + make_interval(0,0,0,id div 2) at, 0L target from range(4)")
    got = rules_of(audit(spark, train, test, target="target", group="who", time="at", config=Config(select=("D003", "D007", "TM001", "M001"))))
    assert got == {"D003", "TM001", "M001"}
    dup = audit(spark, train, test.union(test), target="target", group="who", time="at", config=only("D007")).findings.collect()
    assert json.loads(dup[0].evidence)["duplicate_rows"] == 4
    late = table(spark, c, []) if False else test.withColumn("at", F.expr("timestamp'2031-01-01'")).withColumn("who", F.lit("new"))
    assert rules_of(audit(spark, train, late, target="target", group="who", time="at", config=Config(select=("D003", "TM001")))) == set()


def test_bad_times_make_the_report_partial(spark):
    a, b = table(spark, "at string, x long", [("2020-01-01", 1), ("soon", 2)]), table(spark, "at string, x long", [("2021-01-01", 3)])
    r = audit(spark, a, b, time="at", config=only("TM001"))
    assert r.completion == "partial" and r.diagnostics[0]["code"] == "LP330" and r.exit_code() == 2 and r.exit_code(True) == 0


@pytest.mark.parametrize("change", [{"target": "none"}, {"kinds": {"x": "odd"}}, {"group": 3}])
def test_invalid_roles(spark, change):
    a = table(spark, "x long", [(1,)])
    r = audit(spark, a, a, **change)
    assert r.completion == "failed" and r.diagnostics[0]["code"] == "LP300"
    with pytest.raises(InputError):
        Splits({"train": a, "test": a.withColumnRenamed("x", "y")})


def test_quality_notes(spark):
    a = table(spark, "x double, s string", [(float("inf"), None), (float("nan"), "q")])
    r = audit(spark, a, a.limit(0), config=only("D003"))
    assert {"train.x: 1 missing", "train.x: 1 infinite", "train.s: 1 missing", "test is empty"} <= set(r.notes)


def test_near_numbers_and_texts(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, r)) for r in rng.random((30, 4))]
    near = [tuple(x + 1e-6 for x in r) for r in rows[:10]]
    c = "a double, b double, c double, d double"
    r = audit(spark, table(spark, c, rows), table(spark, c, near), config=only("D002")).findings.collect()
    assert json.loads(r[0].evidence)["rows"] == 10 and r[0].advisory and not r[0].gateable
    far = [tuple(x + 10 for x in r) for r in rows]
    assert rules_of(audit(spark, table(spark, c, rows), table(spark, c, far), config=only("D002"))) == set()
    a = table(spark, "t string", [("the quick brown fox jumps over the lazy dog again and again",), ("",)])
    b = table(spark, "t string", [("The quick  brown fox jumps over the lazy dog again and again!",), ("",), ("nothing of the kind is said in here at all",)])
    r = audit(spark, a, b, config=only("D002")).findings.collect()
    assert len(r) == 1 and json.loads(r[0].evidence)["rows"] == 1


def shingles(t):
    t = " ".join(t.lower().split())
    return {t[i : i + 5] for i in range(max(1, len(t) - 4))} if t else set()


def test_text_join_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "_pos long, text string")
    left, right = df.filter("_pos % 3 < 2"), df.filter("_pos % 3 = 2")
    sets = {i: shingles(t) for i, t in docs}
    for t in (0.8, 0.3):
        want = {b: sum(len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) for a, _ in docs if a % 3 < 2) for b, _ in docs if b % 3 == 2}
        got = similarity.text_near_rows(similarity.text_links(left, right, "text", t)).collect()
        assert sum(r["rows"] for r in got) == sum(1 for v in want.values() if v)
        assert sum(r.links * r["rows"] for r in got) == sum(want.values())


def test_text_join_in_many_blocks_writes_no_pairs(spark, tmp_path, monkeypatch):
    """Few words, so that most texts share fingerprints: steps hold a row a class, whatever the pairs."""
    monkeypatch.setattr(similarity, "BLOCK", 4096)
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    docs = [" ".join(rng.choice(words, int(rng.integers(20, 60)))) for _ in range(200)]
    near = " ".join(rng.choice(words, 80))
    docs += [near + " " + w for w in words[:40]] + [near, near, "a", "b", "a", "abcde", "abcdef"]
    df = spark.createDataFrame(list(enumerate(docs)), "_pos long, text string")
    held = {}

    def put(name, t):
        t.write.parquet(f"{tmp_path}/{name}{len(held)}")
        t = spark.read.parquet(f"{tmp_path}/{name}{len(held)}")
        held[f"{name}{len(held)}"] = t.count()
        return t

    left, right = df.filter("_pos % 3 < 2"), df.filter("_pos % 3 = 2")
    got = {r.r_pos: (r["rows"], r.links, round(r.best, 9), r.l_pos) for r in similarity.text_near_rows(similarity.text_links(left, right, "text", 0.8, put)).collect()}
    sets, want, first = {i: shingles(t) for i, t in enumerate(docs)}, {}, {}
    for b in range(2, len(docs), 3):
        b0 = first.setdefault(docs[b], b)
        score = {a: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(docs)) if a % 3 < 2}
        if near := {a: x for a, x in score.items() if x >= 0.8}:
            n = want[b0][0] + 1 if b0 in want else 1
            want[b0] = (n, len(near), round(max(near.values()), 9), min(a for a, x in near.items() if x == max(near.values())))
    assert got == want
    assert any(n > 3 for k, n in held.items() if k.startswith("sketches_")) and max(held.values()) <= len(set(docs))


def test_near_texts_without_exact_ones_join_digests(spark):
    from tidemark.plans import queries

    df = queries.d002_minus_exact(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if " Join " in x and "text#" in x]
    assert "sha2(cast(text" in plan
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(r.r_pos, r.l_pos) for r in similarity.text_near_rows(similarity.text_links(*queries.halves(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id"), "text")).collect()}
    first = {}
    for i, t in sorted(docs):
        if i % 5 < 4:
            first.setdefault(t, i)
    assert {(r.r_pos, r.l_pos) for r in df.collect()} == want - {(i, first[t]) for i, t in docs if i % 5 == 4 and t in first}


def test_vector_join_equals_brute_force_and_visits_few(spark, monkeypatch):
    """Many components: the first axes tell little, planes between pivots do."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(similarity, "PIVOTS", 16)
    monkeypatch.setattr(similarity, "HELD", 5)
    x = rng.normal(0, 0.125, (300, 64))
    y = np.r_[x[:60] + rng.normal(0, 0.015, (60, 64)), rng.normal(0, 0.125, (40, 64)), x[60:62]]
    x = np.r_[x, x[60:61]]
    rows = lambda m: [(i, [float(v) for v in r]) for i, r in enumerate(m)]
    odd = [(900, None), (901, [None] * 64), (902, [float("nan")] * 64), (903, [1.0] * 9), (904, [float("inf")] * 64)]
    df = lambda m: spark.createDataFrame(rows(m) + odd, "_pos long, v array<double>")
    got = {r.r_pos: (r.l_pos, round(r.distance, 9)) for r in similarity.nearest_within(df(x), df(y), 0.02).collect()}
    want = {903: (903, 0.0)}
    for j, b in enumerate(y):
        d = np.sqrt(((x - b) ** 2).sum(1)) / 8
        if d.min() <= 0.02:
            want[j] = (int(d.argmin()), round(float(d.min()), 9))
    assert got == want and len(want) > 50
    grid = similarity._by_grid(df(x).select(F.col("_pos").alias("l_pos"), F.col("v").alias("lv")), df(y).select(F.col("_pos").alias("r_pos"), F.col("v").alias("rv")), 0.02, 64, 3)
    assert {r.r_pos: (r.l_pos, round(r.distance, 9)) for r in grid.collect()} == want


def test_numeric_join_looks_once_at_equal_rows(spark, monkeypatch):
    seen, plain = [], similarity._by_grid
    monkeypatch.setattr(similarity, "_by_grid", lambda low, high, *a: seen.append(high.count()) or plain(low, high, *a))
    left = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [9.0, 9.0])], "_pos long, v array<double>")
    right = spark.createDataFrame([(k, [0.5, 1.001]) for k in range(20)] + [(20, [9.0, 8.0]), (21, None)], "_pos long, v array<double>")
    got = {(r.r_pos, r.l_pos) for r in similarity.nearest_within(left, right, 0.01).collect()}
    assert got == {(k, 1) for k in range(20)} and seen == [3]


def test_numeric_join_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x, y = rng.random((200, 3)).round(2), rng.random((80, 3)).round(2)
    df = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "_pos long, v array<double>")
    got = {r.r_pos: (r.l_pos, round(r.distance, 9)) for r in similarity.nearest_within(df(x), df(y), 0.08).collect()}
    want = {}
    for j, b in enumerate(y):
        d = np.sqrt(((x - b) ** 2).sum(1)) / np.sqrt(3)
        k = min(range(len(x)), key=lambda i: (round(d[i], 12), i))
        if d[k] <= 0.08:
            want[j] = round(float(d[k]), 9)
    assert {k: v[1] for k, v in got.items()} == want


def test_hamming_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 40, np.int64)
    left = [(i, int(v)) for i, v in enumerate(base)]
    right = [(i, int(v) ^ sum(1 << int(b) for b in rng.choice(63, i % 7, replace=False))) for i, v in enumerate(base)] + [(90, None)]
    df = lambda r: spark.createDataFrame(r, "_pos long, h long")
    got = {r.r_pos: (r.l_pos, r.distance) for r in similarity.hamming_links(df(left), df(right), "h", 4).collect()}
    assert got == {i: (i, i % 7) for i in range(40) if i % 7 <= 4}


def test_predictivity(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 80)
    rows = [(float(n), int(v), int(v)) for n, v in zip(rng.random(80), y, strict=True)]
    c = "noise double, leak long, target long"
    f = audit(spark, table(spark, c, rows), table(spark, c, rows[:20]), target="target", config=only("D005")).findings.collect()
    assert [json.loads(r.evidence)["feature"] for r in f] == ["leak"]
    cols = [[float(v) for v in rng.random(4)] for _ in y]
    rows = [(*r[:3], float(v + rng.normal(0, 0.01)), int(v)) for r, v in zip(cols, y, strict=True)]
    c = "f1 double, f2 double, f3 double, proxy double, target long"
    assert rules_of(audit(spark, table(spark, c, rows), table(spark, c, rows[:9]), target="target", config=only("D006"))) == {"D006"}
    rows = [(*r[:3], r[3], int(v)) for r, v in zip(cols, y, strict=True)]
    assert rules_of(audit(spark, table(spark, c, rows), table(spark, c, rows[:9]), target="target", config=Config(select=("D005", "D006")))) == set()


def test_area_under_the_curve_with_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k % 4), float(rng.integers(0, 6)), int(rng.integers(0, 2)), k) for k in range(120)]
    m = spark.createDataFrame(rows, "f int, x double, y int, _pos long")
    got = {r.fold: r.auc for r in predictivity.fold_auc(predictivity.melt(m, ["x"], F.col("y"), F.col("f"))).collect()}
    for f in range(4):
        test, rest = [r for r in rows if r[0] == f], [r for r in rows if r[0] != f]
        cov = np.cov([r[1] for r in rest], [r[2] for r in rest])[0, 1]
        pairs = [(a[1], b[1]) for a, b in itertools.product(test, test) if a[2] > b[2]]
        area = np.mean([1.0 if p > q else 0.5 if p == q else 0.0 for p, q in pairs])
        assert abs(got[f] - (area if cov > 0 else 1 - area)) < 1e-9


def test_missing_values_in_features(spark):
    rows = [(None if k % 5 == 0 else float(k), "a" if k % 2 else None, k % 2) for k in range(40)]
    c = "x double, s string, target long"
    r = audit(spark, table(spark, c, rows), table(spark, c, rows[:5]), target="target", config=Config(select=("D005", "D006")))
    assert "s" in {json.loads(f.evidence)["feature"] for f in r.findings.collect()}


def test_sampling_and_kinds(spark):
    df = spark.range(100).withColumnRenamed("id", "_pos").withColumn("p", F.concat(F.lit("img/"), "_pos", F.lit(".PNG"))).withColumn("k", F.lit("a"))
    assert statistics.fixed_sample(df, 7).count() == 7 and statistics.head_sample(df, 5).count() == 5
    assert statistics.fixed_sample(df, 7).collect() == statistics.fixed_sample(df.repartition(3), 7).collect()
    got = {r.column: r.looks_like_image for r in statistics.column_kinds(df).collect()}
    assert got == {"p": True, "k": False}
    r = audit(spark, df.drop("_pos"), df.drop("_pos"), config=only("D002"))
    assert r.diagnostics[0]["code"] == "LP330"


def test_positions_follow_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text("x\n" + "\n".join(str(k * 10 + i) for i in range(4)) + "\n")
    df = with_positions(read_table(spark, str(tmp_path / "p0.csv")).limit(4))
    assert df.count() == 4
    spark.range(20).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    got = with_positions(read_table(spark, str(tmp_path / "t.parquet"))).orderBy("id").collect()
    assert [r._pos for r in got] == list(range(20))
    with pytest.raises(InputError):
        read_table(spark, "x.json")


def test_reports(spark):
    a = table(spark, "x long", [(1,), (2,)])
    r = audit(spark, a, a, config=Config(select=("D001", "D007")))
    rows = writers.rows_of(r)
    j = json.loads(writers.to_json(rows, r))
    assert j["summary"]["total"] == 1 and j["completion"] == "complete" and j["coverage"]["executed_checks"] == ["D001", "D007"]
    s = json.loads(writers.to_sarif(rows, r))
    assert s["runs"][0]["results"][0]["ruleId"] == "D001" and s["runs"][0]["results"][0]["level"] == "error"
    assert "| D001 | critical |" in writers.to_markdown(rows, r)
    assert "1 findings, 1 gating" in writers.to_text(rows, r)
    assert json.loads(writers.to_json([{"rule_id": "X", "severity": "low", "category": "c", "layer": "data", "score": float("nan")}]))["findings"][0]["score"] is None


def test_mutual_information_reads_all_rows(spark):
    n = 250_000
    df = spark.range(n).select(F.col("id").alias("_pos"), (F.col("id") * 7919 % 1000).cast("double").alias("x"), F.when(F.col("id") * 7919 % 1000 + F.col("id") % 300 > 600, "b").alias("y"))
    got = {r.feature: r.mi for r in predictivity.continuous_mi(df, ["x", "_pos"], "y").collect()}
    i = np.arange(n)
    x, y = (i * 7919 % 1000).astype(float), (i * 7919 % 1000 + i % 300 > 600).astype(float)
    for name, v in (("x", x), ("_pos", i.astype(float))):
        at = np.lexsort((y + 1, v))
        assert abs(got[name] - predictivity.knn_mi(v[at], y[at] + 1)) < 1e-9


def test_mutual_information_in_many_ranges(spark, monkeypatch):
    """No task holds a feature, and ranges that cut ties and rare classes change nothing."""
    from tidemark.plans.queries import writer

    monkeypatch.setattr(predictivity, "HELD", 900)
    monkeypatch.setattr(predictivity, "DRAWN", 700)
    rng, n = np.random.default_rng(5), 12_000
    y = np.where(np.arange(n) == 77, 9, np.where(rng.random(n) < 0.0004, 3, np.where(rng.random(n) < 0.4, 1, 0)))
    cols = {"ties": np.floor(rng.random(n) * 4) + y % 2, "many": rng.lognormal(size=n) * (1 + y % 2), "one": np.ones(n), "small": np.r_[rng.random(n - 3), 1e6, 2e6, -1e6]}
    df = spark.createDataFrame([(*map(float, v), f"c{c}") for *v, c in zip(*cols.values(), y, strict=True)], ", ".join(f"{c} double" for c in cols) + ", y string")
    ranges = []

    def put(name, t):
        t = writer(spark)(name, t)
        if name == "cells":
            ranges.append(t.filter("y < 0").groupBy("f").count().agg({"count": "min"}).first()[0])
        return t

    # Ranks come in several files.
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = {r.feature: r.mi for r in predictivity.continuous_mi(df, list(cols), "y", put).collect()}
    finally:
        for k in conf:
            spark.conf.unset(k)
    code = np.unique(y, return_inverse=True)[1].astype(float)
    for name, v in cols.items():
        at = np.lexsort((code, v))
        assert abs(got[name] - predictivity.knn_mi(v[at], code[at])) < 1e-7, name
    assert ranges[0] >= 10


def test_runs_are_spread_in_any_order(monkeypatch):
    """A batch may hold the rows of several files, whose ranks do not follow each other."""
    monkeypatch.setattr(predictivity, "DRAWN", 3)
    n, start = np.array([2, 3, 4]), np.array([4, 6, 0])
    batch = pa.record_batch({"f": pa.array([0, 0, 0], pa.int32()), "x": pa.array([50.0, 60.0, 10.0]), "y": pa.array([0, 0, 0], pa.int32()), "n": n, "start": start})
    told = {"drawn": 3, "states": predictivity._draws(9), "scale": {0: 1.0}, "near": {0: np.array([3])}}
    got = np.sort(np.concatenate([x for _, x, _ in predictivity._spread(iter([batch]), told)]))
    noise = np.random.default_rng(0).normal(0, 1e-10, 9)
    assert (got == np.sort(np.repeat([10.0, 50.0, 60.0], [4, 2, 3]) + noise)).all()


def test_all_held_out_embeddings_are_searched(spark, tmp_path):
    from tidemark.plans import queries

    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 64))
    for k in range(4, 200, 15):  # near copies of train rows, at distances around 0.02
        v[k] = v[k - 1] + rng.normal(scale=0.006 + 0.0002 * k, size=64)
    spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(200)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.r_pos: r.distance for r in queries.QUERIES["d002_embeddings_all"](spark, str(tmp_path)).collect()}
    train = np.array([i for i in range(200) if i % 5 < 4])
    best = {i: np.sqrt(((v[train] - v[i]) ** 2).mean(1).min()) for i in range(4, 200, 5)}
    want = {i: x for i, x in best.items() if x <= 0.02}
    assert 2 < len(want) < len(best) and got.keys() == want.keys()
    assert all(abs(got[i] - x) < 2e-6 for i, x in want.items())


def test_folds_say_why_there_are_none(spark):
    rows = [(float(i), "a" if i else "b", i) for i in range(20)]
    train = table(spark, "x double, target string, at long", rows)
    r = audit(spark, train, train.limit(2), target="target", config=only("D005"))
    assert r.unavailable == ["D005"] and "fewer than two rows" in r.diagnostics[0]["message"] and r.completion == "partial"
    for data, told in ((train.filter("at < 3"), "four rows"), (train.filter("at > 0"), "two classes")):
        assert told in audit(spark, data, train, target="target", config=only("D005")).diagnostics[0]["message"]
    timed = table(spark, "x double, target string, at timestamp", [(1.0, "ab"[i % 2], None) for i in range(20)])
    assert "no time" in audit(spark, timed, timed, target="target", time="at", config=only("D005")).diagnostics[0]["message"]


def test_time_comes_before_groups_and_classes(spark):
    # What x says of the target turns over in the second half: only folds in time see that.
    rows = spark.range(400).selectExpr("cast(if(id < 200, id % 2, 1 - id % 2) as double) x", "cast(id % 2 as string) target", "timestamp_seconds(id) at")
    plain = audit(spark, rows.drop("at"), rows.drop("at"), target="target", config=only("D005", target_score=0.7))
    turned = audit(spark, rows.filter("at < timestamp_seconds(200)"), rows, target="target", time="at", config=only("D005", target_score=0.99))
    assert rules_of(plain) == set() and rules_of(turned) == {"D005"}
    blocks = predictivity.time_folds(rows.withColumn("_pos", F.unix_seconds("at")), "at", 3).groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("t")).orderBy("block").collect()
    assert [r.n for r in blocks] == [100] * 4 and sorted(r.t for r in blocks) == [r.t for r in blocks]
    one = spark.range(50).selectExpr("timestamp_seconds(7) at", "id _pos")
    assert [r.n for r in predictivity.time_folds(one, "at", 4).groupBy("block").agg(F.count("*").alias("n")).orderBy("block").collect()] == [10] * 5


def test_several_classes_and_numbers_are_scored(spark):
    three = spark.range(300).selectExpr("cast(id as double) + rand(1) x", "rand(2) noise", "concat('c', id div 100) target")
    e = [json.loads(f.evidence) for f in audit(spark, three, three, target="target", config=only("D005", target_score=0.9)).findings.collect()]
    assert [x["feature"] for x in e] == ["x"]
    number = spark.range(400).selectExpr("concat('s', id % 4) s", "concat('t', id % 3) t", "(id % 4) * 10 + rand(3) target")
    e = [json.loads(f.evidence) for f in audit(spark, number, number, target="target", config=only("D005", target_score=0.9)).findings.collect()]
    assert [x["feature"] for x in e] == ["s"]


@pytest.mark.parametrize("ordered", [False, True])
def test_missing_values_are_the_training_median(spark, ordered):
    rnd = np.random.default_rng(5)
    rows = [("f", int(i % 4), None if i % 7 == 0 else float(rnd.normal() + (i % 3)), float(i % 3 == 0)) for i in range(120)]
    m = table(spark, "feature string, fold int, x double, y double", rows)
    got = {r.fold: r.r2 for r in predictivity.fold_r2(m, ordered).collect()}
    for k in range(1 if ordered else 0, 4):
        learn = [r for r in rows if (r[1] < k if ordered else r[1] != k)]
        known = sorted(r[2] for r in learn if r[2] is not None)
        med = known[(len(known) - 1) // 2]
        x, y = (np.array([v for v in c]) for c in zip(*[(med if r[2] is None else r[2], r[3]) for r in learn], strict=True))
        u, v = (np.array([w for w in c]) for c in zip(*[(med if r[2] is None else r[2], r[3]) for r in rows if r[1] == k], strict=True))
        b, a = np.polyfit(x, y, 1)
        assert abs(got[k] - (1 - ((v - a - b * u) ** 2).sum() / ((v - v.mean()) ** 2).sum())) < 1e-9
    assert set(got) == set(range(1 if ordered else 0, 4))
