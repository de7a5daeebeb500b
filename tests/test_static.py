"""Each static rule fires on its bad script and nothing fires on the good one."""

import json

import pytest
from pyspark.sql import functions as F
from tidemark.static import extract, rules
from tidemark.static.examples import EXAMPLES as PAIRS
from tidemark.static.examples import CV, HEAD, SCALE, SPLIT

def fired(spark, files):
    src = spark.createDataFrame(files, "path string, content string")
    out: dict = {}
    for r in rules.findings(extract.extract(src).cache()).collect():
        out.setdefault(r.path, set()).add(r.rule_id)
    return out


@pytest.fixture(scope="module")
def results(spark):
    files = [(f"{r}/{s}.py", c) for r, pair in PAIRS.items() for s, c in zip(("bad", "good"), pair, strict=True)]
    return fired(spark, files)


@pytest.mark.parametrize("rule", PAIRS)
def test_pair(results, rule):
    assert rule in results.get(f"{rule}/bad.py", set())
    assert results.get(f"{rule}/good.py", set()) == set()


def test_one_owner_for_each_fit(results):
    owners = {"P001", "P002", "P003", "S001", "S003", "S004"}
    for r in owners:
        assert results[f"{r}/bad.py"] & owners == {r}


def test_suppression_notebooks_and_broken_files(spark):
    bad = HEAD + SPLIT.replace(", random_state=3", "")
    quiet = bad.rstrip("\n") + "  # tidemark: ignore[R001]\n"
    cell = lambda t: {"cell_type": "code", "source": [x + "\n" for x in t.split("\n")]}
    nb = json.dumps({"cells": [cell("%matplotlib inline\nimport pandas as pd"), {"cell_type": "markdown", "source": ["x"]}, cell("def ("), cell(bad)]})
    files = [("a.py", bad), ("b.py", quiet), ("c.py", bad + "# tidemark: ignore-file\n"), ("d.ipynb", nb), ("e.py", "def ("), ("f.py", ""), ("g.ipynb", "{")]
    got = fired(spark, files)
    assert got == {"a.py": {"R001"}, "d.ipynb": {"R001"}}
    facts = extract.extract(spark.createDataFrame(files, "path string, content string"))
    assert {(r.path, r.name) for r in facts.filter("kind = 'problem'").collect()} == {("d.ipynb", "LP007"), ("e.py", "LP000"), ("g.ipynb", "LP000")}
    assert [r.cell for r in rules.findings(facts).filter("path = 'd.ipynb'").collect()] == [3]


def test_local_names_and_branches():
    rows = extract.facts_of("x.py", "def train_test_split(a):\n    return a\nq = train_test_split([1])\n")
    assert not [r for r in rows if r["kind"] == "split"]
    rows = extract.facts_of("x.py", HEAD + SPLIT + "if goal:\n    z = a_train\nelse:\n    z = a_test\nw = z\n")
    assert [r["sides"] for r in rows if r["kind"] == "assign" and r["name"] == "w"] == [["unknown"]]


def test_reads_a_tree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "build").mkdir()
    for p in ("a.py", "sub/b.py", "build/c.py", "d.txt"):
        (tmp_path / p).write_text("x = 1\n")
    got = {r.path.rsplit("/", 1)[1] for r in extract.read_sources(spark, str(tmp_path), exclude=("build/",)).collect()}
    assert got == {"a.py", "b.py"}


def test_bare_and_unknown_suppressions_silence_nothing(spark):
    bad = HEAD + SPLIT.replace(", random_state=3", "").rstrip("\n")
    files = [("a.py", bad + "  # tidemark: ignore\n"), ("b.py", bad + "  # tidemark: ignore[R999]\n"), ("c.py", bad + "  # tidemark: ignore[R001, R999]\n")]
    assert fired(spark, files) == {"a.py": {"R001"}, "b.py": {"R001"}}
    facts = extract.extract(spark.createDataFrame(files, "path string, content string"))
    assert sorted((r.path, r.line) for r in facts.filter("kind = 'problem' and name = 'LP201'").collect()) == [(p, 5) for p in ("a.py", "b.py", "c.py")]


def test_cross_validation_owns_its_fits(spark):
    code = HEAD + CV + SCALE + "flat = mm.fit_transform(frame)\nmarks = cross_val_score(Ridge(), flat, goal)\nprint(marks.std())\n" + SPLIT.replace("frame,", "flat,")
    assert fired(spark, [("a.py", code)])["a.py"] & {"P001", "S001", "C001"} == {"C001"}


def test_excluded_by_prefix_and_pattern(spark, tmp_path):
    for p in ("pkg/old/a.py", "pkg/b.py", "pkg/b_old.py", "c.py", "__pycache__/d.py", "node_modules/e.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    left = lambda *x: {r.path.rsplit("/", 1)[1] for r in extract.read_sources(spark, str(tmp_path), exclude=x).collect()}
    assert left() == {"a.py", "b.py", "b_old.py", "c.py"}
    assert left("pkg/old") == {"b.py", "b_old.py", "c.py"}
    assert left("*_old.py") == {"a.py", "b.py", "c.py"}
    assert left("c.py", "old") == {"b.py", "b_old.py"}


def test_files_are_dealt_and_walked_once(spark):
    """Files of one block go to all tasks, facts are written before rules read them, in parts of few files."""
    bad = PAIRS["P002"][0]
    src = spark.range(3 * extract.FILES, numPartitions=1).select(F.concat(F.lit("s"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit(bad).alias("content"))
    made = []
    facts = extract.extract(src, lambda name, df: made.append((name, df.rdd.getNumPartitions())) or df.localCheckpoint())
    assert made == [("facts", 4 * spark.sparkContext.defaultParallelism)]
    assert facts.groupBy("path").count().agg(F.count("*"), F.min("count") == F.max("count")).first()[:] == (3 * extract.FILES, True)
    assert rules.findings(facts, ("P002",)).select("path").distinct().count() == 3 * extract.FILES
