"""Settings, rules, command line, catalogue, streams."""

import pytest
from pyspark.sql import functions as F
from tidemark import cli, config
from tidemark.plans import queries
from tidemark.registry import RULES, Rule, chosen, register
from tidemark.runtime import rules as runtime
from tidemark.streaming import events


def test_thirty_rules():
    assert len(RULES) == 30
    assert sum(bool(r.static_confidence) for r in RULES.values()) == 21
    assert [r.id for r in chosen(("D*",), ("D00[56]",))] == ["D001", "D002", "D003", "D007"]
    assert chosen(("D001",), severities={"D001": "low"})[0].severity == "low"
    assert len(chosen(layers=("runtime",))) == 11
    with pytest.raises(ValueError):
        register(RULES["D001"])
    with pytest.raises(ValueError):
        register(Rule("X001", "t", "c", "awful", ("data",), 0.5))


def test_settings(tmp_path):
    (tmp_path / "pyproject.toml").write_text("[tool.tidemark]\nfail-on = 'low'\n[tool.tidemark.data]\nfolds = 3\n")
    (tmp_path / "tidemark.toml").write_text("profile = 'research'\n")
    c = config.load(tmp_path, ignore=("R*",))
    assert (c.fail_on, c.data.folds, c.min_confidence, c.ignore) == ("low", 3, 0.0, ("R*",))
    for bad in ("nope = 1", "fail_on = 'x'", "[data]\ntext_threshold = 0", "profile = 'x'", "= 3"):
        (tmp_path / "own.toml").write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(tmp_path, tmp_path / "own.toml")
    with pytest.raises(config.ConfigError):
        config.load(tmp_path, tmp_path / "missing.toml")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("x,y\n3,4\n7,9\n")
    out = tmp_path / "r.json"
    args = ["audit-data", "--train", str(tmp_path / "a.csv"), "--test", str(tmp_path / "b.csv")]
    assert cli.main([*args, "--format", "json", "--output", str(out), "--select", "D001"]) == 1
    assert '"D001"' in out.read_text()
    assert cli.main([*args, "--select", "D003"]) == 0
    assert cli.main(["audit-data", "--train", "x.json", "--test", "y.json"]) == 2
    (tmp_path / "s.py").write_text("from sklearn.model_selection import train_test_split\na, b = train_test_split(frame)\n")
    assert cli.main(["check", str(tmp_path), "--fail-on", "low"]) == 0
    assert "R001" in capsys.readouterr().out
    assert cli.main(["rules"]) == 0 and cli.main(["explain", "D001"]) == 0 and cli.main(["explain", "Z"]) == 2 and cli.main(["version"]) == 0


@pytest.mark.parametrize("name", ["d001_docs_overlap", "d005_auc_numeric", "d006_dominance", "findings_gate", "runtime_t001", "d002_numeric_lineitem", "runtime_fit_leak", "runtime_content_match", "corpus_confusion", "d002_hamming_embeddings", "static_suppressions", "typ_columns"])
def test_catalogue_equals_duckdb(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "labels", "lineitem", "orders", "events", "conversations", "embeddings", "supplier"):
        c.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    cur = c.execute(queries.SQL[name])
    cols = [x[0] for x in cur.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr({k: plain(v) for k, v in sorted(zip(cols, r, strict=True))}) for r in cur.fetchall())
    got = sorted(repr({k: plain(v) for k, v in sorted(r.asDict().items())}) for r in queries.QUERIES[name](spark, d).collect())
    assert got == want


def test_runtime_rules_name_one_owner(spark):
    row = lambda *k: [("d", x) for x in k]
    log = spark.createDataFrame(
        [
            ("s", 1, "fit", "a.py:1", "PCA", "fit_transform", row("1", "9"), row(), [], [], False),
            ("s", 2, "fit", "a.py:2", "PCA", "fit", row("1", "9"), row(), [], [], True),
            ("s", 3, "fit", "a.py:3", "KNNImputer", "fit", row("9"), row(), [], [], False),
            ("s", 4, "fit", "a.py:4", "Pipeline", "fit", row("9"), row(), ["SelectKBest"], [], False),
            ("s", 5, "fit", "a.py:5", "Normalizer", "fit", row("9"), row(), [], [], False),
            ("s", 6, "fit", "a.py:6", "GridSearchCV", "fit", row("9"), row("9"), [], [], False),
            ("s", 7, "fit", "a.py:7", "PCA", "fit", row("1"), row(), [], [], False),
            ("s", 8, "score", "a.py:8", "Ridge", "score", row("9"), row(), [], [], False),
            ("s", 9, "score", "a.py:9", "Ridge", "score", row("9"), row(), [], [], False),
            ("s", 10, "cross_validation", "a.py:10", "Ridge", "x", row("1"), row(), [], [7], False),
            ("s", 11, "score", "a.py:11", "Ridge", "score", row("1"), row(), [], [], False),
        ],
        "session_id string, ordinal long, kind string, call_site string, class string, method string, input_rows array<struct<dataset_id:string,row_key:string>>, eval_rows array<struct<dataset_id:string,row_key:string>>, components array<string>, origins array<long>, concat_sources boolean",
    )
    member = spark.createDataFrame([("d", "1", "train"), ("d", "9", "test")], "dataset_id string, row_key string, split string")
    got = {(r.ordinal, r.rule_id) for r in runtime.findings(log, member).collect()}
    assert got == {(1, "P001"), (2, "P002"), (3, "P003"), (4, "S004"), (6, "C004"), (6, "T002"), (9, "T001"), (10, "C001"), (11, "M004")}
    assert {r.ordinal for r in runtime.mixed_concats(log, member).collect()} == {1, 2}


def test_sides_by_content_make_no_pairs(spark):
    from tidemark.runtime import lineage

    df = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") % 2).alias("v"))
    m = F.col("k") % 5
    member = lineage.register_split({"train": df.filter((m < 3) & (F.col("v") == 0)), "test": df.filter((m == 4) | F.col("v").isNull())}, "k", "d")
    part = df.filter("k % 2 = 0").unionByName(df.filter("k = 1"))
    want = lineage.sides(lineage.by_content(part, "k", df, "k", ["v"], "d"), member)
    got = lineage.sides_by_content(part, "k", df, "k", ["v"], "d", member)
    rows = lambda x: sorted((r.row, tuple(r.splits)) for r in x.collect())
    assert rows(got) == rows(want) and rows(got)


def test_ties_of_findings_do_not_hang_on_order(spark):
    from tidemark.plans import findings

    row = lambda adv, fix: ("P001", "c", "high", "static", "m", "f", 1, None, None, None, 0.9, adv, fix, "{}", "")
    rows = [row(True, "a"), row(False, "b"), row(False, "a")]
    for given in (rows, rows[::-1], [rows[1], rows[0], rows[2]]):
        got = findings.dedupe(spark.createDataFrame(given, findings.FINDING).coalesce(1)).collect()
        assert [(r.advisory, r.fix) for r in got] == [(False, "a")]


def test_stream_counts_like_the_batch(spark, tmp_path):
    rows = [("s", k, "score", "x", "m", "score", [("d", str(k % 3))]) for k in range(10)]
    df = spark.createDataFrame(rows, events.EVENT)
    df.filter("ordinal < 6").write.parquet(str(tmp_path / "in"))
    df.filter("ordinal >= 6").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.EVENT).parquet(str(tmp_path / "in"))
    q = events.repeated_evaluations(stream).writeStream.format("memory").queryName("t001").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.ordinal, r.evaluations) for r in spark.sql("select * from t001").collect()}
    assert got == {(k, k // 3 + 1) for k in range(3, 10)}
    w = events.event_counts(spark.createDataFrame([("score", 0), ("fit", 400)], "kind string, s long").withColumn("ts", F.timestamp_seconds("s")), "ts")
    assert w.count() == 2


def test_rest_stands_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(queries.__file__).resolve().parents[2]
    shutil.copytree(top / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not [n for n in q if n.startswith('op') or n == 'pipeline'] and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
