"""python -m tidemark: check sources, audit tables, list and explain rules."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, config
from .plans import findings as rel
from .plans.audit import Report, audit
from .registry import RULES, chosen
from .report import writers
from .sources.tables import InputError, read_table


def session() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def check_sources(spark: SparkSession, paths: list[str], conf: config.Config) -> Report:
    from .static import extract, rules

    facts = extract.extract(extract.read_sources(spark, *paths, exclude=conf.exclude)).cache()
    on = [r.id for r in chosen(conf.select, conf.ignore, ("static",), conf.severity)]
    found = rules.findings(facts).filter(F.col("rule_id").isin(*on))
    none = F.lit(None).cast("string")
    rows = found.select(
        "rule_id", "category", _severity(conf).alias("severity"), F.lit("static").alias("layer"), F.concat("title", F.lit(" ("), "name", F.lit(")")).alias("message"),
        F.col("path").alias("file"), F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), none.alias("label"), F.col("cell").cast("long").alias("cell_index"),
        "confidence", "advisory", none.alias("fix"), F.lit("{}").alias("evidence"), F.col("name").alias("identity"),
    )
    issues = [{"code": r["name"], "rule_id": None, "message": f"{r['path']}: {r['text']}", "level": "warning", "layer": "static"} for r in facts.filter("kind = 'problem'").collect()]
    report = Report(rel.ordered(rel.gated(rel.dedupe(rows), conf.fail_on, conf.gate_confidence)), issues, on)
    report.completion = "partial" if any(i["code"] != "LP201" for i in issues) else "complete"
    return report


def _severity(conf: config.Config):
    out = F.col("severity")
    for rule, s in conf.severity.items():
        out = F.when(F.col("rule_id") == rule, F.lit(s)).otherwise(out)
    return out


def corpus_summary(findings: DataFrame, domains: DataFrame) -> DataFrame:
    """domain, rule_id, n over a tree whose top folders are repositories. domains: repo, domain."""
    repo = F.regexp_extract("file", r"([^/]+)/[^/]*$", 1)
    return findings.withColumn("repo", repo).join(domains, "repo", "left").rollup("domain", "rule_id").agg(F.count("*").cast("long").alias("n"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="do", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--config")
    common.add_argument("--format", action="append", choices=sorted(writers.FORMATS))
    common.add_argument("--output")
    common.add_argument("--select", action="append")
    common.add_argument("--ignore", action="append")
    common.add_argument("--fail-on")
    common.add_argument("--min-confidence", type=float)
    common.add_argument("--allow-partial", action="store_true", default=None)
    c = sub.add_parser("check", parents=[common])
    c.add_argument("paths", nargs="+")
    d = sub.add_parser("audit-data", parents=[common])
    for a in ("train", "test"):
        d.add_argument(f"--{a}", required=True)
    for a in ("val", "target", "group", "time"):
        d.add_argument(f"--{a}")
    sub.add_parser("rules")
    e = sub.add_parser("explain")
    e.add_argument("rule")
    sub.add_parser("version")
    a = p.parse_args(argv)
    if a.do == "version":
        print(__version__)
        return 0
    if a.do == "rules":
        for r in chosen():
            print(f"{r.id:<6} {r.severity:<8} {','.join(r.layers):<16} {r.title}")
        return 0
    if a.do == "explain":
        if a.rule not in RULES:
            print(f"no rule {a.rule}", file=sys.stderr)
            return 2
        r = RULES[a.rule]
        print(f"{r.id}: {r.title}\n{r.category}, {r.severity}, confidence {r.confidence}{', advisory' if r.advisory else ''}\n{r.fix}")
        return 0
    try:
        conf = config.load(file=a.config, select=a.select, ignore=a.ignore, fail_on=a.fail_on, min_confidence=a.min_confidence, allow_partial=a.allow_partial)
        spark = session()
        if a.do == "check":
            report = check_sources(spark, a.paths, conf)
        else:
            tables = {k: read_table(spark, getattr(a, k)) for k in ("train", "test", "val") if getattr(a, k)}
            report = audit(spark, **tables, target=a.target, group=a.group, time=a.time, config=conf)
    except (config.ConfigError, InputError, FileNotFoundError, ValueError) as err:
        print(err, file=sys.stderr)
        return 2
    writers.write(writers.rows_of(report, conf.min_confidence), report, a.format or ["text"], a.output)
    return report.exit_code(conf.allow_partial)
