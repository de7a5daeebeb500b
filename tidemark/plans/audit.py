"""The data audit: eight rules over split tables, one relation of findings.

A rule is a lazy one-row (or few-row) plan; only those rows reach the driver.
A rule that fails leaves a diagnostic and the others run on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.scalars import type_tag
from ..operators import overlap, predictivity, similarity, statistics
from ..registry import Rule, chosen
from ..sources.tables import InputError, Splits
from . import findings as rel


@dataclass
class Report:
    findings: DataFrame
    diagnostics: list[dict] = field(default_factory=list)
    executed: list[str] = field(default_factory=list)
    unavailable: list[str] = field(default_factory=list)
    sampled: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    completion: str = "complete"

    def exit_code(self, allow_partial: bool = False) -> int:
        if self.completion == "failed" or (self.completion == "partial" and not allow_partial):
            return 2
        return int(self.findings.filter("gateable").limit(1).count() > 0)


class Audit:
    def __init__(self, spark: SparkSession, splits: Splits, config: Config = Config(), put=None):
        self.spark, self.s, self.c, self.put = spark, splits, config, put
        self.report = Report(spark.createDataFrame([], rel.FINDING))
        self.numeric = [f for f in splits.features if type_tag(splits.frames["train"].schema[f].dataType) in ("int", "float", "decimal") and splits.kinds.get(f, "numeric") == "numeric"]
        self.strings = [f for f in splits.features if type_tag(splits.frames["train"].schema[f].dataType) == "string"]

    def problem(self, code: str, rule: str | None, message: str) -> None:
        self.report.diagnostics.append({"code": code, "rule_id": rule, "message": message, "level": "warning", "layer": "data"})

    def run(self) -> Report:
        rows = []
        for rule in chosen(self.c.select, self.c.ignore, ("data",), self.c.severity):
            check = getattr(self, rule.id.lower(), None)
            if check is None:
                continue
            try:
                for label, message, evidence in check():
                    rows.append(self._row(rule, label, message, evidence))
                self.report.executed.append(rule.id)
            except Exception as e:  # one rule never stops the others
                self.problem("LP320", rule.id, f"{type(e).__name__}: {str(e).splitlines()[0][:300]}")
        self.report.notes += [n for n in self.notes()]
        found = self.spark.createDataFrame(rows, rel.FINDING)
        found = rel.gated(rel.dedupe(found), self.c.fail_on, self.c.gate_confidence)
        self.report.findings = rel.ordered(found)
        self.report.completion = "partial" if self.report.diagnostics else "complete"
        return self.report

    def _row(self, rule: Rule, label: str, message: str, evidence: dict) -> tuple:
        return (rule.id, rule.category, rule.severity, "data", message, None, None, None, label, None, rule.confidence, rule.advisory, rule.fix, json.dumps(evidence, default=str), json.dumps({k: evidence[k] for k in ("pair", "split", "feature", "modality") if k in evidence}))

    def notes(self) -> Iterator[str]:
        for r in statistics.quality_counts(self.s.ordered).filter("rows = 0 or missing > 0 or infinite > 0").collect():
            if r["missing"]:
                yield f"{r['split']}.{r['column']}: {r['missing']} missing"
            if r["infinite"]:
                yield f"{r['split']}.{r['column']}: {r['infinite']} infinite"
            if not r["rows"]:
                yield f"{r['split']} is empty"

    def d001(self) -> Iterator[tuple]:
        for a, b in self.s.pairs if self.s.identity_columns else ():
            r = overlap.exact_overlap(self.s.frames[a], self.s.frames[b], self.s.identity_columns, self.s.target, self.c.data.max_examples).first()
            if r["overlap_rows"]:
                yield f"{a}/{b} rows", f"{b} repeats {r['overlap_rows']} row(s) of {a} ({r['fraction']:.1%})", {"pair": [a, b], **r.asDict()}

    def d003(self) -> Iterator[tuple]:
        for a, b in self.s.pairs if self.s.group else ():
            r = overlap.group_overlap(self.s.frames[a], self.s.frames[b], self.s.group, self.c.data.max_examples).first()
            if r["groups"]:
                yield f"{a}/{b} groups", f"{r['groups']} value(s) of {self.s.group} are on both sides of {a} and {b}", {"pair": [a, b], **r.asDict()}

    def d007(self) -> Iterator[tuple]:
        for n, f in self.s.ordered[1:] if self.s.identity_columns else ():
            r = overlap.duplicate_rows(f, self.s.identity_columns).first()
            if r["duplicate_rows"]:
                yield f"{n} duplicates", f"{n} holds {r['duplicate_rows']} repeated row(s) ({r['fraction']:.1%})", {"split": n, **r.asDict()}

    def d002(self) -> Iterator[tuple]:
        texts = [c for c in self.strings if self.s.kinds.get(c) == "text"]
        seen = {r["column"]: r for r in statistics.column_kinds(self.s.frames["train"].select("_pos", *self.strings)).collect()} if self.strings else {}
        texts += [c for c in self.strings if c not in self.s.kinds and c in seen and seen[c]["looks_like_text"] and not seen[c]["looks_like_image"]]
        images = [c for c in self.strings if self.s.kinds.get(c) == "image" or (c not in self.s.kinds and c in seen and seen[c]["looks_like_image"])]
        if images:
            self.report.unavailable.append("D002")
            self.problem("LP330", "D002", f"no image decoder here for {', '.join(images)}")
        dates = [c for c in self.s.features if self.s.kinds.get(c) == "datetime"]
        for a, b in self.s.pairs:
            left, right = self.s.frames[a], self.s.frames[b]
            exact = overlap.first_match(left, right, self.s.identity_columns) if self.s.identity_columns else None
            plans = {c: similarity.text_near_rows(similarity.text_links(left, right, c, self.c.data.text_threshold, self.put)) for c in texts}
            if self.numeric:
                plans["numeric"] = similarity.numeric_near(left, right, self.numeric, self.c.data.numeric_distance)
            plans |= {c: similarity.numeric_near(left, right, [c], self.c.data.numeric_distance) for c in dates}
            for name, near in plans.items():
                if exact is not None:
                    near = overlap.without_exact(near, exact)
                n = F.sum("rows") if "rows" in near.columns else F.count("*")
                r = near.agg(n.alias("n")).first()
                if r["n"]:
                    few = near.orderBy("r_pos").limit(self.c.data.max_examples).select("l_pos", "r_pos").collect()
                    yield f"{a}/{b} near {name}", f"{r['n']} row(s) of {b} are almost equal to rows of {a} by {name}", {"pair": [a, b], "modality": name, "rows": r["n"], "examples": [list(x) for x in few]}

    def m001(self) -> Iterator[tuple]:
        if self.s.target:
            r = statistics.class_balance(self.s.frames["train"], self.s.target).first()
            if r["labelled_rows"] and r["classes"] <= 50 and r["majority_share"] >= self.c.data.imbalance_ratio:
                yield "class balance", f"{r['majority_share']:.1%} of the training rows are of class {r['majority_class']}", r.asDict()

    def tm001(self) -> Iterator[tuple]:
        if not self.s.time:
            return
        ranges = statistics.time_ranges(self.s.ordered, self.s.time)
        seen = ranges.collect()
        if any(r["invalid"] for r in seen):
            self.problem("LP330", "TM001", f"{self.s.time} holds values that are no time")
            return
        if not all(r["times"] for r in seen):
            self.problem("LP330", "TM001", "a split has no times")
        for r in statistics.temporal_overlap(ranges).filter("overlaps").collect():
            yield f"{r['before']}/{r['split']} time", f"{r['before']} ends at {r['before_last']}, after {r['split']} starts at {r['split_first']}", {"pair": [r["before"], r["split"]], "last": str(r["before_last"]), "first": str(r["split_first"])}

    def d005(self) -> Iterator[tuple]:
        target, train = self.s.target, self.s.frames["train"]
        if not target or not self.numeric and not self.strings:
            return
        train = train.filter(F.col(f"`{target}`").isNotNull())
        if not self.c.data.sample_cap >= train.count():
            train = statistics.fixed_sample(train, self.c.data.sample_cap)
            self.report.sampled.append("D005")
        classes = statistics.is_classification(train, target)
        train, why = self._folds(train, classes)
        if why:
            self.report.unavailable.append("D005")
            self.problem("LP330", "D005", why)
            return
        fold, ordered = F.col("_fold"), bool(self.s.time)
        labels = [r[0] for r in train.select(F.col(f"`{target}`").cast("string").alias("t")).distinct().orderBy("t").limit(3).collect()] if classes else []
        cats = [c for c in self.strings if self.s.kinds.get(c, "categorical") == "categorical"]
        parts = []
        if classes and len(labels) == 2 and self.numeric:
            y = (F.col(f"`{target}`").cast("string") == labels[1]).cast("int")
            parts.append(predictivity.summarise(predictivity.fold_auc(predictivity.melt(train, self.numeric, y, fold), ordered), "auc"))
        elif not classes and self.numeric:
            parts.append(predictivity.summarise(predictivity.fold_r2(predictivity.melt(train, self.numeric, F.col(f"`{target}`"), fold), ordered), "r2"))
        elif self.numeric:  # several classes: what is most frequent in each range of values
            few = predictivity.ranged(train, self.numeric)
            parts += [predictivity.summarise(predictivity.fold_accuracy(few, c, target, fold, ordered), "accuracy") for c in self.numeric]
        for c in cats:
            one = predictivity.fold_accuracy(train, c, target, fold, ordered) if classes else predictivity.fold_mean_r2(train, c, target, fold, ordered)
            parts.append(predictivity.summarise(one, "accuracy" if classes else "r2"))
        if not parts:
            return
        got = reduce(DataFrame.unionByName, parts).collect()
        if lost := sorted({*self.numeric, *cats} - {r["feature"] for r in got}):
            self.problem("LP330", "D005", f"no score is defined for {', '.join(lost)}")
        for r in sorted((r for r in got if r["score"] >= self.c.data.target_score), key=lambda r: (-r["score"], r["feature"])):
            yield f"feature {r['feature']}", f"{r['feature']} alone scores {r['score']:.3f} on {target}", r.asDict()

    def _folds(self, train: DataFrame, classes: bool) -> tuple[DataFrame, str]:
        """train with _fold, or why there are none: time comes before groups, groups before classes."""
        k, target = self.c.data.folds, F.col(f"`{self.s.target}`")
        n = train.count()
        if n < 4:
            return train, "fewer than four rows"
        k = min(k, n)
        if self.s.time:
            timed = train.withColumn("_time", statistics.parsed_time(train, self.s.time))
            if timed.filter("_time is null").limit(1).count():
                return train, "some rows have no time"
            if k < 3:
                return train, "fewer than two folds in time"
            return predictivity.time_folds(timed, "_time", max(2, k - 1)).withColumnRenamed("block", "_fold").drop("_time"), ""
        if self.s.group:
            groups = train.agg(F.count_distinct(f"`{self.s.group}`").alias("n")).first()["n"]
            if groups < 2:
                return train, "fewer than two groups"
            return train.withColumn("_fold", predictivity.group_folds(f"`{self.s.group}`", min(k, groups))), ""
        if classes:
            r = train.groupBy(target.cast("string").alias("t")).agg(F.count("*").alias("n")).agg(F.count("*").alias("classes"), F.min("n").alias("least")).first()
            if r["classes"] < 2:
                return train, "the target has fewer than two classes"
            if r["least"] < 2:
                return train, "a class has fewer than two rows"
            return train.withColumn("_fold", predictivity.class_folds(f"`{self.s.target}`", min(k, r["least"]))), ""
        if k < 2:
            return train, "fewer than two folds"
        return train.withColumn("_fold", predictivity.plain_folds("_pos", k)), ""

    def d006(self) -> Iterator[tuple]:
        target, train = self.s.target, self.s.frames["train"]
        if not target or len(self.s.features) < 3:
            return
        train = train.filter(F.col(f"`{target}`").isNotNull())
        if not statistics.is_classification(train, target):  # a number: tenths of its rows are classes
            train = predictivity.ranged(train, [target], 10)
        mi = None
        if self.numeric:
            mi = predictivity.continuous_mi(train, self.numeric, f"`{target}`", self.put)
        if self.strings:
            d = predictivity.mutual_information(train, self.strings, target)
            mi = d if mi is None else mi.unionByName(d)
        for r in predictivity.dominance(mi, self.c.data.mi_floor, self.c.data.mi_ratio).filter("fires").orderBy(F.desc("mi")).collect() if mi is not None else ():
            yield f"feature {r['feature']}", f"{r['feature']} tells {r['mi']:.3f} nats of {target}, the others at most {r['best_other']:.3f}", r.asDict()


def audit(spark: SparkSession, train: DataFrame, test: DataFrame, val: DataFrame | None = None, *, target: str | None = None, group: str | None = None, time: str | None = None, kinds: dict[str, str] | None = None, config: Config = Config()) -> Report:
    """All data rules; tables that don't fit together give a failed report."""
    from .queries import writer

    train, test, val = (x if x is None or isinstance(x, DataFrame) else spark.createDataFrame(x) for x in (train, test, val))
    frames = {"train": train, "test": test} | ({"val": val} if val is not None else {})
    try:
        splits = Splits(frames, target, group, time, kinds or {}, list(config.data.hash_include), list(config.data.hash_exclude))
    except InputError as e:
        code = "LP301" if "identity names" in str(e) else "LP300"
        empty = spark.createDataFrame([], T.StructType([*rel.FINDING.fields, T.StructField("reasons", T.ArrayType(T.StringType())), T.StructField("gateable", T.BooleanType())]))
        return Report(empty, [{"code": code, "rule_id": None, "message": str(e), "level": "error", "layer": "data"}], completion="failed")
    return Audit(spark, splits, config, writer(spark)).run()
