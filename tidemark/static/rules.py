"""Static rules: filters and joins over the facts of a source tree.

Each rule gives path, line, col, cell, rule_id, name. ``findings`` unions them,
drops what comments suppress, and adds severity and confidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import has_hint
from ..registry import RULES
from .frameworks import GROUP_HINTS, TARGET_HINTS, TIME_HINTS

OUT = ["path", "line", "col", "cell", "rule_id", "name"]
HELD = ("test", "val")


def _held() -> Column:
    return F.arrays_overlap("sides", F.array(*[F.lit(x) for x in HELD]))


def _is(kind: str) -> Column:
    return F.array_contains("symbols", kind)


def _out(df: DataFrame, rule: str | Column) -> DataFrame:
    return df.select("path", "line", "col", "cell", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), F.coalesce("name", F.lit("")).alias("name")).distinct()


def _keys(df: DataFrame, column: str, *more: str) -> DataFrame:
    return df.select("path", F.explode(column).alias("key"), *more)


def _touches(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of df of which one of the column's keys is among ``keys`` (path, key)."""
    hit = df.select("path", "seq", F.explode(column).alias("key")).join(keys.select("path", "key").distinct(), ["path", "key"], "left_semi")
    return df.join(hit.select("path", "seq").distinct(), ["path", "seq"], "left_semi")


class Rules:
    def __init__(self, facts: DataFrame):
        self.f = facts
        kind = lambda k: facts.filter(F.col("kind") == k)
        self.fits, self.splits, self.calls, self.concats = kind("fit"), kind("split"), kind("call"), kind("concat")
        self.attributes, self.columns, self.assigns = kind("attribute"), kind("column"), kind("assign")
        self.cv = self.calls.filter(_is("cv"))
        self.metrics = self.calls.filter(_is("metric") | ((F.col("name") == "score") & F.col("cls").isNotNull()))

    # Which fits leak, and the one rule that owns each.
    def owned_fits(self) -> DataFrame:
        fits = self.fits.filter(_is("transformer") | _is("selector") | _is("resampler") | _is("imputer") | _is("pipeline"))
        into_split = _keys(self.splits, "closure").unionByName(_keys(self.splits, "args"))
        before = _touches(fits, "args", into_split).unionByName(_touches(fits, "outs", into_split)).select("path", "seq").distinct().withColumn("_before", F.lit(True))
        both = self.concats.filter(F.size(F.array_intersect(F.array_distinct("sides"), F.array(*[F.lit(x) for x in ("train", "test", "val")]))) > 1)
        joined = _touches(fits, "args", _keys(both, "outs")).select("path", "seq").withColumn("_concat", F.lit(True))
        f = fits.join(before, ["path", "seq"], "left").join(joined, ["path", "seq"], "left")
        seen = _held()
        full = F.array_contains("sides", "full")
        leaky = seen | full | F.coalesce("_before", F.lit(False)) | F.coalesce("_concat", F.lit(False))
        rule = (
            F.when(_is("pipeline"), F.when(seen, "S001"))
            .when(F.col("in_pipeline"), F.lit(None))
            .when(F.coalesce("_concat", F.lit(False)), "P002")
            .when(_is("resampler"), "S003")
            .when(_is("selector"), "S004")
            .when(_is("imputer"), "P003")
            .when(_is("stateless"), F.lit(None))
            .when(F.col("name") == "fit_transform", "P001")
            .otherwise("S001")
        )
        return f.filter(leaky).withColumn("_rule", rule).filter("_rule is not null").drop("_before", "_concat")

    def cv_fits(self) -> DataFrame:
        """Fits whose output a cross-validation or a search reads."""
        some = _is("transformer") | _is("selector") | _is("resampler") | _is("imputer")
        fits = self.fits.filter(some & ~_is("stateless") & ~F.col("in_pipeline"))
        searches = self.fits.filter(_is("search"))
        return _touches(fits, "outs", _keys(self.cv, "closure").unionByName(_keys(searches, "closure")))

    def full_fits(self) -> DataFrame:
        """Without those that C001 owns."""
        return _out(self.owned_fits().join(self.cv_fits().select("path", "seq"), ["path", "seq"], "left_anti"), F.col("_rule"))

    def c001(self) -> DataFrame:
        return _out(self.cv_fits(), "C001")

    def _hinted(self, hints: tuple[str, ...]) -> DataFrame:
        named = self.columns.unionByName(self.assigns).filter(has_hint(F.col("name"), list(hints)))
        said = self.calls.filter(F.col("name").isin("to_datetime", "sort_values", "sort_index", "set_index") & has_hint(F.coalesce("text", F.lit("")), list(hints)))
        return named.select("path").unionByName(said.select("path")).distinct()

    def c002(self) -> DataFrame:
        plain = self.calls.filter(_is("folds")).join(self.calls.filter(_is("group_folds")).select("path"), "path", "left_anti")
        return _out(plain.filter(~F.map_contains_key("keywords", "groups")).join(self._hinted(GROUP_HINTS), "path", "left_semi"), "C002")

    def c003(self) -> DataFrame:
        ordered = self.calls.filter("name = 'TimeSeriesSplit'").select("path")
        return _out(self.calls.filter(_is("folds")).join(ordered, "path", "left_anti").join(self._hinted(TIME_HINTS), "path", "left_semi"), "C003")

    def c004(self) -> DataFrame:
        return _out(self.fits.filter(_is("search") & F.array_contains("sides", "test")), "C004")

    def c005(self) -> DataFrame:
        best = self.attributes.filter("name = 'best_score_'")
        nested = _keys(self.cv, "args").unionByName(_keys(self.calls.filter((_is("metric") | F.col("name").isin("score", "predict")) & _held()), "args"))
        checked = _touches(best, "args", nested).select("path", "seq")
        return _out(best.join(checked, ["path", "seq"], "left_anti"), "C005")

    def c006(self) -> DataFrame:
        encoder = self.calls.filter("name = 'TargetEncoder' and not in_pipeline")
        chain = F.coalesce(F.col("keywords")["<chain>"], F.lit(""))
        grouped = self.calls.filter(F.col("name").isin("transform", "agg", "apply", "mean") & chain.contains("groupby") & ((F.col("name") == "mean") | F.coalesce("text", F.lit("")).rlike("mean|median|sum")))
        target = self.columns.filter(has_hint(F.col("name"), list(TARGET_HINTS))).select("path", "line").distinct()
        return _out(encoder, "C006").unionByName(_out(grouped.join(target, ["path", "line"], "left_semi"), "C006"))

    def m002(self) -> DataFrame:
        curves = self.calls.filter(_is("curve") & F.array_contains("sides", "test"))
        chosen = self.assigns.filter(F.lower("name").rlike("thresh|cutoff"))
        return _out(_touches(curves, "outs", _keys(chosen, "closure")), "M002")

    def m003(self) -> DataFrame:
        spread = F.col("name").isin("std", "var", "sem", "quantile", "percentile", "nanstd", "confidence_interval")
        told = self.attributes.unionByName(self.calls).filter(spread).select("path").distinct()
        means = self.attributes.unionByName(self.calls).filter(F.col("name").isin("mean", "average", "nanmean"))
        of_cv = _touches(means, "args", _keys(self.cv, "outs"))
        return _out(of_cv.join(told, "path", "left_anti").dropDuplicates(["path", "line"]), "M003")

    def m004(self) -> DataFrame:
        on = self.metrics.filter(F.size("sides") > 0)
        train = on.filter(F.array_contains("sides", "train") & ~_held() & ~F.array_contains("sides", "full"))
        held = on.filter(_held()).select("path", "name").distinct()
        return _out(train.join(held, ["path", "name"], "left_anti"), "M004")

    def r001(self) -> DataFrame:
        has = lambda k: F.map_contains_key("keywords", k)
        kw = lambda k: F.coalesce(F.col("keywords")[k], F.lit(""))
        every = self.calls.unionByName(self.splits)
        asked = (
            F.when(F.col("name").isin("KFold", "StratifiedKFold"), kw("shuffle") == "True")
            .when(F.col("name") == "LogisticRegression", kw("solver").rlike("liblinear|sag"))
            .when(F.col("name") == "SVC", kw("probability") == "True")
            .when(F.col("name") == "train_test_split", kw("shuffle") != "False")
            .otherwise(_is("seeded"))
        )
        bare = every.filter((_is("seeded") | _is("seeded_if")) & asked & ~has("random_state") & ~has("seed") & ~has("**"))
        seeded = every.filter("name in ('seed', 'set_global_seed', 'seed_everything')").groupBy("path").agg(F.min("line").alias("_from"))
        left = bare.join(seeded, "path", "left").filter((F.col("name") == "train_test_split") | F.col("_from").isNull() | (F.col("_from") > F.col("line")))
        return _out(left, "R001")

    def r002(self) -> DataFrame:
        uses = self.f.filter("kind = 'import' and (name = 'torch' or name like 'torch.%')").groupBy("path").agg(F.min("line").alias("line"), F.min("col").alias("col"), F.min("cell").alias("cell"))
        seed = self.calls.filter("name in ('manual_seed', 'seed_everything')").select("path").distinct()
        fixed = self.calls.filter("name = 'use_deterministic_algorithms'").select("path", "line", (F.coalesce(F.col("keywords")["mode"], "text", F.lit("True")) != "False").alias("on"))
        fixed = fixed.unionByName(self.f.filter("kind = 'setting' and name = 'deterministic'").select("path", "line", (F.col("text") == "True").alias("on")))
        ok = fixed.groupBy("path").agg(F.max_by("on", "line").alias("on")).filter("on").join(seed, "path", "left_semi")
        return _out(uses.join(ok, "path", "left_anti").withColumn("name", F.lit("torch")), "R002")

    def s002(self) -> DataFrame:
        shuffled = self.splits.filter((F.col("name") == "train_test_split") & (F.coalesce(F.col("keywords")["shuffle"], F.lit("True")) != "False"))
        name = lambda k: F.regexp_extract(k, r":([^#]*)#", 1)
        hint = self.columns.filter(has_hint(F.col("name"), list(TIME_HINTS))).select("path", "scope", F.col("receiver").alias("v"))
        hint = hint.unionByName(self.calls.filter(F.col("name").isin("sort_values", "set_index") & has_hint(F.coalesce("text", F.lit("")), list(TIME_HINTS))).select("path", "scope", F.col("receiver").alias("v"))).distinct()
        tied = shuffled.select("path", "scope", "seq", F.explode(F.transform("args", name)).alias("v")).join(hint, ["path", "scope", "v"], "left_semi")
        return _out(shuffled.join(tied.select("path", "seq").distinct(), ["path", "seq"], "left_semi"), "S002")

    def t002(self) -> DataFrame:
        test = F.exists(F.array(*[F.coalesce(F.col("kw_sides")[k], F.lit("")) for k in ("eval_set", "validation_data", "evals", "valid_sets", "eval_data")]), lambda s: s == "test")
        return _out(self.fits.unionByName(self.calls).filter(test), "T002")

    def t003(self) -> DataFrame:
        return _out(self.f.filter("kind = 'selection_loop' and name = 'varied'"), "T003")

    def tm002(self) -> DataFrame:
        step = F.coalesce(F.col("keywords")["periods"], F.col("keywords")["<first>"], F.lit(""))
        ahead = self.calls.filter((F.col("name") == "shift") & step.startswith("-"))
        into_target = has_hint(F.coalesce(F.col("keywords")["<to>"], F.lit("")), list(TARGET_HINTS))
        centred = self.calls.filter((F.col("name") == "rolling") & (F.coalesce(F.col("keywords")["center"], F.lit("")) == "True")).join(self.splits.select("path").distinct(), "path", "left_semi")
        return _out(ahead.filter(~into_target), "TM002").unionByName(_out(centred, "TM002"))

    def parts(self) -> dict[str, DataFrame]:
        """Lazy plans by rule; rules on full fits share one."""
        full = self.full_fits()
        names = ("c001", "c002", "c003", "c004", "c005", "c006", "m002", "m003", "m004", "r001", "r002", "s002", "t002", "t003", "tm002")
        return {r: full for r in ("P001", "P002", "P003", "S001", "S003", "S004")} | {n.upper(): getattr(self, n)() for n in names}

    def all(self, only: tuple[str, ...] | None = None) -> DataFrame:
        asked = [p for r, p in self.parts().items() if only is None or r in only]
        out = reduce(DataFrame.unionByName, list({id(p): p for p in asked}.values()))
        if only is not None:
            out = out.filter(F.col("rule_id").isin(*only))
        whole = self.f.filter("kind = 'suppress' and name = 'ignore-file'").select("path").distinct()
        some = self.f.filter("kind = 'suppress' and name = 'ignore'").select("path", "line", F.explode("args").alias("rule_id"))
        return out.join(whole, "path", "left_anti").join(some, ["path", "line", "rule_id"], "left_anti")


def findings(facts: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    meta = facts.sparkSession.createDataFrame([(r.id, r.category, r.severity, r.static_confidence, r.advisory, r.title) for r in RULES.values() if r.static_confidence], "rule_id string, category string, severity string, confidence double, advisory boolean, title string")
    return Rules(facts).all(only).join(F.broadcast(meta), "rule_id")
