"""The rules: what they are called, how grave they are, which layers find them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from fnmatch import fnmatchcase
from importlib.metadata import entry_points

SEVERITIES = ("info", "low", "medium", "high", "critical")
LAYERS = ("static", "data", "runtime")


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    category: str
    severity: str
    layers: tuple[str, ...]
    confidence: float
    advisory: bool = False
    #: Of the static layer; 0 where there is none.
    static_confidence: float = 0.0
    default: bool = True
    fix: str = ""


def _rule(id: str, title: str, category: str, severity: str, layers: str, conf: float, adv: bool = False, static: float = 0.0, fix: str = "") -> Rule:
    return Rule(id, title, category, severity, tuple(layers.split()), conf, adv, static, fix=fix)


RULES: dict[str, Rule] = {
    r.id: r
    for r in (
        _rule("C001", "statistics learnt before cross-validation", "cross-validation", "high", "static runtime", 0.90, static=0.70, fix="put the step into the validated pipeline"),
        _rule("C002", "folds that ignore groups", "cross-validation", "high", "static", 0.50, True, 0.50, "use a group-aware splitter"),
        _rule("C003", "folds that ignore time", "cross-validation", "high", "static", 0.50, True, 0.50, "use forward-chaining folds"),
        _rule("C004", "parameters searched on test data", "cross-validation", "high", "static runtime", 0.95, static=0.80, fix="search on training data"),
        _rule("C005", "best search score reported as result", "cross-validation", "medium", "static", 0.45, True, 0.45, "nest the search"),
        _rule("C006", "encoding by the target's mean", "cross-validation", "high", "static", 0.50, static=0.50, fix="encode within folds"),
        _rule("D001", "identical rows on both sides", "data-overlap", "critical", "data", 1.0, fix="drop them or split anew"),
        _rule("D002", "almost identical rows on both sides", "data-overlap", "high", "data", 0.75, True, fix="group similar rows before splitting"),
        _rule("D003", "groups on both sides", "data-overlap", "critical", "data", 1.0, fix="split by group"),
        _rule("D005", "a feature that tells the target", "target-leakage", "high", "data", 0.70, True, fix="check where the feature comes from"),
        _rule("D006", "a feature with outstanding mutual information", "target-leakage", "medium", "data", 0.50, True, fix="check where the feature comes from"),
        _rule("D007", "duplicates within held-out data", "data-overlap", "medium", "data", 0.9, fix="deduplicate"),
        _rule("M001", "imbalanced classes", "metrics", "medium", "data", 0.80, True, fix="report a balanced metric"),
        _rule("M002", "threshold chosen on test data", "metrics", "medium", "static", 0.50, static=0.50, fix="choose it on validation data"),
        _rule("M003", "mean of folds without spread", "metrics", "low", "static", 0.40, True, 0.40, "report the spread"),
        _rule("M004", "metric on training data alone", "metrics", "medium", "static runtime", 0.90, static=0.70, fix="evaluate held-out data"),
        _rule("P001", "transformer fitted before the split", "preprocessing", "high", "static runtime", 0.95, static=0.90, fix="fit on training data"),
        _rule("P002", "fitted on joined training and test data", "preprocessing", "high", "static runtime", 0.95, static=0.92, fix="fit on training data"),
        _rule("P003", "imputer fitted before the split", "preprocessing", "high", "static runtime", 0.95, static=0.88, fix="fit on training data"),
        _rule("R001", "random step without a seed", "reproducibility", "low", "static", 0.70, True, 0.70, "set random_state"),
        _rule("R002", "torch without fixed seeds and algorithms", "reproducibility", "low", "static", 0.50, True, 0.50, "seed and fix algorithms"),
        _rule("S001", "fit sees held-out data", "splitting", "high", "static runtime", 0.95, static=0.85, fix="fit on training data"),
        _rule("S002", "shuffled split of dated data", "splitting", "medium", "static", 0.60, True, 0.60, "split by time"),
        _rule("S003", "resampling before the split", "splitting", "high", "static runtime", 0.95, static=0.85, fix="resample training data"),
        _rule("S004", "feature selection before the split", "splitting", "high", "static runtime", 0.95, static=0.85, fix="select on training data"),
        _rule("T001", "test data scored again", "adaptivity", "high", "runtime", 0.85, fix="score test data once"),
        _rule("T002", "test data guides training", "adaptivity", "high", "static runtime", 0.90, static=0.70, fix="stop on validation data"),
        _rule("T003", "best of several runs kept", "adaptivity", "medium", "static", 0.40, True, 0.40, "report all runs"),
        _rule("TM001", "training data reaches into test time", "temporal", "high", "data", 0.95, fix="split by time"),
        _rule("TM002", "values from the future", "temporal", "high", "static", 0.55, True, 0.55, "use past values"),
    )
}


def register(rule: Rule) -> None:
    if rule.id in RULES:
        raise ValueError(f"rule {rule.id} is already there")
    if rule.severity not in SEVERITIES or not set(rule.layers) <= set(LAYERS) or not 0 <= rule.confidence <= 1:
        raise ValueError(f"rule {rule.id} is malformed")
    RULES[rule.id] = rule


def load_plugins(group: str = "tidemark.rules") -> list[str]:
    """Registers rules of installed packages, each package whole or not at all; gives what failed."""
    issues = []
    for ep in entry_points(group=group):
        before = dict(RULES)
        try:
            for r in ep.load()():
                register(r)
        except Exception as e:
            RULES.clear()
            RULES.update(before)
            issues.append(f"LP101: {ep.name}: {e}")
    return issues


def chosen(select: Iterable[str] = ("ALL",), ignore: Iterable[str] = (), layers: Iterable[str] = LAYERS, severities: dict[str, str] | None = None) -> list[Rule]:
    """Rules by glob, in order of their ids."""
    fits = lambda r, pats: any(fnmatchcase(r.id, p) for p in pats)
    every = "ALL" in select
    out = []
    for r in sorted(RULES.values(), key=lambda r: r.id):
        if not set(r.layers) & set(layers) or fits(r, ignore) or not (fits(r, select) or every and r.default):
            continue
        if severities and r.id in severities:
            if severities[r.id] not in SEVERITIES:
                raise ValueError(f"no severity {severities[r.id]!r}")
            r = replace(r, severity=severities[r.id])
        out.append(r)
    return out
