"""Report formats. ``rows`` are dicts of the findings relation with reasons and gateable."""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from pathlib import Path

from .. import __version__

_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def safe(x):
    """NaN and infinities have no place in JSON."""
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {str(k): safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [safe(v) for v in x]
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def rows_of(report, min_confidence: float = 0.0) -> list[dict]:
    return [r.asDict() | {"evidence": json.loads(r["evidence"] or "{}")} for r in report.findings.filter(report.findings.confidence >= min_confidence).collect()]


def counts(rows: list[dict]) -> dict:
    return {"total": len(rows), "gated": sum(bool(r.get("gateable")) for r in rows), "advisory": sum(bool(r.get("advisory")) for r in rows)} | {f"by_{k}": dict(sorted(Counter(r[c] for r in rows).items())) for k, c in (("severity", "severity"), ("category", "category"), ("layer", "layer"), ("rule", "rule_id"))}


def to_json(rows: list[dict], report=None) -> str:
    extra = {}
    if report is not None:
        extra = {"diagnostics": report.diagnostics, "completion": report.completion, "coverage": {"executed_checks": sorted(set(report.executed)), "unavailable_checks": sorted(set(report.unavailable)), "sampled_checks": sorted(set(report.sampled)), "notes": report.notes}}
    return json.dumps(safe({"version": "2.0", "tool": {"name": "tidemark", "version": __version__}, "summary": counts(rows), "findings": rows, **extra}), indent=2, sort_keys=True)


def fingerprint(r: dict) -> str:
    parts = [r["rule_id"], r["layer"], r.get("file") or "", str(r.get("line") or ""), r.get("label") or "", r.get("identity") or ""]
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:32]


def to_sarif(rows: list[dict], report=None) -> str:
    from ..registry import RULES

    results = []
    for r in rows:
        place: dict = {}
        if r.get("file"):
            place["physicalLocation"] = {"artifactLocation": {"uri": r["file"]}} | ({"region": {"startLine": r["line"], "startColumn": (r.get("col") or 0) + 1}} if r.get("line") else {})
        if r.get("label"):
            place["logicalLocations"] = [{"fullyQualifiedName": r["label"]}]
        results.append({"ruleId": r["rule_id"], "level": _LEVEL[r["severity"]], "message": {"text": r["message"]}, "locations": [place] if place else [], "partialFingerprints": {"tidemark/v1": fingerprint(r)}, "properties": {"confidence": r["confidence"], "advisory": r["advisory"]}})
    used = sorted({r["rule_id"] for r in rows})
    rules = [{"id": i, "shortDescription": {"text": RULES[i].title if i in RULES else i}} for i in used]
    done = report is None or report.completion == "complete"
    notes = [{"level": "warning", "message": {"text": f"{d['code']}: {d['message']}"}} for d in (report.diagnostics if report is not None else [])]
    run = {"tool": {"driver": {"name": "tidemark", "version": __version__, "rules": rules}}, "results": results, "invocations": [{"executionSuccessful": done, "toolExecutionNotifications": notes}]}
    return json.dumps(safe({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}), indent=2)


def to_markdown(rows: list[dict], report=None, top: int = 25) -> str:
    c = counts(rows)
    esc = lambda t: str(t).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    out = ["# Audit", "", f"{c['total']} findings, {c['gated']} of them gating; status {report.completion if report is not None else 'complete'}.", "", "| rule | severity | confidence | where | what |", "|-|-|-|-|-|"]
    for r in rows[:top]:
        where = f"{r['file']}:{r['line']}" if r.get("file") else r.get("label") or ""
        out.append(f"| {r['rule_id']} | {r['severity']} | {r['confidence']:.2f} | {esc(where)} | {esc(r['message'])} |")
    if len(rows) > top:
        out.append(f"\n{len(rows) - top} more.")
    out += [f"- {esc(d['code'])}: {esc(d['message'])}" for d in (report.diagnostics if report is not None else [])]
    return "\n".join(out) + "\n"


def to_text(rows: list[dict], report=None) -> str:
    rank = list(_LEVEL)
    out = []
    for f in sorted({r.get("file") or r.get("label") or "" for r in rows}):
        out.append(f or "data")
        for r in sorted((r for r in rows if (r.get("file") or r.get("label") or "") == f), key=lambda r: (rank.index(r["severity"]), r["rule_id"])):
            out.append(f"  {r['severity']:<8} {r['rule_id']:<6} {r['confidence']:.2f} {('line ' + str(r['line'])) if r.get('line') else ''} {r['message']}".rstrip())
    c = counts(rows)
    out.append(f"{c['total']} findings, {c['gated']} gating" + (f", {report.completion}" if report is not None else ""))
    return "\n".join(out) + "\n"


FORMATS = {"json": (to_json, ".json"), "sarif": (to_sarif, ".sarif"), "markdown": (to_markdown, ".md"), "text": (to_text, ".txt")}


def write(rows: list[dict], report, formats: list[str], output: str | None) -> list[str]:
    """Prints one format, or writes stem.suffix per format."""
    made = []
    for f in formats:
        text = FORMATS[f][0](rows, report)
        if output is None:
            print(text, end="")
        else:
            p = Path(output) if len(formats) == 1 else Path(output).with_suffix(FORMATS[f][1])
            p.write_text(text)
            made.append(str(p))
    return made
