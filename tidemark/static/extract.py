"""From source text to fact rows.

A file is walked once, statement by statement. Names have versions; a binding's
side is full, train, test, val or unknown. Where branches disagree it is
unknown; after a loop both ways are merged. What depends on later statements
(a split of data that was fitted on before) is left to joins on versions.
"""

from __future__ import annotations

import ast
import fnmatch
import io
import json
import os
import re
import tokenize
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..registry import RULES
from .frameworks import kinds_of

FACTS = (
    "path string, scope string, seq int, line int, col int, kind string, name string, cls string, symbols array<string>, receiver string, "
    "args array<string>, sides array<string>, outs array<string>, keywords map<string,string>, kw_sides map<string,string>, "
    "closure array<string>, in_pipeline boolean, in_loop boolean, cell int, text string"
)
COLUMNS = [c.strip().split(" ")[0] for c in re.split(r",\s+(?=\w+ )", FACTS)]
SIDES = ("train", "test", "val")


def merge(sides: list[str]) -> str:
    known = {s for s in sides if s != "unknown"}
    if "full" in known or len(known) > 1:
        return "full"
    return known.pop() if known else "unknown"


def by_name(name: str) -> str:
    low = name.lower()
    if re.search(r"(^|_)(test|te|holdout)$", low):
        return "test"
    if re.search(r"(^|_)(val|valid|validation|dev)$", low):
        return "val"
    return "train" if re.search(r"(^|_)(train|tr)$", low) else "unknown"


class Scope:
    def __init__(self, name: str, parent: Scope | None = None):
        self.name = name
        self.version: dict[str, int] = dict(parent.version) if parent else {}
        self.side: dict[str, str] = {}
        self.cls: dict[str, str] = {}
        self.deps: dict[str, set[str]] = {}
        self.piped: set[str] = set()
        self.imports: dict[str, str] = dict(parent.imports) if parent else {}
        self.local: set[str] = set(parent.local) if parent else set()

    def key(self, name: str) -> str:
        return f"{self.name}:{name}#{self.version.get(name, 0)}"


class Walker(ast.NodeVisitor):
    def __init__(self, path: str, lines: list[tuple[int, int]] | None = None):
        self.path, self.rows, self.scope, self.loop, self.pipe = path, [], Scope("<module>"), 0, 0
        self.cells = lines

    def fact(self, node: ast.AST, kind: str, **values) -> None:
        line = getattr(node, "lineno", 0)
        row = dict.fromkeys(COLUMNS)
        row |= {"path": self.path, "scope": self.scope.name, "seq": len(self.rows), "line": line, "col": getattr(node, "col_offset", 0), "kind": kind, "symbols": [], "args": [], "sides": [], "outs": [], "keywords": {}, "kw_sides": {}, "closure": [], "in_pipeline": self.pipe > 0, "in_loop": self.loop > 0}
        if self.cells and 0 < line <= len(self.cells):
            row["cell"] = self.cells[line - 1][0]
        self.rows.append(row | values)

    # What an expression reads.
    def names(self, node: ast.AST | None) -> list[str]:
        return [n.id for n in ast.walk(node) if isinstance(n, ast.Name)] if node is not None else []

    def side(self, node: ast.AST | None) -> str:
        if node is None:
            return "unknown"
        found = []
        for n in dict.fromkeys(self.names(node)):
            s = self.scope.side.get(n, "unknown")
            found.append(s if s != "unknown" else by_name(n))
        return merge(found)

    def tail(self, f: ast.AST) -> str | None:
        return f.attr if isinstance(f, ast.Attribute) else self.scope.imports.get(f.id, f.id) if isinstance(f, ast.Name) else None

    def class_of(self, node: ast.AST | None) -> str | None:
        if isinstance(node, ast.Name):
            return self.scope.cls.get(node.id)
        if isinstance(node, ast.Call):
            t = self.tail(node.func)
            if isinstance(node.func, ast.Attribute) and t in ("fit", "set_params", "set_output"):
                return self.class_of(node.func.value)
            if isinstance(node.func, ast.Name) and node.func.id in self.scope.local:
                return None
            return t
        return None

    def bind(self, target: ast.AST, side: str, cls: str | None, value: ast.AST | None) -> list[str]:
        out = []
        if isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                out += self.bind(t, side, None, value)
            return out
        if isinstance(target, ast.Starred):
            return self.bind(target.value, side, None, value)
        if not isinstance(target, ast.Name):
            return out
        s, n = self.scope, target.id
        deps = set()
        for d in self.names(value):
            deps |= {s.key(d), *s.deps.get(s.key(d), ())}
        s.version[n] = s.version.get(n, 0) + 1
        s.side[n] = side
        s.local.add(n)
        s.piped.discard(n)
        s.cls.pop(n, None)
        if cls:
            s.cls[n] = cls
            if "pipeline" in kinds_of(cls):
                s.piped.add(n)
        s.deps[s.key(n)] = deps
        out.append(s.key(n))
        self.fact(target, "assign", name=n, outs=[s.key(n)], closure=sorted(deps), sides=[side])
        return out

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.scope.imports[a.asname or a.name.split(".")[0]] = a.name
            self.fact(node, "import", name=a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.scope.imports[a.asname or a.name] = a.name
            self.scope.local.discard(a.asname or a.name)
            self.fact(node, "import", name=f"{node.module or ''}.{a.name}")

    def visit_FunctionDef(self, node) -> None:
        outer, loop, pipe = self.scope, self.loop, self.pipe
        outer.local.add(node.name)
        self.scope = Scope(f"{outer.name}.{node.name}", outer)
        self.loop = self.pipe = 0
        for a in [*node.args.args, *node.args.kwonlyargs]:
            self.scope.side[a.arg] = by_name(a.arg)
            self.scope.local.add(a.arg)
        for s in node.body:
            self.visit(s)
        self.scope, self.loop, self.pipe = outer, loop, pipe

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node: ast.Assign) -> None:
        self.assign(node.targets, node.value, node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value is not None:
            self.assign([node.target], node.value, node)

    def assign(self, targets: list[ast.AST], value: ast.AST, node: ast.AST) -> None:
        calls = len(self.rows)
        self.visit(value)
        made = self.rows[calls:]
        for t in targets:
            if isinstance(t, ast.Subscript):
                base, key = t.value, t.slice
                if isinstance(base, ast.Name) and isinstance(key, ast.Constant):
                    self.fact(t, "column", name=str(key.value), args=[self.scope.key(base.id)], receiver=base.id)
                    for r in made:
                        r["keywords"] = {**r["keywords"], "<to>": str(key.value)}
                continue
            outs = self.split_outputs(t, value) if isinstance(value, ast.Call) and "splitter" in kinds_of(self.tail(value.func)) else self.bind(t, self.side(value), self.class_of(value), value)
            for r in made:
                if r["kind"] in ("call", "fit", "split", "concat") and r["outs"] == []:
                    r["outs"] = outs
                    if isinstance(t, ast.Name):
                        r["keywords"] = {**r["keywords"], "<to>": t.id}
        if isinstance(value, (ast.Constant, ast.Attribute)) and isinstance(targets[0], ast.Attribute):
            self.fact(node, "setting", name=targets[0].attr, text=ast.unparse(value))

    def split_outputs(self, target: ast.AST, call: ast.Call) -> list[str]:
        names = target.elts if isinstance(target, (ast.Tuple, ast.List)) else [target]
        inputs = [a for a in call.args if not isinstance(a, ast.Starred)]
        inner = [self.side(a) for a in inputs]
        out = []
        for k, t in enumerate(names):
            inside = inner[k // 2] if k // 2 < len(inner) else "unknown"
            side = "train" if k % 2 == 0 else "val" if inside == "train" else "test"
            out += self.bind(t, side if inside not in ("test", "val") else inside, None, call)
        return out

    def visit_If(self, node: ast.If) -> None:
        self.visit(node.test)
        before = dict(self.scope.side)
        for s in node.body:
            self.visit(s)
        one, self.scope.side = self.scope.side, before
        for s in node.orelse:
            self.visit(s)
        two = self.scope.side
        self.scope.side = {n: one.get(n, "unknown") if one.get(n) == two.get(n, one.get(n)) else "unknown" for n in {**one, **two}}

    def visit_For(self, node) -> None:
        self.visit(node.iter)
        self.loop += 1
        before = dict(self.scope.side)
        for t in node.target.elts if isinstance(node.target, (ast.Tuple, ast.List)) else [node.target]:
            self.bind(t, by_name(t.id.replace("_idx", "").replace("_index", "")) if isinstance(t, ast.Name) else "unknown", None, node.iter)
        start = len(self.rows)
        for s in node.body:
            self.visit(s)
        self.loop -= 1
        body = self.rows[start:]
        best = any(isinstance(n, ast.Call) and self.tail(n.func) in ("max", "min") and len(n.args) == 2 for s in node.body for n in ast.walk(s)) or any(
            isinstance(n, ast.If) and isinstance(n.test, ast.Compare) and any("best" in x.lower() for x in self.names(n.test)) for s in node.body for n in ast.walk(s)
        )
        scored = any(r["kind"] == "call" and ({"cv", "metric"} & set(r["symbols"]) or r["name"] == "score") for r in body)
        varied = any(w in x.lower() for x in [*self.names(node.target)] for w in ("seed", "config", "param", "run", "trial", "state"))
        if best and scored:
            self.fact(node, "selection_loop", name="varied" if varied else "plain")
        for s in node.orelse:
            self.visit(s)
        self.scope.side = {n: merge([before.get(n, v), v]) for n, v in self.scope.side.items()}

    visit_AsyncFor = visit_For

    def visit_While(self, node: ast.While) -> None:
        self.visit(node.test)
        self.loop += 1
        for s in node.body:
            self.visit(s)
        self.loop -= 1

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if isinstance(node.value, ast.Name):
            n = node.value.id
            self.fact(node, "attribute", name=node.attr, receiver=n, cls=self.scope.cls.get(n), args=[self.scope.key(n)])
        self.generic_visit(node)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        if isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            base = node.value.id if isinstance(node.value, ast.Name) else None
            self.fact(node, "column", name=node.slice.value, args=[self.scope.key(base)] if base else [], receiver=base)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        f, tail = node.func, self.tail(node.func)
        piped = "pipeline" in kinds_of(tail)
        self.pipe += piped
        self.visit(f)
        for a in [*node.args, *[k.value for k in node.keywords]]:
            self.visit(a)
        self.pipe -= piped
        if tail is None or (isinstance(f, ast.Name) and f.id in self.scope.local and f.id not in self.scope.imports):
            return
        s = self.scope
        values = [a for a in node.args if not isinstance(a, ast.Starred)]
        args = list(dict.fromkeys(s.key(n) for a in values for n in self.names(a)))
        got = {k.arg or "**": ast.unparse(k.value) for k in node.keywords}
        sides = {k.arg: self.side(k.value) for k in node.keywords if k.arg}
        kw_args = list(dict.fromkeys(s.key(n) for k in node.keywords for n in self.names(k.value)))
        common = {"name": tail, "symbols": kinds_of(tail), "args": args, "sides": [self.side(a) for a in values], "keywords": got, "kw_sides": sides}
        text = ",".join(a.value for a in values if isinstance(a, ast.Constant) and isinstance(a.value, str)) or None
        owner = f.value if isinstance(f, ast.Attribute) else None
        cls = self.class_of(owner)
        receiver = owner.id if isinstance(owner, ast.Name) else None
        common["receiver"] = receiver
        closure = {x for a in args for x in (a, *s.deps.get(a, ()))}
        if tail in ("fit", "fit_transform", "fit_resample", "fit_predict", "partial_fit", "train") and owner is not None:
            in_pipe = self.pipe > 0 or bool(receiver and receiver in s.piped)
            self.fact(node, "fit", cls=cls, closure=sorted(closure), in_pipeline=in_pipe, **common | {"symbols": kinds_of(cls)})
        elif "splitter" in common["symbols"]:
            self.fact(node, "split", closure=sorted(closure), **common)
        elif tail in ("concat", "vstack", "concatenate", "append", "union", "unionByName") and args:
            axis = got.get("axis", "0")
            each = [self.side(e) for a in values for e in (a.elts if isinstance(a, (ast.List, ast.Tuple)) else [a])]
            self.fact(node, "concat" if axis not in ("1", "'columns'") else "call", **common | {"sides": each})
        else:
            inner = owner
            chain = []
            while inner is not None:  # df.groupby(...)[...].transform(...)
                if isinstance(inner, ast.Call):
                    chain.append(self.tail(inner.func) or "")
                    inner = inner.func.value if isinstance(inner.func, ast.Attribute) else None
                elif isinstance(inner, (ast.Subscript, ast.Attribute)):
                    inner = inner.value
                else:
                    break
            base = [s.key(n) for n in self.names(owner)] if owner is not None else []
            number = next((ast.unparse(a) for a in values if isinstance(a, (ast.UnaryOp, ast.Constant)) and not isinstance(getattr(a, "value", None), str)), None)
            self.fact(node, "call", cls=cls, closure=sorted(closure | {y for b in base for y in (b, *s.deps.get(b, ()))}), text=text or (number if tail != "shift" else None), **common | {"args": list(dict.fromkeys([*args, *kw_args, *base])), "keywords": got | ({"<first>": number} if number else {}) | ({"<chain>": ">".join(chain)} if chain else {})})


def comments(text: str) -> Iterator[tuple[int, str]]:
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                yield t.start[0], t.string
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return


_IGNORE = re.compile(r"#\s*tidemark:\s*(ignore-file|ignore)(?:\[([A-Z0-9, ]+)\])?")


def notebook(raw: str) -> tuple[str, list[tuple[int, int]], list[str]]:
    """Code cells below each other, the cell of each line, and what went wrong. Magics become pass."""
    lines, cells, issues = [], [], []
    for k, cell in enumerate(json.loads(raw).get("cells", [])):
        if cell.get("cell_type") != "code":
            continue
        src = cell.get("source", "")
        src = ("".join(src) if isinstance(src, list) else str(src)).split("\n")
        if src and src[0].lstrip().startswith("%%"):
            continue
        plain = [re.sub(r"^(\s*)[%!].*$", r"\1pass", x) for x in src]
        try:
            ast.parse("\n".join(plain))
        except SyntaxError:
            issues.append(f"cell {k} cannot be read")
            continue
        for n, x in enumerate(plain):
            lines.append(x)
            cells.append((k, n + 1))
    return "\n".join(lines), cells, issues


def facts_of(path: str, content: str | bytes) -> list[dict]:
    """All facts of a file; bytes are decoded as their first lines say. What cannot be read gives a
    fact of kind ``problem``."""
    cells, issues = None, []
    w = Walker(path)
    try:
        if not isinstance(content, str):
            raw = bytes(content)
            code = "utf-8" if path.endswith(".ipynb") else tokenize.detect_encoding(io.BytesIO(raw).readline)[0]
            content = raw.decode(code)
        if path.endswith(".ipynb"):
            content, cells, issues = notebook(content)
            w.cells = cells
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as e:
        w.fact(ast.Module([], []), "problem", name="LP000", text=str(e))
        return w.rows
    for i in issues:
        w.fact(ast.Module([], []), "problem", name="LP007", text=i)
    for s in tree.body:
        w.visit(s)
    for line, text in comments(content):
        if m := _IGNORE.search(text):
            row = ast.Constant(None, lineno=line, col_offset=0)
            ids = [x.strip() for x in (m[2] or "").split(",") if x.strip()]
            odd = [x for x in ids if x not in RULES]
            if m[1] == "ignore" and (odd or not ids):  # it says nothing: nothing is silenced by it
                w.fact(row, "problem", name="LP201", text=f"unknown rule {', '.join(odd)}" if odd else "ignore needs the ids of rules in brackets")
            if m[1] == "ignore-file" or len(ids) > len(odd):
                w.fact(row, "suppress", name=m[1], args=[x for x in ids if x not in odd])
    return w.rows


#: Folders that hold no source of one's own.
PRUNED = (".git", ".hg", ".tox", ".nox", ".venv", "venv", "__pycache__", "node_modules", ".ipynb_checkpoints", "site-packages")


def read_sources(spark: SparkSession, *paths: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, content (bytes) of .py and .ipynb files below the paths, each once.

    Left out are folders of ``PRUNED`` and what ``exclude`` names: a path below one of the roots or the
    beginning of one, a pattern with * and ?, or a folder anywhere.
    """
    found = None
    for p in paths:
        for g in ("*.py", "*.ipynb"):
            try:
                part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", g).load(p)
            except Exception as e:
                raise FileNotFoundError(f"LP003: {p} cannot be read") from e
            root = p.split("://", 1)[-1] if "://" in p else os.path.abspath(p)
            inside = F.element_at(F.split("path", f"\\Q{root.rstrip('/')}/\\E", 2), -1)
            part = part.select("path", "content", inside.alias("_inside"))
            found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("LP002: no paths")
    for x in (*PRUNED, *exclude):
        part = x.rstrip("/")
        out = (F.col("_inside") == part) | F.col("_inside").startswith(f"{part}/") | F.concat(F.lit("/"), "_inside").contains(f"/{part.strip('/')}/")
        if set(part) & set("*?["):
            out = out | F.col("_inside").rlike(f"^{fnmatch.translate(part)}") | F.col("_inside").rlike(f"^{fnmatch.translate(part + '/*')}")
        found = found.filter(~out)
    return found.drop("_inside").dropDuplicates(["path"])


#: Files whose facts a task holds at once.
FILES = 64


def extract(sources: DataFrame, put: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Facts of (path, content) rows; a file is one unit of work, and files are dealt to all tasks.

    Rules read facts many times: ``put(name, df)`` may write them so that files are walked once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for o in range(0, len(b), FILES):
                part = b.iloc[o : o + FILES]
                rows = [r for p, c in zip(part["path"], part["content"], strict=True) for r in facts_of(p, "" if c is None else c)]
                yield pd.DataFrame(rows, columns=COLUMNS)

    spark = sources.sparkSession
    ship(spark)
    tasks = 4 * max(spark.sparkContext.defaultParallelism, 1)
    facts = sources.select("path", "content").repartition(tasks, "path").mapInPandas(run, FACTS)
    return put("facts", facts) if put else facts
