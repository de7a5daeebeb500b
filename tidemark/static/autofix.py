"""Seeds where R001 asks for one: ``random_state=0`` before the closing bracket of the call.

A file is changed only if it is still what was analysed, is written whole or not
at all, and must still parse. Notebooks are never changed.
"""

from __future__ import annotations

import ast
import hashlib
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path


class FixError(ValueError):
    """LP600: the file cannot be changed safely."""


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def seeded(source: str, places: Iterable[tuple[int, int]], seed: int = 0) -> str:
    """The source with a seed in the calls at these (line, column) places."""
    wanted = set(places)
    lines = source.encode().split(b"\n")
    edits = []
    for n in ast.walk(ast.parse(source)):
        if isinstance(n, ast.Call) and (n.lineno, n.col_offset) in wanted and not any(k.arg in ("random_state", None) for k in n.keywords):
            row, col = n.end_lineno - 1, n.end_col_offset - 1
            if lines[row][col : col + 1] != b")":
                raise FixError("LP600: the call's end was not found")
            last = max([*n.args, *[k.value for k in n.keywords]], key=lambda a: (a.end_lineno, a.end_col_offset), default=None)
            comma = b""
            if last is not None:
                rest = b"\n".join([lines[last.end_lineno - 1][last.end_col_offset :], *lines[last.end_lineno : row]]) if last.end_lineno - 1 < row else lines[row][last.end_col_offset : col]
                comma = b"" if b"," in b"\n".join(x.split(b"#")[0] for x in rest.split(b"\n")) else b", "
            edits.append((row, col, comma + f"random_state={seed}".encode()))
    for row, col, text in sorted(edits, reverse=True):
        lines[row] = lines[row][:col] + text + lines[row][col:]
    out = b"\n".join(lines).decode()
    ast.parse(out)
    return out


def apply(path: str | Path, places: Iterable[tuple[int, int]], analysed: str, seed: int = 0) -> bool:
    """Writes the seeded file; False if nothing changes. ``analysed``: digest of the text the findings are of."""
    path = Path(path)
    if path.suffix != ".py":
        raise FixError("LP600: only .py files are changed")
    source = path.read_text()
    if digest(source) != analysed:
        raise FixError("LP600: the file has changed since")
    out = seeded(source, places, seed)
    if out == source:
        return False
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False) as f:
        f.write(out)
    os.chmod(f.name, path.stat().st_mode)
    os.replace(f.name, path)
    return True
