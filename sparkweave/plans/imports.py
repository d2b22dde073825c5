"""Imports of transform and schema texts, resolved on the driver when planning.

``@import ./file`` lines are read relative to the importing file, inside a root folder.
Codes: I001 missing, I002 outside the root, I003 wrong extension, I004 cycle, I005 too
deep, I006 too many files, I007 too large.
"""

from __future__ import annotations

import re
from pathlib import Path

MAX_DEPTH, MAX_FILES, MAX_BYTES = 32, 100, 10 << 20
LINE = re.compile(r"^\s*@import\s+\"?([^\"\s]+)\"?(?:\s+as\s+(\w+))?\s*$", re.M)


class ImportProblem(ValueError):
    def __init__(self, code: str, path: object):
        super().__init__(f"{code}: {path}")
        self.code = code


def resolve(path: str | Path, root: str | Path, extensions: tuple[str, ...] = (".txt", ".sw")) -> str:
    """The text with its imports put before it, each file once; local entries win because
    they come later."""
    base, seen, parts = Path(root).resolve(), {}, []

    def visit(p: Path, depth: int, chain: tuple[Path, ...]) -> None:
        p = p.resolve()
        if p in chain:
            raise ImportProblem("I004", p)
        if p in seen:
            return
        if not p.is_relative_to(base):
            raise ImportProblem("I002", p)
        if p.suffix not in extensions:
            raise ImportProblem("I003", p)
        if depth > MAX_DEPTH:
            raise ImportProblem("I005", p)
        if len(seen) >= MAX_FILES:
            raise ImportProblem("I006", p)
        if not p.is_file():
            raise ImportProblem("I001", p)
        if p.stat().st_size > MAX_BYTES:
            raise ImportProblem("I007", p)
        text = p.read_text(encoding="utf-8")
        for m in LINE.finditer(text):
            visit(p.parent / m[1], depth + 1, (*chain, p))
        seen[p] = True
        parts.append(LINE.sub("", text))

    visit(Path(path), 0, ())
    return "\n".join(parts)
