"""Schema texts as data: checks of the definition itself (V017), serialising, flattening."""

from __future__ import annotations

import re

from .formats import NAMES
from .validate import KINDS, Rule, Schema, parse_schema

PREFIX = {v: k for k, v in KINDS.items() if k and not k.isalpha()}


def problems(schema: Schema) -> list[tuple[str, str, str]]:
    """(code, path, message) of what is wrong with a definition."""
    out, seen = [], set()
    for r in schema.rules:
        if r.path in seen:
            out.append(("V017", r.path, "defined twice"))
        seen.add(r.path)
        if r.low is not None and r.high is not None and r.low > r.high:
            out.append(("V017", r.path, "empty bounds"))
        if r.pattern:
            try:
                re.compile(r.pattern)
            except re.error:
                out.append(("V017", r.path, "malformed pattern"))
            if re.search(r"\([^)]*[+*][^)]*\)[+*]", r.pattern):
                out.append(("V017", r.path, "a pattern that may run forever"))
        if r.format and r.format not in NAMES:
            out.append(("V017", r.path, f"unknown format {r.format}"))
    for names, lo, hi in schema.one_of:
        out += [("V017", n, "not defined") for n in names if n not in seen]
        if lo > hi:
            out.append(("V017", ",".join(names), "empty cardinality"))
    return out


def _spec(r: Rule) -> str:
    num = lambda x: "" if x is None else f"{x:g}"
    parts = ["!" if r.required else "", "[]" if r.array else "", PREFIX.get(r.kind, r.kind if r.kind != "string" else "")]
    s = " ".join(p for p in parts if p)
    if r.places is not None:
        s += f".{r.places}"
    if r.low is not None or r.high is not None:
        s += f":({num(r.low)}..{num(r.high)})"
    if r.earliest or r.latest:
        s += f":({r.earliest or ''}..{r.latest or ''})"
    if r.pattern:
        s += f":/{r.pattern}/"
    if r.values:
        s += " (" + ", ".join(f'"{v}"' for v in r.values) + ")"
    if r.format:
        s += f" :format {r.format}"
    if r.unique:
        s += " :unique"
    if r.condition:
        p, op, v = r.condition
        s += f' :{"unless" if r.unless else "if"} {p} {op} "{v}"'
    return s.strip()


def serialize(schema: Schema) -> str:
    """Text that parses to the same schema."""
    out, section = [], ""
    for r in schema.rules:
        head, _, name = r.path.rpartition(".")
        if head != section:
            out.append(f"{{{head}}}")
            section = head
        out.append(f"{name} = {_spec(r)}".rstrip())
    for names, lo, hi in schema.one_of:
        out.append("{}")
        out.append(f":of ({lo}..{'' if hi >= 10**9 else hi}) " + " ".join(names))
    return "\n".join(out) + "\n"


def flatten(texts: dict[str, str], conflict: str = "error", keep: set[str] | None = None) -> Schema:
    """One schema from several (name -> text).  Paths defined differently twice: ``error``,
    ``overwrite`` (the later one) or ``namespace`` (prefixed by the later one's name).
    ``keep``: only sections that it names, and what they hold, stay."""
    rules: dict[str, Rule] = {}
    one_of = []
    for name, text in texts.items():
        s = parse_schema(text)
        for r in s.rules:
            if r.path in rules and rules[r.path] != r:
                if conflict == "error":
                    raise ValueError(f"V017: {r.path} is defined twice")
                if conflict == "namespace":
                    r.path = f"{name}.{r.path}"
            rules[r.path] = r
        one_of += s.one_of
    out = [r for r in rules.values() if keep is None or r.path.split(".")[0] in keep]
    known = {r.path for r in out}
    return Schema(out, [o for o in one_of if known.issuperset(o[0])])
