"""A YAML subset: block maps and lists, comments, scalars.  No anchors or flow style."""

from __future__ import annotations

import re


def scalar(s: str):
    s = s.strip()
    if not s or s in ("~", "null"):
        return None
    if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'":
        return s[1:-1]
    if s.lower() in ("true", "yes", "on"):
        return True
    if s.lower() in ("false", "no", "off"):
        return False
    if re.fullmatch(r"[+-]?\d+", s):
        return int(s)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?|[+-]?\d+[eE][+-]?\d+", s):
        return float(s)
    return s


def _without_comment(line: str) -> str:
    quote = ""
    for i, ch in enumerate(line):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def _key(s: str) -> tuple[str, str] | None:
    m = re.match(r"""("[^"]*"|'[^']*'|[^\s:][^:]*?)\s*:(?:\s+(.*))?$""", s)
    return (m.group(1).strip("\"'"), m.group(2) or "") if m else None


def parse_yaml(text: str):
    lines = []
    for raw in text.splitlines():
        line = _without_comment(raw).rstrip()
        if line.strip() and line.strip() != "---":
            lines.append([len(line) - len(line.lstrip()), line.strip()])
    at = 0

    def block(indent: int):
        nonlocal at
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out = []
            while at < len(lines) and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")):
                rest = lines[at][1][1:].strip()
                if not rest:
                    at += 1
                    out.append(block(lines[at][0]) if at < len(lines) and lines[at][0] > indent else None)
                elif _key(rest):
                    lines[at] = [indent + 2, rest]
                    out.append(block(indent + 2))
                else:
                    at += 1
                    out.append(scalar(rest))
            return out
        out = {}
        while at < len(lines) and lines[at][0] == indent:
            pair = _key(lines[at][1])
            if pair is None:
                break
            at += 1
            k, v = pair
            if v:
                out[k] = scalar(v)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
                out[k] = block(lines[at][0])
            else:
                out[k] = None
        return out

    return block(lines[0][0]) if lines else {}
