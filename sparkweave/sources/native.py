"""Native text documents: {section} headers, path = value lines, tabular sections, several
documents between --- lines.

Literals: "text", ##1 integer, #1.5 number, #$9.99:USD currency, #%15 percent, true or ?true,
~ null, ISO dates, timestamps, T times, P durations, @path references, ^algo:base64 binary,
%verb expressions.  ! required, * confidential and - deprecated may stand before a value.
"""

from __future__ import annotations

import re

ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "0": "\0"}
PATTERNS = (
    ("timestamp", r"\d{4}-\d{2}-\d{2}T\S+"), ("date", r"\d{4}-\d{2}-\d{2}"), ("time", r"T\d{2}:\d{2}(:\d{2}(\.\d+)?)?"),
    ("duration", r"P(?=[\dT])(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?"),
)


class NativeError(ValueError):
    """code and line of a syntax error."""

    def __init__(self, code: str, line: int, message: str):
        super().__init__(f"{code} at line {line}: {message}")
        self.code, self.line = code, line


def unquote(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), s)


def value(text: str, line: int = 0) -> tuple[str, str | None, str]:
    """(type, value text, modifiers) of a literal."""
    s, mods = text.strip(), ""
    while s[:1] in ("!", "*") or (s[:1] == "-" and not re.match(r"-\d", s)):
        mods += {"!": "required ", "*": "confidential ", "-": "deprecated "}[s[0]]
        s = s[1:].lstrip()
    mods = mods.strip()
    if s == "~":
        return "null", None, mods
    if s in ("true", "false", "?true", "?false"):
        return "boolean", s.lstrip("?"), mods
    if s.startswith('"""'):
        return "string", s[3:-3] if s.endswith('"""') else s[3:], mods
    if s.startswith('"'):
        m = re.match(r'"((?:[^"\\]|\\.)*)"', s)
        if not m:
            raise NativeError("P004", line, "text without an end")
        return "string", unquote(m[1]), mods
    if s.startswith("##"):
        m = re.match(r"##(-?\d+)", s)
        if m:
            return "integer", m[1], mods
    elif s.startswith("#$"):
        m = re.match(r"#\$(-?\d+(?:\.\d+)?)(?::([A-Za-z]{3}))?", s)
        if m:
            return "currency", m[1] + (":" + m[2].upper() if m[2] else ""), mods
    elif s.startswith("#%"):
        m = re.match(r"#%(-?\d+(?:\.\d+)?)", s)
        if m:
            return "percent", m[1], mods
    elif s.startswith("#"):
        m = re.match(r"#(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", s)
        if m:
            return "number", m[1], mods
    elif s.startswith("@"):
        return "reference", s[1:].split()[0] if s[1:].split() else "", mods
    elif s.startswith("^"):
        return "binary", s[1:], mods
    elif s.startswith("%"):
        return "verb", s, mods
    else:
        for kind, rx in PATTERNS:
            if re.fullmatch(rx, s):
                return kind, s, mods
        raise NativeError("P002", line, f"a bare word: {s}")
    raise NativeError("P003", line, f"a malformed literal: {s}")


def strip_comment(line: str) -> str:
    quoted = False
    for i, ch in enumerate(line):
        if ch == '"' and (i == 0 or line[i - 1] != "\\"):
            quoted = not quoted
        elif ch == ";" and not quoted:
            return line[:i]
    return line


def split_cells(line: str) -> list[str]:
    return [m.group(0).strip() for m in re.finditer(r'(?:"(?:[^"\\]|\\.)*"|[^,"])+|(?<=,)(?=,|$)', line)]


def parse_document(text: str) -> list[tuple[str, str, str | None, str]]:
    """(path, type, value, modifiers) of each assignment, in order; documents after the
    first get paths under ``$n.``."""
    out, section, table, row, prefix, n_doc = [], "", None, 0, "", 0
    for number, raw in enumerate(text.splitlines(), 1):
        line = strip_comment(raw).strip()
        if not line:
            continue
        if line == "---":
            n_doc, section, table, prefix = n_doc + 1, "", None, f"${n_doc + 1}."
            continue
        m = re.fullmatch(r"\{([^}]*)\}", line)
        if m:
            head = m[1].strip()
            t = re.fullmatch(r"(.+?)\[\]\s*:\s*(.+)", head)
            section, table, row = (t[1].strip(), [x.strip() for x in t[2].split(",")], 0) if t else (head, None, 0)
            continue
        if table is not None:
            for name, cell in zip(table, split_cells(line), strict=False):
                if cell:
                    out.append((f"{prefix}{section}[{row}].{name}", *value(cell, number)))
            row += 1
            continue
        if "=" not in line:
            raise NativeError("P001", number, "an assignment or a section is expected")
        k, _, v = line.partition("=")
        path = f"{section}.{k.strip()}" if section else k.strip()
        out.append((prefix + path, *value(v, number)))
    return out


def render(kind: str, v: str | None) -> str:
    if kind == "null" or v is None:
        return "~"
    if kind == "string":
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
    return {"integer": "##", "number": "#", "currency": "#$", "percent": "#%", "reference": "@", "binary": "^"}.get(kind, "") + v


def canonical_key(path: str):
    """Order for hashing: metadata first, & last, array positions by number."""
    parts = [(1, int(p[1:-1]), "") if p.startswith("[") else (0, 0, p) for p in re.findall(r"\[\d+\]|[^.\[\]]+", path)]
    return (2 if path.startswith("&") else 0 if path.startswith("$") else 1, parts)


MARKS = {"required": "!", "confidential": "*", "deprecated": "-"}


def stringify(rows: list[tuple[str, str, str | None, str]], canonical: bool = False) -> str:
    """Text of (path, type, value, modifiers) rows; canonical: one sorted line each."""
    rows = sorted(rows, key=lambda r: canonical_key(r[0])) if canonical else list(rows)
    out, section = [], ""
    for path, kind, v, mods in rows:
        marks = "".join(MARKS[m] for m in mods.split()) if mods else ""
        head, _, name = path.rpartition(".")
        if canonical:
            head, name = section, path
        if head != section:
            out.append(f"{{{head}}}")
            section = head
        out.append(f"{name} = {marks}{render(kind, v)}")
    return "\n".join(out) + "\n" if out else ""
