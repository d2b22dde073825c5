"""Forms: elements bound to paths, rendered to HTML a document at a time.  Presentation
only; documents are bounded by the parser's limits and are rendered in Arrow batches."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.native import strip_comment, value

INPUTS = {"text": "text", "number": "number", "date": "date", "email": "email", "password": "password", "checkbox": "checkbox", "hidden": "hidden", "file": "file"}
BLOCKS = {"label": "span", "heading": "h2", "paragraph": "p", "section": "section", "line": "hr", "image": "img", "select": "select", "textarea": "textarea", "signature": "div", "table": "table"}


@dataclass
class Element:
    kind: str
    name: str
    options: dict[str, str | None] = field(default_factory=dict)


def parse_form(text: str) -> list[Element]:
    """{kind name} sections with option = literal lines."""
    out: list[Element] = []
    for number, raw in enumerate(text.splitlines(), 1):
        line = strip_comment(raw).strip()
        m = re.fullmatch(r"\{(\w+)(?:\s+([\w.]+))?\}", line)
        if m:
            if m[1] not in INPUTS and m[1] not in BLOCKS:
                raise ValueError(f"unknown element {m[1]}")
            out.append(Element(m[1], m[2] or f"e{len(out)}"))
        elif "=" in line and out:
            k, _, v = line.partition("=")
            out[-1].options[k.strip()] = value(v, number)[1]
    return out


def render(elements: list[Element], values: dict[str, str | None]) -> str:
    esc = lambda x: html.escape("" if x is None else str(x))
    out = []
    for e in elements:
        o = e.options
        bound = values.get(o.get("bind") or e.name, o.get("value"))
        attrs = f' id="{esc(e.name)}"' + "".join(f' {k}="{esc(o[k])}"' for k in ("style", "class", "placeholder") if o.get(k))
        label = f'<label for="{esc(e.name)}">{esc(o["label"])}</label>' if o.get("label") else ""
        if e.kind == "table":
            p = o.get("bind") or e.name
            cells: dict[int, dict[str, str | None]] = {}
            for path, v in values.items():
                m = re.fullmatch(re.escape(p) + r"\[(\d+)\]\.(.+)", path)
                if m:
                    cells.setdefault(int(m[1]), {})[m[2]] = v
            heads = list(dict.fromkeys(k for _, row in sorted(cells.items()) for k in row))
            body = "".join("<tr>" + "".join(f"<td>{esc(row.get(h))}</td>" for h in heads) + "</tr>" for _, row in sorted(cells.items()))
            out.append(f"<table{attrs}><tr>{''.join(f'<th>{esc(h)}</th>' for h in heads)}</tr>{body}</table>")
        elif e.kind in INPUTS:
            checked = " checked" if e.kind == "checkbox" and bound == "true" else ""
            shown = "" if e.kind in ("checkbox", "file", "password") else f' value="{esc(bound)}"'
            out.append(f'{label}<input type="{INPUTS[e.kind]}" name="{esc(e.name)}"{attrs}{shown}{checked}>')
        elif e.kind == "select":
            items = "".join(f"<option{' selected' if x == bound else ''}>{esc(x)}</option>" for x in (o.get("items") or "").split(",") if x)
            out.append(f'{label}<select name="{esc(e.name)}"{attrs}>{items}</select>')
        elif e.kind in ("line", "image"):
            out.append(f'<{BLOCKS[e.kind]}{attrs}' + (f' src="{esc(o.get("src"))}"' if e.kind == "image" else "") + ">")
        else:
            out.append(f"{label}<{BLOCKS[e.kind]}{attrs}>{esc(bound)}</{BLOCKS[e.kind]}>")
    return "<form>" + "".join(out) + "</form>"


def render_documents(long: DataFrame, form: str) -> DataFrame:
    """doc, html of each document."""
    elements = parse_form(form)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "html": [render(elements, {r["path"]: r["value"] for r in rows}) for rows in b["rows"]]})

    return long.groupBy("doc").agg(F.collect_list(F.struct("path", "value")).alias("rows")).mapInPandas(run, "doc string, html string")
