"""Object invariants (V008): + - * / %, comparisons, && || !, parentheses, dotted paths.

An absent operand makes the rule not applicable; a null operand or a false result is a
violation.  Numbers are equal within 1e-9.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9
OPS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Mod: F.try_mod}


def parse_invariant(text: str) -> tuple[ast.expr, dict[str, str]]:
    """The tree and the names that stand for paths in it."""
    names: dict[str, str] = {}

    def name(m: re.Match) -> str:
        if m[0].startswith('"'):
            return m[0]
        return names.setdefault(m[0], f"p{len(names)}_") if m[0] not in ("true", "false") else m[0].title()

    s = re.sub(r'"[^"]*"|[A-Za-z_][\w.]*(?:\[\d+\])?', name, text)
    s = s.replace("&&", " and ").replace("||", " or ")
    s = re.sub(r"!(?!=)", " not ", s)
    s = re.sub(r"(?<![<>=!])=(?!=)", "==", s)
    return ast.parse(s.strip(), mode="eval").body, {v: k for k, v in names.items()}


def check_invariants(long: DataFrame, rules: list[str]) -> DataFrame:
    """doc, path (the rule), code, message."""
    parsed = [(r, *parse_invariant(r)) for r in rules]
    paths = sorted({p for _, _, names in parsed for p in names.values()})
    per = long.groupBy("doc").agg(
        F.count(F.lit(1)).alias("_c"), *[F.max(F.when(F.col("path") == p, F.struct((F.col("type") != "null").alias("set"), F.substring_index(F.coalesce("value", F.lit("")), ":", 1).alias("v")))).alias(f"v{i}") for i, p in enumerate(paths)]
    )
    at = {p: F.col(f"v{i}") for i, p in enumerate(paths)}
    found = []
    for rule, tree, names in parsed:
        own = [at[p] for p in names.values()]
        present, known = F.lit(True), F.lit(True)
        for c in own:
            present, known = present & c.isNotNull(), known & c["set"]
        holds = F.coalesce(_column(tree, {k: at[p]["v"] for k, p in names.items()}), F.lit(False))
        found.append(F.when(present & ~(known & holds), F.struct(F.lit(rule).alias("path"), F.lit("V008").alias("code"), F.lit("invariant").alias("message"))))
    return per.select("doc", F.explode(F.array_compact(F.array(*found))).alias("v")).select("doc", "v.*")


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _column(n: ast.expr, names: dict[str, Column]) -> Column:
    if isinstance(n, ast.Name):
        return names[n.id]
    if isinstance(n, ast.Constant):
        return F.lit(n.value)
    if isinstance(n, ast.BoolOp):
        parts = [_truth(_column(v, names)) for v in n.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(n.op, ast.And) else out | p
        return out
    if isinstance(n, ast.UnaryOp):
        c = _column(n.operand, names)
        return ~_truth(c) if isinstance(n.op, ast.Not) else -_number(c) if isinstance(n.op, ast.USub) else _number(c)
    if isinstance(n, ast.BinOp):
        return OPS[type(n.op)](_number(_column(n.left, names)), _number(_column(n.right, names)))
    if isinstance(n, ast.Compare) and len(n.ops) == 1:
        a, b = _column(n.left, names), _column(n.comparators[0], names)
        x, y = _number(a.cast("string")), _number(b.cast("string"))
        same = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= EPS).otherwise(a.cast("string") == b.cast("string"))
        order = {ast.Lt: lambda p, q: p < q, ast.LtE: lambda p, q: p <= q, ast.Gt: lambda p, q: p > q, ast.GtE: lambda p, q: p >= q}
        kind = type(n.ops[0])
        if kind in (ast.Eq, ast.NotEq):
            return same if kind is ast.Eq else ~same
        return F.when(x.isNotNull() & y.isNotNull(), order[kind](x, y)).otherwise(order[kind](a.cast("string"), b.cast("string")))
    raise ValueError(f"V017: unsupported syntax in an invariant: {ast.dump(n)}")


def _truth(c: Column) -> Column:
    return F.coalesce(c.try_cast("boolean"), F.lit(False)) if not isinstance(c, bool) else F.lit(c)
