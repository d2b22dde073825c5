"""The transform language, compiled to DataFrame plans.

A text has sections.  ``{$const}``, ``{$table.NAME[columns]}`` and ``{$accumulator}`` hold
data; every other section is a *segment* that maps documents (rows of the source, one
document each) to rows of its own table:

    {rows[]}
    :loop vehicles :as veh
    :loop .coverages :as cov
    vin = @veh.vin
    code = %upper @cov.code :default "none"

Loops become a chain of ``posexplode``; conditions become filters or ``when``; verbs become
columns; lookups in tables of the text become literal maps, in registered tables joins;
accumulators become windows (read while looping) or aggregates (read later); passes order
the segments, and start with the accumulators' initial values unless these persist
(``name.persist = ?true``).  Nothing runs row by row in Python, and a bad value ends in
``_errors`` (code, field, message), never in an exception.

Policies of ``{$target}``: ``onValidation``, ``onMissing`` and ``onError`` are ``fail`` (a
row in ``_errors``), ``warn`` (one in ``_warnings``, which only then is a column) or ``skip``
(neither; a value that fails its validation is null).  Unless named, validations and bad
values fail, and a missing source is no error but for ``:required`` fields.

Records of several types: with ``discriminator = ":pos 0 :len 2"`` or ``":field 0"`` under
``{$source}``, the text column ``line`` says which segments take a row, those whose
``_type`` names the record's type.
"""

from __future__ import annotations

import inspect
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import BUILT_IN, call
from ..functions.arrays import predicate
from ..functions.registry import CUSTOM
from ..functions.scalar import text, truthy
from ..operators.relational import lookup as lookup_join
from ..sources.native import strip_comment, unquote

#: Arguments that a call in text takes where the function itself could take
#: more, fewer or any number of them.
TEXT_ARITY = {
    "truncate": 2, "formatCurrency": 1, "formatLocaleNumber": 2, "sequence": 1, "accumulate": 2, "set": 2, "wrap": 3, "assert": 2,
    "sum": 1, "count": 1, "min": 1, "max": 1, "avg": 1, "uuid": 1, "coalesce": -1, "concat": -1, "cond": -1, "switch": -1, "minOf": -1, "maxOf": -1, "lookup": -1, "lookupDefault": -1,
}
TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "currency": "decimal(38,2)", "percent": "double", "string": "string", "time": "string", "duration": "string", "reference": "string"}
MAX_DEPTH = 32


class TransformError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


# -- syntax --------------------------------------------------------------------------------

TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*")|(%&?\w+)|(@[\w$.\[\]#]*)|(\#\$-?[\d.]+(?::\w+)?|\#\#-?\d+|\#%-?[\d.]+|\#-?[\d.]+(?:[eE][+-]?\d+)?)|(\?(?:true|false))|(:\w+)|([^\s]+))""")


@dataclass
class Node:
    kind: str  # path, literal, verb, text
    value: object
    args: list = field(default_factory=list)


@dataclass
class Mapping:
    target: str
    node: Node
    directives: dict[str, str | bool]


@dataclass
class Segment:
    name: str
    loops: list[tuple[str, str | None]] = field(default_factory=list)
    condition: tuple[str, str] | None = None  # if, unless, elif, else
    counter: str | None = None
    number: int = 0  # the pass
    mappings: list[Mapping] = field(default_factory=list)

    @property
    def sink(self) -> bool:
        return self.name.startswith("_")


@dataclass
class Transform:
    segments: list[Segment]
    constants: dict[str, object]
    tables: dict[str, tuple[list[str], list[list]]]
    accumulators: dict[str, object]
    options: dict[str, object]
    persistent: set[str] = field(default_factory=set)

    def policy(self, name: str, otherwise: str) -> str:
        return str(self.options.get(f"target.{name}", otherwise))


def arity(verb: str) -> int:
    if verb in TEXT_ARITY:
        return TEXT_ARITY[verb]
    f = CUSTOM.get(verb) or BUILT_IN.get(verb)
    if f is None:
        return -1
    kinds = [p.kind for p in inspect.signature(f).parameters.values()]
    return -1 if inspect.Parameter.VAR_POSITIONAL in kinds else sum(k == inspect.Parameter.POSITIONAL_OR_KEYWORD for k in kinds)


def tokens(source: str) -> list[str]:
    return [m.group(0).strip() for m in TOKEN.finditer(source) if m.group(0).strip()]


def literal(t: str) -> Node:
    if t.startswith('"'):
        s = unquote(t[1:-1])
        if s[:1] in "@%" and len(s) > 1:
            return parse_expression(s)[0]
        return Node("text" if "${" in s else "literal", s)
    if t in ("?true", "?false", "true", "false"):
        return Node("literal", t.endswith("true"))
    if t == "~":
        return Node("literal", None)
    if t.startswith("##"):
        return Node("literal", int(t[2:]))
    if t.startswith(("#$", "#%")):
        return Node("literal", float(t[2:].split(":")[0]))
    if t.startswith("#"):
        return Node("literal", float(t[1:]))
    return Node("literal", t)


def parse_expression(source: str) -> tuple[Node, dict[str, str | bool]]:
    """(expression, trailing directives)."""
    made = re.match(r":object\s*\{((?:[^{}\"]|\"(?:[^\"\\]|\\.)*\")*)\}\s*(.*)$", source.strip())
    if made:
        pairs = [p.partition("=") for p in re.findall(r"(?:[^,\"]|\"(?:[^\"\\]|\\.)*\")+", made[1]) if "=" in p]
        node = Node("object", [k.strip() for k, _, _ in pairs], [parse_expression(v.strip())[0] for _, _, v in pairs])
        return node, parse_expression(made[2])[1]
    ts = tokens(source)
    at = 0

    def one(depth: int) -> Node:
        nonlocal at
        if depth > MAX_DEPTH:
            raise TransformError("T018", "expression too deep")
        t = ts[at]
        at += 1
        if t.startswith("@"):
            return Node("path", t[1:])
        if t.startswith("%"):
            custom, name = t.startswith("%&"), t.lstrip("%&")
            if name == "expr" and depth == 0:
                formula = literal(ts[at]).value
                at += 1
                prefix = ts[at][1:] if at < len(ts) and ts[at].startswith("@") else ""
                at += bool(prefix)
                return formula_tree(str(formula), prefix)
            n, args = arity(name), []
            while at < len(ts) and not ts[at].startswith(":") and (n < 0 or len(args) < n):
                args.append(one(depth + 1))
            return Node("verb", ("&" if custom else "") + name, args)
        return literal(t)

    node = one(0) if ts and not ts[0].startswith(":") else Node("literal", None)
    directives: dict[str, str | bool] = {}
    while at < len(ts):
        if ts[at].startswith(":"):
            name, rest = ts[at][1:], []
            at += 1
            while at < len(ts) and not ts[at].startswith(":"):
                rest.append(ts[at])
                at += 1
            directives[name] = " ".join(rest) if rest else True
        else:
            at += 1
    return node, directives


def formula_tree(formula: str, prefix: str) -> Node:
    """Infix arithmetic as verb calls: ^ (right), unary -, * / %, + -, calls, parentheses."""
    ts = re.findall(r"\d+\.?\d*(?:[eE][+-]?\d+)?|\w+|[-+*/%^(),]", formula)
    at = 0
    names = {"+": "add", "-": "subtract", "*": "multiply", "/": "divide", "%": "mod", "^": "pow", "min": "minOf", "max": "maxOf"}

    def peek():
        return ts[at] if at < len(ts) else None

    def take(expected=None):
        nonlocal at
        if at >= len(ts) or expected and ts[at] != expected:
            raise TransformError("T015", f"malformed formula {formula!r}")
        at += 1
        return ts[at - 1]

    def primary():
        t = take()
        if t == "(":
            e = binary(0)
            take(")")
            return e
        if t == "-":
            return Node("verb", "negate", [power()])
        if t == "+":
            return power()
        if re.match(r"\d", t):
            return Node("literal", float(t))
        if peek() == "(":
            take("(")
            args = [binary(0)]
            while peek() == ",":
                take(",")
                args.append(binary(0))
            take(")")
            if t not in ("abs", "floor", "ceil", "trunc", "sqrt", "round", "pow", "min", "max"):
                raise TransformError("T015", f"unknown function {t}")
            return Node("verb", names.get(t, t), args)
        if not prefix:
            raise TransformError("T015", f"no bindings for {t}")
        return Node("path", f"{prefix}.{t}")

    def power():
        base = primary()
        if peek() == "^":
            take()
            return Node("verb", "pow", [base, power()])
        return base

    levels = (("+", "-"), ("*", "/", "%"))

    def binary(level):
        if level == 2:
            return power()
        left = binary(level + 1)
        while peek() in levels[level]:
            left = Node("verb", names[take()], [left, binary(level + 1)])
        return left

    tree = binary(0)
    if at != len(ts):
        raise TransformError("T015", f"malformed formula {formula!r}")
    return tree


def plain(source: str):
    node = literal(source.strip())
    return node.value


def parse_transform(source: str) -> Transform:
    out = Transform([], {}, {}, {}, {})
    here, kind, columns = None, "", []
    for raw in source.splitlines():
        line = strip_comment(raw).strip() if not raw.strip().startswith('"') else raw.strip()
        if not line:
            continue
        head = re.fullmatch(r"\{(.*)\}", line)
        if head:
            name, _, rest = head[1].strip().partition(" ")
            if name.startswith("$table."):
                t = re.fullmatch(r"\$table\.(\w+)\[(.*)\]", head[1].strip())
                kind, columns = "table", [c.strip() for c in t[2].split(",")]
                here = out.tables.setdefault(t[1], (columns, []))
            elif name.startswith("$"):
                kind = name[1:]
                here = None
            else:
                kind, here = "segment", Segment(re.sub(r"\[\]$", "", name))
                out.segments.append(here)
                for d, v in parse_expression(rest)[1].items():
                    _segment_directive(here, d, v, rest)
            continue
        if kind == "table":
            here[1].append([plain(x) for x in re.findall(r'"(?:[^"\\]|\\.)*"|[^,\s][^,]*', line)])
        elif kind == "segment" and line.startswith(":"):
            for m in re.finditer(r":loop\s+(\S+)(?:\s+:as\s+(\w+))?", line):
                here.loops.append((m[1], m[2]))
            for d, v in parse_expression(re.sub(r":loop\s+\S+(\s+:as\s+\w+)?", "", line))[1].items():
                _segment_directive(here, d, v, line)
        elif "=" in line:
            k, _, v = line.partition("=")
            k, v = k.strip(), v.strip()
            if kind == "segment":
                if k == "_pass":
                    here.number = int(plain(v))
                elif k in ("_loop", "_from"):
                    here.loops.append((str(literal(v).value).lstrip("@"), None))
                elif k in ("_if", "_when"):
                    here.condition = ("if", v.strip('"'))
                else:
                    here.mappings.append(Mapping(k, *parse_expression(v)))
            elif kind == "const":
                out.constants[k] = plain(v)
            elif kind == "accumulator":
                name, _, setting = k.partition(".")
                if not setting:
                    out.accumulators[name] = plain(v)
                elif setting == "persist" and plain(v) is True:
                    out.persistent.add(name)
            else:
                out.options[f"{kind}.{k}" if kind else k] = plain(v)
    return out


def _segment_directive(s: Segment, name: str, value, source: str) -> None:
    if name in ("if", "unless", "elif", "else"):
        s.condition = (name, re.search(rf":{name}\b\s*(.*?)(?=\s:(?:loop|counter|pass|as)\b|$)", source)[1])
    elif name == "counter":
        s.counter = str(value)
    elif name == "pass":
        s.number = int(str(value).lstrip("#"))
    elif name == "loop":
        m = re.search(r":loop\s+(\S+)(?:\s+:as\s+(\w+))?", source)
        s.loops.append((m[1], m[2]))


# -- compilation ---------------------------------------------------------------------------

COMPARE = re.compile(r"^@?([\w$.\[\]]+)\s*(==|=|!=|<>|<=|>=|<|>)\s*(.+)$")
ERROR = "struct<code:string,field:string,message:string>"


class Compiler:
    """Plans for one transform over one source.  ``doc``: the column that names a document."""

    def __init__(self, transform: Transform, source: DataFrame, doc: str, tables: dict[str, DataFrame] | None = None):
        self.t, self.doc, self.tables = transform, doc, tables or {}
        self.source = source
        self.totals: dict[str, DataFrame] = {}
        self.outputs: dict[str, DataFrame] = {}

    def run(self) -> dict[str, DataFrame]:
        order = sorted(range(len(self.t.segments)), key=lambda i: (self.t.segments[i].number or 10**9, i))
        before: Column | None = None
        number = None
        for i in order:
            s = self.t.segments[i]
            if number is not None and s.number != number:
                # another pass: branches and accumulators start anew
                before, self.totals = None, {k: v for k, v in self.totals.items() if k in self.t.persistent}
            number = s.number
            before = self.segment(s, before)
        return self.outputs

    def records(self, s: Segment) -> DataFrame:
        """The rows of the source that a segment takes."""
        config = self.t.options.get("source.discriminator")
        if not config:
            return self.source
        d = parse_expression(str(config))[1]
        line = F.col("line")
        if "field" in d:
            kind = F.get(F.split(line, r"\Q" + str(self.t.options.get("source.delimiter", ",")) + r"\E", -1), F.lit(int(str(d["field"]))))
        elif "pos" in d and "len" in d:
            kind = F.substring(line, int(str(d["pos"])) + 1, int(str(d["len"])))
        else:
            raise TransformError("T010", f"no discriminator: {config}")
        types = [t.strip() for m in s.mappings if m.target == "_type" for t in str(m.node.value).split(",")]
        return self.source.filter(F.btrim(kind).isin(*types)) if types else self.source.filter(F.lit(False))

    # names -> columns

    def path(self, p: str, scope: dict) -> Column:
        steps = re.findall(r"[^.\[\]]+|\[\d+\]", p)
        if p.startswith("$const."):
            return F.lit(self.t.constants[p[7:]])
        if p.startswith("$accumulator.") or p in scope["acc"]:
            return scope["acc"].get(p.removeprefix("$accumulator."), F.lit(self.t.accumulators.get(p.removeprefix("$accumulator."))))
        if p in scope["special"]:
            return scope["special"][p]
        if p in ("", "."):
            return scope["item"]
        if p.startswith("."):
            return self.walk(scope["item"], steps)
        if steps[0] in scope["alias"]:
            return self.walk(scope["alias"][steps[0]], steps[1:])
        if len(steps) == 1 and steps[0] in scope["out"]:
            return scope["out"][steps[0]]
        if steps[0] in self.source.columns:
            return self.walk(F.col(f"`{steps[0]}`"), steps[1:])
        return F.lit(None)

    @staticmethod
    def walk(c: Column, steps: list[str]) -> Column:
        for s in steps:
            c = F.get(c, F.lit(int(s[1:-1]))) if s.startswith("[") else c[s]
        return c

    def value(self, n: Node, scope: dict):
        """A column, or the Python value of a literal."""
        if n.kind == "path":
            return self.path(n.value, scope)
        if n.kind == "text":
            parts, at = [], 0
            for m in re.finditer(r"(?<!\\)\$\{([^}]*)\}", n.value):
                parts += [F.lit(n.value[at : m.start()]), text(self.column(parse_expression(m[1])[0], scope))]
                at = m.end()
            return F.concat_ws("", *parts, F.lit(n.value[at:].replace("\\${", "${")))
        if n.kind == "literal":
            return n.value
        if n.kind == "object":
            return F.struct(*[self.column(a, scope).alias(k) for k, a in zip(n.value, n.args, strict=True)])
        name = n.value.lstrip("&")
        if name in ("lookup", "lookupDefault"):
            return self.lookup(n, scope)
        if name in ("accumulate", "set"):
            return self.accumulate(name, n, scope)
        try:
            return call(name, *[self.value(a, scope) for a in n.args], custom=n.value.startswith("&"))
        except KeyError as e:
            raise TransformError("T001", f"unknown verb {name}") from e

    def column(self, n: Node, scope: dict) -> Column:
        v = self.value(n, scope)
        return v if isinstance(v, Column) else F.lit(v)

    def accumulate(self, verb: str, n: Node, scope: dict) -> Column:
        """Inside a loop: a running value; the final one is kept for later segments."""
        name = str(n.args[0].value).lstrip("@")
        c = self.column(n.args[1], scope)
        first = self.t.accumulators.get(name, 0)
        start = scope["start"].get(name, F.lit(first))
        scope["sums"].append((name, verb, c))
        w = Window.partitionBy(self.doc).orderBy(*scope["order"]).rowsBetween(Window.unboundedPreceding, 0)
        if verb == "set":
            return c
        run = F.concat(start, F.array_join(F.collect_list(c).over(w), "")) if isinstance(first, str) else start + F.sum(c).over(w)
        scope["acc"][name] = run
        return run

    def lookup(self, n: Node, scope: dict) -> Column:
        name, _, result = str(n.args[0].value).partition(".")
        keys = [self.column(a, scope) for a in n.args[1:]]
        default = keys.pop() if n.value == "lookupDefault" else None
        key = F.concat_ws("\x1f", *[text(k) for k in keys])
        if name in self.t.tables:
            columns, rows_ = self.t.tables[name]
            if result not in columns:
                raise TransformError("T003", f"table {name} has no column {result}")
            at = columns.index(result)
            others = [i for i in range(len(columns)) if i != at][: len(keys)]
            found: dict[str, object] = {}
            for row in rows_:
                found.setdefault("\x1f".join(str(row[i]) for i in others), row[at])
            if not found:
                return default if default is not None else F.lit(None)
            out = F.try_element_at(F.create_map(*[F.lit(x) for p in found.items() for x in p]), key)
        elif name in self.tables:
            alias = f"_lookup_{name}_{result}_{len(scope['joins'])}"
            scope["joins"].append((name, keys, result, alias))
            out = F.col(alias)
        else:
            raise TransformError("T003", f"unknown table {name}")
        return out if default is None else F.coalesce(out, default)

    def condition(self, source: str, scope: dict) -> Column:
        s = source.strip()
        if s.startswith('"') and s.endswith('"'):
            s = s[1:-1]
        if s.startswith("%"):
            return truthy(self.column(parse_expression(s)[0], scope))
        m = COMPARE.match(s)
        if not m:
            return truthy(self.path(s.lstrip("@"), scope))
        v = literal(m[3].strip() if m[3].strip()[:1] in '"#?' else m[3].strip()).value
        return predicate(self.path(m[1], scope), m[2], v)

    # segments

    def segment(self, s: Segment, before: Column | None) -> Column | None:
        df = self.records(s)
        scope = {"alias": {}, "out": {}, "special": {}, "acc": {}, "start": {}, "sums": [], "joins": [], "order": [], "item": F.struct(*[F.col(f"`{c}`") for c in self.source.columns])}
        for name, total in self.totals.items():
            df = df.join(total, self.doc, "left")
            scope["acc"][name] = F.coalesce(F.col(f"_acc_{name}"), F.lit(self.t.accumulators.get(name)))
            if name in self.t.persistent:
                scope["start"][name] = scope["acc"][name]
        for k, (p, alias) in enumerate(s.loops):
            array = self.path(p.lstrip("@"), scope)
            df = df.select("*", F.size(array).alias(f"_n{k}"), F.posexplode(array).alias(f"_i{k}", f"_x{k}"))
            item = F.col(f"_x{k}")
            scope["item"] = item
            if alias:
                scope["alias"][alias] = item
            scope["order"].append(F.col(f"_i{k}"))
            scope["special"] |= {"_item": item, "_index": F.col(f"_i{k}"), "_length": F.col(f"_n{k}")}
        if s.counter:
            scope["special"][s.counter] = scope["special"].get("_index", F.lit(0))
        chain = None
        if s.condition:
            kind, source = s.condition
            c = F.lit(True) if kind == "else" else self.condition(source, scope)
            if kind == "unless":
                c = ~c
            if kind in ("elif", "else"):
                if before is None:
                    raise TransformError("T012", f"{s.name}: no branch before :{kind}")
                df = df.filter(~before & c)
                chain = before | c
            else:
                df = df.filter(c)
                chain = c
        errors: list[Column] = []
        warnings: list[Column] = []
        for m in s.mappings:
            scope["out"][target_key(m.target, scope["out"])] = self.field(m, scope, errors, warnings)
        for name, keys, result, alias in scope["joins"]:
            df = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
            table = self.tables[name]
            others = [c for c in table.columns if c != result][: len(keys)]
            df = lookup_join(df, table, {f"_k{i}": o for i, o in enumerate(others)}, result, alias).drop(*[f"_k{i}" for i in range(len(keys))])
        if s.sink or scope["sums"]:
            for name, verb, c in scope["sums"]:
                start = self.t.accumulators.get(name, 0)
                last = F.max_by(c, F.struct(*scope["order"])) if scope["order"] else F.first(c)
                agg = last if verb == "set" else F.first(scope["start"].get(name, F.lit(start))) + F.sum(c)
                self.totals[name] = df.groupBy(self.doc).agg(agg.alias(f"_acc_{name}"))
        if not s.sink:
            told = lambda found: F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast(f"array<{ERROR}>")
            notes = [told(warnings).alias("_warnings")] if any(self.t.policy(p, "") == "warn" for p in ("onValidation", "onMissing", "onError")) else []
            tree = nested({k: v for k, v in scope["out"].items() if not k.startswith("_")})
            self.outputs[s.name] = df.select(self.doc, *[F.col(f"_i{k}").alias(f"_ord{k}") for k in range(len(s.loops))], *[v.alias(k) for k, v in tree.items()], told(errors).alias("_errors"), *notes)
        return chain

    def field(self, m: Mapping, scope: dict, errors: list[Column], warnings: list[Column]) -> Column:
        d = m.directives
        c = self.column(m.node, scope)
        if "field" in d:
            c = F.get(F.split(text(c), ","), F.lit(int(str(d["field"]).lstrip("#"))))
        if "pos" in d:
            at, n = int(str(d["pos"]).lstrip("#")), int(str(d.get("len", 2**30)).lstrip("#"))
            c = F.substring(text(c), at + 1, n)
        if "trim" in d:
            c = call("trim", c)
        if "default" in d:
            c = F.coalesce(c, F.lit(literal(str(d["default"])).value))

        def say(bad: Column, code: str, what: str, policy: str = "fail") -> None:
            row = F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(m.target).alias("field"), F.lit(what).alias("message")))
            {"fail": errors, "warn": warnings}.get(policy, []).append(row)

        if "required" in d:
            say(c.isNull(), "T005", "a required value is missing")
        elif m.node.kind == "path" and "default" not in d:
            say(c.isNull(), "T005", "no value at the path", self.t.policy("onMissing", "skip"))
        for name, to in TYPES.items():
            if name in d:
                if name == "currency" and "decimals" in d:
                    to = f"decimal(38,{int(str(d['decimals']).lstrip('#'))})"
                cast = text(c) if to == "string" else c.try_cast(to)
                say(c.isNotNull() & cast.isNull(), "T002", f"no {name}", self.t.policy("onError", "fail"))
                c = cast
        if "binary" in d:
            c = F.encode(text(c), "UTF-8")
        if "decimals" in d and "currency" not in d:
            c = F.round(c.cast("double"), int(str(d["decimals"]).lstrip("#")))
        wrong = []
        if "enum" in d:
            wrong.append((~text(c).isin(*[x.strip() for x in str(d["enum"]).split(",")]), "not among the values"))
        if "range" in d:
            lo, _, hi = str(d["range"]).partition("..")
            x = c.try_cast("double")
            bad = x.isNull() & c.isNotNull()
            bad = bad | (x < float(lo.lstrip("#"))) if lo else bad
            bad = bad | (x > float(hi.lstrip("#"))) if hi else bad
            wrong.append((bad, "out of range"))
        if "validate" in d:
            wrong.append((~text(c).rlike(unquote(str(d["validate"]).strip('"'))), "no match"))
        policy = self.t.policy("onValidation", "fail")
        for bad, what in wrong:
            say(bad, "T013", what, policy)
        if policy == "skip":
            for bad, _ in wrong:
                c = F.when(F.coalesce(~bad, F.lit(True)), c)
        if "currencyCode" in d:
            c = F.when(c.isNotNull(), F.struct(c.alias("amount"), F.lit(str(d["currencyCode"]).strip('"')).alias("code")))
        if "confidential" in d:
            c = F.repeat(F.lit("*"), F.length(text(c))) if self.t.options.get("target.confidential") == "mask" else F.lit(None).cast("string")
        if "raw" in d:
            c = F.try_parse_json(text(c))
        if "array" in d:
            c = F.array(c)
        if "if" in d:
            c = F.when(self.condition(str(d["if"]), scope), c)
        if "unless" in d:
            c = F.when(~self.condition(str(d["unless"]), scope), c)
        return c


def failures(outputs: dict[str, DataFrame]) -> DataFrame | None:
    """document, segment, code, field, message of all errors; a ``fail`` policy is a test
    that this is empty, ``skip`` is a filter on it."""
    out = None
    for name, df in outputs.items():
        own = df.select(F.col(df.columns[0]).cast("string").alias("document"), F.lit(name).alias("segment"), F.explode("_errors").alias("e")).select("document", "segment", "e.*")
        out = own if out is None else out.unionByName(own)
    return out


def literal_lines(df: DataFrame, template: str) -> DataFrame:
    """Text lines of each row from a template with ``${field}`` places; nested places are
    not allowed (T014)."""
    if re.search(r"\$\{[^}]*\$\{", template):
        raise TransformError("T014", "nested place")
    parts, at = [], 0
    for m in re.finditer(r"\$\{@?([\w.]+)\}", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(text(F.col(m[1])), F.lit(""))]
        at = m.end()
    return df.select(F.concat(*parts, F.lit(template[at:])).alias("value"))


STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def target_key(target: str, taken: dict) -> str:
    """A target with ``[]`` appends: its place is the number of items before it."""
    while "[]" in target:
        head, _, rest = target.partition("[]")
        used = {int(m[1]) for k in taken if (m := re.match(re.escape(head) + r"\[(\d+)\]", k))}
        target = f"{head}[{max(used, default=-1) + 1}]{rest}"
    return target


def nested(flat: dict[str, Column]) -> dict[str, Column]:
    """a.b targets as structs, a[0].b as arrays of them; places that no target fills are
    null, and so are fields that an item of an array lacks."""
    tree: dict = {}
    for k, v in flat.items():
        here = tree
        *parents, last = [int(i) if i else name for name, i in STEP.findall(k)]
        for p in parents:
            here = here.setdefault(p, {})
        here[last] = v

    def names(items: list) -> list:
        return list(dict.fromkeys(k for x in items for k in x))

    def build(x, like: list | None = None) -> Column:
        if not isinstance(x, dict):
            return x
        if all(isinstance(k, int) for k in x):
            items = [x.get(i) for i in range(max(x) + 1)]
            dicts = [i for i in items if isinstance(i, dict) and not all(isinstance(k, int) for k in i)]
            return F.array(*[F.lit(None) if i is None else build(i, names(dicts) if i in dicts else None) for i in items])
        return F.struct(*[(build(x[k]) if k in x else F.lit(None)).alias(str(k)) for k in (like or x)])

    return {str(k): build(v) for k, v in tree.items()}


def execute(source: str, df: DataFrame, doc: str, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Segment name -> table of its rows (document, loop positions, fields, _errors)."""
    return Compiler(parse_transform(source), df, doc, tables).run()
