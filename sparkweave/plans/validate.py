"""Schema text and validation of long-form documents as a table of violations.

    {Person}
    name = !
    age = ##:(0..150)
    email = :format email
    status = ("active", "closed")
    phone = ! :if status = "active"
    tags = [] :(1..5)

Rules are a small broadcast list; documents are grouped only for presence, sizes and
uniqueness.  Codes: V001 required, V002 type, V003 bounds, V004 pattern or format, V005
enumeration, V006 array size, V007 repeated row, V009 cardinality, V010 conditionally
required, V011 unknown field, V012 reference cycle, V013 reference without target.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import shuffled
from .documents import chase
from .formats import meets

KINDS = {"##": "integer", "#": "number", "#$": "currency", "#%": "percent", "?": "boolean", "@": "reference", "^": "binary", "date": "date", "timestamp": "timestamp", "time": "time", "duration": "duration", "": "string"}
#: Types that satisfy a declared one.
ACCEPTS = {"number": ("number", "integer"), "string": ("string", "date", "timestamp", "time", "duration")}


@dataclass
class Rule:
    path: str
    kind: str = ""
    required: bool = False
    low: float | None = None
    high: float | None = None
    earliest: str | None = None  # bounds of dates and timestamps
    latest: str | None = None
    places: int | None = None  # exact decimal places
    pattern: str | None = None
    values: tuple[str, ...] = ()
    format: str | None = None
    condition: tuple[str, str, str] | None = None
    unless: bool = False
    array: bool = False
    unique: bool = False


@dataclass
class Schema:
    rules: list[Rule] = field(default_factory=list)
    one_of: list[tuple[list[str], int, int]] = field(default_factory=list)


def parse_schema(text: str) -> Schema:
    out, section = Schema(), ""
    for raw in text.splitlines():
        line = raw.split(";")[0].strip()
        if not line:
            continue
        m = re.fullmatch(r"\{(.*)\}", line)
        if m:
            section = m[1].strip().lstrip("@")
            continue
        if line.startswith((":one_of", ":exactly_one", ":of")):
            names = [f"{section}.{n}" if section else n for n in re.findall(r"[\w.]+", re.sub(r"^:\w+|\(.*?\)", "", line))]
            b = re.search(r"\((\d*)\.\.(\d*)\)", line)
            out.one_of.append((names, int(b[1] or 0) if b else 1, int(b[2] or 10**9) if b else (1 if line.startswith(":exactly_one") else 10**9)))
            continue
        k, _, spec = line.partition("=")
        r = Rule(f"{section}.{k.strip()}" if section else k.strip())
        spec = spec.strip()
        c = re.search(r":(if|unless)\s+([\w.]+)\s*(=|!=|<=|>=|<|>)\s*(.+)$", spec)
        if c:
            r.condition, r.unless = (c[2] if "." in c[2] or not section else f"{section}.{c[2]}", c[3], c[4].strip().strip('"')), c[1] == "unless"
            spec = spec[: c.start()].strip()
        r.required = spec.startswith("!")
        spec = spec.lstrip("!*- ")
        r.array, spec = spec.startswith("[]"), spec.removeprefix("[]").strip()
        r.unique = ":unique" in spec
        d = re.match(r"#\$?\.(\d+)", spec)
        if d:
            r.places = int(d[1])
            spec = ("#$" if spec.startswith("#$") else "#") + spec[d.end() :]
        t = re.match(r"(##|#\$|#%|#|\?|@|\^|date\b|timestamp\b|time\b|duration\b)?", spec)
        r.kind = KINDS[t[0] or ""] if t[0] else ""
        b = re.search(r":\((-?[\d.]*?)(?:\.\.(-?[\d.]*))?\)", spec)
        if b:
            r.low = float(b[1]) if b[1] else None
            r.high = float(b[2]) if b[2] else (r.low if b[2] is None else None)
        when = re.search(r":\((\d{4}-\d{2}-\d{2}[^.)]*)?\.\.(\d{4}-\d{2}-\d{2}[^)]*)?\)", spec)
        if when and (when[1] or when[2]):
            r.earliest, r.latest, r.low, r.high = when[1], when[2], None, None
        p = re.search(r":/(.*)/", spec)
        r.pattern = p[1] if p else None
        e = re.search(r'(?<!:)\(("[^)]*)\)', spec)
        r.values = tuple(re.findall(r'"([^"]*)"', e[1])) if e else ()
        f = re.search(r":format\s+([\w-]+)", spec)
        r.format = f[1] if f else None
        out.rules.append(r)
    return out


def violation(code: str, message: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))


def _checks(r: Rule) -> list[Column]:
    """Violations of one present value."""
    v, t = F.col("value"), F.col("type")
    out = []
    if r.kind:
        out.append(F.when(~t.isin(*ACCEPTS.get(r.kind, (r.kind,)), "null"), violation("V002", f"{r.kind} expected")))
    if not r.array and (r.low is not None or r.high is not None):
        size = F.octet_length(F.try_to_binary(F.substring_index(v, ":", -1), F.lit("base64")))
        x = F.when(t.isin("string", "reference"), F.length(v).cast("double")).when(t == "binary", size.cast("double")).otherwise(F.substring_index(v, ":", 1).try_cast("double"))
        bad = F.lit(False)
        bad = bad | (x < r.low) if r.low is not None else bad
        bad = bad | (x > r.high) if r.high is not None else bad
        out.append(F.when(F.coalesce(bad, F.lit(False)), violation("V003", "out of bounds")))
    if not r.array and (r.earliest or r.latest):
        moment = v.try_cast("timestamp")
        bad = F.lit(False)
        bad = bad | (moment < F.lit(r.earliest).cast("timestamp")) if r.earliest else bad
        bad = bad | (moment > F.lit(r.latest).cast("timestamp")) if r.latest else bad
        out.append(F.when(t.isin("date", "timestamp") & F.coalesce(bad, F.lit(False)), violation("V003", "out of bounds")))
    if r.places is not None:
        number = F.substring_index(v, ":", 1)
        places = F.length(F.regexp_extract(number, r"\.(\d*)", 1))
        kinds = ("currency",) if r.kind == "currency" else ("number",)
        out.append(F.when(t.isin(*kinds) & (places != r.places), violation("V003", f"{r.places} decimal places expected")))
    if r.pattern:
        out.append(F.when(~v.rlike(f"^(?:{r.pattern})$"), violation("V004", "pattern")))
    if r.format:
        out.append(F.when(~meets(v, r.format), violation("V004", r.format)))
    if r.values:
        out.append(F.when(~v.isin(*r.values), violation("V005", "not among the values")))
    return out


def validate(long: DataFrame, schema: Schema, strict: bool = False) -> DataFrame:
    """doc, path, code, message of every violation in (doc, path, type, value) rows."""
    generic = F.regexp_replace("path", r"\[\d+\]", "[]")
    rows = long.withColumn("_g", generic)
    found = F.array().cast("array<struct<code:string,message:string>>")
    for r in schema.rules:
        own = _checks(r)
        if own:
            name = f"{r.path}[]" if r.array else r.path
            found = F.when(F.col("_g") == name, F.array_compact(F.array(*own))).otherwise(found)
    values = rows.select("doc", "path", F.explode(found).alias("v")).select("doc", "path", "v.code", "v.message")

    # presence, sizes and cardinality: one pre-aggregated map of paths a document
    needed = sorted({r.path for r in schema.rules if r.required or r.array} | {r.condition[0] for r in schema.rules if r.condition} | {n for names, _, _ in schema.one_of for n in names})
    aggs = [F.max(F.when((F.col("path") == p) & (F.col("type") != "null"), F.coalesce("value", F.lit("")))).alias(f"p{i}") for i, p in enumerate(needed)]
    sizes = [(r, F.max(F.when(F.col("path").startswith(r.path + "["), F.regexp_extract(F.substring("path", len(r.path) + 1, 2**31 - 1), r"^\[(\d+)\]", 1).cast("int") + 1))) for r in schema.rules if r.array]
    at = {p: F.col(f"p{i}") for i, p in enumerate(needed)}
    per = long.groupBy("doc").agg(F.count(F.lit(1)).alias("_c"), *aggs, *[c.alias(f"s{i}") for i, (_, c) in enumerate(sizes)])
    whole = []
    for r in schema.rules:
        if not r.required or r.array:
            continue
        bad = at[r.path].isNull()
        if r.condition:
            p, op, v = r.condition
            x = at[p]
            hit = {"=": x == v, "!=": x != v}.get(op)
            if hit is None:
                a, b = x.try_cast("double"), float(v)
                hit = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
            hit = F.coalesce(hit, F.lit(False))
            bad = bad & (~hit if r.unless else hit)
        whole.append(F.when(bad, F.struct(F.lit(r.path).alias("path"), F.lit("V010" if r.condition else "V001").alias("code"), F.lit("missing").alias("message"))))
    for i, (r, _) in enumerate(sizes):
        n = F.coalesce(F.col(f"s{i}"), F.lit(0))
        bad = F.lit(False)
        bad = bad | (n < r.low) if r.low is not None else bad
        bad = bad | (n > r.high) if r.high is not None else bad
        whole.append(F.when(bad | (F.lit(r.required) & (n == 0)), F.struct(F.lit(r.path).alias("path"), F.lit("V006").alias("code"), F.lit("size").alias("message"))))
    for names, lo, hi in schema.one_of:
        n = sum((at[x].isNotNull().cast("int") for x in names), F.lit(0))
        whole.append(F.when((n < lo) | (n > hi), F.struct(F.lit(",".join(names)).alias("path"), F.lit("V009").alias("code"), F.lit("cardinality").alias("message"))))
    out = values
    if whole:
        out = out.unionByName(per.select("doc", F.explode(F.array_compact(F.array(*whole))).alias("v")).select("doc", "v.*"))
    for r in schema.rules:
        if r.array and r.unique:
            items = long.filter(F.col("path").startswith(r.path + "[")).withColumn("_i", F.regexp_extract("path", r"\[(\d+)\]", 1).cast("int"))
            keys = items.groupBy("doc", "_i").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(F.regexp_replace("path", r"\[\d+\]", "").alias("p"), "value")))), 256).alias("k"))
            out = out.unionByName(keys.groupBy("doc", "k").count().filter("count > 1").select("doc", F.lit(r.path).alias("path"), F.lit("V007").alias("code"), F.lit("repeated row").alias("message")))
    refs = long.filter("type = 'reference'").select("doc", F.col("path").alias("path"), F.col("value").alias("target"))
    paths = long.select("doc", F.col("path").alias("target")).distinct()
    out = out.unionByName(refs.join(shuffled(paths), ["doc", "target"], "left_anti").select("doc", "path", F.lit("V013").alias("code"), F.lit("no such path").alias("message")))
    out = out.unionByName(cycles(refs).select("doc", "path", F.lit("V012").alias("code"), F.lit("cycle").alias("message")))
    if strict:
        known = [f"{r.path}[]" if r.array else r.path for r in schema.rules]
        inside = F.lit(False)
        for r in schema.rules:
            if r.array:
                inside = inside | F.col("_g").startswith(r.path + "[]")
        out = out.unionByName(rows.filter(~F.col("_g").isin(*known) & ~inside & ~F.col("path").startswith("$")).select("doc", "path", F.lit("V011").alias("code"), F.lit("unknown field").alias("message")))
    return out


def cycles(refs: DataFrame) -> DataFrame:
    """References whose chain never ends, whatever the cycle's length."""
    return chase(refs).filter("endless").select("doc", "path")
