"""Core, coercion, logic, numeric and formatting verbs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import col, let, value_of, verb

INF = float("inf")


def num(x) -> Column:
    """A number or null: strings are parsed, booleans are 0 and 1."""
    return col(x).try_cast("double")


def text(x) -> Column:
    """String form; a double without fraction loses its ``.0``."""
    x = col(x)
    s = x.cast("string")
    return F.when(F.typeof(x).isin("double", "float"), F.regexp_replace(s, r"\.0$", "")).otherwise(s)


def is_text(x: Column) -> Column:
    return F.typeof(x) == "string"


def truthy(x) -> Column:
    """Null, false, zero and the empty string are false; everything else is true."""
    x = col(x)
    s = x.cast("string")
    return F.coalesce(F.when(is_text(x), s != "").otherwise(~s.isin("false", "0", "0.0", "-0.0", "")), F.lit(False))


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def null_if_empty(x) -> Column:
    x = col(x)
    return F.when(x.cast("string") != "", x)


# -- core ----------------------------------------------------------------------------------


@verb("concat")
def concat(*xs):
    return F.concat_ws("", *[text(x) for x in xs])


@verb("upper")
def upper(s):
    return F.upper(col(s))


@verb("lower")
def lower(s):
    return F.lower(col(s))


@verb("trim")
def trim(s):
    return F.regexp_replace(col(s), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


@verb("trimLeft")
def trim_left(s):
    return F.regexp_replace(col(s), r"^\s+", "")


@verb("trimRight")
def trim_right(s):
    return F.regexp_replace(col(s), r"\s+$", "")


@verb("coalesce")
def coalesce(*xs):
    return F.coalesce(*[null_if_empty(x) for x in xs])


@verb("ifNull")
def if_null(x, default):
    return F.coalesce(col(x), col(default))


@verb("ifEmpty")
def if_empty(x, default):
    return F.coalesce(null_if_empty(x), col(default))


@verb("ifElse")
def if_else(c, a, b):
    return F.when(truthy(c), col(a)).otherwise(col(b))


# -- coercion ------------------------------------------------------------------------------


@verb("coerceString")
def coerce_string(x):
    return text(x)


@verb("coerceNumber")
def coerce_number(x):
    return F.coalesce(num(x), F.lit(0.0))


@verb("coerceInteger")
def coerce_integer(x):
    return F.floor(coerce_number(x))


@verb("coerceBoolean")
def coerce_boolean(x):
    return F.coalesce(F.lower(F.btrim(text(x))).isin("true", "yes", "y", "1"), F.lit(False))


@verb("coerceDate")
def coerce_date(x):
    """ISO prefix, yyyyMMdd, M/D/Y (D/M/Y when the first part exceeds 12) or epoch seconds."""
    s = text(x)
    a, b, y = (F.regexp_extract(s, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", i).try_cast("int") for i in (1, 2, 3))
    slash = F.when(a > 12, F.try_to_date(F.format_string("%04d-%02d-%02d", y, b, a), "yyyy-MM-dd")).otherwise(F.try_to_date(F.format_string("%04d-%02d-%02d", y, a, b), "yyyy-MM-dd"))
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
        .when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))
        .when(s.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$"), slash)
        .when(s.rlike(r"^-?\d+$"), F.to_date(F.timestamp_seconds(s.try_cast("bigint"))))
    )


@verb("coerceTimestamp")
def coerce_timestamp(x):
    return F.try_to_timestamp(text(x))


@verb("tryCoerce")
def try_coerce(x):
    """The most specific reading as a tagged struct."""
    s = text(x)
    i, d = s.try_cast("bigint"), s.try_cast("double")
    tag = (
        F.when(s.rlike(r"^[+-]?\d+$") & i.isNotNull(), "integer").when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & d.isNotNull(), "number")
        .when(s.isin("true", "false"), "boolean").when(s.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(s, "yyyy-MM-dd").isNotNull(), "date").when(s.isNotNull(), "string").otherwise("null")
    )
    return F.struct(
        tag.alias("type"), F.when(tag == "integer", i).alias("integer"), F.when(tag.isin("integer", "number"), d).alias("number"),
        F.when(tag == "boolean", s == "true").alias("boolean"), F.when(tag == "date", F.try_to_date(s, "yyyy-MM-dd")).alias("date"), s.alias("string"),
    )


@verb("toArray")
def to_array(x):
    return F.array(col(x))


@verb("toObject")
def to_object(pairs):
    """An array of {key, value} (or two-field) structs as a map; the last of a key wins."""
    m = F.map_from_entries(last_entries(col(pairs)))
    return F.when(F.size(col(pairs)) > 0, m)


def last_entries(pairs: Column) -> Column:
    """Entries in first-seen order of their keys, each with its last value."""
    last = lambda pairs, k: F.element_at(F.filter(pairs, lambda p: p.getField("key") == k), -1)
    keys = lambda pairs: F.array_distinct(F.transform(pairs, lambda p: p.getField("key")))
    return let(pairs, lambda pairs: F.transform(keys(pairs), lambda k: F.struct(k.alias("key"), last(pairs, k).getField("value").alias("value"))))


# -- logic ---------------------------------------------------------------------------------


@verb("and")
def and_(a, b):
    return truthy(a) & truthy(b)


@verb("or")
def or_(a, b):
    return truthy(a) | truthy(b)


@verb("not")
def not_(x):
    x = col(x)
    return ~truthy(x) | F.coalesce(is_text(x) & (x.cast("string") == "false"), F.lit(False))


@verb("xor")
def xor(a, b):
    return col(a) != col(b)


def equal(a, b) -> Column:
    """Numbers by value (also inside strings when the other side is a number), else text."""
    a, b = col(a), col(b)
    both_text = is_text(a) & is_text(b)
    return F.when(both_text, text(a).eqNullSafe(text(b))).otherwise(F.when(num(a).isNotNull() & num(b).isNotNull(), num(a) == num(b)).otherwise(text(a).eqNullSafe(text(b))))


@verb("eq")
def eq(a, b):
    return equal(a, b)


@verb("ne")
def ne(a, b):
    return ~equal(a, b)


def _order(a, b, op):
    """Numeric with null as 0 when both sides are numbers, else by text, else false."""
    a, b = col(a), col(b)
    x = F.when(a.isNull(), F.lit(0.0)).otherwise(num(a))
    y = F.when(b.isNull(), F.lit(0.0)).otherwise(num(b))
    return F.coalesce(op(x, y), op(text(a), text(b)), F.lit(False))


@verb("lt")
def lt(a, b):
    return _order(a, b, lambda x, y: x < y)


@verb("lte")
def lte(a, b):
    return _order(a, b, lambda x, y: x <= y)


@verb("gt")
def gt(a, b):
    return _order(a, b, lambda x, y: x > y)


@verb("gte")
def gte(a, b):
    return _order(a, b, lambda x, y: x >= y)


@verb("between")
def between(x, lo, hi):
    return col(x).between(col(lo), col(hi))


@verb("isNull")
def is_null(x):
    return col(x).isNull()


NAMES = {"string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "void": "null", "binary": "binary"}


@verb("typeOf")
def type_of(x):
    x = col(x)
    t = F.typeof(x)
    out = F.when(x.isNull(), "null")
    for spark, name in NAMES.items():
        out = out.when(t == spark, name)
    return (
        out.when(t.isin("tinyint", "smallint", "int", "bigint"), "integer").when(t.startswith("decimal") | t.isin("double", "float"), "number")
        .when(t.startswith("array"), "array").otherwise("object")
    )


@verb("isString")
def is_string(x):
    return type_of(x) == "string"


@verb("isNumber")
def is_number(x):
    return type_of(x).isin("integer", "number")


@verb("isBoolean")
def is_boolean(x):
    return type_of(x) == "boolean"


@verb("isArray")
def is_array(x):
    x = col(x)
    return (type_of(x) == "array") | F.coalesce(is_text(x) & x.cast("string").rlike(r"(?s)^\s*\[.*\]\s*$"), F.lit(False))


@verb("isObject")
def is_object(x):
    x = col(x)
    return (type_of(x) == "object") | F.coalesce(is_text(x) & x.cast("string").rlike(r"(?s)^\s*\{.*\}\s*$"), F.lit(False))


@verb("isDate")
def is_date(x):
    return type_of(x).isin("date", "timestamp")


@verb("cond")
def cond(*xs):
    out = None
    for c, v in zip(xs[0 : len(xs) // 2 * 2 : 2], xs[1::2], strict=False):
        out = (F if out is None else out).when(truthy(c), col(v))
    return out.otherwise(col(xs[-1])) if len(xs) % 2 else out


@verb("assert")
def assert_(c, *_):
    return F.when(truthy(c), col(c))


@verb("switch")
def switch(subject, *xs):
    out = None
    for k, v in zip(xs[0 : len(xs) // 2 * 2 : 2], xs[1::2], strict=False):
        out = (F if out is None else out).when(equal(subject, k), col(v))
    return out.otherwise(col(xs[-1])) if len(xs) % 2 else out


@verb("isFinite")
def is_finite(x):
    x = num(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < INF), F.lit(False))


@verb("isNaN")
def is_nan(x):
    return F.coalesce(F.isnan(num(x)), F.lit(False))


# -- numbers -------------------------------------------------------------------------------


def zero(x) -> Column:
    return F.coalesce(num(x), F.lit(0.0))


@verb("formatNumber")
def format_number(x, places=0):
    return F.format_string(f"%.{int(value_of(places))}f", num(x))


@verb("formatInteger")
def format_integer(x):
    return F.floor(num(x)).cast("string")


@verb("formatCurrency")
def format_currency(x, places=2):
    return F.format_string(f"%.{int(value_of(places))}f", num(x))


@verb("floor")
def floor(x):
    return F.floor(zero(x))


@verb("ceil")
def ceil(x):
    return F.ceil(zero(x))


@verb("negate")
def negate(x):
    return -num(x)


@verb("sign")
def sign(x):
    return F.signum(num(x)).cast("bigint")


@verb("trunc")
def trunc(x):
    x = num(x)
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


@verb("minOf")
def min_of(*xs):
    return F.least(*[num(x) for x in xs]) if len(xs) > 1 else F.array_min(F.transform(col(xs[0]), num))


@verb("maxOf")
def max_of(*xs):
    return F.greatest(*[num(x) for x in xs]) if len(xs) > 1 else F.array_max(F.transform(col(xs[0]), num))


@verb("formatPercent")
def format_percent(x, places=0):
    p = int(value_of(places))
    return F.format_string(f"%.{p}f%%", F.round(num(x) * 100, p))


@verb("parseInt")
def parse_int(s, radix=10):
    r = int(value_of(radix))
    digits = "".join("0123456789abcdefghijklmnopqrstuvwxyz"[:r])
    found = F.regexp_extract(F.lower(F.btrim(text(s))), rf"^([+-]?)([{digits}]+)", 2)
    minus = F.btrim(text(s)).startswith("-")
    value = F.conv(F.when(found != "", found), r, 10).try_cast("bigint")
    return F.when(minus, -value).otherwise(value)


@verb("safeDivide")
def safe_divide(n, d, fallback=None):
    q = F.try_divide(num(n), num(d))
    return F.when(num(n).isNotNull(), q if fallback is None else F.coalesce(q, num(fallback)))


@verb("add")
def add(a, b):
    return zero(a) + zero(b)


@verb("subtract")
def subtract(a, b):
    return num(a) - num(b)


@verb("multiply")
def multiply(a, b):
    return num(a) * num(b)


@verb("divide")
def divide(a, b):
    return F.try_divide(num(a), num(b))


@verb("abs")
def abs_(x):
    return F.abs(zero(x))


@verb("round")
def round_(x, places=0):
    """Half-even on the decimal text of the number."""
    p = int(value_of(places))
    return F.bround(zero(x).cast("decimal(38,12)"), p).cast("double")


@verb("mod")
def mod(a, b):
    return F.when(num(b) != 0, F.try_mod(num(a), num(b)))


#: Factors to the base unit of each kind.
UNITS = {
    "mass": {"kg": 1.0, "g": 0.001, "mg": 1e-6, "lb": 0.45359237, "oz": 0.028349523125, "ton": 907.18474, "tonne": 1000.0},
    "length": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "yd": 0.9144, "ft": 0.3048, "in": 0.0254},
    "volume": {"l": 1.0, "ml": 0.001, "gal": 3.785411784, "qt": 0.946352946, "pt": 0.473176473, "cup": 0.2365882365, "floz": 0.0295735295625},
    "speed": {"m/s": 1.0, "mps": 1.0, "km/h": 1 / 3.6, "kph": 1 / 3.6, "mph": 0.44704, "knot": 0.514444},
    "area": {"sqm": 1.0, "sqft": 0.09290304, "sqmi": 2589988.110336, "sqkm": 1e6, "acre": 4046.8564224, "hectare": 10000.0},
    "data": {"b": 1.0, "kb": 1024.0, "mb": 1024.0**2, "gb": 1024.0**3, "tb": 1024.0**4},
    "time": {"s": 1.0, "ms": 0.001, "min": 60.0, "h": 3600.0, "hr": 3600.0, "d": 86400.0, "day": 86400.0, "week": 604800.0},
}


@verb("convertUnit")
def convert_unit(x, source, target):
    """Rounded to six places; units of different kinds give null.  The units are constants,
    so that the conversion folds to one multiplication."""
    a, b, x = value_of(source).lower(), value_of(target).lower(), num(x)
    if a in ("c", "f", "k") and b in ("c", "f", "k"):
        kelvin = {"c": x + 273.15, "f": (x - 32) * 5 / 9 + 273.15, "k": x}[a]
        return F.round({"c": kelvin - 273.15, "f": (kelvin - 273.15) * 9 / 5 + 32, "k": kelvin}[b], 6)
    for kind in UNITS.values():
        if a in kind and b in kind:
            return F.round(x * (kind[a] / kind[b]), 6)
    return F.lit(None).cast("double")


@verb("gcd")
def gcd(a, b):
    """Euclid's steps as a fold of as many as the lesser operand can ask for."""
    a, b = F.abs(trunc(a)).cast("bigint"), F.abs(trunc(b)).cast("bigint")
    steps = (F.ceil(F.log2(F.least(a, b).cast("double") + 1) * 1.45) + 2).cast("int")
    end = F.aggregate(
        F.sequence(F.lit(1), steps), F.struct(a.alias("x"), b.alias("y")),
        lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), F.try_mod(p["x"], p["y"]).alias("y"))),
    )
    return F.when(a.isNotNull() & b.isNotNull(), end["x"])


@verb("lcm")
def lcm(a, b):
    x, y, g = F.abs(trunc(a)).cast("bigint"), F.abs(trunc(b)).cast("bigint"), gcd(a, b)
    return F.when((x == 0) | (y == 0), F.lit(0).cast("bigint")).otherwise(F.try_multiply(F.try_divide(x, g).cast("bigint"), y))


@verb("factorial")
def factorial(n):
    n = num(n)
    return F.when((n >= 0) & (n <= 18) & (n == F.floor(n)), F.factorial(n.cast("int")))
