"""String verbs."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import col, value_of, verb
from .scalar import text

LAST = 2**31 - 1


def q(delimiter: str) -> str:
    """A Java pattern that matches the delimiter literally."""
    return r"\Q" + delimiter + r"\E"


def false(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


@verb("capitalize")
def capitalize(s):
    s = col(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, LAST)))


@verb("titleCase")
def title_case(s):
    return F.initcap(F.replace(col(s), F.lit("\t"), F.lit(" ")))


@verb("contains")
def contains(s, sub):
    return false(F.contains(text(s), text(sub)))


@verb("startsWith")
def starts_with(s, p):
    return false(F.startswith(text(s), text(p)))


@verb("endsWith")
def ends_with(s, p):
    return false(F.endswith(text(s), text(p)))


@verb("replace")
def replace(s, find, new):
    return F.replace(col(s), col(find), col(new))


def valid(pattern: str) -> bool:
    try:
        re.compile(re.sub(r"\\[QE]|\\p\{\w+\}|\(\?<(?=[A-Za-z])|[+*?}]\+", "x", pattern))
        return True
    except re.error:
        return False


@verb("replaceRegex")
def replace_regex(s, pattern, new):
    p = value_of(pattern)
    return F.regexp_replace(col(s), p, value_of(new)) if valid(p) else F.lit(None).cast("string")


@verb("padLeft")
def pad_left(s, width, ch=" "):
    s = text(s)
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, int(value_of(width)), value_of(ch)[:1] or " "))


@verb("padRight")
def pad_right(s, width, ch=" "):
    s = text(s)
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(s, int(value_of(width)), value_of(ch)[:1] or " "))


@verb("pad")
def pad(s, width, ch):
    return pad_right(s, width, ch)


@verb("truncate")
def truncate(s, most, ellipsis=""):
    s, n, e = col(s), int(value_of(most)), value_of(ellipsis)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, max(0, n - len(e))), F.lit(e[:n]))).otherwise(s)


@verb("split")
def split(s, delimiter, index=None):
    d = value_of(delimiter)
    parts = F.split(col(s), q(d), -1) if d else F.filter(F.split(col(s), "", -1), lambda x: x != "")
    if index is None:
        return parts
    i = int(value_of(index))
    return F.try_element_at(parts, F.lit(i + 1 if i >= 0 else i))


@verb("join")
def join(array, delimiter):
    return F.array_join(F.transform(col(array), text), value_of(delimiter), "")


@verb("mask")
def mask(s, pattern):
    """# A * take the next character, anything else is literal; ends with the text."""
    s, used, parts = text(s), 0, []
    for ch in value_of(pattern):
        enough = F.length(s) > used
        if ch in "#A*":
            used += 1
            parts.append(F.when(enough, F.substring(s, used, 1)).otherwise(""))
        else:
            parts.append(F.when(enough, ch).otherwise(""))
    return F.when(s.isNotNull(), F.concat(*parts)) if parts else F.lit("")


@verb("reverseString")
def reverse_string(s):
    return F.reverse(col(s))


@verb("repeat")
def repeat(s, n):
    return F.when(col(n) >= 0, F.repeat(col(s), col(n).cast("int")))


@verb("substring")
def substring(s, start, length=None):
    s, a = col(s), F.greatest(col(start), F.lit(0)).cast("int")
    return F.substring(s, a + 1, F.lit(LAST) if length is None else F.greatest(col(length), F.lit(0)).cast("int"))


@verb("length")
def length(x):
    return F.coalesce(F.length(text(x)), F.lit(0))


def word_list(s) -> Column:
    """Words at spaces, tabs, underscores, hyphens and between a small and a large letter."""
    marked = F.regexp_replace(F.regexp_replace(col(s), r"([a-z0-9])([A-Z])", "$1 $2"), r"[ \t_-]+", " ")
    return F.filter(F.split(marked, " "), lambda w: w != "")


def _cap(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, LAST)))


@verb("camelCase")
def camel_case(s):
    return F.array_join(F.transform(word_list(s), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(_cap(w))), "")


@verb("snakeCase")
def snake_case(s):
    return F.lower(F.array_join(word_list(s), "_"))


@verb("kebabCase")
def kebab_case(s):
    return F.lower(F.array_join(word_list(s), "-"))


@verb("pascalCase")
def pascal_case(s):
    return F.array_join(F.transform(word_list(s), _cap), "")


@verb("slugify")
def slugify(s):
    low = F.regexp_replace(F.lower(col(s)), r"[^a-z0-9\s_-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[\s_]+", "-"), "-+", "-"), "^-+|-+$", "")


@verb("match")
def match(s, pattern):
    p = value_of(pattern)
    return col(s).rlike(p) if valid(p) else F.lit(None).cast("boolean")


@verb("matches")
def matches(s, pattern):
    return false(match(s, pattern))


@verb("extract")
def extract(s, pattern, group=0):
    p, g = value_of(pattern), int(value_of(group))
    if not valid(p):
        return F.lit(None).cast("string")
    return F.when(col(s).rlike(p), F.regexp_extract(col(s), p, g))


@verb("normalizeSpace")
def normalize_space(s):
    return F.btrim(F.regexp_replace(col(s), r"\s+", " "))


@verb("leftOf")
def left_of(s, delimiter):
    return F.substring_index(col(s), value_of(delimiter), 1)


@verb("rightOf")
def right_of(s, delimiter):
    s, d = col(s), value_of(delimiter)
    at = F.instr(s, d)
    return F.when(at > 0, F.substring(s, at + len(d), F.lit(LAST))).otherwise(F.when(s.isNotNull(), ""))


@verb("wrap")
def wrap(s, width):
    n = int(value_of(width))
    words = F.filter(F.split(col(s), r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))
    add = lambda a, w: (
        F.when(a["line"] == "", F.struct(a["done"].alias("done"), w.alias("line")))
        .when(F.length(a["line"]) + 1 + F.length(w) <= n, F.struct(a["done"].alias("done"), F.concat(a["line"], F.lit(" "), w).alias("line")))
        .otherwise(F.struct(F.concat(a["done"], a["line"], F.lit("\n")).alias("done"), w.alias("line")))
    )
    return F.aggregate(words, start, add, lambda a: F.concat(a["done"], a["line"]))


@verb("center")
def center(s, width, ch=" "):
    s, n, c = text(s), int(value_of(width)), value_of(ch)[:1] or " "
    left = F.length(s) + F.floor((F.lit(n) - F.length(s)) / 2).cast("int")
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(F.lpad(s, left, F.lit(c)), F.lit(n), F.lit(c)))


def _bare(x: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.StringType())
def _strip_accents(s: pd.Series) -> pd.Series:
    return s.map(_bare, na_action="ignore")


#: Blocks whose characters lose their marks one by one, whatever stands beside them: Latin,
#: combining marks, Greek, Cyrillic, their extensions, punctuation, kana and Han.
_PLAIN = ((0x0000, 0x052F), (0x1E00, 0x1FFF), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x3000, 0x3029), (0x3040, 0x30FF), (0x4E00, 0x9FA5))
_MARKED = {chr(c): _bare(chr(c)) for a, b in _PLAIN for c in range(a, b + 1) if _bare(chr(c)) != chr(c)}
_MARKED = dict(sorted(_MARKED.items(), key=lambda p: not p[1]))  # what goes for good comes last
_PLAIN_TEXT = "^[" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in _PLAIN) + "]*+$"


@verb("stripAccents")
def strip_accents(s):
    """No built-in normalises Unicode.  ASCII stays as it is, characters of common scripts
    are translated; only other texts reach Python, which gets null for the rest: it is
    handed every row of a batch, whatever a condition around it says."""
    s = col(s)
    ascii_, plain = F.length(s) == F.octet_length(s), s.rlike(_PLAIN_TEXT)
    return F.when(ascii_, s).when(plain, F.translate(s, "".join(_MARKED), "".join(_MARKED.values()))).otherwise(_strip_accents(F.when(~ascii_ & ~plain, s)))


@verb("clean")
def clean(s):
    no_control = F.regexp_replace(col(s), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(no_control, r"[   -   　]", " "), r"\s+", " "))


@verb("wordCount")
def word_count(s):
    return F.coalesce(F.size(F.filter(F.split(col(s), r"\s+"), lambda w: w != "")), F.lit(0))


@verb("tokenize")
def tokenize(s, delimiter=None):
    if delimiter is None:
        return F.filter(F.split(col(s), r"\s+"), lambda w: w != "")
    return F.filter(F.transform(F.split(col(s), q(value_of(delimiter)), -1), F.btrim), lambda w: w != "")


@verb("levenshtein")
def levenshtein(a, b):
    return F.coalesce(F.levenshtein(col(a), col(b)), F.lit(0))


#: Sound classes of the letters.
SOUNDS = {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}


@verb("soundex")
def soundex(s):
    """Every letter without a class, H and W included, ends a run of one class."""
    up = F.upper(col(s))
    letters = "".join(SOUNDS.values())
    digits = "".join(k * len(v) for k, v in SOUNDS.items())
    rest = "AEIOUYHW"
    coded = F.translate(F.regexp_replace(up, "[^A-Z]", ""), letters + rest, digits + "0" * len(rest))
    start = F.struct(F.lit("").alias("out"), F.substring(coded, 1, 1).alias("last"))
    tail = F.filter(F.split(F.substring(coded, 2, LAST), ""), lambda c: c != "")
    found = F.aggregate(tail, start, lambda a, c: F.struct(F.when((c != "0") & (c != a["last"]), F.concat(a["out"], c)).otherwise(a["out"]).alias("out"), c.alias("last")), lambda a: a["out"])
    return F.when(up.rlike("^[A-Z]"), F.rpad(F.concat(F.substring(up, 1, 1), F.substring(found, 1, 3)), 4, "0")).otherwise(F.when(up.isNotNull(), "0000"))


#: Fixed values: (country, digits, trunk prefix dropped, template).
PHONES = (
    ("US", 10, "1", "($1) $2-$3", r"^(\d{3})(\d{3})(\d{4})$"),
    ("CA", 10, "1", "($1) $2-$3", r"^(\d{3})(\d{3})(\d{4})$"),
    ("GB", 10, "44", "+44 $1 $2", r"^(\d{4})(\d{6})$"),
    ("DE", 10, "49", "+49 $1 $2", r"^(\d{3})(\d{7})$"),
    ("FR", 9, "33", "+33 $1 $2 $3 $4 $5", r"^(\d)(\d{2})(\d{2})(\d{2})(\d{2})$"),
    ("AU", 9, "61", "+61 $1 $2 $3", r"^(\d)(\d{4})(\d{4})$"),
    ("JP", 10, "81", "+81 $1-$2-$3", r"^(\d{2})(\d{4})(\d{4})$"),
)


@verb("formatPhone")
def format_phone(s, country):
    raw, c = text(s), col(country)
    out = None
    for name, n, trunk, template, shape in PHONES:
        d = F.regexp_replace(raw, r"\D", "")
        d = F.when((F.length(d) == n + len(trunk)) & d.startswith(trunk), F.substring(d, len(trunk) + 1, LAST)).when((F.length(d) == n + 1) & d.startswith("0"), F.substring(d, 2, LAST)).otherwise(d)
        out = (F if out is None else out).when((F.upper(c) == name) & (F.length(d) == n), F.regexp_replace(d, shape, template))
    return out.otherwise(raw)


@verb("escapeHtml")
def escape_html(s, apostrophe="&#39;"):
    out = col(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@verb("escapeXml")
def escape_xml(s):
    return escape_html(s, "&apos;")


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@verb("unescapeHtml")
def unescape_html(s):
    """Only texts with references beside those of ``escapeHtml`` and ``escapeXml`` reach Python."""
    s = col(s)
    odd, out = s.rlike("&(?!(?:lt|gt|quot|#39|apos|amp);)"), s
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(odd, _unescape(F.when(odd, s))).otherwise(out)


@verb("stripTags")
def strip_tags(s):
    return F.regexp_replace(col(s), "<[^>]*>", "")


@verb("template")
def template(tpl, values):
    """A constant template with {key} places; ``values``: a struct, map or dict of columns."""
    parts, at, t = [], 0, value_of(tpl)
    for m in re.finditer(r"\{(\w+)\}", t):
        parts.append(F.lit(t[at : m.start()]))
        k = m.group(1)
        parts.append(F.coalesce(text(values[k]), F.lit("")) if not isinstance(values, dict) or k in values else F.lit(""))
        at = m.end()
    return F.concat(*parts, F.lit(t[at:]))
