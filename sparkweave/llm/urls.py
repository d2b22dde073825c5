"""URL filter: pattern rules indexed by their rarest literal token.

Tokens are runs of letters or of digits (``casino24`` holds the token ``casino``).  The
tokens that every match of an expression holds as whole tokens are read off the expression;
each of its alternatives is filed under the one that the corpus has in the fewest URLs, so
no URL that lacks it can match.  An alternative without such a token is filed under the
empty token, which every URL has.  A URL fetches the rules filed under its own tokens, and
only those run.  Domain rules (host, path, verdict) are filed in the same index and judged
on host and path apart; the longest that fits gives ``rule`` and ``verdict``; otherwise the
pattern rules decide, block before allow, and what no rule matches is allowed.  Row-local:
no shuffle but the token counts.

Defined cases: a null URL or one without ``://`` has empty host and path, no domain rule,
and is judged by the pattern rules on its text (null counts as empty).  Repeated rows give
repeated results; columns named like the results are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

TOKEN = "[a-z]+|[0-9]+"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str  # pattern rules: over the lower-cased URL
    host: str  # domain rules
    path: str
    tokens: tuple[tuple[str, ...], ...]  # of each alternative
    rank: int  # domain rules: length, pattern rules: 0


#: (verdict, host, path)
DOMAIN_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: (verdict, expression over the lower-cased URL)
PATTERN_RULES = (
    ("block", r"://[^/?#]*\bcasino-win\b"),
    ("block", r"\bonline-casino\b|\bcasino\d*\."),
    ("block", r"\bcheap-pills\b"),
    ("block", r"\bfree-bets\b"),
    ("block", r"://[^/?#]*\bads-track\b"),
    ("block", r"\badserver\b"),
    ("block", r"\bdoubleclick\."),
    ("block", r"://[^/?#]*\bxxx\b"),
    ("block", r"\bporn\b"),
    ("block", r"\bphishing\b"),
)


def _kind(ch: int) -> str:
    return "letter" if 97 <= ch <= 122 else "digit" if 48 <= ch <= 57 else "other"


def _apart(item, kind: str) -> bool:
    """No text of the item has a character of the kind at an end."""
    name, arg = item
    if name is op.LITERAL:
        return _kind(arg) != kind
    if name is op.IN:
        for n, a in arg:
            if n is op.LITERAL and _kind(a) != kind:
                continue
            if n is op.CATEGORY and (a is op.CATEGORY_SPACE or a is op.CATEGORY_DIGIT and kind == "letter"):
                continue
            return False
        return True
    return False


def _edge(items: list, at: int, step: int, kind: str) -> bool:
    """A token of the kind ends beside place ``at``, whatever is matched there."""
    while 0 <= at < len(items):
        name, arg = items[at]
        if name is op.AT:
            if arg in (op.AT_BOUNDARY, op.AT_BEGINNING, op.AT_BEGINNING_STRING, op.AT_END_STRING):
                return True
            return False
        if name in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, _, inner = arg
            if len(inner) != 1 or not _apart(inner[0], kind):
                return False
            if least:
                return True
            at += step  # it may match nothing
            continue
        return _apart(items[at], kind)
    return False


def _alternatives(items: list, most: int = 64) -> list[list]:
    """The expression as one list of items for each way through its groups and branches;
    where that makes more than ``most``, a branch stays an item that holds no token."""
    out: list[list] = [[]]
    for item in items:
        name, arg = item
        inner = [list(b) for b in arg[1]] if name is op.BRANCH else [list(arg[3])] if name is op.SUBPATTERN and not arg[1] and not arg[2] else None
        ways = [w for b in inner for w in _alternatives(b, most)] if inner else [[item]]
        if len(out) * len(ways) > most:
            ways = [[item]]
        out = [o + w for o in out for w in ways]
    return out


def literal_tokens(regex: str) -> tuple[tuple[str, ...], ...]:
    """For each alternative of the expression, the tokens that all its matches hold."""
    branches = _alternatives(list(_parser.parse(regex)))
    out = []
    for items in branches:
        own, i = [], 0
        while i < len(items):
            kind = _kind(items[i][1]) if items[i][0] is op.LITERAL else "other"
            j = i
            while j < len(items) and items[j][0] is op.LITERAL and _kind(items[j][1]) == kind:
                j += 1
            if kind != "other" and _edge(items, i - 1, -1, kind) and _edge(items, j, 1, kind):
                own.append("".join(chr(x[1]) for x in items[i:j]))
            i = max(j, i + 1)
        out.append(tuple(dict.fromkeys(own)))
    return tuple(out)


def domain_rule(verdict: str, host: str, path: str) -> Rule:
    whole = path.lower()[: len(path) - len(re.search("[A-Za-z0-9]*$", path)[0])]  # a token cut by the rule's end isn't whole in the URL
    return Rule(host + path, verdict, "", host, path, (tuple(re.findall(TOKEN, host + " " + whole)),), len(host + path))


def pattern_rule(verdict: str, regex: str) -> Rule:
    return Rule(regex, verdict, regex, "", "", literal_tokens(regex), 0)


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_index(pages: DataFrame, rules: list[Rule], tokens: Column) -> dict[str, list[Rule]]:
    """Rules by the rarest token of each alternative.  Counts cover every URL; at most one
    count for each token of the rule list comes to the driver."""
    known = sorted({t for r in rules for alt in r.tokens for t in alt})
    counts = dict.fromkeys(known, 0)
    if known:
        hits = pages.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, known)))).alias("t"))
        counts.update({r["t"]: r["count"] for r in hits.groupBy("t").count().collect()})
    out: dict[str, list[Rule]] = {}
    for r in rules:
        for at in {min(alt, key=lambda t: (counts[t], t), default="") for alt in r.tokens}:
            out.setdefault(at, []).append(r)
    return out


def filter_urls(pages: DataFrame, domain_rules=DOMAIN_RULES, pattern_rules=PATTERN_RULES, url_col: str = "url") -> DataFrame:
    """All columns of ``pages`` with host, path, rule, verdict, n_candidates."""
    rules = [domain_rule(*r) for r in domain_rules] + [pattern_rule(*r) for r in pattern_rules]
    host, path = host_path(F.col(url_col))
    low = ascii_lower(F.coalesce(F.col(url_col), F.lit("")))
    mine = ["host", "path", "rule", "verdict", "n_candidates"]
    kept = [c for c in pages.columns if c not in mine]
    u, t_, h_, f_, top_ = (fresh(pages, n) for n in ("url", "tokens", "hits", "fits", "top"))
    base = pages.select(*kept, host.alias("host"), path.alias("path"), low.alias(u))
    tokens = F.array_distinct(F.regexp_extract_all(u, F.lit(TOKEN), F.lit(0)))
    index = rule_index(base, rules, tokens)
    entry = lambda r: F.struct(
        F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path")
    )
    found = base.withColumn(t_, F.array_append(tokens, F.lit("")) if "" in index else tokens)
    if index:
        table = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(entry, rs)))])
        # a rule of several alternatives may come by several tokens
        hits = F.array_distinct(F.flatten(F.filter(F.transform(t_, lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull())))
    else:
        hits = F.array().cast("array<struct<rank:int,name:string,verdict:string,regex:string,host:string,path:string>>")
    found = found.withColumn(h_, hits)
    dotted = F.concat(F.lit("."), F.col("host"))
    fits = F.filter(
        h_,
        lambda r: F.when(r["rank"] > 0, F.endswith(dotted, F.concat(F.lit("."), r["host"])) & F.startswith(F.col("path"), r["path"])).otherwise(F.rlike(F.col(u), r["regex"])),
    )
    top = F.array_max(F.transform(F.filter(f_, lambda r: r["rank"] > 0), lambda r: F.struct(r["rank"].alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    matched = lambda v: F.exists(f_, lambda r: (r["rank"] == 0) & (r["verdict"] == v))
    return (
        found.withColumn(f_, fits).withColumn(top_, top)
        .select(*kept, "host", "path", F.col(top_)["name"].alias("rule"), F.coalesce(F.col(top_)["verdict"], F.when(matched("block"), "block").otherwise("allow")).alias("verdict"), F.size(h_).alias("n_candidates"))
    )
