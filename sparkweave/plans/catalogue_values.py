"""Queries of verbs over arrays of structs, objects, cash flows and generated values: every
argument that may be a column is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import call as v
from .catalogue import LATE, QUERIES, r, rows
from .catalogue_language import order_documents

c = F.col
i = lambda x: x.cast("bigint")
text_of = lambda xs: v("join", F.transform(xs, lambda x: x.cast("string")), ",")

_ORDER = "order by l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag"
_DOCS = f"""(select l_orderkey as doc, list(struct_pack(line := l_linenumber, part := l_partkey, qty := l_quantity, price := l_extendedprice, flag := l_returnflag) {_ORDER}) as ls,
    list(l_quantity {_ORDER}) as qs, list(l_extendedprice {_ORDER}) as ps, list(l_returnflag {_ORDER}) as fl, list(l_linenumber {_ORDER}) as ln from lineitem join orders on o_orderkey = l_orderkey group by 1)"""


def documents(name: str, columns) -> None:
    """A projection of order documents: columns() gives name -> (column, SQL)."""

    def run(spark, sf_dir):
        d = order_documents(spark, sf_dir)
        d = d.select("doc", c("lines").alias("ls"), *[c("lines")[f].alias(n) for n, f in (("qs", "qty"), ("ps", "price"), ("fl", "flag"), ("ln", "line"))])
        return d.select("doc", *[x.alias(n) for n, (x, _) in columns().items()])

    QUERIES[name] = run
    LATE[name] = lambda: "select doc, " + ", ".join(f"{s} as {n}" for n, (_, s) in columns().items()) + f" from {_DOCS}"


def has_flag(x: str) -> str:
    return f"list_filter(ls, lambda x: x.flag = '{x}')"


_NULLED = "list_transform(qs, lambda x: case when x > 25 then x end)"
nulled = lambda: F.transform("qs", lambda x: F.when(x > 25, x))

documents("array_items", lambda: {
    "filtered": (text_of(v("pluck", v("filter", c("ls"), "flag", "=", "R"), "part")), f"array_to_string(list_transform({has_flag('R')}, lambda x: x.part::varchar), ',')"),
    "mapped": (text_of(v("map", c("ls"), "line")), "array_to_string(list_transform(ls, lambda x: x.line::varchar), ',')"),
    "sorted": (text_of(v("pluck", v("sortBy", c("ls"), "qty"), "part")), "array_to_string(list_transform(list_sort(list_transform(ls, lambda x, i: {'k': x.qty, 'i': i, 'p': x.part})), lambda y: y.p::varchar), ',')"),
    "found": (v("find", c("ls"), "flag", "=", "R")["part"], f"{has_flag('R')}[1].part"),
    "found_at": (i(v("findIndex", c("ls"), "qty", ">", 40)), "coalesce(list_position(list_transform(ls, lambda x: x.qty > 40), true), 0)::bigint - 1"),
    "flat": (v("join", v("flatten", F.array("fl", "fl")), ""), "array_to_string(list_concat(fl, fl), '')"), "uniques": (v("join", v("sort", v("unique", c("fl"))), ""), "array_to_string(list_sort(list_distinct(fl)), '')"),
    "groups": (i(F.size(v("groupBy", c("ls"), "flag"))), "len(list_distinct(fl))"), "first_key": (F.get(v("groupBy", c("ls"), "flag"), F.lit(0))["key"], "fl[1]"),
    "first_items": (i(F.size(F.get(v("groupBy", c("ls"), "flag"), F.lit(0))["items"])), "len(list_filter(fl, lambda x: x = fl[1]))"),
    "passed": (i(F.size(v("partition", c("ls"), "qty", ">", 25)["pass"])), "len(list_filter(qs, lambda x: x > 25))"), "failed": (i(F.size(v("partition", c("ls"), "qty", ">", 25)["fail"])), "len(list_filter(qs, lambda x: x <= 25))"),
    "limited": (v("join", v("limit", c("fl"), 2), ""), "array_to_string(fl[1:2], '')"), "numbered": (i(v("at", v("rowNumber", c("fl")), -1)["_rowNum"]), "len(fl)"),
    "sampled": (v("includes", c("fl"), v("at", v("sample", c("fl"), 1, c("doc"), kind="string"), 0)), "true"), "sample_size": (i(F.size(v("sample", c("ln"), 3, "s", kind="int"))), "least(len(ln), 3)"),
    "deduped": (text_of(v("pluck", v("dedupe", c("ls"), "flag"), "line")), "array_to_string(list_transform(list_filter(ls, lambda x, i: list_position(fl, x.flag) = i), lambda x: x.line::varchar), ',')"),
    "both": (i(F.size(v("concatArrays", c("fl"), c("fl")))), "2 * len(fl)"), "united": (i(F.size(v("union", c("fl"), F.array(F.lit("Z"))))), "len(list_distinct(fl)) + 1"),
    "apart": (i(F.size(v("symmetricDifference", c("fl"), F.array(F.lit("R"), F.lit("Z"))))), "len(list_filter(list_distinct(fl), lambda x: x <> 'R')) + 1 + (not list_contains(fl, 'R'))::int"),
    "pivoted": (v("pivot", c("ls"), "flag", "qty")["R"], f"{has_flag('R')}[-1].qty"), "unpivoted": (i(F.size(v("unpivot", v("pivot", c("ls"), "flag", "qty")))), "len(list_distinct(fl))"),
    "counted": (i(v("countBy", c("ls"), "flag")["R"]), f"nullif(len({has_flag('R')}), 0)"), "keyed": (v("keyBy", c("ls"), "flag")["R"]["part"], f"{has_flag('R')}[-1].part"),
    "exploded": (i(F.size(v("explode", F.transform("ls", lambda x: F.struct(F.array(x["line"], x["line"]).alias("xs"))), "xs"))), "2 * len(ls)"),
    "pairs": (i(F.size(v("zip", c("fl"), c("qs")))), "len(fl)"), "second_window": (text_of(F.get(v("window", c("ln"), 2), F.lit(1))), "case when len(ln) >= 3 then ln[2]::varchar || ',' || ln[3]::varchar end"), "second_chunk": (text_of(F.get(v("chunk", c("ln"), 2), F.lit(1))), "case when len(ln) >= 3 then array_to_string(list_transform(ln[3:4], lambda x: x::varchar), ',') end"),
})
documents("array_numbers", lambda: {
    "cumsum_": (r(v("last", v("cumsum", c("qs")))), "round(list_sum(qs), 6)"), "cumprod_": (v("last", v("cumprod", c("ln"))), "list_product(ln)::double"), "diff_": (v("at", v("diff", c("qs")), 1), "qs[2] - qs[1]"), "diff2": (v("at", v("diff", c("qs"), 2), 2), "qs[3] - qs[1]"),
    "pct": (r(v("at", v("pctChange", c("qs")), 1)), "round((qs[2] - qs[1]) / qs[1], 6)"), "shift_": (text_of(v("shift", c("ln"), 1, 0)), "array_to_string(list_transform(list_prepend(0, ln[1:len(ln) - 1]), lambda x: x::varchar), ',')"), "lag_": (v("at", v("lag", c("qs")), 1), "case when len(qs) > 1 then qs[1] end"),
    "lead_": (v("at", v("lead", c("qs"), 1, -1.0), 0), "coalesce(qs[2], -1.0)"), "rank_": (i(v("at", v("rank", c("ls"), "qty"), 0)["_rank"]), "1 + len(list_filter(qs, lambda x: x > qs[1]))"), "rank_up": (i(v("at", v("rank", c("ls"), "qty", "asc"), 0)["_rank"]), "1 + len(list_filter(qs, lambda x: x < qs[1]))"),
    "filled": (v("sum", v("fillMissing", nulled(), 0.0)), f"coalesce(list_sum({_NULLED}), 0)"), "filled_mean": (r(v("avg", v("fillMissing", nulled(), 0.0, "mean"))), f"round(coalesce(list_avg({_NULLED}), 0), 6)"),
    "filled_on": (v("last", v("fillMissing", nulled(), -1.0, "forward")), "coalesce(list_filter(qs, lambda x: x > 25)[-1], -1.0)"), "filled_back": (v("first", v("fillMissing", nulled(), -1.0, "backward")), "coalesce(list_filter(qs, lambda x: x > 25)[1], -1.0)"),
    "reduced": (r(v("reduce", c("qs"), "add", 0.0)), "round(list_sum(qs), 6)"), "reduced_max": (v("reduce", c("qs"), "maxOf", 0.0), "list_max(qs)"), "accumulated": (r(v("accumulate", c("qs"), "sum", 0.0)), "round(list_sum(qs), 6)"),
    "count_if": (i(v("countIf", c("ls"), "flag", "=", "R")), f"len({has_flag('R')})"), "sum_if": (r(v("sumIf", c("ls"), "flag", "=", "R", "price"), 2), f"round(coalesce(list_sum(list_transform({has_flag('R')}, lambda x: x.price)), 0), 2)"),
    "avg_if": (r(v("avgIf", c("ls"), "flag", "=", "R", "qty")), f"round(list_avg(list_transform({has_flag('R')}, lambda x: x.qty)), 6)"), "every_": (v("every", c("ls"), "qty", ">", 5), "len(list_filter(qs, lambda x: x <= 5)) = 0"), "some_": (v("some", c("ls"), "qty", ">", 45), "len(list_filter(qs, lambda x: x > 45)) > 0"),
    "percentile_": (r(v("percentile", c("qs"), 90)), "round(list_aggregate(qs, 'quantile_cont', 0.9), 6)"), "quantile_": (r(v("quantile", c("qs"), 0.25)), "round(list_aggregate(qs, 'quantile_cont', 0.25), 6)"),
    "covariance_": (r(v("covariance", c("qs"), c("ln"))), "round(list_avg(list_transform(ls, lambda x: x.qty * x.line)) - list_avg(qs) * list_avg(ln), 6)"), "zscore_": (r(v("zscore", F.get(c("qs"), F.lit(0)), c("qs")), 5), "round((qs[1] - list_avg(qs)) / nullif(list_stddev_pop(qs), 0), 5)"),
    "weighted": (r(v("weightedAvg", c("qs"), c("ln"))), "round(list_sum(list_transform(ls, lambda x: x.qty * x.line)) / list_sum(ln), 6)"), "moving": (v("at", v("movingAvg", c("qs"), 2), 1), "case when len(qs) > 1 then (qs[1] + qs[2]) / 2 end"),
    "last_mode": (v("mode", F.array(c("doc") % 3, c("doc") % 2, c("doc") % 3)), "(doc % 3)::double"),
})

_MAP = lambda: F.create_map(F.lit("name"), c("c_name"), F.lit("segment"), c("c_mktsegment"), F.lit("id"), c("c_custkey").cast("string"))
other = lambda: F.create_map(F.lit("segment"), F.lit("none"), F.lit("more"), c("c_nationkey").cast("string"))
pair_list = lambda: F.array(F.struct(F.lit("a").alias("key"), c("c_name").alias("value")), F.struct(F.lit("a").alias("key"), c("c_mktsegment").alias("value")), F.struct(F.lit("b").alias("key"), c("c_name").alias("value")))
rows("objects", "customer", ["c_custkey"], lambda: {
    "keys_": (v("join", v("keys", _MAP()), ","), "'name,segment,id'"), "values_": (v("join", v("values", _MAP()), ","), "c_name || ',' || c_mktsegment || ',' || c_custkey"), "entries_": (F.get(v("entries", _MAP()), F.lit(1))["value"], "c_mktsegment"),
    "has_": (v("has", _MAP(), "name"), "true"), "has_not": (v("has", _MAP(), "nothing"), "false"), "get_": (v("get", _MAP(), "segment"), "c_mktsegment"), "get_default": (v("get", _MAP(), "nothing", c("c_name")), "c_name"),
    "merged": (F.to_json(v("merge", _MAP(), other())), "'{\"name\":\"' || c_name || '\",\"segment\":\"none\",\"id\":\"' || c_custkey || '\",\"more\":\"' || c_nationkey || '\"}'"), "picked": (F.to_json(v("pick", _MAP(), "id", "name")), "'{\"id\":\"' || c_custkey || '\",\"name\":\"' || c_name || '\"}'"),
    "omitted": (F.to_json(v("omit", _MAP(), "id", "name")), "'{\"segment\":\"' || c_mktsegment || '\"}'"), "of_entries": (F.to_json(v("fromEntries", pair_list())), "'{\"a\":\"' || c_mktsegment || '\",\"b\":\"' || c_name || '\"}'"), "object_": (F.to_json(v("toObject", pair_list())), "'{\"a\":\"' || c_mktsegment || '\",\"b\":\"' || c_name || '\"}'"),
    "inverted": (v("invert", _MAP())[c("c_name")], "'name'"), "defaults_": (F.to_json(v("defaults", _MAP(), other())), "'{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\",\"id\":\"' || c_custkey || '\",\"more\":\"' || c_nationkey || '\"}'"),
    "renamed": (F.to_json(v("renameKeys", _MAP(), {"name": "title", "id": "key"})), "'{\"title\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\",\"key\":\"' || c_custkey || '\"}'"),
    "compacted": (F.to_json(v("compactObject", F.create_map(F.lit("a"), c("c_name"), F.lit("b"), F.nullif(c("c_mktsegment"), F.lit("BUILDING")), F.lit("c"), F.lit("")))), "case when c_mktsegment = 'BUILDING' then '{\"a\":\"' || c_name || '\"}' else '{\"a\":\"' || c_name || '\",\"b\":\"' || c_mktsegment || '\"}' end"),
    "stable": (v("stableStringify", _MAP()), "'{\"id\":\"' || c_custkey || '\",\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}'"), "hash_": (v("canonicalHash", _MAP()), "sha256('{\"id\":\"' || c_custkey || '\",\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}')"),
    "query_": (v("buildQuery", F.create_map(F.lit("q"), F.concat(c("c_mktsegment"), F.lit(" &")), F.lit("id"), c("c_custkey").cast("string"))), "'id=' || c_custkey || '&q=' || c_mktsegment || '+%26'"), "query_back": (v("parseQuery", F.concat(F.lit("?b="), c("c_custkey").cast("string"), F.lit("&a=x%20y&b=2")))["b"], "c_custkey::varchar"),
    "url_": (v("buildUrl", F.struct(F.lit("https").alias("scheme"), F.lit("h.example").alias("host"), F.lit(8080).alias("port"), F.concat(F.lit("c/"), c("c_custkey").cast("string")).alias("path"), F.create_map(F.lit("s"), c("c_mktsegment")).alias("query"), F.lit("top").alias("fragment"))), "'https://h.example:8080/c/' || c_custkey || '?s=' || c_mktsegment || '#top'"),
    "mac": (v("hmac", "The quick brown fox jumps over the lazy dog", "key"), "'f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8'"), "mac_length": (i(F.length(v("hmac", c("c_name"), c("c_mktsegment"), "sha512"))), "128::bigint"), "set_": (v("set", c("c_name")), "c_name"),
}, spread=True)
_FLOWS = lambda: F.array(-c("o_totalprice"), c("o_totalprice") * 1.1)
_DATES = lambda: F.array(F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 365))
rows("cash_flows", "orders", ["o_orderkey"], lambda: {
    "irr_": (r(v("irr", _FLOWS())), "0.1::double"), "xirr_": (r(v("xirr", _FLOWS(), _DATES())), "0.1::double"), "xnpv_": (r(v("xnpv", 0.05, _FLOWS(), _DATES()), 3), "round(-o_totalprice + o_totalprice * 1.1 / 1.05, 3)"),
    "rate_": (r(v("rate", 12, -v("pmt", c("o_totalprice"), 0.01, 12), c("o_totalprice"))), "0.01::double"), "irr3": (r(v("irr", F.array(-c("o_totalprice"), c("o_totalprice") * 0.0, c("o_totalprice") * 1.21))), "0.1::double"),
}, spread=True)
rows("text_marks", "documents", ["doc_id"], lambda: {
    "plain": (v("md5", v("stripAccents", c("text"))), "md5(strip_accents(text))"), "unescaped": (v("md5", v("unescapeHtml", v("escapeHtml", c("text")))), "md5(text)"),
})
rows("generated", "orders", ["o_orderkey"], lambda: {
    "today_": (v("today") >= F.lit("2020-01-01").cast("date"), "true"), "now_": (v("now") >= F.lit("2020-01-01").cast("timestamp"), "true"), "stamp": (v("parseTimestamp", F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss"), "DD.MM.YYYY HH:mm:ss"), "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"),
    "die": (v("random", 1, 6).between(1, 6), "true"), "seeded": (v("random", 1, 6, "s") == v("random", 1, 6, "s"), "true"), "uuid_": (i(F.length(v("uuid"))), "36::bigint"), "uuid_seeded": (v("uuid", c("o_custkey")) == v("uuid", c("o_custkey").cast("string")), "true"), "nano": (i(F.length(v("nanoid", 12))), "12::bigint"),
    "number_": (v("sequence", c("o_orderkey"), 5, ("o_custkey",)), "row_number() over (partition by o_custkey order by o_orderkey) + 4"), "reset": (v("resetSequence", c("o_orderkey"), "o_custkey"), "row_number() over (partition by o_custkey order by o_orderkey) - 1"),
})
