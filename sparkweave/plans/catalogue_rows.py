"""Queries of the row-local verb families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import call as v
from .catalogue import r, rows

c = F.col
i = lambda x: x.cast("bigint")

rows("core", "customer", ["c_custkey"], lambda: {
    "concat": (v("concat", c("c_name"), "/", c("c_mktsegment")), "c_name || '/' || c_mktsegment"),
    "upper": (v("upper", c("c_name")), "upper(c_name)"), "lower": (v("lower", c("c_name")), "lower(c_name)"),
    "trim": (v("trim", F.concat(F.lit(" \t"), c("c_name"), F.lit("\n "))), "c_name"),
    "trim_left": (v("trimLeft", F.concat(F.lit("  "), c("c_name"))), "c_name"), "trim_right": (v("trimRight", F.concat(c("c_name"), F.lit("  "))), "c_name"),
    "coalesce_": (v("coalesce", F.lit(""), F.lit(None).cast("string"), c("c_name")), "c_name"), "if_null": (v("ifNull", F.nullif(c("c_mktsegment"), F.lit("BUILDING")), "none"), "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')"),
    "if_empty": (v("ifEmpty", F.lit(""), c("c_name")), "c_name"), "if_else": (v("ifElse", c("c_acctbal") > 0, "credit", "debit"), "case when c_acctbal > 0 then 'credit' else 'debit' end"),
})
rows("coercion", "orders", ["o_orderkey"], lambda: {
    "string_": (v("coerceString", c("o_custkey")), "cast(o_custkey as varchar)"), "number_": (v("coerceNumber", c("o_orderpriority")), "0.0::double"), "integer_": (i(v("coerceInteger", c("o_totalprice"))), "floor(o_totalprice)::bigint"),
    "boolean_": (v("coerceBoolean", F.when(c("o_orderstatus") == "O", "YES").otherwise("x")), "o_orderstatus = 'O'"), "date_": (v("coerceDate", F.date_format("o_orderdate", "yyyyMMdd")), "o_orderdate::date"),
    "slash_": (v("coerceDate", F.date_format("o_orderdate", "MM/dd/yyyy")), "o_orderdate::date"), "timestamp_": (v("coerceTimestamp", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), "date_trunc('second', o_orderdate)"),
    "tag_": (v("tryCoerce", c("o_custkey"))["type"], "'integer'"), "array_": (i(F.size(v("toArray", c("o_custkey")))), "1::bigint"),
})
rows("logic", "lineitem", ["l_orderkey", "l_linenumber"], lambda: {
    "and_": (v("and", c("l_quantity") > 10, c("l_discount") > 0), "l_quantity > 10 and l_discount > 0"), "or_": (v("or", c("l_quantity") > 40, c("l_tax")), "l_quantity > 40 or l_tax <> 0"),
    "not_": (v("not", c("l_discount")), "l_discount = 0"), "xor_": (v("xor", c("l_quantity") > 10, c("l_discount") > 0.05), "(l_quantity > 10) <> (l_discount > 0.05)"),
    "eq_": (v("eq", c("l_linenumber"), "1"), "l_linenumber = 1"), "ne_": (v("ne", c("l_returnflag"), "R"), "l_returnflag <> 'R'"), "lt_": (v("lt", c("l_quantity"), 20), "l_quantity < 20"), "lte_": (v("lte", c("l_quantity"), 20), "l_quantity <= 20"),
    "gt_": (v("gt", c("l_returnflag"), "N"), "l_returnflag > 'N'"), "gte_": (v("gte", c("l_quantity"), "20"), "l_quantity >= 20"), "between_": (v("between", c("l_quantity"), 10, 20), "l_quantity between 10 and 20"),
    "is_null": (v("isNull", F.nullif(c("l_returnflag"), F.lit("R"))), "l_returnflag = 'R'"), "is_string": (v("isString", c("l_returnflag")), "true"), "is_number": (v("isNumber", c("l_tax")), "true"), "is_boolean": (v("isBoolean", c("l_tax")), "false"),
    "is_array": (v("isArray", F.lit("[1]")), "true"), "is_object": (v("isObject", F.lit("{}")), "true"), "is_date": (v("isDate", c("l_shipdate")), "true"), "type_of": (v("typeOf", c("l_linenumber")), "'integer'"),
    "cond_": (v("cond", c("l_quantity") > 40, "big", c("l_quantity") > 20, "mid", "small"), "case when l_quantity > 40 then 'big' when l_quantity > 20 then 'mid' else 'small' end"),
    "assert_": (v("assert", F.nullif(c("l_returnflag"), F.lit("R"))), "nullif(l_returnflag, 'R')"), "switch_": (v("switch", c("l_returnflag"), "R", "returned", "A", "accepted", "none"), "case l_returnflag when 'R' then 'returned' when 'A' then 'accepted' else 'none' end"),
    "is_finite": (v("isFinite", c("l_tax")), "true"), "is_nan": (v("isNaN", c("l_tax")), "false"),
})
rows("string_case", "part", ["p_partkey"], lambda: {
    "capitalize": (v("capitalize", c("p_type")), "upper(left(p_type, 1)) || lower(substr(p_type, 2))"), "contains_": (v("contains", c("p_name"), "an"), "contains(p_name, 'an')"), "starts_": (v("startsWith", c("p_type"), "S"), "starts_with(p_type, 'S')"),
    "ends_": (v("endsWith", c("p_type"), "L"), "ends_with(p_type, 'L')"), "replace_": (v("replace", c("p_type"), "A", "_"), "replace(p_type, 'A', '_')"), "regex_": (v("replaceRegex", c("p_brand"), "[0-9]+", "N"), "regexp_replace(p_brand, '[0-9]+', 'N', 'g')"),
    "pad_left": (v("padLeft", c("p_size"), 5, "0"), "lpad(p_size::varchar, 5, '0')"), "pad_right": (v("padRight", c("p_size"), 5, "."), "rpad(p_size::varchar, 5, '.')"), "pad_": (v("pad", c("p_size"), 4, "*"), "rpad(p_size::varchar, 4, '*')"),
    "truncate_": (v("truncate", c("p_name"), 5), "left(p_name, 5)"), "split_": (v("split", c("p_brand"), "#", 1), "split_part(p_brand, '#', 2)"), "join_": (v("join", F.split("p_name", ""), "-"), "array_to_string(string_split(p_name, ''), '-')"),
    "mask_": (v("mask", c("p_brand"), "##-##"), "substr(p_brand, 1, 2) || '-' || substr(p_brand, 3, 2)"), "reverse_": (v("reverseString", c("p_name")), "reverse(p_name)"), "repeat_": (v("repeat", c("p_brand"), 2), "repeat(p_brand, 2)"),
    "substring_": (v("substring", c("p_name"), 2, 3), "substr(p_name, 3, 3)"), "length_": (i(v("length", c("p_name"))), "length(p_name)"), "left_of": (v("leftOf", c("p_brand"), "#"), "split_part(p_brand, '#', 1)"),
    "right_of": (v("rightOf", c("p_brand"), "#"), "split_part(p_brand, '#', 2)"), "snake": (v("snakeCase", F.concat(c("p_brand"), F.lit(" NameOf"))), "lower(p_brand) || '_name_of'"), "kebab": (v("kebabCase", F.lit("someName here")), "'some-name-here'"),
    "camel": (v("camelCase", F.lit("some_name here")), "'someNameHere'"), "pascal": (v("pascalCase", F.lit("some_name here")), "'SomeNameHere'"), "slug": (v("slugify", c("p_brand")), "replace(lower(p_brand), '#', '')"),
    "match_": (v("match", c("p_brand"), "#[1-3]"), "regexp_matches(p_brand, '#[1-3]')"), "matches_": (v("matches", c("p_brand"), "1$"), "regexp_matches(p_brand, '1$')"), "extract_": (v("extract", c("p_brand"), "#([0-9]+)", 1), "nullif(regexp_extract(p_brand, '#([0-9]+)', 1), '')"),
    "center_": (v("center", F.lit("ab"), 6, "*"), "'**ab**'"), "title": (v("titleCase", F.lit("big\tred box")), "'Big Red Box'"), "levenshtein_": (i(v("levenshtein", c("p_brand"), c("p_type"))), "levenshtein(p_brand, p_type)"),
    "phone": (v("formatPhone", F.lit("5551234567"), "US"), "'(555) 123-4567'"), "escape_html": (v("escapeHtml", F.concat(F.lit("<b>"), c("p_brand"), F.lit("</b>"))), "'&lt;b&gt;' || p_brand || '&lt;/b&gt;'"), "escape_xml": (v("escapeXml", F.lit("a'b")), "'a&apos;b'"),
    "strip_tags": (v("stripTags", F.concat(F.lit("<i>"), c("p_brand"), F.lit("</i>"))), "p_brand"), "template_": (v("template", "{a}:{b}", {"a": c("p_brand"), "b": c("p_size")}), "p_brand || ':' || p_size"), "soundex_": (v("soundex", F.lit("Ashcraft")), "'A226'"),
})
rows("string_text", "documents", ["doc_id"], lambda: {
    "words": (i(v("wordCount", c("text"))), "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::bigint"), "normal": (v("md5", v("normalizeSpace", c("text"))), "md5(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^ | $', '', 'g'))"),
    "tokens": (i(F.size(v("tokenize", c("text")))), "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::bigint"), "size_": (i(v("length", c("text"))), "length(text)"), "clean_": (i(F.least(v("length", v("clean", c("text"))), F.lit(1))), "least(length(trim(text)), 1)"),
    "wrapped": (i(v("length", v("wrap", F.lit("aa bb cc dd"), 5))), "11::bigint"),
})
rows("encoding", "documents", ["doc_id"], lambda: {
    "md5_": (v("md5", c("text")), "md5(text)"), "sha1_": (v("sha1", c("text")), "sha1(text)"), "sha256_": (v("sha256", c("text")), "sha256(text)"), "b64": (v("base64Encode", c("source")), "base64(encode(source))"), "hex_": (v("hexEncode", c("source")), "lower(hex(source))"),
    "back64": (v("base64Decode", v("base64Encode", c("source"))), "source"), "back_hex": (v("hexDecode", v("hexEncode", c("lang"))), "lang"), "b64url": (v("base64urlEncode", c("source")), "rtrim(translate(base64(encode(source)), '+/', '-_'), '=')"), "back_url64": (v("base64urlDecode", v("base64urlEncode", c("source"))), "source"),
    "url_": (v("urlEncode", F.concat(c("source"), F.lit(" &~"))), "source || '%20%26~'"), "unurl": (v("urlDecode", v("urlEncode", c("source"))), "source"), "crc": (v("crc32", F.lit("abc")), "'352441c2'"), "sha512_": (F.length(v("sha512", c("text"))).cast("bigint"), "128::bigint"),
    "json_": (v("jsonEncode", F.concat(c("lang"), F.lit('"'))), "lang || '\\\"'"),
})
rows("json_path", "events", ["event_id"], lambda: {"whole": (v("jsonPath", c("props"), "$.k"), "json_extract_string(props, '$.k')"), "decoded": (v("isNull", v("jsonDecode", c("props"))), "not json_valid(props)")})
rows("url_parts", "pages", ["page_id"], lambda: {
    "scheme": (v("parseUrl", c("url"))["scheme"], "regexp_extract(url, '^([a-z]+):', 1)"), "host_": (v("parseUrl", c("url"))["host"], "regexp_extract(url, '://([^/?#]+)', 1)"), "ref": (v("parseUrl", c("url"))["query"]["ref"], "nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '')"),
})
rows("numbers", "lineitem", ["l_orderkey", "l_linenumber"], lambda: {
    "floor_": (i(v("floor", c("l_extendedprice"))), "floor(l_extendedprice)::bigint"), "ceil_": (i(v("ceil", c("l_extendedprice"))), "ceil(l_extendedprice)::bigint"), "negate_": (v("negate", c("l_tax")), "-l_tax"), "sign_": (v("sign", c("l_tax")), "sign(l_tax)::bigint"), "trunc_": (i(v("trunc", -c("l_extendedprice"))), "trunc(-l_extendedprice)::bigint"),
    "min_of": (v("minOf", c("l_quantity"), c("l_linenumber")), "least(l_quantity, l_linenumber)"), "max_of": (v("maxOf", c("l_quantity"), c("l_linenumber")), "greatest(l_quantity, l_linenumber)"), "parse_int": (v("parseInt", F.concat(c("l_linenumber").cast("string"), F.lit("x"))), "l_linenumber::bigint"), "hex_int": (v("parseInt", F.lit("ff"), 16), "255::bigint"),
    "safe": (r(v("safeDivide", c("l_extendedprice"), c("l_discount"), -1)), "round(case when l_discount = 0 then -1 else l_extendedprice / l_discount end, 6)"), "add_": (r(v("add", c("l_tax"), c("l_discount"))), "round(l_tax + l_discount, 6)"), "subtract_": (r(v("subtract", c("l_tax"), c("l_discount"))), "round(l_tax - l_discount, 6)"),
    "multiply_": (r(v("multiply", c("l_tax"), c("l_quantity"))), "round(l_tax * l_quantity, 6)"), "divide_": (r(v("divide", c("l_tax"), c("l_quantity"))), "round(l_tax / l_quantity, 6)"), "abs_": (v("abs", -c("l_tax")), "abs(l_tax)"), "mod_": (v("mod", c("l_quantity"), 7), "l_quantity % 7"), "round_": (v("round", F.lit(2.5)), "2.0::double"),
    "gcd_": (v("gcd", c("l_orderkey"), 12), "gcd(l_orderkey, 12)::bigint"), "lcm_": (v("lcm", c("l_linenumber"), 6), "lcm(l_linenumber, 6)::bigint"), "factorial_": (v("factorial", c("l_linenumber")), "factorial(l_linenumber)::bigint"), "km": (v("convertUnit", c("l_quantity"), "km", "m"), "round(l_quantity * 1000, 6)"), "fahrenheit": (v("convertUnit", c("l_quantity"), "c", "f"), "round(l_quantity * 9 / 5 + 32, 6)"),
    "fixed": (v("formatNumber", c("l_quantity"), 1), "printf('%.1f', l_quantity)"), "integer_": (v("formatInteger", c("l_quantity")), "floor(l_quantity)::bigint::varchar"), "currency": (v("formatCurrency", c("l_quantity")), "printf('%.2f', l_quantity)"), "percent": (v("formatPercent", c("l_discount")), "round(l_discount * 100)::bigint || '%'"),
    "clamp_": (v("clamp", c("l_quantity"), 10, 20), "least(greatest(l_quantity, 10), 20)"), "interpolated": (r(v("interpolate", c("l_quantity"), 0, 0, 10, 5)), "round(l_quantity / 2, 6)"), "log_": (r(v("log", c("l_quantity"), 2)), "round(ln(l_quantity) / ln(2), 6)"), "ln_": (r(v("ln", c("l_quantity"))), "round(ln(l_quantity), 6)"), "log10_": (r(v("log10", c("l_quantity"))), "round(log10(l_quantity), 6)"),
    "exp_": (r(v("exp", c("l_tax"))), "round(exp(l_tax), 6)"), "pow_": (r(v("pow", c("l_quantity"), 2)), "round(pow(l_quantity, 2), 6)"), "sqrt_": (r(v("sqrt", c("l_quantity"))), "round(sqrt(l_quantity), 6)"), "locale": (v("formatLocaleNumber", F.lit(1234567.5), "de-DE", 2), "'1.234.567,50'"),
})
rows("dates", "orders", ["o_orderkey"], lambda: {
    "formatted": (v("formatDate", c("o_orderdate"), "DD.MM.YYYY"), "strftime(o_orderdate, '%d.%m.%Y')"), "parsed": (v("parseDate", F.date_format("o_orderdate", "dd-MM-yyyy"), "DD-MM-YYYY"), "o_orderdate::date"), "time_": (v("formatTime", c("o_orderdate"), "HH:mm"), "strftime(o_orderdate, '%H:%M')"), "stamp": (v("formatTimestamp", c("o_orderdate"), "YYYY-MM-DD HH:mm:ss"), "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"),
    "days": (v("addDays", F.to_date("o_orderdate"), 40), "o_orderdate::date + 40"), "months": (v("addMonths", F.to_date("o_orderdate"), 1), "(o_orderdate::date + interval 1 month)::date"), "years": (v("addYears", F.to_date("o_orderdate"), 1), "(o_orderdate::date + interval 1 year)::date"), "diff_": (i(v("dateDiff", F.lit("1992-01-01"), F.to_date("o_orderdate"), "days")), "(o_orderdate::date - date '1992-01-01')::bigint"),
    "diff_months": (i(v("dateDiff", F.lit("1992-03-31"), F.to_date("o_orderdate"), "months")), "datediff('month', date '1992-03-31', o_orderdate::date)::bigint"), "hours": (v("addHours", c("o_orderdate"), 5), "o_orderdate + interval 5 hour"), "minutes": (v("addMinutes", c("o_orderdate"), 5), "o_orderdate + interval 5 minute"), "seconds": (v("addSeconds", c("o_orderdate"), 5), "o_orderdate + interval 5 second"),
    "day0": (v("startOfDay", c("o_orderdate")), "date_trunc('day', o_orderdate)::timestamp"), "day1": (v("endOfDay", c("o_orderdate")), "date_trunc('day', o_orderdate) + interval 86399999 millisecond"), "month0": (v("startOfMonth", c("o_orderdate")), "date_trunc('month', o_orderdate)::date"), "month1": (v("endOfMonth", c("o_orderdate")), "last_day(o_orderdate)"), "year0": (v("startOfYear", c("o_orderdate")), "date_trunc('year', o_orderdate)::date"),
    "year1": (v("endOfYear", c("o_orderdate")), "make_date(year(o_orderdate), 12, 31)"), "dow": (i(v("dayOfWeek", c("o_orderdate"))), "isodow(o_orderdate)"), "week": (i(v("weekOfYear", c("o_orderdate"))), "weekofyear(o_orderdate)"), "quarter_": (i(v("quarter", c("o_orderdate"))), "quarter(o_orderdate)"), "leap": (v("isLeapYear", c("o_orderdate")), "day(last_day(make_date(year(o_orderdate), 2, 1))) = 29"),
    "before_": (v("isBefore", c("o_orderdate"), "1996-01-01"), "o_orderdate < timestamp '1996-01-01'"), "after_": (v("isAfter", c("o_orderdate"), "1996-01-01"), "o_orderdate > timestamp '1996-01-01'"), "between_": (v("isBetween", c("o_orderdate"), "1994-01-01", "1996-01-01"), "o_orderdate between timestamp '1994-01-01' and timestamp '1996-01-01'"), "unix": (v("toUnix", c("o_orderdate")), "epoch(o_orderdate)::bigint"),
    "from_unix": (v("fromUnix", F.lit(0)), "'1970-01-01T00:00:00.000Z'"), "between_days": (i(v("daysBetweenDates", F.lit("1992-01-01"), c("o_orderdate"))), "(o_orderdate::date - date '1992-01-01')::bigint"), "age": (i(v("ageFromDate", c("o_orderdate"), "2020-06-15")), "date_sub('year', o_orderdate::date, date '2020-06-15')"), "valid": (v("isValidDate", F.date_format("o_orderdate", "yyyy-MM-dd")), "true"),
    "business": (v("businessDays", c("o_orderdate"), 0), "o_orderdate::date"), "next_business": (v("nextBusinessDay", c("o_orderdate")), "o_orderdate::date + (case isodow(o_orderdate) when 5 then 3 when 6 then 2 else 1 end)::int"), "duration": (v("formatDuration", F.lit("P1DT2H")), "'1 day, 2 hours'"), "locale": (v("formatLocaleDate", c("o_orderdate"), "de-DE", "short"), "strftime(o_orderdate, '%d.%m.%y')"),
})
rows("finance", "orders", ["o_orderkey"], lambda: {
    "compound_": (r(v("compound", c("o_totalprice"), 0.05, 3), 3), "round(o_totalprice * pow(1.05, 3), 3)"), "discount_": (r(v("discount", c("o_totalprice"), 0.05, 3), 3), "round(o_totalprice / pow(1.05, 3), 3)"), "pmt_": (r(v("pmt", c("o_totalprice"), 0.01, 12), 3), "round(o_totalprice * 0.01 / (1 - pow(1.01, -12)), 3)"),
    "fv_": (r(v("fv", c("o_totalprice"), 0.01, 12), 2), "round(o_totalprice * (pow(1.01, 12) - 1) / 0.01, 2)"), "pv_": (r(v("pv", c("o_totalprice"), 0.01, 12), 2), "round(o_totalprice * (1 - pow(1.01, -12)) / 0.01, 2)"), "depreciation_": (r(v("depreciation", c("o_totalprice"), 0, 5), 3), "round(o_totalprice / 5, 3)"),
    "nper_": (r(v("nper", 0.01, -100.0, 1000.0), 6), "round(ln(-100.0 / (-100.0 + 0.01 * 1000)) / ln(1.01), 6)"), "npv_": (r(v("npv", 0.1, F.array(-c("o_totalprice"), c("o_totalprice"), c("o_totalprice"))), 2), "round(-o_totalprice + o_totalprice / 1.1 + o_totalprice / 1.21, 2)"),
})
_E = "embedding"
rows("array_statistics", "embeddings", ["vec_id"], lambda: {
    "sum_": (r(v("sum", c(_E)), 4), "round(list_sum(list_transform(embedding, lambda x: x::double)), 4)"), "count_": (i(v("count", c(_E))), "len(embedding)"), "min_": (r(v("min", c(_E)), 5), "round(list_min(embedding)::double, 5)"), "max_": (r(v("max", c(_E)), 5), "round(list_max(embedding)::double, 5)"), "avg_": (r(v("avg", c(_E)), 5), "round(list_avg(list_transform(embedding, lambda x: x::double)), 5)"),
    "std_": (r(v("std", c(_E)), 5), "round(list_stddev_pop(list_transform(embedding, lambda x: x::double)), 5)"), "variance_": (r(v("variance", c(_E)), 5), "round(list_var_pop(list_transform(embedding, lambda x: x::double)), 5)"), "std_sample": (r(v("stdSample", c(_E)), 5), "round(list_stddev_samp(list_transform(embedding, lambda x: x::double)), 5)"), "variance_sample": (r(v("varianceSample", c(_E)), 5), "round(list_var_samp(list_transform(embedding, lambda x: x::double)), 5)"),
    "median_": (r(v("median", c(_E)), 5), "round(list_median(list_transform(embedding, lambda x: x::double)), 5)"), "first_": (r(v("first", c(_E)).cast("double"), 5), "round(embedding[1]::double, 5)"), "last_": (r(v("last", c(_E)).cast("double"), 5), "round(embedding[-1]::double, 5)"),
})
_Q = "ws"
rows("arrays", "documents", ["doc_id"], lambda: {
    "distinct_": (i(F.size(v("distinct", c("ws")))), f"len(list_distinct({_Q}))"), "sorted": (v("join", v("take", v("sort", c("ws")), 3), "|"), f"array_to_string(list_sort({_Q})[1:3], '|')"), "sorted_desc": (v("join", v("take", v("sortDesc", c("ws")), 3), "|"), f"array_to_string(list_reverse_sort({_Q})[1:3], '|')"),
    "index_": (i(v("indexOf", c("ws"), "the")), f"coalesce(list_position({_Q}, 'the'), 0)::bigint - 1"), "at_": (v("at", c("ws"), 1), f"{_Q}[2]"), "at_end": (v("at", c("ws"), -1), f"{_Q}[-1]"), "slice_": (v("join", v("slice", c("ws"), 1, 4), "|"), f"array_to_string({_Q}[2:4], '|')"), "reversed": (v("first", v("reverse", c("ws"))), f"{_Q}[-1]"),
    "includes_": (v("includes", c("ws"), "the"), f"list_contains({_Q}, 'the')"), "compact_": (i(F.size(v("compact", c("ws")))), f"len(list_filter({_Q}, lambda x: x <> ''))"), "drop_": (i(F.size(v("drop", c("ws"), 2))), f"greatest(len({_Q}) - 2, 0)"), "chunks_": (i(F.size(v("chunk", c("ws"), 10))), f"ceil(len({_Q}) / 10.0)::bigint"), "windows_": (i(F.size(v("window", c("ws"), 3))), f"greatest(len({_Q}) - 2, 0)"),
    "zip_": (i(F.size(v("zip", c("ws"), F.array(F.lit(1), F.lit(2))))), f"least(len({_Q}), 2)"), "range_": (i(F.size(v("range", 2, 10, 3))), "3::bigint"), "both_": (i(F.size(v("intersection", c("ws"), F.array(F.lit("the"), F.lit("of"))))), f"len(list_filter(['the', 'of'], lambda x: list_contains({_Q}, x)))"),
    "minus_": (i(F.size(v("difference", c("ws"), F.array(F.lit("the"))))), f"len(list_filter(list_distinct({_Q}), lambda x: x <> 'the'))"), "some_": (v("some", c("ws")), f"len(list_filter({_Q}, lambda x: x <> '')) > 0"), "every_": (v("every", c("ws")), f"len(list_filter({_Q}, lambda x: x = '')) = 0"),
}, base=lambda d: d.withColumn("ws", F.split("text", " ")), base_sql="string_split(text, ' ') as ws")
rows("geography", "lineitem", ["l_orderkey", "l_linenumber"], lambda: {
    "km": (r(v("distance", c("l_quantity"), 0, 0, c("l_quantity")), 4), "round(2 * 6371.0 * asin(sqrt(pow(sin(radians(-l_quantity) / 2), 2) + cos(radians(l_quantity)) * pow(sin(radians(l_quantity) / 2), 2))), 4)"),
    "inside": (v("inBoundingBox", c("l_quantity"), c("l_linenumber"), 10, 2, 30, 5), "l_quantity between 10 and 30 and l_linenumber between 2 and 5"), "rad": (r(v("toRadians", c("l_quantity"))), "round(radians(l_quantity), 6)"), "deg": (r(v("toDegrees", c("l_tax"))), "round(degrees(l_tax), 6)"),
    "north": (r(v("bearing", 0, 0, c("l_quantity"), 0), 4), "0.0::double"), "mid": (r(v("midpoint", 0, 0, 0, c("l_quantity"))["lon"], 4), "round(l_quantity / 2, 4)"),
})
