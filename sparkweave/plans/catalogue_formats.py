"""Queries that write a format and read it back, and one for each kind of violation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import readers, writers
from ..sources.yamlish import parse_yaml
from ..storage import scratch
from . import exports
from .catalogue import query, r, read
from .invariants import check_invariants
from .validate import parse_schema, validate

c = F.col


def somewhere(spark: SparkSession) -> str:
    return f"{scratch(spark)}/{uuid.uuid4().hex}"


def parts(spark, sf_dir) -> DataFrame:
    """Texts with a delimiter, a quote and an edge blank among them."""
    odd = F.when(c("p_partkey") % 3 == 0, F.concat(c("p_name"), F.lit(', "x"'))).otherwise(c("p_name"))
    return read(spark, sf_dir, "part").select(c("p_partkey").alias("id"), odd.alias("name"), c("p_size").cast("bigint").alias("size"), c("p_retailprice").alias("price"))


_PARTS = "(select p_partkey as id, case when p_partkey % 3 = 0 then p_name || ', \"x\"' else p_name end as name, p_size::bigint as size, p_retailprice as price from part)"


@query("source_csv", f"select id, name, size, price from {_PARTS}")
def source_csv(spark, sf_dir):
    at = somewhere(spark)
    writers.write_csv(parts(spark, sf_dir), at)
    return readers.read_csv(spark, at).select("id", "name", "size", "price")


@query("source_csv_delimiter", f"select id, name, size, price from {_PARTS}")
def source_csv_delimiter(spark, sf_dir):
    at = somewhere(spark)
    writers.write_csv(parts(spark, sf_dir), at, delimiter="|", header=False)
    return readers.read_csv(spark, at, delimiter="|", header=False, columns=["id", "name", "size", "price"])


@query("source_json", f"select id, name, size, price from {_PARTS}")
def source_json(spark, sf_dir):
    at = somewhere(spark)
    writers.write_json(parts(spark, sf_dir), at)
    return spark.read.schema("id bigint, name string, size bigint, price double").json(at)


@query("source_json_documents", "select o_custkey as id, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def source_json_documents(spark, sf_dir):
    """Nested arrays, read with a schema from whole-document texts."""
    d = read(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("id")).agg(F.collect_list(F.struct(c("o_orderkey").alias("key"), c("o_totalprice").alias("price"))).alias("orders"))
    back = writers.json_text(d).select(F.from_json("value", "id bigint, orders array<struct<key:bigint,price:double>>").alias("v")).select("v.*")
    return back.select("id", F.size("orders").cast("bigint").alias("n"), r(F.aggregate("orders", F.lit(0.0), lambda a, x: a + x["price"]), 2).alias("total"))


@query("source_xml", f"select id, name, size, price from {_PARTS}")
def source_xml(spark, sf_dir):
    at = somewhere(spark)
    writers.write_xml(parts(spark, sf_dir).withColumnRenamed("id", "@id"), at, "parts", "part")
    return readers.read_xml(spark, at, "part", "`@id` bigint, name string, size bigint, price double").select(c("@id").alias("id"), "name", "size", "price")


@query("source_fixed_width", "select c_custkey::varchar as id, rpad(c_name, 20, ' ') as name_, lpad(c_nationkey::varchar, 4, '0') as nation from customer")
def source_fixed_width(spark, sf_dir):
    at = somewhere(spark)
    layout = [("c_custkey", 0, 12, " ", "right"), ("c_name", 12, 20, " ", "right"), ("c_nationkey", 34, 4, "0", "left")]
    writers.fixed_width_text(read(spark, sf_dir, "customer"), layout, width=40).write.text(at)
    d = readers.read_fixed_width(spark, at, "id:0:12;name:12:20;nation:34:4")
    return d.select("id", F.rpad("name", 20, " ").alias("name_"), "nation")


@query("source_flat", "select c_custkey as id, c_name as name, c_acctbal as balance from customer")
def source_flat(spark, sf_dir):
    d = read(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), F.struct(c("c_name").alias("name"), c("c_acctbal").alias("balance")).alias("who"))
    texts = writers.flat_text(d).select(F.lit("d").alias("doc"), "value")
    return readers.typed_json(readers.parse_texts(texts, readers.parse_flat), "id bigint, who struct<name:string,balance:double>").select("id", "who.name", "who.balance")


@query("source_yaml", "select c_custkey as id, c_name as name, c_mktsegment as segment from customer")
def source_yaml(spark, sf_dir):
    """Block maps and lists."""
    value = F.concat(F.lit("id: "), c("c_custkey"), F.lit("\nwho:\n  name: "), c("c_name"), F.lit(" # a note\n  tags:\n    - "), c("c_mktsegment"), F.lit("\n    - other\n"))
    texts = read(spark, sf_dir, "customer").select(F.lit("d").alias("doc"), value.alias("value"))
    d = readers.typed_json(readers.parse_texts(texts, parse_yaml), "id bigint, who struct<name:string,tags:array<string>>")
    return d.select("id", "who.name", c("who.tags")[0].alias("segment"))


def customer_cells(spark, sf_dir, *cells) -> DataFrame:
    """Long-form rows (doc, ord, path, type, value, modifiers) of customers."""
    made = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(p).alias("path"), F.lit(t).alias("type"), x.cast("string").alias("value"), F.lit("").alias("modifiers")) for k, (p, t, x) in enumerate(cells)])
    return read(spark, sf_dir, "customer").select(c("c_custkey").cast("string").alias("doc"), F.explode(made).alias("x")).select("doc", "x.*")


def natural(spark, sf_dir) -> DataFrame:
    return customer_cells(spark, sf_dir, ("Who.name", "string", F.concat(c("c_name"), F.lit('"q"\n'))), ("Who.nation", "integer", c("c_nationkey")), ("Who.tags[0]", "string", c("c_mktsegment")), ("balance", "number", c("c_acctbal")))


_NATURAL = """select c_custkey::varchar as doc, 'Who.name' as path, 'string' as type, c_name || '"q"' || chr(10) as value from customer union all select c_custkey::varchar, 'Who.nation', 'integer', c_nationkey::varchar from customer
    union all select c_custkey::varchar, 'Who.tags[0]', 'string', c_mktsegment from customer union all select c_custkey::varchar, 'balance', 'number', c_acctbal::varchar from customer"""


@query("source_native", _NATURAL)
def source_native(spark, sf_dir):
    d = natural(spark, sf_dir).filter("path <> 'balance'").unionByName(natural(spark, sf_dir).filter("path = 'balance'").withColumn("ord", F.lit(-1)))
    return readers.parse_native(writers.native_text(d), "doc", "value").select("doc", "path", "type", "value")


@query("canonical_native", "select c_custkey::varchar as doc, 'Who.name = \"' || c_name || '\\\"q\\\"\\n\"' || chr(10) || 'Who.nation = ##' || c_nationkey || chr(10) || 'Who.tags[0] = \"' || c_mktsegment || '\"' || chr(10) || 'balance = #' || c_acctbal || chr(10) as value from customer")
def canonical_native(spark, sf_dir):
    return writers.native_text(natural(spark, sf_dir), canonical=True)


@query("export_json", "select c_custkey::varchar as doc, c_nationkey::bigint as nation, c_mktsegment as tag, c_acctbal as balance from customer")
def export_json(spark, sf_dir):
    d = exports.to_json(natural(spark, sf_dir)).select("doc", F.from_json("value", "Who struct<nation:bigint,tags:array<string>>, balance double").alias("v"))
    return d.select("doc", "v.Who.nation", c("v.Who.tags")[0].alias("tag"), "v.balance")


def histories(spark, sf_dir) -> DataFrame:
    """A document for each customer with orders; every third order states its priority."""
    o = read(spark, sf_dir, "orders").select(c("o_custkey").cast("string").alias("doc"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("k"), "o_orderkey", "o_totalprice", "o_orderpriority")
    cells = [("key", "integer", c("o_orderkey").cast("string")), ("total", "currency", F.concat(F.floor("o_totalprice").cast("string"), F.lit(".00:USD"))), ("priority", "string", F.when(c("o_orderkey") % 3 == 0, F.concat("o_orderpriority", F.lit(', "p"'))))]
    rows = F.array(*[F.struct((c("k") * 3 + i).cast("bigint").alias("ord"), F.concat(F.lit("orders["), "k", F.lit(f"].{n}")).alias("path"), F.lit(t).alias("type"), v.alias("value"), F.lit("").alias("modifiers")) for i, (n, t, v) in enumerate(cells)])
    return o.select("doc", F.inline(rows)).filter("value is not null")


@query("export_csv", """with o as (select o_custkey::varchar as doc, o_orderkey as k, floor(o_totalprice)::bigint as t, case when o_orderkey % 3 = 0 then '"' || o_orderpriority || ', ""p""' || '"' end as p, row_number() over (partition by o_custkey order by o_orderkey) as i from orders),
    h as (select doc, min(case when p is not null then i end) as f from o group by 1)
    select doc, 'key,total' || case when any_value(f) is not null then ',priority' else '' end || chr(10) || string_agg(k || ',' || t || case when f is not null then ',' || coalesce(p, '') else '' end, chr(10) order by i) || chr(10) as value from o join h using (doc) group by doc""")
def export_csv(spark, sf_dir):
    """Items of an array of records under the union of their fields."""
    return exports.to_csv(histories(spark, sf_dir))


@query("export_xml", """select c_custkey::varchar as doc, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<customer xmlns:doc="urn:document">' || chr(10) || '  <balance doc:type="number">' || c_acctbal || '</balance>' || chr(10) || '  <Who>' || chr(10) || '    <name>' || replace(c_name, '&', '&amp;') || '&quot;q&quot;' || chr(10) || '</name>' || chr(10)
    || '    <nation doc:type="integer">' || c_nationkey || '</nation>' || chr(10) || '    <tags_0_>' || c_mktsegment || '</tags_0_>' || chr(10) || '  </Who>' || chr(10) || '</customer>' || chr(10) as value from customer""")
def export_xml(spark, sf_dir):
    return exports.to_xml(natural(spark, sf_dir), "customer", types=True)


@query("export_fixed_width", "select c_custkey::varchar as doc, lpad(c_nationkey::varchar, 4, '0') || '  ' || rpad(substr(c_mktsegment, 1, 6), 6, ' ') || '........' as value from customer")
def export_fixed_width(spark, sf_dir):
    line = exports.to_fixed_width(natural(spark, sf_dir), [("Who.nation", 0, 4, "0", "left"), ("Who.tags[0]", 6, 6, " ", "right"), ("none", 12, 8, ".", "right")], 20)
    return line


@query("export_wide", "select c_custkey::varchar as doc, c_nationkey::varchar as nation, c_mktsegment as tag from customer")
def export_wide(spark, sf_dir):
    w = writers.wide(natural(spark, sf_dir), ["Who.nation", "Who.tags[0]"])
    return w.select("doc", c("`Who.nation`").alias("nation"), c("`Who.tags[0]`").alias("tag"))


@query("multi_record", "select 'H' as kind, count(*) as n from orders union all select 'L', count(*) from lineitem")
def multi_record(spark, sf_dir):
    """Two record types in one file, told apart by a delimited field and routed."""
    at = somewhere(spark)
    heads = read(spark, sf_dir, "orders").select(F.concat_ws(",", F.lit("H"), "o_orderkey", "o_orderstatus").alias("value"))
    heads.unionByName(read(spark, sf_dir, "lineitem").select(F.concat_ws(",", F.lit("L"), "l_orderkey", "l_quantity").alias("value"))).write.text(at)
    return readers.read_multi_record(spark, at, field=0).groupBy(c("record_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# -- violations ----------------------------------------------------------------------------

SCHEMA = """
{}
name = !:/Customer#\\d+/
nation = ##
balance = #.2:(-500..9000)
zip = :format zip
since = date:(1995-01-01..1997-12-31)
phone = ! :if segment = "BUILDING"
tags = [] :(1..3) :unique
:exactly_one phone, fax
segment = ("BUILDING", "MACHINERY", "AUTOMOBILE")
next =
"""


def flawed(spark, sf_dir) -> DataFrame:
    k = c("c_custkey")
    d = customer_cells(
        spark, sf_dir, ("name", "string", F.when(k % 7 > 0, F.concat(F.lit("Customer#"), k))), ("nation", "integer", c("c_nationkey")), ("balance", "number", F.format_string("%.2f", c("c_acctbal"))), ("zip", "string", F.lpad(k.cast("string"), 5, "0").substr(F.lit(1), F.when(k % 9 == 0, 4).otherwise(5))),
        ("since", "date", F.date_add(F.lit("1994-06-01").cast("date"), (k % 1500).cast("int"))), ("phone", "string", F.when(k % 2 == 0, "555")), ("fax", "string", F.when(k % 3 == 0, "556")), ("segment", "string", c("c_mktsegment")),
        ("tags[0]", "string", F.when(k % 5 > 0, "a")), ("tags[1]", "string", F.when(k % 5 > 1, F.when(k % 11 == 0, "a").otherwise("b"))), ("tags[2]", "string", F.when(k % 5 > 2, "c")), ("tags[3]", "string", F.when(k % 5 > 3, "d")), ("extra", "string", F.when(k % 13 == 0, "x")), ("next", "reference", F.when(k % 4 == 1, "nation").when(k % 4 == 2, "next").when(k % 4 == 3, "nowhere")),
    )
    return d.filter("value is not null").withColumn("type", F.when((c("path") == "nation") & (c("doc").cast("int") % 10 == 0), "string").otherwise(c("type"))).select("doc", "path", "type", "value")


_K = "c_custkey"
_IS = [
    ("name", "V001", f"{_K} % 7 = 0"), ("nation", "V002", f"{_K} % 10 = 0"), ("balance", "V003", "round(c_acctbal, 2) not between -500 and 9000"), ("zip", "V004", f"{_K} % 9 = 0"), ("since", "V003", f"date '1994-06-01' + ({_K} % 1500)::int not between date '1995-01-01' and date '1997-12-31'"),
    ("phone", "V010", f"c_mktsegment = 'BUILDING' and {_K} % 2 = 1"), ("segment", "V005", "c_mktsegment not in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')"), ("tags", "V006", f"{_K} % 5 in (0, 4)"), ("tags", "V007", f"{_K} % 5 > 1 and {_K} % 11 = 0"), ("phone,fax", "V009", f"({_K} % 2 = 0)::int + ({_K} % 3 = 0)::int <> 1"),
    ("extra", "V011", f"{_K} % 13 = 0"), ("fax", "V011", f"{_K} % 3 = 0"), ("next", "V012", f"{_K} % 4 = 2"), ("next", "V013", f"{_K} % 4 = 3"),
]


@query("violations", " union all ".join(f"select c_custkey::varchar as doc, '{p}' as path, '{v}' as code from customer where {w}" for p, v, w in _IS))
def violations(spark, sf_dir):
    return validate(flawed(spark, sf_dir), parse_schema(SCHEMA), strict=True).select("doc", "path", "code")


@query("invariants", "select c_custkey::varchar as doc, 'balance >= 0 || nation < 10' as path, 'V008' as code from customer where not (c_acctbal >= 0 or c_nationkey < 10)")
def invariants(spark, sf_dir):
    return check_invariants(natural(spark, sf_dir).withColumn("path", F.regexp_replace("path", "^Who\\.", "")), ["balance >= 0 || nation < 10"]).select("doc", "path", "code")


@query("references", "select c_custkey::varchar as doc, case when c_custkey % 4 = 1 then c_nationkey::varchar end as value, c_custkey % 4 = 2 as cycle from customer where c_custkey % 4 > 0")
def references(spark, sf_dir):
    from .documents import resolve

    return resolve(flawed(spark, sf_dir)).filter("path = 'next'").select("doc", "value", "cycle")
