"""Queries through the transform language, documents and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import query, r, read
from .documents import diff, overlay, patch
from .language import execute
from .validate import parse_schema, validate


def order_documents(spark, sf_dir):
    """One document an order: its lines as an ordered array."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return lines.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderstatus").alias("status")), "doc")


_LINES = "(select l_orderkey as doc, l_linenumber as line, l_partkey as part, l_quantity as qty, l_extendedprice as price, l_returnflag as flag from lineitem join orders on o_orderkey = l_orderkey)"

LOOP = """
{$const}
rate = #1.1
{$table.FLAG[code, name]}
"R", "returned"
"A", "accepted"
{rows[]}
:loop lines :as l
line = @l.line
part = @l.part
gross = %multiply @l.price @$const.rate
flag = %lookupDefault FLAG.name @l.flag "none"
big = "yes" :if @l.qty > ##40
"""


@query("transform_loop", f"select doc, line, part, round(price * 1.1, 4) as gross, case flag when 'R' then 'returned' when 'A' then 'accepted' else 'none' end as flag, case when qty > 40 then 'yes' end as big from {_LINES}")
def transform_loop(spark, sf_dir):
    rows = execute(LOOP, order_documents(spark, sf_dir), "doc")["rows"]
    return rows.select("doc", "line", "part", r("gross", 4).alias("gross"), "flag", "big")


TOTALS = """
{$accumulator}
total = #0
n = ##0
{_sink[]}
:loop lines
_t = %accumulate total @.price
_n = %accumulate n ##1
{summary :if @status = "F"}
total = @$accumulator.total
n = @$accumulator.n
mean = %divide @total @n
"""


@query("transform_accumulate", f"select doc, round(sum(price), 2) as total, count(*) as n, round(avg(price), 7) as mean from {_LINES} where doc in (select o_orderkey from orders where o_orderstatus = 'F') group by 1")
def transform_accumulate(spark, sf_dir):
    s = execute(TOTALS, order_documents(spark, sf_dir), "doc")["summary"]
    return s.select("doc", r("total", 2).alias("total"), F.col("n").cast("bigint").alias("n"), r("mean", 7).alias("mean"))


def customer_documents(spark, sf_dir, shifted: bool):
    """Long form of customers; the shifted version changes, drops and adds paths."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc"), "c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("nation"), "c_mktsegment")
    cell = lambda p, k, x: F.struct(F.lit(p).alias("path"), F.lit(k).alias("type"), x.alias("value"))
    if not shifted:
        cells = [cell("name", "string", F.col("c_name")), cell("nation", "integer", F.col("nation")), cell("segment", "string", F.col("c_mktsegment"))]
    else:
        cells = [cell("title", "string", F.col("c_name")), cell("nation", "integer", F.when(F.col("c_custkey") % 2 == 0, "99").otherwise(F.col("nation"))), cell("extra", "string", F.concat(F.lit("x"), F.col("doc")))]
    return c.select("doc", F.explode(F.array(*cells)).alias("x")).select("doc", "x.*")


@query(
    "document_diff",
    """select cast(c_custkey as varchar) as doc, 'moved' as op, 'title' as path, 'name' as from_path, c_name as value from customer
       union all select cast(c_custkey as varchar), 'changed', 'nation', null, '99' from customer where c_custkey % 2 = 0
       union all select cast(c_custkey as varchar), 'removed', 'segment', null, c_mktsegment from customer
       union all select cast(c_custkey as varchar), 'added', 'extra', null, 'x' || c_custkey from customer""",
)
def document_diff(spark, sf_dir):
    return diff(customer_documents(spark, sf_dir, False), customer_documents(spark, sf_dir, True)).select("doc", "op", "path", "from_path", "value")


@query(
    "document_patch",
    """select cast(c_custkey as varchar) as doc, 'title' as path, c_name as value from customer
       union all select cast(c_custkey as varchar), 'nation', case when c_custkey % 2 = 0 then '99' else cast(c_nationkey as varchar) end from customer
       union all select cast(c_custkey as varchar), 'extra', 'x' || c_custkey from customer""",
)
def document_patch(spark, sf_dir):
    a, b = customer_documents(spark, sf_dir, False), customer_documents(spark, sf_dir, True)
    return patch(a, diff(a, b)).select("doc", "path", "value")


@query(
    "document_overlay",
    """select cast(o_custkey as varchar) as doc, 'last' as path, cast(max(o_orderkey) as varchar) as value from orders group by 1
       union all select cast(o_custkey as varchar), 'status', arg_max(o_orderstatus, o_orderkey) from orders group by 1""",
)
def document_overlay(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    cells = F.array(F.struct(F.lit("last").alias("path"), F.lit("integer").alias("type"), F.col("seq").cast("string").alias("value")), F.struct(F.lit("status").alias("path"), F.lit("string").alias("type"), F.col("o_orderstatus").alias("value")))
    return overlay(o.select("doc", "seq", F.explode(cells).alias("x")).select("doc", "seq", "x.*")).select("doc", "path", "value")


SCHEMA = '{}\nname = !:(1..18)\nnation = ##:(0..20)\nsegment = ("BUILDING", "MACHINERY")\n'


@query(
    "validation",
    """select cast(c_custkey as varchar) as doc, 'nation' as path, 'V003' as code from customer where c_nationkey > 20
       union all select cast(c_custkey as varchar), 'segment', 'V005' from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')
       union all select cast(c_custkey as varchar), 'name', 'V003' from customer where length(c_name) > 18""",
)
def validation(spark, sf_dir):
    return validate(customer_documents(spark, sf_dir, False), parse_schema(SCHEMA)).select("doc", "path", "code")


def customer_orders(spark, sf_dir):
    """One document a customer: orders, and in each its lines."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    o = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    order = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("lines").alias("lines"))
    return o.groupBy(F.col("o_custkey").alias("doc")).agg(F.array_sort(F.collect_list(order)).alias("orders"), F.max("o_orderpriority").alias("priority"))


NESTED = """
{rows[]}
:loop orders :as o
:loop .lines :as l
:counter n
key = @o.key
part = @l.part
at = @n
label = "${@o.key}/${@l.line}: ${@o.status}"
half = %expr "qty / 2 + (qty - 1) ^ 2" @l
"""


@query(
    "transform_nested",
    """select o_custkey as doc, o_orderkey as key, l_partkey as part, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 as at,
              o_orderkey || '/' || l_linenumber || ': ' || o_orderstatus as label, round(l_quantity / 2 + pow(l_quantity - 1, 2), 6) as half from orders join lineitem on l_orderkey = o_orderkey""",
)
def transform_nested(spark, sf_dir):
    rows = execute(NESTED, customer_orders(spark, sf_dir), "doc")["rows"]
    return rows.select("doc", "key", "part", F.col("at").cast("bigint").alias("at"), "label", r("half").alias("half"))


BRANCHES = """
{high :if @priority = "5-LOW"}
kind = "low"
{mid :elif %startsWith @priority "4"}
kind = "mid"
{rest :else}
kind = "rest"
skipped = "x" :unless @priority = "3-MEDIUM"
tag = %upper @priority :trim
mask = @priority :confidential
"""


@query(
    "transform_branches",
    """select o_custkey as doc, case when p = '5-LOW' then 'low' when starts_with(p, '4') then 'mid' else 'rest' end as kind, case when p = '5-LOW' or starts_with(p, '4') or p = '3-MEDIUM' then null else 'x' end as skipped,
              case when p = '5-LOW' or starts_with(p, '4') then null else upper(p) end as tag from (select o_custkey, max(o_orderpriority) as p from orders group by 1)""",
)
def transform_branches(spark, sf_dir):
    out = execute(BRANCHES, customer_orders(spark, sf_dir).select("doc", "priority"), "doc")
    none = [F.lit(None).cast("string").alias(n) for n in ("skipped", "tag")]
    a, b, c_ = out["high"].select("doc", "kind", *none), out["mid"].select("doc", "kind", *none), out["rest"].select("doc", "kind", "skipped", "tag")
    return a.unionByName(b).unionByName(c_)


PASSES = """
{$accumulator}
total = #0
seen = ##0
seen.persist = ?true
{_first[]}
_pass = ##1
:loop orders
_t = %accumulate total @.total
_n = %accumulate seen ##1
{one}
_pass = ##1
total = @$accumulator.total
seen = @$accumulator.seen
{_again[]}
_pass = ##2
:loop orders
_n = %accumulate seen ##1
{two}
_pass = ##2
total = @$accumulator.total
seen = @$accumulator.seen
"""


@query("transform_passes", "select o_custkey as doc, round(sum(o_totalprice), 2) as total, count(*) as seen, 0.0::double as total2, 2 * count(*) as seen2 from orders group by 1")
def transform_passes(spark, sf_dir):
    """The second pass starts with the accumulators' initial values but for those that persist."""
    out = execute(PASSES, customer_orders(spark, sf_dir).select("doc", "orders"), "doc")
    one, two = out["one"].select("doc", r("total", 2).alias("total"), F.col("seen").cast("bigint").alias("seen")), out["two"].select("doc", F.col("total").cast("double").alias("total2"), F.col("seen").cast("bigint").alias("seen2"))
    return one.join(two, "doc")


CHECKED = """
{$target}
onValidation = "warn"
{out}
status = @status :enum F,O
price = @price :range 1000..200000 :required
day = @day :date
code = @status :validate "^[FO]$" :default "none"
both.key = @doc
both.items[0] = @status
both.items[1] = "end"
made = :object {k = @doc, s = %lower @status}
"""


@query(
    "transform_directives",
    """select o_orderkey as doc, o_orderstatus as status, o_totalprice as price, o_orderdate::date as day, o_orderkey as key, o_orderstatus || ',end' as items, o_orderkey || lower(o_orderstatus) as made,
              (o_orderstatus not in ('F', 'O'))::int * 2 + (o_totalprice not between 1000 and 200000)::int as warned, 0 as failed from orders""",
)
def transform_directives(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    out = execute(CHECKED, d, "doc")["out"]
    return out.select("doc", "status", "price", "day", F.col("both.key").alias("key"), F.array_join("both.items", ",").alias("items"), F.concat(F.col("made.k").cast("string"), "made.s").alias("made"), F.size("_warnings").alias("warned"), F.size("_errors").alias("failed"))


RECORDS = """
{$source}
discriminator = ":field 0"
{heads[]}
_type = "H"
key = @line :field 1 :integer
status = @line :field 2
{lines[]}
_type = "L,M"
key = @line :field 1 :integer
qty = @line :field 2 :number
"""


@query("transform_records", "select o_orderkey as key, o_orderstatus as status, count(l_orderkey) as n, sum(l_quantity) as qty from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2")
def transform_records(spark, sf_dir):
    """Lines of two record types, routed to segments and joined again."""
    heads = read(spark, sf_dir, "orders").select(F.concat_ws(",", F.lit("H"), "o_orderkey", "o_orderstatus").alias("line"))
    items = read(spark, sf_dir, "lineitem").select(F.concat_ws(",", F.when(F.col("l_linenumber") == 1, "L").otherwise("M"), "l_orderkey", "l_quantity").alias("line"))
    out = execute(RECORDS, heads.unionByName(items).withColumn("doc", F.xxhash64("line")), "doc")
    per = out["lines"].groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))
    return out["heads"].select("key", "status").join(per, "key", "left").select("key", "status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "qty")


@query("sliding_windows", "select w as window_start, event_type, count(*) as n, round(sum(value), 4) as total from (select event_type, value, time_bucket(interval '12 hour', ts, timestamp '1970-01-01') - to_hours(12 * k) as w from events, (select unnest([0, 1]) as k)) group by 1, 2")
def sliding_windows(spark, sf_dir):
    from ..streaming.events import sliding

    return sliding(read(spark, sf_dir, "events"), "1 day", "12 hours").select("window_start", "event_type", "n", r("total", 4).alias("total"))


@query(
    "sessions",
    """with a as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hour' then 0 else 1 end as new_ from events), b as (select *, sum(new_) over (partition by user_id order by ts range unbounded preceding) as s from a)
       select user_id, min(ts) as start, max(ts) + interval '6 hour' as end_, count(*) as n from b group by user_id, s""",
)
def sessions(spark, sf_dir):
    from ..streaming.events import sessions as by_gap

    return by_gap(read(spark, sf_dir, "events"), "6 hours").select("user_id", F.col("session_start").alias("start"), F.col("session_end").alias("end_"), "n")
