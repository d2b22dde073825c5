"""Registered queries, each with the SQL that gives the same rows.

A family of row-local verbs is one query with a column for each verb; relational operators
have a query each.  Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import call as v
from ..operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rows(name: str, table: str, keys: list[str], columns: Callable[[], dict], where: str | None = None, base: Callable[[DataFrame], DataFrame] | None = None, base_sql: str | None = None, spread: bool = False) -> None:
    """A projection: columns() gives name -> (column, SQL).  ``spread``: rows that take long for
    their bytes are dealt out, so that a small file is not one task."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        df = df.filter(where) if where else df
        df = base(df) if base else df
        df = df.repartition(max(4 * spark.sparkContext.defaultParallelism, R.size_in_bytes(df) >> 22), *keys) if spread else df
        return df.select(*keys, *[x.alias(n) for n, (x, _) in columns().items()])

    QUERIES[name] = run

    def sql() -> str:
        source = f"(select *{', ' + base_sql if base_sql else ''} from {table}{' where ' + where if where else ''})"
        return f"select {', '.join(keys)}, " + ", ".join(f"{s} as {n}" for n, (_, s) in columns().items()) + f" from {source}"

    LATE[name] = sql


#: SQL made with the session at hand: the columns beside it need one.
LATE: dict[str, Callable[[], str]] = {}


def oracle_sql() -> dict[str, str]:
    return SQL | {n: f() for n, f in LATE.items()}


def r(x, n=6):
    return F.round(x, n)


@query("flagship", "select l_returnflag, round(sum(l_quantity), 4) as sum_qty, count(*) as cnt from lineitem where l_quantity > 45 group by 1")
def flagship(spark, sf_dir):
    items = R.filter_rows(read(spark, sf_dir, "lineitem"), "l_quantity", ">", 45)
    return items.groupBy("l_returnflag").agg(r(F.sum("l_quantity"), 4).alias("sum_qty"), F.count(F.lit(1)).alias("cnt")).orderBy("l_returnflag")


# -- filters -------------------------------------------------------------------------------

for _n, _table, _key, _field, _op, _value, _sql in (
    ("filter_eq", "part", "p_partkey", "p_brand", "=", "Brand#1", "p_brand = 'Brand#1'"),
    ("filter_ne", "orders", "o_orderkey", "o_orderstatus", "!=", "O", "o_orderstatus <> 'O'"),
    ("filter_lt", "lineitem", "l_orderkey, l_linenumber", "l_quantity", "<", 10, "l_quantity < 10"),
    ("filter_lte", "part", "p_partkey", "p_size", "<=", 10, "p_size <= 10"),
    ("filter_gt", "lineitem", "l_orderkey, l_linenumber", "l_discount", ">", 0.05, "l_discount > 0.05"),
    ("filter_gte", "customer", "c_custkey", "c_acctbal", ">=", 0, "c_acctbal >= 0"),
    ("filter_contains", "part", "p_partkey", "p_name", "contains", "a", "contains(p_name, 'a')"),
    ("filter_starts_with", "part", "p_partkey", "p_type", "startsWith", "S", "starts_with(p_type, 'S')"),
    ("filter_ends_with", "customer", "c_custkey", "c_mktsegment", "endsWith", "G", "ends_with(c_mktsegment, 'G')"),
):

    @query(_n, f"select {_key}, {_field} from {_table} where {_sql}")
    def _filter(spark, sf_dir, t=_table, k=_key, f=_field, o=_op, x=_value):
        return R.filter_rows(read(spark, sf_dir, t), f, o, x).select(*k.split(", "), f)


# -- relational operators ------------------------------------------------------------------


@query("map_pluck", "select o_orderkey, o_totalprice from orders")
def map_pluck(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


@query("omit_rename", "select o_orderkey as id, o_custkey as customer, o_orderstatus, o_orderdate, o_orderpriority from orders")
def omit_rename(spark, sf_dir):
    return read(spark, sf_dir, "orders").drop("o_totalprice").withColumnsRenamed({"o_orderkey": "id", "o_custkey": "customer"})


@query("distinct", "select distinct c_nationkey, c_mktsegment from customer")
def distinct(spark, sf_dir):
    return R.distinct(read(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


def _nations(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(c("c_nationkey").alias("n")), read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(c("s_nationkey").alias("n"))


_A, _B = "select c_nationkey as n from customer where c_acctbal > 5000", "select s_nationkey as n from supplier where s_acctbal > 5000"
for _n, _f, _sql in (
    ("union", R.union, f"{_A} union {_B}"), ("intersection", R.intersection, f"{_A} intersect {_B}"), ("difference", R.difference, f"{_A} except {_B}"),
    ("symmetric_difference", R.symmetric_difference, f"({_A} except {_B}) union all ({_B} except {_A})"), ("concat_arrays", lambda a, b: a.unionByName(b), f"{_A} union all {_B}"),
):

    @query(_n, _sql)
    def _set(spark, sf_dir, f=_f):
        return f(*_nations(spark, sf_dir))


@query("dedupe", "select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) where k = 1")
def dedupe(spark, sf_dir):
    return R.dedupe(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@query("key_by", "select o_custkey, arg_max(o_orderkey, o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by 1")
def key_by(spark, sf_dir):
    return R.key_by(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("group_by", "select o_orderpriority as key, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def group_by(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(c("o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("group_items", "select cast(o_custkey as varchar) as key, count(*) as n, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as keys from orders group by 1")
def group_items(spark, sf_dir):
    g = R.group_items(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    return g.select("key", F.size("items").cast("bigint").alias("n"), F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@query("count_by", "select o_orderstatus as key, count(*) as count from orders group by 1")
def count_by(spark, sf_dir):
    return R.count_by(read(spark, sf_dir, "orders"), "o_orderstatus")


@query(
    "conditional_aggregates",
    """select l_returnflag, count(*) filter (where l_quantity > 30) as n, round(coalesce(sum(l_extendedprice) filter (where l_linestatus = 'O'), 0), 2) as s,
              round(sum(l_quantity) filter (where l_discount >= 0.05) / count(*) filter (where l_discount >= 0.05), 6) as a,
              bool_and(l_quantity > 0) as every_, bool_or(l_quantity > 49) as some_ from lineitem group by 1""",
)
def conditional_aggregates(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        R.count_if("l_quantity", ">", 30).alias("n"), r(R.sum_if("l_linestatus", "=", "O", "l_extendedprice"), 2).alias("s"),
        r(R.avg_if("l_discount", ">=", 0.05, "l_quantity")).alias("a"), R.every("l_quantity", ">", 0).alias("every_"), R.some("l_quantity", ">", 49).alias("some_"),
    )


@query("aggregates", "select l_shipmode_ as k, sum(q) as s, count(*) as n, min(q) as lo, max(q) as hi, round(avg(q), 6) as a, arg_min(q, o) as f, arg_max(q, o) as l from (select l_returnflag || l_linestatus as l_shipmode_, l_quantity as q, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey as o from lineitem) group by 1")
def aggregates(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"), c("l_quantity").alias("q"), ((c("l_orderkey") * 10 + c("l_linenumber")) * 10000000 + c("l_partkey")).alias("o"))
    return d.groupBy("k").agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("n"), F.min("q").alias("lo"), F.max("q").alias("hi"), r(F.avg("q")).alias("a"), F.min_by("q", "o").alias("f"), F.max_by("q", "o").alias("l"))


@query("sort_take", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 20")
def sort_take(spark, sf_dir):
    return R.top(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 20)


@query("slice", "select p_partkey from part order by p_partkey limit 30 offset 20")
def slice_(spark, sf_dir):
    return R.slice_rows(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 20, 50)


@query("drop_first", "select p_partkey from part order by p_partkey offset 100")
def drop_first(spark, sf_dir):
    return R.skip(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 100)


@query("row_number", 'select o_orderkey, row_number() over (order by o_orderkey) as "_rowNum" from orders')
def row_number(spark, sf_dir):
    return R.numbered(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("row_number_all_columns", "select *, row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem")
def row_number_all_columns(spark, sf_dir):
    return R.numbered(read(spark, sf_dir, "lineitem"), ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "n")


@query("chunk", "select chunk, count(*) as n, min(p_partkey) as lo from (select p_partkey, (row_number() over (order by p_partkey) - 1) // 64 as chunk from part) group by 1")
def chunk(spark, sf_dir):
    return R.chunks(read(spark, sf_dir, "part"), "p_partkey", 64, "p_partkey").select("chunk", F.size("items").cast("bigint").alias("n"), F.array_min("items").alias("lo"))


@query("partition", "select 'pass' as side, count(*) as n from orders where o_orderstatus = 'F' union all select 'fail', count(*) from orders where o_orderstatus <> 'F'")
def partition(spark, sf_dir):
    a, b = R.partition_rows(read(spark, sf_dir, "orders"), "o_orderstatus", "=", "F")
    return a.agg(F.count(F.lit(1)).alias("n")).select(F.lit("pass").alias("side"), "n").unionByName(b.agg(F.count(F.lit(1)).alias("n")).select(F.lit("fail").alias("side"), "n"))


@query("explode", "select vec_id, i - 1 as pos, round(cast(embedding[i] as double), 5) as x from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)")
def explode(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e")).select("vec_id", c("pos").cast("bigint").alias("pos"), r(c("e").cast("double"), 5).alias("x"))


_W = "(partition by user_id order by ts, event_id)"


@query(
    "windows",
    f"""select event_id, round(sum(value) over {_W[:-1]} rows unbounded preceding), 4) as cumsum, round(value - lag(value) over {_W}, 6) as diff,
               round(case when lag(value) over {_W} <> 0 then (value - lag(value) over {_W}) / lag(value) over {_W} end, 6) as pct_change,
               lag(value, 2) over {_W} as lag2, lead(value, 1, -1.0) over {_W} as lead1, round(avg(value) over {_W[:-1]} rows 2 preceding), 6) as moving_avg,
               rank() over (partition by event_type order by value desc) as rank_, row_number() over {_W} as rn from events""",
)
def windows(spark, sf_dir):
    e, o, p = R.rank_rows(read(spark, sf_dir, "events"), "value", ["event_type"], name="rank_"), ["ts", "event_id"], ["user_id"]
    return e.select(
        "event_id", r(R.cumsum("value", o, p), 4).alias("cumsum"), r(R.diff("value", o, p)).alias("diff"), r(R.pct_change("value", o, p)).alias("pct_change"), R.lag("value", o, p, 2).alias("lag2"),
        R.lead("value", o, p, 1, -1.0).alias("lead1"), r(R.moving_avg("value", 3, o, p)).alias("moving_avg"), "rank_",
        F.row_number().over(Window.partitionBy(*p).orderBy(*o)).cast("bigint").alias("rn"),
    )


_V = "case when event_id % 3 = 0 then value end"


@query(
    "fill_missing",
    f"""select event_id, last_value(x ignore nulls) over {_W[:-1]} rows unbounded preceding) as forward, first_value(x ignore nulls) over {_W[:-1]} rows between current row and unbounded following) as backward,
               coalesce(x, -1.0) as value_, round(coalesce(x, avg(x) over (partition by user_id)), 6) as mean from (select *, {_V} as x from events)""",
)
def fill_missing(spark, sf_dir):
    e, o, p = read(spark, sf_dir, "events").withColumn("x", F.when(c("event_id") % 3 == 0, c("value"))), ["ts", "event_id"], ["user_id"]
    e = R.fill_mean(e, "x", p, "m")
    return e.select("event_id", R.fill_missing("x", o, p, None, "forward").alias("forward"), R.fill_missing("x", o, p, None, "backward").alias("backward"), R.fill_missing("x", o, p, -1.0).alias("value_"), r(c("m")).alias("mean"))


@query("shift", f"select event_id, lag(value, 1, 0.0) over {_W} as right1, lead(value, 2) over {_W} as left2, round(product(1 + value / 1000) over {_W[:-1]} rows unbounded preceding), 5) as cumprod from events")
def shift(spark, sf_dir):
    e, o, p = read(spark, sf_dir, "events").withColumn("g", 1 + c("value") / 1000), ["ts", "event_id"], ["user_id"]
    return e.select("event_id", R.shift("value", o, p, 1, 0.0).alias("right1"), R.shift("value", o, p, -2).alias("left2"), r(R.cumprod("g", o, p), 5).alias("cumprod"))


@query("accumulate", "select o_orderkey, round(sum(o_totalprice) over (order by o_orderkey rows unbounded preceding), 2) as total from orders")
def accumulate(spark, sf_dir):
    return R.global_running_sum(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", "t").select("o_orderkey", r("t", 2).alias("total"))


@query("accumulate_all_columns", "select *, cast(sum(cast(o_totalprice as decimal(18, 2))) over (order by o_orderdate, o_orderkey rows unbounded preceding) as double) as total from orders")
def accumulate_all_columns(spark, sf_dir):
    d = R.prefix_sum(read(spark, sf_dir, "orders"), c("o_totalprice").cast("decimal(18,2)"), ["o_orderdate", "o_orderkey"], "total")
    return d.withColumn("total", c("total").cast("double"))


@query("quantiles", "select user_id, round(quantile_cont(value, 0.25), 6) as q25, round(median(value), 6) as q50, round(quantile_cont(value, 0.99), 6) as q99 from events group by 1")
def quantiles(spark, sf_dir):
    q = R.quantiles(read(spark, sf_dir, "events"), ["user_id"], {"q25": ("value", 0.25), "q50": ("value", 0.5), "q99": ("value", 0.99)})
    return q.select("user_id", *[r(n).alias(n) for n in ("q25", "q50", "q99")])


@query("accumulate_in_loop", f"select event_id, count(*) over {_W[:-1]} rows unbounded preceding) as n, min(value) over {_W[:-1]} rows unbounded preceding) as lo, max(value) over {_W[:-1]} rows unbounded preceding) as hi, first_value(event_type) over {_W} as f from events")
def accumulate_in_loop(spark, sf_dir):
    o, p = ["ts", "event_id"], ["user_id"]
    return read(spark, sf_dir, "events").select("event_id", *[R.running(op, x, o, p).alias(n) for n, op, x in (("n", "count", "value"), ("lo", "min", "value"), ("hi", "max", "value"), ("f", "first", "event_type"))])


@query("consecutive_windows", f"select event_id, round(s, 4) as s from (select event_id, sum(value) over {_W[:-1]} rows between current row and 2 following) as s, count(*) over {_W[:-1]} rows between current row and 2 following) as n from events) where n = 3")
def consecutive_windows(spark, sf_dir):
    w = R.windows_of(read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "value", 3, ["ts", "event_id"], ["user_id"])
    return w.select("event_id", r(v("sum", c("items")), 4).alias("s"))


@query(
    "pivot",
    """select o_orderpriority, round(sum(case when o_orderstatus = 'F' then o_totalprice end), 2) as "F", round(sum(case when o_orderstatus = 'O' then o_totalprice end), 2) as "O",
              round(sum(case when o_orderstatus = 'P' then o_totalprice end), 2) as "P" from orders group by 1""",
)
def pivot(spark, sf_dir):
    return R.pivot_rows(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], r(F.sum("o_totalprice"), 2))


@query("unpivot", "select l_orderkey, l_linenumber, 'l_discount' as key, l_discount as value from lineitem union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem")
def unpivot(spark, sf_dir):
    return R.unpivot_rows(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query(
    "statistics",
    """select l_returnflag, round(stddev_pop(l_quantity), 6) as std, round(var_pop(l_quantity), 5) as variance, round(stddev_samp(l_quantity), 6) as std_sample, round(var_samp(l_quantity), 5) as variance_sample,
              median(l_quantity) as median, round(quantile_cont(l_extendedprice, 0.9), 4) as p90, round(covar_pop(l_quantity, l_extendedprice), 3) as covariance,
              round(corr(l_quantity, l_extendedprice), 6) as correlation, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) as weighted from lineitem group by 1""",
)
def statistics(spark, sf_dir):
    q, p = "l_quantity", "l_extendedprice"
    d = read(spark, sf_dir, "lineitem")
    mids = R.quantiles(d, ["l_returnflag"], {"median": (q, 0.5), "p90": (p, 0.9)})
    return d.groupBy("l_returnflag").agg(
        r(F.stddev_pop(q)).alias("std"), r(F.var_pop(q), 5).alias("variance"), r(F.stddev_samp(q)).alias("std_sample"), r(F.var_samp(q), 5).alias("variance_sample"),
        r(F.covar_pop(q, p), 3).alias("covariance"), r(R.correlation(q, p)).alias("correlation"), r(R.weighted_avg("l_discount", q), 8).alias("weighted"),
    ).join(mids.withColumn("p90", r("p90", 4)), "l_returnflag")


@query("zscore", "select l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) over (partition by l_suppkey)) / nullif(stddev_pop(l_quantity) over (partition by l_suppkey), 0), 6) as z from lineitem")
def zscore(spark, sf_dir):
    return R.zscores(read(spark, sf_dir, "lineitem"), "l_quantity", ["l_suppkey"], "z").select("l_orderkey", "l_linenumber", r(c("z")).alias("z"))


@query("mode", "select l_suppkey, l_quantity as mode from (select l_suppkey, l_quantity, row_number() over (partition by l_suppkey order by count(*) desc, min((l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey)) as k from lineitem group by 1, 2) where k = 1")
def mode(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").withColumn("o", (c("l_orderkey") * 10 + c("l_linenumber")) * 10000000 + c("l_partkey"))
    return R.mode_of(d, ["l_suppkey"], "l_quantity", "o")


@query("lookup", "select c_custkey, n_name as nation from customer left join nation on c_nationkey = n_nationkey")
def lookup(spark, sf_dir):
    return R.lookup(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "nation"), {"c_nationkey": "n_nationkey"}, "n_name", "nation").select("c_custkey", "nation")


@query("lookup_default", "select c_custkey, coalesce(n_name, 'elsewhere') as nation from customer left join (select * from nation where n_regionkey = 1) on c_nationkey = n_nationkey")
def lookup_default(spark, sf_dir):
    return R.lookup(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "nation").filter("n_regionkey = 1"), {"c_nationkey": "n_nationkey"}, "n_name", "nation", default="elsewhere").select("c_custkey", "nation")


@query("having_some", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 49)")
def having_some(spark, sf_dir):
    return R.having_some(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


@query("having_none", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 30)")
def having_none(spark, sf_dir):
    return R.having_none(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


@query("salted_sum", "select l_returnflag, round(sum(l_extendedprice), 2) as total from lineitem group by 1")
def salted_sum(spark, sf_dir):
    return R.salted_sum(read(spark, sf_dir, "lineitem"), ["l_returnflag"], {"t": "l_extendedprice"}).select("l_returnflag", r("t", 2).alias("total"))


@query("tumbling_windows", "select time_bucket(interval '1 day', ts, timestamp '1970-01-01') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_windows(spark, sf_dir):
    from ..streaming.events import tumbling

    return tumbling(read(spark, sf_dir, "events"), "1 day").select("window_start", "event_type", "n", r("total", 4).alias("total"))


@query(
    "multi_pass",
    """with t as (select sum(o_totalprice) as all_ from orders), s as (select c_nationkey, sum(o_totalprice) as total from orders join customer on o_custkey = c_custkey group by 1)
       select n_name, round(total / all_, 8) as share from s join nation on c_nationkey = n_nationkey cross join t""",
)
def multi_pass(spark, sf_dir):
    """Pass one accumulates the grand total, pass two reads it."""
    o = read(spark, sf_dir, "orders")
    total = o.agg(F.sum("o_totalprice").alias("all_"))
    s = o.join(read(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("total"))
    n = read(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), c("c_nationkey") == c("n_nationkey")).join(F.broadcast(total)).select("n_name", r(c("total") / c("all_"), 8).alias("share"))


@query(
    "pricing_summary",
    """select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc,
              round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""",
)
def pricing_summary(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").filter(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), r(F.sum("l_extendedprice"), 2).alias("sum_base"), r(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("sum_disc"), r(F.avg("l_discount")).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query(
    "revenue_by_nation",
    """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
       join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey join nation on n_nationkey = s_nationkey group by 1""",
)
def revenue_by_nation(spark, sf_dir):
    t = {n: read(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier", "nation")}
    j = t["customer"].join(t["orders"], c("c_custkey") == c("o_custkey")).join(t["lineitem"], c("l_orderkey") == c("o_orderkey"))
    j = j.join(t["supplier"], (c("l_suppkey") == c("s_suppkey")) & (c("s_nationkey") == c("c_nationkey"))).join(t["nation"], c("n_nationkey") == c("s_nationkey"))
    return j.groupBy("n_name").agg(r(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"))


from . import catalogue_formats, catalogue_language, catalogue_rows, catalogue_values  # noqa: E402,F401
