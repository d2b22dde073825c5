import duckdb
import pytest

from sparkweave.operators import relational as R
from sparkweave.plans import catalogue

SLOW = {"arrays", "string_case", "dates"}


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in SLOW][:28])
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, sf)
    want = con.sql(catalogue.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    key = lambda rows, cols: sorted(tuple(str(r[cols.index(c)]) for c in order) for r in rows)
    assert key([tuple(r) for r in got.collect()], got.columns) == key(want.fetchall(), want.columns)


def test_numbering_without_keys_is_distributed(spark):
    d = R.numbered(spark.range(1000).selectExpr("id * 7 % 1000 as x"), "x")
    assert sorted(r["_rowNum"] for r in d.collect()) == list(range(1, 1001))
    assert "SinglePartition" not in d.select("x", "_rowNum")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_numbering_keeps_every_row_whatever_the_exchanges(spark, sf):
    """Wide rows, and partitions that adaptive execution coalesces to other counts."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
        n = R.numbered(lines, order, "n")
        assert n.agg({"n": "count"}).first()[0] == lines.count() and sorted(x["n"] for x in n.select("n").collect()) == list(range(1, lines.count() + 1))
        total = R.global_running_sum(lines, "l_quantity", order, "t")
        assert total.count() == lines.count() and total.agg({"t": "max"}).first()[0] == lines.agg({"l_quantity": "sum"}).first()[0]
        assert R.skip(lines, order, 100).count() == lines.count() - 100
        ranks = R.rank_rows(lines, "l_quantity", ["l_returnflag"])
        assert ranks.count() == lines.count() and ranks.filter("_rank = 1").agg({"l_quantity": "min"}).first()[0] == 50
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_quantiles_and_ranks_take_nulls_and_ties(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("a", None), (None, 2.0), ("b", None)], "k string, x double")
    got = {r["k"]: r["m"] for r in R.quantiles(d, ["k"], {"m": ("x", 0.75)}).collect()}
    assert got == {"a": 2.5, None: 2.0, "b": None}
    ranks = sorted(((r["k"], r["x"], r["_rank"]) for r in R.rank_rows(d, "x", ["k"]).collect()), key=str)
    assert ranks == sorted([("a", 4.0, 1), ("a", 1.0, 2), ("a", 1.0, 2), ("a", None, 4), (None, 2.0, 1), ("b", None, 1)], key=str)
    assert R.quantiles(d.filter("x > 9"), ["k"], {"m": ("x", 0.5)}).count() == 0


def test_dedupe_keeps_rows_without_key(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "o int, k string")
    assert sorted(r["o"] for r in R.dedupe(d, "k", "o").collect()) == [1, 3, 4]


def test_lookup_takes_the_first_row_of_a_key(spark):
    d = spark.createDataFrame([("a",), ("b",)], "k string")
    t = spark.createDataFrame([("a", 2, 1), ("a", 1, 0)], "c string, v int, o int")
    assert {r["k"]: r["x"] for r in R.lookup(d, t, {"k": "c"}, "v", "x", order="o", default=9).collect()} == {"a": 1, "b": 9}


def test_asof_and_range_joins(spark):
    a = spark.createDataFrame([(1, 5), (1, 1)], "k int, t int")
    b = spark.createDataFrame([(1, 3, 30), (1, 4, 40)], "k int, t int, v int")
    assert {r["t"]: r["v2"] for r in R.asof_join(a, b, ["k"], "t", "v", "v2").collect()} == {5: 40, 1: None}
    p, q = spark.createDataFrame([(4.0,), (11.0,)], "x double"), spark.createDataFrame([(0.0, 5.0), (3.0, 20.0)], "lo double, hi double")
    assert R.range_join(p, q, "x", "lo", "hi", 4.0).count() == 3


def test_streaming_windows(spark, tmp_path, sf):
    from sparkweave.streaming.events import tumbling

    src = spark.read.parquet(f"{sf}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = tumbling(stream, "1 day").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tumbled").agg({"n": "sum"}).first()[0] == src.count()
