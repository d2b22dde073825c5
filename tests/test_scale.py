"""Plans and figures that must not grow faster than the input."""

import html
import random

from pyspark.sql import functions as F

from sparkweave.functions import call, strings
from sparkweave.functions.geo import mulberry, seed_of
from sparkweave.plans.catalogue_values import QUERIES
from sparkweave.plans.documents import resolve
from sparkweave.plans.validate import parse_schema, validate


def test_tables_that_grow_with_the_input_are_not_broadcast(spark):
    """They are small on disk and look smaller still under an explode."""
    cells = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("type"), F.lit(v).alias("value")) for p, t, v in (("a", "string", "x"), ("b", "reference", "a"), ("c", "reference", "d"), ("d", "reference", "c"), ("e", "reference", "f"))])
    long = spark.range(50).select(F.col("id").cast("string").alias("doc"), F.inline(cells))
    for d in (resolve(long), validate(long, parse_schema("{}\na =\nb =\n"), strict=True)):
        assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
    assert {(r["path"], r["value"], r["cycle"]) for r in resolve(long).filter("doc = '7'").collect()} == {("a", "x", False), ("b", "x", False), ("c", None, True), ("d", None, True), ("e", None, False)}


def test_a_value_beside_a_lambda_is_computed_once(spark):
    """Means, keys and lookups of an array are not computed anew for each of its items."""
    a = F.transform(F.sequence(F.lit(1), F.col("id") + 9), lambda x: x * F.lit(1.5))
    rows = F.transform(F.sequence(F.lit(1), F.col("id") + 9), lambda x: F.struct((x % 3).alias("key"), x.alias("value")))
    for x in (call("std", a), call("covariance", a, a), call("zscore", 1, a), call("fillMissing", a, 0.0, "mean"), call("rank", a), call("diff", a), call("shift", a, 1), call("movingAvg", a, 2), call("dedupe", rows, "key"), call("keyBy", rows, "key"), call("sortBy", rows, "value")):
        plan = spark.range(3).select(x.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sequence(") <= 2, plan


def test_samples_keep_items_in_the_jvm(spark):
    d = spark.createDataFrame([(["a", "b", "c", "d"], "s"), (["a", "b", "c", "d"], "s"), (None, "s"), ([], "t"), (["x"], "u")], "a array<string>, s string").coalesce(1)
    got = [r[0] for r in d.select(call("sample", F.col("a"), 3, F.col("s"), kind="string")).collect()]

    def want(a, n, seed):
        a, u = list(a), mulberry(seed_of(seed))
        for i in range(min(n, len(a))):
            j = i + int(next(u) * (len(a) - i))
            a[i], a[j] = a[j], a[i]
        return a[:n]

    assert got == [want("abcd", 3, "s")] * 2 + [None, [], ["x"]]


def test_rates_of_a_batch(spark):
    flows = [[-100.0, 110.0], [-100.0, 0.0, 121.0], [-1.0], None, [1.0, 2.0], [-100.0, None, 5.0], [-100.0] + [12.0] * 12]
    d = spark.createDataFrame([(k, f) for k, f in enumerate(flows)], "k int, f array<double>").coalesce(1)
    got = [r[0] for r in d.orderBy("k").select(call("irr", F.col("f"))).collect()]
    assert [None if x is None else round(x, 8) for x in got[:4]] == [0.1, 0.1, None, None] and got[4:6] == [None, None]
    assert abs(sum(c / (1 + got[6]) ** t for t, c in enumerate(flows[6]))) < 1e-6
    r = spark.range(1).select(call("rate", 12, -10.0, 100.0).alias("a"), call("rate", 360, -1.0, 100.0).alias("b")).first()
    assert abs(100 - 10 * (1 - (1 + r["a"]) ** -12) / r["a"]) < 1e-6 and abs(100 - (1 - (1 + r["b"]) ** -360) / r["b"]) < 1e-4


def test_rows_that_take_long_are_dealt_out(spark, sf):
    for q in ("objects", "cash_flows"):
        assert QUERIES[q](spark, sf).rdd.getNumPartitions() >= 4


def test_constants_are_hashed_when_planning(spark):
    assert "Python" not in spark.range(1).select(call("hmac", "m", "k"))._jdf.queryExecution().executedPlan().toString()


def test_python_gets_only_texts_it_must_see(spark):
    """Texts of common scripts, and references of escapeHtml, are null to it."""
    rnd = random.Random(7)
    pool = [chr(c) for a, b in ((32, 127), (0xC0, 0x24F), (0x300, 0x36F), (0x370, 0x52F), (0x1E00, 0x1FFF), (0x2000, 0x206F), (0x3000, 0x30FF), (0x4E00, 0x4E40)) for c in range(a, b)]
    odd = [chr(c) for c in (0x1100, 0x1161, 0xAC00, 0x9C7, 0x9BE, 0x212B, 0x1F600, 0xF900)]
    texts = ["".join(rnd.choice(pool) for _ in range(40)) for _ in range(300)] + ["".join(rnd.choice(pool + odd * 60) for _ in range(30)) for _ in range(300)] + ["", None, "é\n"]
    texts += ["&amp;lt; &#39;&apos; &quot;", "&lt &eacute; &amp;", "a & b", "&amp;#39;"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    got = rows.select("k", call("stripAccents", F.col("t")).alias("a"), call("unescapeHtml", F.col("t")).alias("u")).collect()
    assert [r["a"] for r in got] == [None if t is None else strings._bare(t) for t in texts]
    assert [r["u"] for r in got] == [None if t is None else html.unescape(t) for t in texts]
    for name in ("stripAccents", "unescapeHtml"):
        plan = rows.select(call(name, F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
        inner = plan[plan.index("ArrowEvalPython"):]
        assert "_strip_accents(t#" not in inner and "_unescape(t#" not in inner, plan
