import random
import zlib

import brute
import numpy as np
import pytest
from cases import EDGE, PASSAGE
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_dedup import against_sql

import corpus_pipeline
from sparkweave.llm import decontam, entry, langid, lm, packing, toxicity, urls
from sparkweave.llm.common import crc_mod5


def test_lm_base_and_normalisation(spark, edge, empty):
    got = sorted(((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.score(edge, crc_mod5(F.col("doc_id")) == 1, block_bytes=5000, top=20).collect()))
    want = brute.unigram(EDGE, [brute.mod5(i) == 1 for i, _ in EDGE])
    assert got == sorted((i or -1, *w[:3], round(w[3], 6)) for (i, _), w in zip(EDGE, want, strict=True))
    assert lm.score(empty, F.lit(False)).count() == 0


def test_lm_class_softmax_sums_to_one():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    f = np.stack([rng.integers(0, lm.ROWS, 50) for _ in range(3)])
    assert np.allclose(np.exp(lm.class_logs(w, np.zeros(lm.CLASSES, np.float32), f)).sum(axis=1), 1, atol=1e-4)


def test_lm_beats_its_base(spark, sf):
    d = entry.op3_lm_scoring(spark, sf).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert d[0] > d[1]


def costs(hist, bounds):
    return sum(n * (min(b for b in bounds if b >= k) - k) for k, n in hist.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_buckets_are_optimal(hist, k):
    from itertools import combinations

    bounds = packing.bucket_bounds(hist, k)
    assert len(bounds) <= k and bounds[-1] == max(hist)
    best = min(costs(hist, [*c, max(hist)]) for n in range(k) for c in combinations(sorted(hist), n))
    assert costs(hist, bounds) == best


def test_packing(edge, empty):
    rows = packing.pack(edge, budget=64, shard_rows=4).collect()
    assert len(rows) == len(EDGE) and sorted(r["n_tokens"] for r in rows) == sorted(len(brute.words(t)) for _, t in EDGE)
    groups = {}
    for r in rows:
        groups.setdefault(r["batch_id"], []).append(r)
    for g in groups.values():
        assert sorted(r["slot"] for r in g) == list(range(len(g))) and all(r["batch_docs"] == len(g) for r in g)
        assert len(g) * g[0]["bucket_len"] <= 64 or len(g) == 1
    assert packing.pack(empty).count() == 0


def brute_segments(x):
    """All maximal segments, by the definition that a longest one splits the rest."""
    if not len(x):
        return []
    best = max(((sum(x[i:j]), -(j - i), -i) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=None)
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    return [*brute_segments(x[:i]), (best[0], i, j), *[(s, a + j, b + j) for s, a, b in brute_segments(x[j:])]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-3, 3), max_size=14))
def test_segments_have_the_scores_of_all_maximal_ones(x):
    got = toxicity.segments(np.array(x, dtype=float))
    assert sorted(s for s, _, _ in got) == sorted(float(s) for s, _, _ in brute_segments(x))
    assert all(sum(x[a:b]) == s for s, a, b in got)


def test_toxicity(spark, edge, empty):
    rnd = random.Random(3)
    bad = ["vile", "rotten", "foul"]
    rows = []
    for i in range(400):
        w = [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(20, 120))]
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((i, " ".join(w).title(), int(i % 4 == 0)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows] + [(7, None)], "doc_id long, toxic int")
    m = toxicity.train(docs.filter(crc_mod5(F.col("doc_id")) != 0), labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, m).collect()}
    held = [i for i in got if brute.mod5(i) == 0]
    assert np.mean([got[i]["predicted"] == rows[i][2] for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.score(edge, m).count() == len(EDGE) and toxicity.score(empty, m).count() == 0
    none = toxicity.train(docs.limit(0), labels)
    assert {r["predicted"] for r in toxicity.score(edge, none).collect()} == {0}


def test_urls_sql(spark, sf):
    against_sql(spark, sf, "op6_url_filter")


def test_url_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.A.NET/x"), (4, "http://a.net?x"), (5, "http://example.net/en/1"), (6, "http://notexample.com/de/"), (7, "http://x.example.com/de/a://b"), (8, "http://x.org/fr/"), (9, ""), (10, "http://casino-win.example.org/"), (3, "HTTP://WWW.A.NET/x")]
    d = spark.createDataFrame(rows, "page_id int, url string").withColumn("rule", F.lit("mine"))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(d).collect())
    assert got == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "www.a.net", "/x", "net/", "block"), (4, "a.net", "", None, "allow"), (5, "example.net", "/en/1", "example.net/en/", "allow"), (6, "notexample.com", "/de/", None, "allow"),
        (7, "x.example.com", "/de/a://b", "example.com/de/", "block"), (8, "x.org", "/fr/", "org/fr/", "allow"), (9, "", "", None, "allow"), (10, "casino-win.example.org", "/", None, "block"), (3, "www.a.net", "/x", "net/", "block"),
    ], key=lambda r: r)


def test_language(spark, sf, edge, empty):
    d = entry.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in d]) > 0.9
    m = langid.Model(langid.fit(edge))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(edge, m).collect()}
    assert got[4] == got[5] == got[6] == "und" and set(got.values()) <= {"und", "en", "de"}
    assert langid.predict(empty, m).count() == 0 and langid.fit(empty) == {}
    assert {r["lang_pred"] for r in langid.predict(edge, langid.Model({})).collect()} == {"und"}


def distance(a, b):
    """Least edit distance of a to any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=12), st.binary(max_size=25))
def test_bit_parallel_distance(a, b):
    a, b = bytes(x % 3 for x in a), bytes(x % 3 for x in b)
    assert decontam.edit_distance_within(a, b)[0] == distance(a, b)


def test_leaks(spark, edge, empty):
    rnd = random.Random(5)
    items = [(1, PASSAGE), (2, " ".join(f"question{rnd.randrange(999)}" for _ in range(12))), (3, "tiny"), (4, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    changed = items[1][1].replace("question", "qestion", 3)
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame([(50, f"Before, {changed.upper()}!! after"), (51, "nothing here tiny")], "doc_id bigint, text string"))
    got = {r["doc_id"]: [(x["item_id"], x["distance"]) for x in r["leaks"]] for r in decontam.find_leaks(docs, bench).collect()}
    assert {k: v for k, v in got.items() if v} == {14: [(1, 0)], 15: [(1, 0)], 50: [(2, 3)], 51: [(3, 0)]}
    two = {r["doc_id"]: len(r["leaks"]) for r in decontam.find_leaks(docs, bench, block_items=1).collect()}
    assert {k for k, v in two.items() if v} == {14, 15, 50, 51}
    assert decontam.find_leaks(empty, bench).count() == 0 and decontam.find_leaks(edge, bench.limit(0)).filter("size(leaks) > 0").count() == 0


def test_leak_recall():
    rnd = random.Random(2)
    items = [bytes(rnd.choice(b"abcdefghij ") for _ in range(rnd.randrange(90, 300))) for _ in range(30)]
    ix = decontam.Index(list(range(30)), items, 0.1, 0.999, 3, 5)
    found = 0
    for k in range(120):
        s = bytearray(items[k % 30])
        for _ in range(int(ix.k[k % 30])):
            p = rnd.randrange(len(s))
            s[p : p + rnd.randrange(2)] = bytes([rnd.choice(b"xyz")]) if rnd.random() < 0.7 else b""
        found += k % 30 in {x[0] for x in ix.leaks([b"before " + bytes(s) + b" after"])[0]}
    assert found >= 118


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns and after.exceptAll(before).count() == 0
        before = after
    ids = [r["doc_id"] for r in after.collect()]
    assert len(ids) == len(set(ids)) and 0.5 * docs.count() < len(ids) < docs.count()
    assert zlib.crc32(b"1") % 5 == brute.mod5(1) and pytest
