"""Cases in which an operator once left its contract."""

import random

import pytest
from pyspark.sql import functions as F
from test_models import distance

import corpus_pipeline
from sparkweave.llm import decontam, exact_dedup, langid, near_dedup


def test_a_hot_text_and_long_texts_do_not_push_a_language_out(spark):
    rnd = random.Random(1)
    en, fr, de = (["".join(rnd.choice(ch) for _ in range(rnd.randint(3, 8))) for _ in range(30)] for ch in ("abcdef", "ghijkl", "mnopqr"))
    text = lambda vocabulary, n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    hot = text(fr, 40)
    rows = [(hot, "fr")] * 2000 + [(text(en, 30), "en") for _ in range(300)] + [(text(de, 6000), "de") for _ in range(5)] + [(None, "xx"), ("", "xx"), ("some text", None)]
    d = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert set(d) == {"fr", "en", "de"} and len(d["de"]) > 16000 and list(d)[0] == "fr"
    assert len(d["fr"]) <= len(hot)
    m = langid.Model(d)
    assert [m.judge(text(x, 12).encode())[0] for x in (en, de, fr)] == ["en", "de", "fr"]


def test_a_narrow_margin_is_a_rejection(spark):
    same = b"alpha beta gamma delta " * 50
    m = langid.Model({"a": same, "b": same})
    got = langid.predict(spark.createDataFrame([(1, "alpha beta gamma"), (2, "12 34"), (3, None)], "doc_id int, text string"), m).collect()
    assert all(r["rejected"] for r in got) and [r["lang_pred"] for r in got] == ["a", "und", "und"]


@pytest.mark.parametrize("kind", ["string", "bigint", "struct"])
def test_item_ids_of_any_type_and_short_items(spark, kind):
    texts = ["who wrote the old book about whales", "short item here", "a cat", "", None, "!!"]
    ids = {"string": [f"q{k}" for k in range(6)], "bigint": list(range(6)), "struct": [(k, "x") for k in range(6)]}[kind]
    bench = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"item_id {'struct<a:int,b:string>' if kind == 'struct' else kind}, text string")
    docs = spark.createDataFrame(
        [(1, "He asked WHO wrote the old bok about whales, twice", "x"), (2, "a shrt item here", "x"), (3, "I have a cat.", "x"), (4, "a catalogue", "x"), (5, None, "x"), (6, "nothing of it", "x")], "doc_id int, text string, leaks string"
    )
    for block in (20000, 2):
        out = decontam.find_leaks(docs, bench, block_items=block, out_col="found")
        got = {r["doc_id"]: [(tuple(x["item_id"]) if kind == "struct" else x["item_id"], x["distance"]) for x in r["found"]] for r in out.collect()}
        assert {k: v for k, v in got.items() if v} == {1: [(ids[0], 1)], 2: [(ids[1], 1)], 3: [(ids[2], 0)]}
        assert out.filter("leaks <> 'x'").count() == 0


def test_leaks_against_all_items_on_all_texts(spark):
    """Items of 9 to 120 bytes, edited passages in documents, against the edit distance of every pair."""
    rnd = random.Random(8)
    letters = "abcdefghijklm"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (2, 3, 4, 5, 6, 8, 10, 14, 18, 20) for _ in range(3)]
    items = [x for x in items if len(x) > decontam.WORD]
    docs = []
    for k in range(90):
        x = items[k % len(items)]
        t = list(x)
        for _ in range(rnd.randint(0, len(x) // 8 + 1)):
            p = rnd.randrange(len(t))
            t[p : p + 1] = rnd.choice([[], [rnd.choice(letters)], [t[p], rnd.choice(letters)]])
        docs.append((k, f"{word()} {word()} " + "".join(t) + f" {word()}"))
    want = set()
    for k, t in docs:
        for i, x in enumerate(items):
            if distance(x.encode(), decontam.fold(t)) <= int(0.1 * len(x)):
                want.add((k, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {(r["doc_id"], x["item_id"]) for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), bench).collect() for x in r["leaks"]}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 40


def test_buckets_alone_name_the_items():
    """The prefilter gives windows; which items they are compared with is up to the buckets."""
    items = [b"the quick brown fox jumps over the lazy dog today", b"the quick brown fox jumps over the lazy cat today"]
    ix = decontam.Index([0, 1], items, 0.1, 0.999, 3, 5)
    assert [x[0] for x in ix.leaks([b"see " + items[0]])[0]] == [0, 1]
    ix.buckets = [(k[:0], i[:0]) for k, i in ix.buckets]
    assert ix.leaks([items[0]]) == [[]]


def test_stages_leave_clashing_columns_alone(spark):
    rows = [(i, t, "en", "k", 0.5, True, "m") for i, t in enumerate(["one text of some words here", "one text of some words here", None, "", "quite another text about other things", "quite another text about other things"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _key string, score double, rejected boolean, leaks string").withColumn("_id", F.lit(7))
    for drop_ in (exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates, lambda d: corpus_pipeline.language_id(spark, d, ""), lambda d: corpus_pipeline.decontaminate(spark, d, "/root/testdata/sf0.001")):
        out = drop_(docs)
        assert out.columns == docs.columns
        assert out.filter("_key <> 'k' or score <> 0.5 or not rejected or leaks <> 'm' or _id <> 7").count() == 0 and out.count() > 0


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0 and (k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns)


def test_pipeline_of_nulls_ties_and_repeated_rows(spark, tmp_path):
    """Brute force of what stays: letters at all, one of each text, one of each near group."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "der die das und nicht ein eine wer wo was wie warum"
    rows = [(1, a), (2, a.upper()), (2, a.upper()), (3, None), (4, ""), (5, "12 34"), (6, b), (7, b), (8, a + " mu"), (None, b)]
    docs = spark.createDataFrame([(i, t, "de" if t and t.startswith("der") else "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item that no document holds at all")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [2, 7]
