from sparkweave.llm import packing


def test_one_long_text_changes_no_other_bucket(spark):
    rows = [(k, (10, 11, 13)[k % 3]) for k in range(60)] + [(60, 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, n int")
    got = {r["doc_id"]: r for r in packing.pack(docs, length_col="n", n_buckets=4).collect()}
    assert all(got[k]["bucket_len"] == n and got[k]["padding"] == 0 for k, n in rows)
