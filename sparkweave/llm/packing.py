"""Packing: optimal length buckets and token-budget batches.

1. Token counts (words [^\\x20\\x09-\\x0D]+, or any length column) and their global
   histogram, the only thing that comes to the driver: one row for each different length,
   of which there are at most sqrt(2 * tokens).
2. Dynamic programming over the histogram picks at most ``n_buckets`` upper bounds with the
   least total padding (monotone hull, O(buckets * bins)).
3. In each bucket, documents in hash order fill batches of ``budget // bound`` rows (one at
   least), numbered from exact prefix sums over (bucket, shard) counts: no bucket is ever
   gathered in one task.

Defined cases: null text has 0 tokens; 0-token rows share the first bucket; a text longer
than the budget is a batch by itself; repeated rows are packed once each; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("int")


def bucket_bounds(hist: dict[int, int], n_buckets: int) -> list[int]:
    """Upper bounds, ascending, the last the largest length, that minimise
    sum(count * (bound - length)) with at most ``n_buckets`` buckets."""
    lens = sorted(k for k, v in hist.items() if v > 0)
    if not lens:
        return []
    n = len(lens)
    cnt, tot = [0] * (n + 1), [0] * (n + 1)
    for i, x in enumerate(lens):
        cnt[i + 1] = cnt[i] + hist[x]
        tot[i + 1] = tot[i] + hist[x] * x
    # cost of bins i..j-1 in one bucket: lens[j-1] * (cnt[j] - cnt[i]) - (tot[j] - tot[i])
    best = [0] + [lens[j - 1] * cnt[j] - tot[j] for j in range(1, n + 1)]
    back = [[0] * (n + 1)]
    for _ in range(1, min(n_buckets, n)):
        new, frm = [0] * (n + 1), [0] * (n + 1)
        hull: deque[tuple[int, int, int]] = deque()  # (slope, intercept, i): value at x = slope * x + intercept
        for j in range(1, n + 1):
            i = j - 1
            line = (-cnt[i], best[i] + tot[i], i)
            while len(hull) >= 2:
                (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                if (line[1] - b1) * (m1 - m2) <= (b2 - b1) * (m1 - line[0]):
                    hull.pop()
                else:
                    break
            hull.append(line)
            x = lens[j - 1]
            while len(hull) >= 2 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            m, b, frm[j] = hull[0]
            new[j] = m * x + b + x * cnt[j] - tot[j]
        if new[n] >= best[n]:
            break
        best = new
        back.append(frm)
    bounds, j = [], n
    for frm in reversed(back):
        bounds.append(lens[j - 1])
        j = frm[j]
        if j == 0:
            break
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, n_buckets: int = 12, budget: int = 16384, shard_rows: int = 20000) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, padding, batch_id, slot, batch_docs."""
    n = F.coalesce(F.col(length_col).cast("int"), F.lit(0)) if length_col else word_count(F.col(text_col))
    # rows that share an id, or have none, are spread by their text too
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), n.alias("n_tokens"), F.xxhash64(F.col(id_col), F.col(length_col or text_col), F.lit(1)).alias("h")), "lengths")
    stats = rows.agg(F.count(F.lit(1)).alias("rows")).first()
    hist = {r["n_tokens"]: r["count"] for r in rows.groupBy("n_tokens").count().collect()}
    bounds = bucket_bounds(hist, n_buckets) or [0]
    shards = max(1, -(-stats["rows"] // shard_rows))
    bucket = F.lit(len(bounds) - 1)
    for i in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(bucket)
    length = F.array(*map(F.lit, bounds))[F.col("bucket")]
    rows = rows.select("*", bucket.cast("int").alias("bucket"), F.pmod("h", F.lit(shards)).cast("int").alias("shard"))
    # exact prefix sums over buckets x shards, in shard order inside a bucket
    sums = cut(rows.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("here")), "shards")
    before = F.coalesce(F.sum("here").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cut(sums.select("bucket", "shard", before.alias("before"), F.sum("here").over(Window.partitionBy("bucket")).alias("in_bucket")), "offsets")
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h", "doc_id")) - 1 + F.col("before")
    each = F.greatest(F.lit(budget) / F.greatest(length, F.lit(1)), F.lit(1)).cast("long")
    out = rows.join(sums, ["bucket", "shard"]).withColumn("rank", rank).withColumn("bucket_len", length).withColumn("each", each)
    batch = F.floor(F.col("rank") / F.col("each"))
    return out.select(
        "doc_id", "n_tokens", "bucket", "bucket_len", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        F.concat(F.lpad(F.col("bucket").cast("string"), 3, "0"), F.lit("-"), batch.cast("string")).alias("batch_id"),
        (F.col("rank") % F.col("each")).cast("int").alias("slot"),
        F.least(F.col("each"), F.col("in_bucket") - batch * F.col("each")).cast("int").alias("batch_docs"),
    )
