"""MinHash near-dedup: one-permutation hashing, optimal densification, star edges.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes).  Texts with equal
   sets are one *node*, named by a 128-bit digest of the set, so that groups of copies
   cost one signature, however large they are.
2. One hash a shingle: the top bits choose one of ``bins`` bins, the least value stays.
   Empty bins copy a bin that is not empty along a fixed random walk of their own (optimal
   densification).  ``bins / rows`` bands are hashed to buckets; with 32 bands of 4 rows a
   pair at similarity 0.75 shares a bucket with probability 1 - 5e-6.
3. In each bucket one node, the first by a hash order that all buckets share, is the centre and
   the others link to it: at most one candidate pair a node and band, and few different
   ones, because the buckets of one group mostly share their centre.  In later rounds the
   centre is a node of the component that has the most nodes in the bucket, and only the
   nodes of other components link to it.  Each pair is confirmed on the full sets and links
   are contracted to components.  Stars only shrink the buckets: they end when a round adds
   few links.
4. Buckets that still hold several components are finished exactly, without all their
   pairs: their nodes are joined on the rarest shingles of their sets (prefix filtering, which
   loses no link), and the pairs of different components that this shows are confirmed.
   So every two linked nodes that share a bucket end in one component.
5. Components: alternating large-star and small-star, all distributed; every join reads
   plain tables on both sides so that adaptive execution can split hot keys.

Defined cases: null or empty text, or text without words: n_shingles 0, linked with nothing,
component_id its own doc_id, kept.  Fewer than five words: one shingle, the whole sequence.
Null ids: component_id is the least id that is not null in the component, kept false unless
the text is empty.  Rows with the same id share kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import cut, drop, fresh, mark, release, ship

BINS, ROWS = 128, 4
#: Stars end when fewer than one in so many of their pairs is a link.
FEW = 50

_walks: dict[int, np.ndarray] = {}


def walks(bins: int) -> np.ndarray:
    """walks[b]: the order in which bin b looks for a donor; the same everywhere."""
    if bins not in _walks:
        _walks[bins] = np.stack([np.random.default_rng(7919 * b + 13).permutation(bins) for b in range(bins)])
    return _walks[bins]


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One-permutation minima of sorted, not empty sets; every bin is filled."""
    n = len(sets)
    out = np.zeros((n, bins), dtype=np.uint64)
    full = np.zeros((n, bins), dtype=bool)
    if not n:
        return out
    all_, row = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    b = (all_ >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    key = row * bins + b
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    out.reshape(-1)[key[first]] = all_[first]
    full.reshape(-1)[key[first]] = True
    walk = walks(bins)
    r, c = np.nonzero(~full)
    for t in range(bins):
        if not len(r):
            break
        d = walk[c, t]
        hit = full[r, d]
        out[r[hit], c[hit]] = out[r[hit], d[hit]] + np.uint64(t + 1)
        r, c = r[~hit], c[~hit]
    return out


def band_hashes(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, bins = sig.shape
    s = W.mix(sig).reshape(n, bins // rows, rows)
    h = np.zeros((n, bins // rows), dtype=np.uint64)
    for k in range(rows):
        h = (h + s[:, :, k]) * np.uint64(W.BASE)
    return W.mix(h + np.arange(bins // rows, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def node_of(s: np.ndarray) -> bytes:
    m = W.mix(s + np.uint64(0x51ED270B27B4F3CF))
    with np.errstate(over="ignore"):
        a = int(m.sum(dtype=np.uint64)) ^ len(s)
        b = int((W.mix(s ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(W.BASE)).sum(dtype=np.uint64))
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, bins: int, rows: int) -> DataFrame:
    """doc_id, tkey, n_shingles, node, bands for every row."""
    data = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tkey"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                sets = list(W.shingle_sets(b.column(2), size))
                some = [s for s in sets if len(s)]
                hashes = band_hashes(signatures(some, bins), rows).view(np.int64)
                nodes, bands, k = [], [], 0
                for s in sets:
                    nodes.append(node_of(s) if len(s) else None)
                    bands.append(hashes[k] if len(s) else None)
                    k += bool(len(s))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "tkey", "n_shingles", "node", "bands"],
                )

    return ship(data).mapInArrow(run, f"doc_id {id_type}, tkey bigint, n_shingles bigint, node binary, bands array<bigint>")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have 100 * |A and B| >= percent * |A or B|."""
    t = lambda c, v: texts.select(F.col("node").alias(c), F.col("text").alias(v))
    both = pairs.join(t("a", "ta").hint("merge"), "a").join(t("b", "tb").hint("merge"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                p = batch.slice(lo, 1000)
                keep = []
                for x, y in zip(W.shingle_sets(p.column(2), size), W.shingle_sets(p.column(3), size), strict=True):
                    n = len(x) + len(y)
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        keep.append(False)
                        continue
                    z = np.sort(np.concatenate([x, y]))
                    inter = int(np.count_nonzero(z[1:] == z[:-1]))
                    keep.append(100 * inter >= percent * (n - inter))
                yield p.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return ship(both).mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node that has a link."""
    n = links.count()
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", n)
    last = None
    while True:
        # large star: neighbours above u link to the least of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least", n)
        large = cut(both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large", n)
        # small star: neighbours below u, and u, link to the least of them
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low", n)
        moved = large.join(low.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small", n)
        now = new.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        drop(edges, least, large, low)
        edges = new
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def joined(label: DataFrame | None, new: DataFrame, rows: int) -> DataFrame:
    """Labels after new links: only the labels that the links join are contracted again."""
    if label is None:
        return cut(components(new), "labels", rows)
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")).hint("merge")
    edges = new.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    up = cut(components(edges.filter("a <> b").distinct()), "joined", rows)
    moved = label.join(up.select(F.col("node").alias("label"), F.col("label").alias("to")).hint("merge"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return cut(moved.unionByName(up.join(label.select("node").hint("merge"), "node", "left_anti").select("node", "label")), "labels", rows)


def rest(own: DataFrame, texts: DataFrame, size: int, percent: int, rows: int) -> DataFrame:
    """Pairs (a, b) of different labels among the nodes of buckets that hold several labels,
    from rows (bucket, node, size, label): all that can be links, by prefix filtering.

    Sets are put in one order, rare shingles first.  Of two linked sets x and y, x not the
    larger, with at least ``need`` common shingles, the first of these is among the first
    |x| - need + 1 of x and |y| - need + 1 of y; what follows it must suffice for the others.
    Shingles that only one set has link nothing and are not even shuffled back."""
    of = lambda c: F.ceil(F.lit(percent) * c / 100).cast("int")  # noqa: E731  least overlap for any partner
    both = lambda c: F.ceil(F.lit(percent) * c / (100 + percent)).cast("int")  # noqa: E731  c: the sum of both sizes
    several = own.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    who = cut(own.join(cut(several, "several", rows).hint("merge"), "bucket").select("node", "size", "label").distinct(), "open", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                sets = list(W.shingle_sets(b.column(1), size))
                at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                h = np.concatenate(sets).view(np.int64)
                for k in range(0, len(h), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 100_000]), b.column(0).take(at.slice(k, 100_000))], names=["h", "node"])

    every = cut(ship(texts.join(who.select("node").hint("merge"), "node").select("node", "text")).mapInArrow(run, "h bigint, node binary"), "shingles")
    often = cut(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "often")
    found = cut(every.join(often.hint("merge"), "h"), "common")
    node = Window.partitionBy("node")
    found = found.withColumn("k", F.row_number().over(node.orderBy("n", "h"))).withColumn("own", F.count(F.lit(1)).over(node))
    # at: how many shingles of the set come before this one
    found = found.join(who.hint("merge"), "node").withColumn("at", (F.col("size") - F.col("own") + F.col("k") - 1).cast("int"))
    found = cut(found.filter(F.col("at") <= F.col("size") - of(F.col("size"))).select("h", "node", "size", "label", "at"), "prefixes")
    x = found.filter(F.col("at") <= F.col("size") - both(2 * F.col("size"))).select("h", *(F.col(c).alias(f"{c}_x") for c in ("node", "size", "label", "at")))
    need = both(F.col("size") + F.col("size_x"))
    order = (F.col("size_x") < F.col("size")) | ((F.col("size_x") == F.col("size")) & (F.col("node_x") < F.col("node")))
    fits = (100 * F.col("size_x") >= percent * F.col("size")) & (F.least(F.col("size_x") - F.col("at_x"), F.col("size") - F.col("at")) >= need)
    pairs = x.join(found.hint("merge"), "h").filter((F.col("label_x") != F.col("label")) & order & fits)
    return pairs.select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every input row (and tkey, the text's key)."""
    since = mark()
    all_rows = cut(sketch(docs, id_col, text_col, size, bins, rows), "sketch")
    rows_ = all_rows.select("doc_id", "tkey", "n_shingles", "node")
    nodes = cut(all_rows.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "tkey")).alias("r"), F.min_by("bands", "tkey").alias("bands"), F.max("n_shingles").alias("size")), "nodes")
    # one row for each (bucket, node); only buckets with two nodes or more go on
    flat = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = cut(flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"), "buckets")
    members = cut(flat.join(shared.hint("merge"), "bucket"), "members")
    n_members = members.count()
    near = members.select("node").distinct()
    who = nodes.drop("bands", "size").join(near, "node").select("node", F.col("r.doc_id").alias("_id"), F.col("r.tkey").alias("_tkey"))
    data = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tkey"), F.col(text_col).alias("text"))
    texts = cut(data.join(cut(who, "who", n_members).hint("merge"), (F.col("tkey") == F.col("_tkey")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text"), "texts")
    if texts.count() > texts.select("node").distinct().count():  # repeated rows
        texts = cut(texts.groupBy("node").agg(F.min("text").alias("text")), "texts1")

    def labelled(label: DataFrame | None) -> DataFrame:
        if label is None:
            return members.withColumn("label", F.col("node"))
        return cut(members.join(label.hint("merge"), "node", "left").select("bucket", "node", "size", F.coalesce("label", "node").alias("label")), "labelled", n_members)

    label, seen, step = None, None, 0
    while True:
        step += 1
        own = labelled(label)
        order = lambda c: F.xxhash64(c, F.lit(step))  # noqa: E731  the same in all buckets
        if label is None:
            per = own.select("bucket", "label", "node", F.lit(1).alias("n"))
        else:
            per = own.groupBy("bucket", "label").agg(F.min_by("node", order("node")).alias("node"), F.count(F.lit(1)).alias("n"))
        centre = per.groupBy("bucket").agg(F.max_by(F.struct("node", "label"), F.struct("n", order("label"))).alias("c"), F.count(F.lit(1)).alias("labels"))
        centre = cut(centre.filter("labels > 1").select("bucket", F.col("c.node").alias("c"), F.col("c.label").alias("cl")), "centres", n_members)
        pairs = own.join(centre.hint("merge"), "bucket").filter("label <> cl").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs", n_members)
        n_pairs = pairs.count()
        if not n_pairs:
            break
        seen = pairs if seen is None else seen.unionByName(pairs)
        new = cut(confirm(pairs, texts, size, percent), "links", n_pairs, 2000)
        n_new = new.count()
        if n_new:
            label = joined(label, new, n_members)
        if FEW * n_new < n_pairs:
            break
    if seen is not None:  # what no centre showed
        pairs = cut(rest(labelled(label), texts, size, percent, n_members).join(seen, ["a", "b"], "left_anti"), "pairs")
        n_pairs = pairs.count()
        new = cut(confirm(pairs, texts, size, percent), "links", n_pairs, 2000)
        if new.limit(1).count():
            label = joined(label, new, n_members)
    return _result(rows_, label, since)


def _result(rows: DataFrame, label: DataFrame | None, since: int) -> DataFrame:
    if label is not None:
        rows = rows.join(label.hint("merge"), "node", "left").withColumn("group", F.coalesce("label", "node"))
    else:
        rows = rows.withColumn("group", F.col("node"))
    rows = cut(rows.select("doc_id", "tkey", "n_shingles", "group"), "grouped")
    first = cut(rows.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id")), "first")
    release(since, rows, first)
    linked = rows.filter("group is not null").join(first.hint("merge"), "group").select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "tkey")
    alone = rows.filter("group is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "tkey")
    return linked.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """The input's rows and columns without the members of a group but the one of least id."""
    since = mark()
    key, id_, tkey = (fresh(docs, n) for n in ("key", "id", "tkey"))
    gone = cut(near_duplicates(docs, id_col, text_col, size, percent).filter("not kept").select(F.col("doc_id").alias(id_), F.col("tkey").alias(tkey)).distinct(), "gone")
    release(since, gone)
    out = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return out.join(gone.hint("merge"), (F.col(key) == F.col(tkey)) & F.col(id_col).eqNullSafe(F.col(id_)), "left_anti").select(*docs.columns)
