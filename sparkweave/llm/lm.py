"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

log P(word | context) = log P(class | context) + log P(word | class).

* Classes (64): unknown words, the end of a text, the most frequent words one by one, and
  the rest by a hash of their last two bytes.
* P(class | context) is a softmax over hashed features of the two words before: the last
  one, the last but one (skip), and the pair (n-gram), plus a bias.  The bias starts at the
  classes' share of the training tokens; unknown words get the share of words seen once.
* P(word | class) is the word's smoothed share of its class, so V + 1 events sum to one.

Counting: texts are dealt to blocks; a block sends each of its words once, with its count.
Global counts come back only for words that other blocks have too and that are not among
the ``top`` most frequent ones (those are broadcast: at most ``top`` pairs).  A word that
half of all texts hold costs one row a block.

Training: each task runs mini-batch gradient steps over its own training texts from the
shared weights; the changes of all tasks are averaged by feature row, weighted by the
tokens each saw there, in a tree of bounded fan-in.  The weights have a fixed size
(8 MB), so what the driver holds does not grow.  Every training token is used.

Defined cases: null text is empty: one token, the end; no training rows: base and score are
those of an empty vocabulary (every token unknown, N = 0, V = 0: log10(0.5 / 0.5) = 0);
null ids hash as empty text; repeated rows are scored once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import cut, drop, ship

CLASSES, SINGLE, SUFFIX = 64, 24, 38
UNKNOWN, END, BOS = 0, np.uint64(0xE4D << 6 | 62), np.uint64(0xB05 << 6 | 62)
BITS1, BITS2, BITS3 = 13, 13, 14
ROWS = (1 << BITS1) + (1 << BITS2) + (1 << BITS3)
CHUNK = 1024


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of words and ends, offsets of each row).  The low six bits of an id hold the
    suffix class."""
    b = W.LOWER[data]
    h, start, end, woff = W.words(data, off)
    last = b[end - 1].astype(np.int64) if len(h) else np.zeros(0, np.int64)
    before = np.where(end - start > 1, b[np.maximum(end - 2, 0)] if len(h) else 0, 0).astype(np.int64)
    ids = (h & ~np.uint64(63)) | ((last * 31 + before * 17) % SUFFIX).astype(np.uint64)
    n = len(off) - 1
    count = np.diff(woff)
    toff = np.concatenate([[0], np.cumsum(count + 1)])
    out = np.full(toff[-1], END, dtype=np.uint64)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), count)] = ids
    return out, toff


def features(ids: np.ndarray, toff: np.ndarray) -> np.ndarray:
    """Rows of the weight table for each token, shape (3, n)."""
    p1 = np.concatenate([[BOS], ids[:-1]]).astype(np.uint64)
    p1[toff[:-1]] = BOS
    p2 = np.concatenate([[BOS], p1[:-1]]).astype(np.uint64)
    p2[toff[:-1]] = BOS
    a = p1 * np.uint64(0x9E3779B97F4A7C15)
    c = p2 * np.uint64(0xC2B2AE3D27D4EB4F)
    pair = W.mix(a ^ (c >> np.uint64(7)) ^ c)
    f1 = (W.mix(a) >> np.uint64(64 - BITS1)).astype(np.int32)
    f2 = (W.mix(c) >> np.uint64(64 - BITS2)).astype(np.int32) + (1 << BITS1)
    f3 = (pair >> np.uint64(64 - BITS3)).astype(np.int32) + (1 << BITS1) + (1 << BITS2)
    return np.stack([f1, f2, f3])


def classes(ids: np.ndarray, single: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Class of each known token: ``single`` (sorted ids of the frequent words), ``order``
    (their classes)."""
    out = (ids & np.uint64(63)).astype(np.int64) + 2 + SINGLE
    if len(single):
        at = np.minimum(np.searchsorted(single, ids), len(single) - 1)
        out = np.where(single[at] == ids, order[at], out)
    return np.where(ids == END, 1, out)


def class_logs(w: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = w[f[0]]
    z += w[f[1]]
    z += w[f[2]]
    z += bias
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def step(w: np.ndarray, bias: np.ndarray, f: np.ndarray, y: np.ndarray, rate: float, seen: np.ndarray) -> None:
    """One mini-batch gradient step in place."""
    g = np.exp(class_logs(w, bias, f))
    g[np.arange(len(y)), y] -= 1
    g[:, UNKNOWN] = 0
    for r in f:
        order = np.argsort(r, kind="stable")
        s = r[order]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        n = np.diff(np.append(head, len(s)))
        w[s[head]] -= (rate / np.sqrt(n))[:, None].astype(np.float32) * np.add.reduceat(g[order], head, axis=0)
        seen[s[head]] += n


class Model:
    def __init__(self, n_tokens: int, vocabulary: int, once: int, mass: np.ndarray, single: np.ndarray, order: np.ndarray, top_ids: np.ndarray, top_counts: np.ndarray):
        self.n, self.v = n_tokens, vocabulary
        self.total = n_tokens + 0.5 * (vocabulary + 1)
        self.mass, self.single, self.order = mass, single, order
        self.top_ids, self.top_counts = top_ids, top_counts
        share = np.maximum(mass, 1e-9) / self.total
        share[UNKNOWN] = max(once / n_tokens if n_tokens else 1.0, 0.5 / self.total)
        # a class without any word can't be drawn
        self.bias = np.where((mass > 0) | (np.arange(CLASSES) == UNKNOWN), np.log(share), -1e4).astype(np.float32)
        self.w = np.zeros((ROWS, CLASSES), dtype=np.float32)


def _blocks(docs: DataFrame, id_col: str, text_col: str, held_out: Column, block_bytes: int) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), held_out.alias("held_out"), F.pmod(F.xxhash64(text, F.col(id_col)), F.lit(n)).cast("int").alias("block"))


def _summed(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(ids, return_inverse=True)
    return u, np.bincount(inv, weights=counts, minlength=len(u)).astype(np.int64)


def _block_counts(text: pa.ChunkedArray, held: np.ndarray):
    """Parts of tokens, and the block's distinct ids with their training counts."""
    parts, ids, counts = [], [], []
    column = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    for first, data, off in W.parts(column):
        t, toff = tokens(data, off)
        own = np.repeat(~held[first : first + len(off) - 1], np.diff(toff))
        u, c = _summed(t, own)
        parts.append((first, t, toff))
        ids.append(u)
        counts.append(c)
    if not ids:
        return parts, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return parts, *_summed(np.concatenate(ids), np.concatenate(counts))


def fit(rows: DataFrame, counts: DataFrame, top: int, rate: float, batch: int, fan_in: int) -> tuple[Model, int]:
    """The trained model, and the count up to which words are not in its table."""
    spark = rows.sparkSession
    seen = counts.filter("c > 0")
    cl = F.col("id").bitwiseAND(F.lit(63))
    per = {r["k"]: r for r in seen.filter(F.col("id") != int(END)).groupBy(cl.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect()}
    ends = seen.filter(F.col("id") == int(END)).agg(F.sum("c")).first()[0] or 0
    best = seen.filter(F.col("id") != int(END)).orderBy(F.desc("c"), "id").limit(top + 1).collect()
    least = best[-1]["c"] if len(best) > top else 0
    kept = [(np.int64(r["id"]).view(np.uint64), r["c"]) for r in best if r["c"] > least] + ([(END, ends)] if ends else [])
    kept.sort()
    mass = np.zeros(CLASSES)
    for k, r in per.items():
        mass[2 + SINGLE + k] = r["c"] + 0.5 * r["v"]
    single = [(np.int64(r["id"]).view(np.uint64), r["c"]) for r in best[:SINGLE]]
    order = {}
    for k, (i, c) in enumerate(single):
        order[i] = 2 + k
        mass[2 + k] = c + 0.5
        mass[2 + SINGLE + int(i & np.uint64(63))] -= c + 0.5
    mass[1] = ends + 0.5 if ends else 0
    mass[np.abs(mass) < 1e-6] = 0
    ids = np.array(sorted(order), dtype=np.uint64)
    model = Model(
        int(sum(r["c"] for r in per.values()) + ends), int(sum(r["v"] for r in per.values()) + bool(ends)), int(sum(r["once"] for r in per.values())),
        mass, ids, np.array([order[i] for i in ids], dtype=np.int64), np.array([k[0] for k in kept], dtype=np.uint64), np.array([k[1] for k in kept], dtype=np.int64),
    )
    if not model.n:
        return model, least
    held = spark.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        w = m.w.copy()
        seen = np.zeros(ROWS, dtype=np.int64)
        part = 0
        for b in batches:
            part = b.column(1)[0].as_py() if b.num_rows else part
            for _, data, off in W.parts(b.column(0)):
                t, toff = tokens(data, off)
                f, y = features(t, toff), classes(t, m.single, m.order)
                for lo in range(0, len(t), batch):
                    step(w, m.bias, f[:, lo : lo + batch], y[lo : lo + batch], rate, seen)
        out = [(c, (w[c : c + CHUNK] - m.w[c : c + CHUNK]).astype(np.float16).tobytes(), seen[c : c + CHUNK].tobytes()) for c in range(0, ROWS, CHUNK) if seen[c : c + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([part // fan_in] * len(out), pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["chunk", "part", "delta", "seen"])

    def average(table: pa.Table) -> pa.Table:
        d, n = np.zeros((CHUNK, CLASSES)), np.zeros(CHUNK, dtype=np.int64)
        for x, s in zip(table.column("delta"), table.column("seen"), strict=True):
            s = np.frombuffer(s.as_py(), np.int64)
            d += np.frombuffer(x.as_py(), np.float16).reshape(CHUNK, CLASSES).astype(float) * s[:, None]
            n += s
        d /= np.maximum(n, 1)[:, None]
        return pa.table({"chunk": table.column("chunk")[:1], "part": pa.array([table.column("part")[0].as_py() // fan_in], pa.int32()), "delta": pa.array([d.astype(np.float16).tobytes()], pa.binary()), "seen": pa.array([n.tobytes()], pa.binary())})

    shape = "chunk int, part int, delta binary, seen binary"
    deltas = rows.filter("not held_out").select("text", F.spark_partition_id().alias("p")).mapInArrow(learn, shape)
    width = rows.rdd.getNumPartitions()
    while True:
        deltas = deltas.groupBy("chunk", "part").applyInArrow(average, shape)
        if width <= fan_in:
            break
        width = -(-width // fan_in)
    for r in deltas.collect():  # ROWS x CLASSES weights, whatever the input
        model.w[r["chunk"] : r["chunk"] + CHUNK] += np.frombuffer(r["delta"], np.float16).reshape(CHUNK, CLASSES)
    return model, least


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", top: int = 1 << 16, rate: float = 0.3, batch: int = 4096, fan_in: int = 64, block_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row;
    rows with ``held_out`` false are the training texts."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = ship(_blocks(docs, id_col, text_col, held_out, block_bytes))

    def count(table: pa.Table) -> pa.Table:
        _, ids, n = _block_counts(table.column("text"), np.asarray(table.column("held_out").to_pylist(), dtype=bool))
        return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(ids), pa.int32()), "id": pa.array(ids.view(np.int64)), "n": pa.array(n)})

    own = cut(rows.select("text", "held_out", "block").groupBy("block").applyInArrow(count, "block int, id bigint, n bigint"), "block_counts")
    counts = cut(own.groupBy("id").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("blocks")), "counts")
    model, least = fit(rows, counts, top, rate, batch, fan_in)
    held = docs.sparkSession.sparkContext.broadcast(model)
    # the other words that several blocks have: their counts go back to those blocks
    back = cut(own.select("block", "id").join(counts.filter((F.col("blocks") > 1) & (F.col("c") <= least)).select("id", "c"), "id").select("block", "id", "c"), "back")
    drop(own, counts)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        m = held.value
        n_rows = left.num_rows
        held_ = np.asarray(left.column("held_out").to_pylist(), dtype=bool)
        parts, ids, c = _block_counts(left.column("text"), held_)
        for k, v in ((m.top_ids, m.top_counts), _sorted(right)):
            if len(k) and len(ids):
                at = np.minimum(np.searchsorted(k, ids), len(k) - 1)
                c = np.where(k[at] == ids, v[at], c)
        base, total = np.zeros(n_rows), np.zeros(n_rows)
        n_tok, n_known = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
        log_base = np.log10((c + 0.5) / m.total)
        cls = np.where(c > 0, classes(ids, m.single, m.order), UNKNOWN)
        log_word = np.where(c > 0, np.log10((c + 0.5) / np.maximum(m.mass[cls], 0.5)), 0.0)
        for first, t, toff in parts:
            at = np.searchsorted(ids, t)
            f, y = features(t, toff), cls[at]
            lp = np.empty(len(t))
            for lo in range(0, len(t), batch):
                hi = min(lo + batch, len(t))
                lp[lo:hi] = class_logs(m.w, m.bias, f[:, lo:hi])[np.arange(hi - lo), y[lo:hi]]
            lp = lp / np.log(10) + log_word[at]
            own = slice(first, first + len(toff) - 1)
            base[own] = np.add.reduceat(log_base[at], toff[:-1])
            total[own] = np.add.reduceat(lp, toff[:-1])
            n_known[own] = np.add.reduceat((c[at] > 0).astype(np.int64), toff[:-1])
            n_tok[own] = np.diff(toff)
        return pa.table({"doc_id": left.column("doc_id"), "held_out": pa.array(held_), "n_tokens": pa.array(n_tok), "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(n_rows, m.n, np.int64)), "base_score": pa.array(base), "score": pa.array(total)})

    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(judge, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _sorted(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    k = right.column("id").to_numpy().view(np.uint64)
    order = np.argsort(k)
    return k[order], right.column("c").to_numpy()[order]
