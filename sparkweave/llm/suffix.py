"""Repeated-substring removal by a distributed, prefix-aware merge of suffix runs.

Every byte covered by a ``width``-byte string that starts anywhere else too is removed.

1. Sampling that loses nothing.  Each ``width``-byte window picks an *anchor*: the leftmost
   least hash among the ``gram``-byte strings inside it.  Equal windows pick the anchor at
   the same offset, so a window can only repeat if its anchor's string repeats.  The windows
   of one anchor occurrence are a run of starts; the bytes they span are its *chunk*.
   Anchors are counted over the corpus: one that occurs once is done; one whose chunk is the
   same at every occurrence has all its windows repeated; the others are open.  A chunk of
   an open anchor that occurs twice or more has all its windows repeated too; one block of
   documents, its owner, lends them to the sort on behalf of all.
2. Suffixes.  What is left, windows in chunks of open anchors that occur once, is sorted
   together with the lent ones, as suffixes cut at ``width`` bytes.  A suffix is spelled in
   letters of ``width / 4`` bytes, each letter the 64-bit hash of its bytes, so that order
   and common prefixes are counted in letters.  Each task sorts
   its suffixes, merges equal ones, and writes front-coded runs: the letters shared with the
   entry before are left out.  A run holds a suffix at most once, so a passage that a third
   of all documents share costs one entry a task.
3. Runs are exchanged by ranges of the first letter and combined in a loser tree that carries
   common-prefix lengths: letters known to be equal are never compared again.  A suffix met
   in two runs, or twice in one, is repeated.
4. Answers go back to the tasks that asked, and documents are cut.

Equality is that of 64-bit hashes of parts (four of them for an open window, a 64-bit chunk
hash and the anchor's for a closed one), not of bytes.

Beside it, passages by words: ``passage`` words, 50 if not said otherwise, are often fewer
than ``width`` bytes.  Of every run of so many words the least hash among its runs of
``passage * 3 // 5`` words is kept (winnowing), so two documents that share ``passage``
words share a kept run, and documents that share a kept run share that many words.
``n_passages`` counts a document's kept runs that other rows hold too.

Defined cases: null counts as empty (0 bytes, nothing removed); texts shorter than ``width``
stay whole; a repeated row is text that starts elsewhere too; overlapping repeats inside one
text count; an empty table gives an empty result; further columns are not carried here but
may be joined by the caller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import cut, drop, ship, tidy

LETTERS = 4
SEGMENT = 1 << 22


def window_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


class Text:
    """Prefix sums of one text: the hash of any span in a few operations."""

    def __init__(self, b: np.ndarray):
        n = len(b)
        self.n = n
        self.sum = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * W.powers(W.BASE, n), out=self.sum[1:])
        self.inv = W.powers(W._INV, n + 1)

    def span(self, lo, hi) -> np.ndarray:
        return W.mix((self.sum[hi] - self.sum[lo]) * self.inv[lo])

    def grams(self, k: int) -> np.ndarray:
        m = self.n - k + 1
        return W.mix((self.sum[k:] - self.sum[:m]) * self.inv[:m])


def anchors(b: np.ndarray, width: int, gram: int):
    """(anchor hash, chunk hash, first window, last window) of each anchor occurrence,
    and the Text.  Long texts are worked in segments that overlap by width - 1 bytes."""
    t = Text(b)
    key, chunk, first, last = [], [], [], []
    for at in range(0, t.n - width + 1, SEGMENT):
        end = min(t.n, at + SEGMENT + width - 1)
        s = Text(b[at:end]) if end - at < t.n else t
        g = s.grams(gram)
        low = np.uint64((1 << 23) - 1)
        sel = (window_least((g & ~low) | np.arange(len(g), dtype=np.uint64), width - gram + 1) & low).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], sel[1:] != sel[:-1]]))
        tail = np.concatenate([head[1:], [len(sel)]]) - 1
        a = sel[head]
        key.append(g[a])
        # the chunk's hash says where in it the anchor lies
        chunk.append(W.mix(s.span(head, tail + width) + (a - head).astype(np.uint64) * np.uint64(W.BASE) + (tail - head).astype(np.uint64)))
        first.append(head + at)
        last.append(tail + at)
    if not key:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), z, z, t
    return np.concatenate(key), np.concatenate(chunk), np.concatenate(first), np.concatenate(last), t


def letters(t: Text, starts: np.ndarray, width: int) -> np.ndarray:
    edge = np.linspace(0, width, LETTERS + 1).astype(np.int64)
    return np.stack([t.span(starts + edge[i], starts + edge[i + 1]) for i in range(LETTERS)], axis=1) if len(starts) else np.zeros((0, LETTERS), np.uint64)


def sort_suffixes(x: np.ndarray):
    """(order, common prefix with the entry before) of rows of letters."""
    order = np.lexsort(tuple(x[:, i] for i in reversed(range(x.shape[1])))) if len(x) else np.zeros(0, np.int64)
    y = x[order]
    lcp = np.zeros(len(y), dtype=np.int64)
    if len(y) > 1:
        same = np.cumprod(y[1:] == y[:-1], axis=1)
        lcp[1:] = same.sum(axis=1)
    return order, lcp


def front_code(y: np.ndarray, lcp: np.ndarray) -> bytes:
    """The letters after the common prefix, entry after entry."""
    return y[np.arange(y.shape[1]) >= lcp[:, None]].tobytes()


def front_decode(lcp: np.ndarray, rest: bytes) -> np.ndarray:
    y = np.zeros((len(lcp), LETTERS), dtype=np.uint64)
    own = np.arange(LETTERS) >= lcp[:, None]
    y[own] = np.frombuffer(rest, dtype=np.uint64)
    last = np.maximum.accumulate(np.where(own, np.arange(len(lcp))[:, None], 0), axis=0)
    return np.take_along_axis(y, last, axis=0)


def merge_runs(runs: list[tuple[np.ndarray, bytes, np.ndarray]]) -> list[np.ndarray]:
    """Loser tree over front-coded runs (lcp, rest, times); for each run, which entries are
    repeated.  ``h`` of a player is its common prefix with the last winner; players with
    unequal h are ordered by it alone, letters are compared from h on."""
    seqs, lcps = [], []
    for lcp, rest, _ in runs:
        seqs.append([tuple(r) for r in front_decode(lcp, rest).tolist()])
        lcps.append(lcp.tolist())
    out = [np.asarray(times) > 1 for _, _, times in runs]
    k = 1
    while k < len(runs):
        k *= 2
    at, h = [0] * k, [0] * k
    live = [i < len(runs) and len(seqs[i]) > 0 for i in range(k)]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's h becomes its common prefix with the winner."""
        if not live[a]:
            return b, a
        if not live[b]:
            return a, b
        if h[a] != h[b]:
            return (a, b) if h[a] > h[b] else (b, a)
        x, y = seqs[a][at[a]], seqs[b][at[b]]
        n = h[a]
        while n < LETTERS and x[n] == y[n]:
            n += 1
        if n == LETTERS or x[n] < y[n]:
            h[b] = n
            return a, b
        h[a] = n
        return b, a

    tree = [0] * k
    win = list(range(k))
    while len(win) > 1:
        half = len(win) // 2
        nxt = []
        for i in range(half):
            w, l = play(win[2 * i], win[2 * i + 1])
            tree[half + i] = l
            nxt.append(w)
        win = nxt
    top, last = win[0], None
    while live[top]:
        p = at[top]
        if last is not None and h[top] == LETTERS:
            out[top][p] = True
            out[last[0]][last[1]] = True
        last = (top, p)
        at[top] = p + 1
        if p + 1 < len(seqs[top]):
            h[top] = lcps[top][p + 1]
        else:
            live[top] = False
        node = (k + top) // 2
        w = top
        while node >= 1:
            w, l = play(w, tree[node])
            tree[node] = l
            node //= 2
        top = w
    return out


def merged_spans(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (first byte, end) of the union of spans."""
    if not len(first):
        return first, end
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    head = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    tail = np.concatenate([head[1:], [len(first)]]) - 1
    return first[head], end[tail]


def expand(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers of the ranges first..last."""
    n = last - first + 1
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def found_in(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def passages(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the kept runs of words of each row, each once."""
    gram = words * 3 // 5
    span = words - gram + 1
    low = np.uint64((1 << 26) - 1)
    keys, rows = [], []
    for first, data, off in W.parts(column, 1 << 20):  # small parts: a worker's memory follows their size
        h, _, _, woff = W.words(data, off)
        n = len(h) - gram + 1
        if n < span:
            continue
        at = np.arange(n)
        g = W.mix(W.span_hash(h, at, at + gram))
        own = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
        whole = own[: n - span + 1] == own[words - 1 : words + n - span]  # windows inside one row
        head = np.flatnonzero(whole)
        kept = (window_least((g & ~low) | at.astype(np.uint64), span)[head] & low).astype(np.int64)
        new = np.concatenate([[True], kept[1:] != kept[:-1]]) if len(kept) else np.zeros(0, bool)
        kept, row = kept[new], own[head[new]]
        order = np.lexsort((g[kept], row))
        k, r = g[kept][order], row[order]
        once = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]) if len(k) else np.zeros(0, bool)
        keys.append(k[once])
        rows.append(r[once] + first)
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


RESULT = "n_passages bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<first:bigint,end:bigint>>, kept binary"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_RESULT = [("n_passages", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPANS), ("kept", pa.binary())]


def result(raw: bytes, first: np.ndarray, end: np.ndarray, keep_text: bool) -> dict:
    lo, hi = merged_spans(first, end)
    left, at = [], 0
    for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
        left.append(raw[at:x])
        at = y
    kept = b"".join([*left, raw[at:]])
    return {
        "n_bytes": len(raw), "n_removed": int((hi - lo).sum()), "n_spans": len(lo), "kept_sha256": hashlib.sha256(kept).hexdigest(),
        "spans": [{"first": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], "kept": kept if keep_text else None,
    }


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400, gram: int = 320, block_bytes: int = 8 << 20, slice_entries: int = 100_000, keep_text: bool = False, passage: int = 50) -> DataFrame:
    """doc_id, n_passages, n_bytes, n_removed, n_spans, kept_sha256, spans, kept (the remaining bytes if
    ``keep_text``, else null) for every row.  Spans are in bytes of the UTF-8 text."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    text = F.coalesce(F.col(text_col), F.lit(""))
    data = docs.select(F.col(id_col).alias("doc_id"), F.encode(text, "UTF-8").alias("b"), F.pmod(F.xxhash64(text, F.col(id_col)), F.lit(blocks)).cast("int").alias("block"))

    def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(1).to_numpy()
            ks, cs, bs = [], [], []
            for i, x in enumerate(batch.column(0)):
                b = np.frombuffer(x.as_py(), np.uint8)
                if len(b) >= width:
                    k, c, *_ = anchors(b, width, gram)
                    ks.append(k)
                    cs.append(c)
                    bs.append(np.full(len(k), block[i], np.int32))
            if ks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks).view(np.int64)), pa.array(np.concatenate(cs).view(np.int64)), pa.array(np.concatenate(bs))], names=["k", "c", "block"])

    def count_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, row = passages(batch.column(0), passage)
            block = batch.column(1).to_numpy()[row]
            order = np.lexsort((f, block))
            f, block = f[order], block[order]
            head = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (block[1:] != block[:-1])])) if len(f) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(f[head].view(np.int64)), pa.array(block[head]), pa.array(np.diff(np.append(head, len(f))))], names=["f", "block", "n"])

    # rows that hold a run: one row a batch and block on the way, whatever the run's frequency
    runs_of = cut(ship(data.select("b", "block")).mapInArrow(count_passages, "f bigint, block int, n bigint"), "passages")
    twice = runs_of.groupBy("f").agg(F.sum("n").alias("n")).filter("n > 1").select("f")
    shared = cut(runs_of.select("f", "block").distinct().join(twice.hint("merge"), "f"), "shared")
    drop(runs_of)
    tidy(spark)
    found = ship(data.select("b", "block")).mapInArrow(count_anchors, "k bigint, c bigint, block int")
    state = cut(found.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("n > 1").select("k", (F.col("c0") != F.col("c1")).alias("open")), "state")
    tidy(spark)
    hits = cut(found.join(state.hint("merge"), "k"), "hits")
    drop(state)
    tidy(spark)
    open_ = hits.filter("open").select("block", "k", "c")
    chunks = cut(open_.groupBy("k", "c").agg((F.count(F.lit(1)) > 1).alias("repeats"), F.min("block").alias("owner")), "chunks")
    no = F.lit(False)
    asked = open_.join(chunks.hint("merge"), ["k", "c"]).select("block", F.col("c").alias("key"), F.lit(True).alias("open"), "repeats", (F.col("owner") == F.col("block")).alias("lend"), no.alias("passage"))
    asked = asked.unionByName(hits.filter("not open").select("block", F.col("k").alias("key"), no.alias("open"), F.lit(True).alias("repeats"), no.alias("lend"), no.alias("passage")))
    asked = cut(asked.unionByName(shared.select("block", F.col("f").alias("key"), no.alias("open"), F.lit(True).alias("repeats"), no.alias("lend"), F.lit(True).alias("passage"))), "asked")
    drop(shared)
    n_sent = chunks.count() * (width - gram + 1) // 2
    bits = max(4, min(24, (n_sent // slice_entries).bit_length()))
    drop(hits, chunks)
    tidy(spark)

    def judge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Results of the documents without open windows; text, settled spans and open
        windows of the others; the block's sorted run of suffixes, in slices."""
        block = int(key[0].as_py())
        keys = right.column("key").to_numpy().view(np.uint64)
        flag = [np.asarray(right.column(c).to_pylist(), dtype=bool) for c in ("open", "repeats", "lend", "passage")]
        held, which = passages(left.column("b"), passage)
        n_passages = np.bincount(which[np.isin(held, keys[flag[3]])], minlength=left.num_rows).tolist()
        keys, flag = keys[~flag[3]], [f[~flag[3]] for f in flag]
        closed = np.unique(keys[~flag[0]])
        chunk, at = np.unique(keys[flag[0]], return_index=True)
        repeats, lend = flag[1][flag[0]][at], flag[2][flag[0]][at]
        lent: set[int] = set()
        out, xs, weights, pending, n_x = [], [], [], [], 0
        for did, x, n_own in zip(left.column("doc_id"), left.column("b"), n_passages, strict=True):
            raw = x.as_py()
            b = np.frombuffer(raw, np.uint8)
            lo = hi = p0 = p1 = np.zeros(0, np.int64)
            if len(b) >= width and len(keys):
                a, c, first, last, t = anchors(b, width, gram)
                settled = found_in(closed, a)
                i = np.minimum(np.searchsorted(chunk, c), max(len(chunk) - 1, 0))
                is_open = chunk[i] == c if len(chunk) else np.zeros(len(c), bool)
                if len(chunk):
                    settled |= is_open & repeats[i]
                    wait = is_open & ~repeats[i]
                    p0, p1 = first[wait], last[wait]
                    for j in np.flatnonzero(is_open & repeats[i] & lend[i]).tolist():
                        if int(c[j]) not in lent:
                            lent.add(int(c[j]))
                            xs.append(letters(t, np.arange(first[j], last[j] + 1), width))
                            weights.append(np.full(last[j] - first[j] + 1, 2, np.int64))
                            n_x += len(weights[-1])
                lo, hi = first[settled], last[settled] + width
            if len(p0):
                starts = expand(p0, p1)
                pending.append((did.as_py(), n_own, raw, lo, hi, p0, p1, n_x, len(starts)))
                xs.append(letters(t, starts, width))
                weights.append(np.ones(len(starts), np.int64))
                n_x += len(starts)
            else:
                out.append({"kind": "final", "doc_id": did.as_py(), "n_passages": n_own, **result(raw, lo, hi, keep_text)})
        if xs:
            x = np.concatenate(xs)
            order, lcp = sort_suffixes(x)
            new = lcp < LETTERS
            rank = np.empty(len(x), np.int32)
            rank[order] = np.cumsum(new) - 1
            y, lcp = x[order][new], lcp[new]
            times = np.minimum(np.bincount(rank, weights=np.concatenate(weights)), 2).astype(np.uint8)
            for did, n_own, raw, lo, hi, p0, p1, at, n in pending:
                out.append({"kind": "doc", "doc_id": did, "n_passages": n_own, "block": block, "b": raw, "lo": lo.tobytes(), "hi": hi.tobytes(), "p0": p0.tobytes(), "p1": p1.tobytes(), "ranks": rank[at : at + n].tobytes()})
            of = (y[:, 0] >> np.uint64(64 - bits)).astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(of)], strict=True):
                own = lcp[lo:hi].copy()
                own[0] = 0
                out.append({"kind": "run", "block": block, "slice": int(of[lo]), "base": lo, "lcp": own.astype(np.uint8).tobytes(), "rest": front_code(y[lo:hi], own), "times": times[lo:hi].tobytes()})
        types = [("kind", pa.string()), ("doc_id", left.column("doc_id").type), *_RESULT, ("block", pa.int32()), *((n, pa.binary()) for n in ("b", "lo", "hi", "p0", "p1", "ranks")), ("slice", pa.int64()), ("base", pa.int64()), *((n, pa.binary()) for n in ("lcp", "rest", "times"))]
        return pa.table({n: pa.array([r.get(n) for r in out], t) for n, t in types})

    schema = f"kind string, doc_id {id_type}, {RESULT}, block int, b binary, lo binary, hi binary, p0 binary, p1 binary, ranks binary, slice bigint, base bigint, lcp binary, rest binary, times binary"
    judged = cut(ship(data).groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(judge, schema), "judged")
    drop(asked)
    tidy(spark)

    def combine(table: pa.Table) -> pa.Table:
        lcp, rest, times, base = (table.column(c).to_pylist() for c in ("lcp", "rest", "times", "base"))
        hits = merge_runs([(np.frombuffer(p, np.uint8).astype(np.int64), r, np.frombuffer(t, np.uint8)) for p, r, t in zip(lcp, rest, times, strict=True)])
        return pa.table({"block": table.column("block"), "ranks": pa.array([(np.flatnonzero(h) + b).tobytes() for h, b in zip(hits, base, strict=True)], pa.binary())})

    runs = judged.filter("kind = 'run'").select("slice", "block", "base", "lcp", "rest", "times")
    repeated = cut(runs.groupBy("slice").applyInArrow(combine, "block int, ranks binary"), "repeated")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [np.frombuffer(x, np.int64) for x in right.column("ranks").to_pylist()]
        top = max([int(x.max()) for x in got if len(x)], default=-1)
        yes = np.zeros(top + 2, dtype=bool)  # the last one stands for all ranks above
        for x in got:
            yes[x] = True
        out = []
        for did, n_own, raw, *spans in zip(*(left.column(c).to_pylist() for c in ("doc_id", "n_passages", "b", "lo", "hi", "p0", "p1", "ranks")), strict=True):
            lo, hi, p0, p1 = (np.frombuffer(x, np.int64) for x in spans[:4])
            more = expand(p0, p1)[yes[np.minimum(np.frombuffer(spans[4], np.int32), top + 1)]]
            out.append({"doc_id": did, "n_passages": n_own, **result(raw, np.concatenate([lo, more]), np.concatenate([hi, more + width]), keep_text)})
        return pa.table({n: pa.array([r[n] for r in out], t) for n, t in [("doc_id", left.column("doc_id").type), *_RESULT]})

    rows = judged.filter("kind = 'doc'").select("block", "doc_id", "n_passages", "b", "lo", "hi", "p0", "p1", "ranks")
    late = rows.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(finish, f"doc_id {id_type}, {RESULT}")
    return judged.filter("kind = 'final'").select(*late.columns).unionByName(late)
