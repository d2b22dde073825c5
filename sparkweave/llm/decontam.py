"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

Texts and items are folded (lower case, letters and digits, single spaces).  A passage of a
document is a leak of an item of L bytes when its edit distance to the item is at most
k = ratio * L.

1. Prefilter.  k edits leave at least L // piece - k of the item's disjoint pieces intact
   (8 bytes; 5 for items under 32 bytes, so that one stays at least), all within k of one
   alignment.  Only item-sized windows that hold so many go on: nothing within k edits is
   lost.
2. CGK: ``walks`` random walks shared by both sides turn each window and item into strings
   of 3L symbols whose Hamming distance follows the edit distance.
3. Bit sampling: in each walk, again and again ``bits`` positions of the embedding are
   hashed.  The items' samples are filed in one table a walk, under repetition, length and
   hash; a window looks its own samples up there, and whatever items it finds are its
   candidates.  The number of repetitions follows from the target recall at ``distance``,
   the share of unequal symbols that k edits give in the median walk (measured 0.51); the
   other walks make up for an unlucky one.
4. Candidates are confirmed exactly by a bit-parallel semi-global edit distance.

Map-only over documents.  Items are shipped in blocks of at most ``block_items`` items, one
pass a block, so what is broadcast at a time does not grow with the benchmark.

Defined cases: null or empty texts hold no leak; items without letters or digits match
nothing; items of at most 8 folded bytes match where they stand as whole words, unchanged;
repeated items are all reported; item ids are of any type; an empty benchmark leaves every
document clean; further columns stay (one named as ``out_col`` is replaced).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import words as W
from .common import ship

PIECE, SHORT_PIECE, SHORT, WORD = 8, 5, 32, 8
_KEEP = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def fold(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_KEEP).split())


def limit(n: int, ratio: float, piece: int = PIECE) -> int:
    """Most edits of a leak of an item of n bytes."""
    return min(int(ratio * n), n // piece - 1)


def grams(b: np.ndarray, size: int = PIECE) -> np.ndarray:
    """The ``size`` bytes from each position as one integer."""
    n = len(b) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        g |= b[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    return g


def edit_distance_within(item: bytes, region: bytes) -> tuple[int, int]:
    """(least edit distance of the item to a substring of the region, its end)."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(region):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


def cgk(b: np.ndarray, start: np.ndarray, length: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """Embeddings of b[start:start+length], one row each; 0 pads."""
    walk = np.random.default_rng(seed).integers(0, 2, size=(steps, 256), dtype=np.int8)
    i = np.zeros(len(start), dtype=np.int64)
    out = np.zeros((len(start), steps), dtype=np.uint8)
    last = max(len(b) - 1, 0)
    for t in range(steps):
        c = np.where(i < length, b[np.minimum(start + i, last)], 0).astype(np.uint8)
        out[:, t] = c
        i += walk[t][c]
    return out


def samples(emb: np.ndarray, length: np.ndarray, reps: int, bits: int, seed: int) -> np.ndarray:
    """One hash for each repetition: ``bits`` positions of the first 2 * length symbols."""
    u = np.random.default_rng(seed + 1).random((reps, bits))
    mul = np.random.default_rng(seed + 2).integers(1, 1 << 62, size=bits, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(emb), reps), dtype=np.uint64)
    rows = np.arange(len(emb))
    for r in range(reps):
        for k in range(bits):
            out[:, r] += (emb[rows, (u[r, k] * 2 * length).astype(np.int64)].astype(np.uint64) + np.uint64(1)) * mul[k]
    return out


def repetitions(recall: float, bits: int, distance: float) -> int:
    """Samplings after which a pair at this share of unequal symbols is found with
    probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - distance) ** bits)))


@dataclass
class Index:
    """One block of benchmark items of one piece size, ready for lookups."""

    ids: list
    items: list[bytes]
    ratio: float
    recall: float
    bits: int
    seed: int
    walks: int = 6
    distance: float = 0.55
    piece: int = PIECE

    def __post_init__(self):
        self.length = np.array([len(t) for t in self.items], dtype=np.int64)
        self.k = np.array([limit(len(t), self.ratio, self.piece) for t in self.items], dtype=np.int64)
        self.need = self.length // self.piece - self.k
        keys, item, at = [], [], []
        for i, t in enumerate(self.items):
            g = grams(np.frombuffer(t, np.uint8), self.piece)[:: self.piece]
            keys.append(g)
            item += [i] * len(g)
            at += range(0, self.piece * len(g), self.piece)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.at = keys[order], np.array(item, np.int64)[order], np.array(at, np.int64)[order]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self._slot(self.keys)] = True
        self.reps = repetitions(self.recall, self.bits, self.distance)
        b = np.frombuffer(b"".join(self.items) + b" ", np.uint8)
        start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64) if len(self.items) else np.zeros(0, np.int64)
        self.steps = 3 * int(self.length.max(initial=1))
        # the buckets of a walk, sorted: (repetition, length, sample) as one key, and the item
        self.buckets = []
        for w in range(self.walks):
            key = self.filed(self.sketch(b, start, self.length, self.length, w), self.length)
            order = np.argsort(key, kind="stable")
            self.buckets.append((key[order], np.repeat(np.arange(len(self.items)), self.reps)[order]))

    def filed(self, sample: np.ndarray, length: np.ndarray) -> np.ndarray:
        rep = np.arange(self.reps, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return W.mix(sample + rep[None, :] + W.mix(length.astype(np.uint64))[:, None]).ravel()

    def candidates(self, b: np.ndarray, start: np.ndarray, length: np.ndarray, nominal: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all that share a bucket in this walk."""
        keys, of = self.buckets[walk]
        own = self.filed(self.sketch(b, start, length, nominal, walk), nominal)
        lo = np.searchsorted(keys, own, "left")
        n = np.searchsorted(keys, own, "right") - lo
        hit = np.flatnonzero(n)
        lo, n = lo[hit], n[hit]
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.unique(np.repeat(hit // self.reps, n) * len(self.items) + of[at])
        return pair // max(len(self.items), 1), pair % max(len(self.items), 1)

    def sketch(self, b, start, length, nominal, walk: int) -> np.ndarray:
        seed = self.seed + 1000 * walk
        return samples(cgk(b, start, length, self.steps, seed), nominal, self.reps, self.bits, seed)

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def windows(self, b: np.ndarray, doc_off: np.ndarray):
        """(document, item, start) of the windows that hold enough pieces."""
        g = grams(b, self.piece)
        pos = np.flatnonzero(self.maybe[self._slot(g)]) if len(self.keys) else np.zeros(0, np.int64)
        lo = np.searchsorted(self.keys, g[pos], "left")
        n = np.searchsorted(self.keys, g[pos], "right") - lo
        pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos = np.repeat(pos, n)
        doc = np.searchsorted(doc_off, pos, "right") - 1
        item, start = self.item[which], pos - self.at[which]
        order = np.lexsort((start, item, doc))
        doc, item, start = doc[order], item[order], start[order]
        # pieces of one alignment lie within 2 k of each other: compare with the need-th one on
        m = len(doc)
        ahead = np.arange(m) + self.need[item] - 1
        at = np.minimum(ahead, max(m - 1, 0))
        ok = (ahead < m) & (doc[at] == doc) & (item[at] == item) & (start[at] - start <= 2 * self.k[item]) if m else np.zeros(0, bool)
        return doc[ok], item[ok], start[ok]

    def leaks(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each text the (item, start, end, distance) of its leaks, best one an item."""
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        b = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        doc, item, start = self.windows(b, off)
        if not len(doc):
            return found
        # several aligned starts of one (document, item): keep one of each run of near starts, with its middle
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > self.k[item[1:]] + 1)])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(doc)]]) - 1
        tries = np.concatenate([head, (head + tail) // 2, tail])
        own = np.tile(np.arange(len(head)), 3)
        s0 = np.maximum(start[tries], off[doc[tries]])
        length = np.minimum(self.length[item[tries]], off[doc[tries] + 1] - 1 - s0)
        named, seen, done = item[head], set(), np.zeros(len(head), dtype=bool)
        for w in range(self.walks):
            todo = np.flatnonzero(~done[own])
            window, other = self.candidates(b, s0[todo], length[todo], self.length[item[tries[todo]]], w)
            for c, i in zip(own[todo[window]].tolist(), other.tolist(), strict=True):
                if (c, i) in seen:
                    continue
                seen.add((c, i))
                h, t = head[c], tail[c]
                d, k = int(doc[h]), int(self.k[i])
                base, slack = int(off[d]), 2 * k
                lo = max(0, int(start[h]) - base - slack)
                region = texts[d][lo : int(start[t]) - base + len(self.items[i]) + slack]
                dist, end = edit_distance_within(self.items[i], region)
                if dist <= k:
                    found[d].append((i, max(0, lo + end - len(self.items[i])), lo + end, dist))
                    done[c] |= i == named[c]
        return [best_of(f) for f in found]


def best_of(leaks: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The first of least distance of each item."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for x in leaks:
        if x[0] not in best or (x[3], x[1]) < (best[x[0]][3], best[x[0]][1]):
            best[x[0]] = x
    return [best[i] for i in sorted(best)]


class Words:
    """Items of at most 8 bytes: they match where they stand as whole words."""

    def __init__(self, ids: list, items: list[bytes]):
        self.ids = ids
        self.by: dict[int, dict[int, list[int]]] = {}
        for i, t in enumerate(items):
            key = int(grams(np.frombuffer(t, np.uint8), len(t))[0])
            self.by.setdefault(len(t), {}).setdefault(key, []).append(i)

    def leaks(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        b = np.frombuffer(b"\x00" + b"\x00".join(texts) + b"\x00", np.uint8)
        off = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        edge = (b == 32) | (b == 0)
        for n, items in self.by.items():
            at = np.flatnonzero(edge[: -n - 1] & edge[n + 1 :]) + 1
            g = grams(b, n)[at]
            at = at[np.isin(g, np.fromiter(items, np.uint64, len(items)))]
            for p in at.tolist():
                d = int(np.searchsorted(off, p, "right")) - 1
                for i in items[int(grams(b[p : p + n], n)[0])]:
                    found[d].append((i, p - int(off[d]), p - int(off[d]) + n, 0))
        return [best_of(f) for f in found]


class Block:
    """A block of items: long ones, short ones and words, each with an index of its own."""

    def __init__(self, ids: list, items: list[bytes], ratio: float, recall: float, bits: int, seed: int):
        of = lambda f: [i for i, t in enumerate(items) if f(len(t))]
        self.parts = []
        for at, piece in ((of(lambda n: n >= SHORT), PIECE), (of(lambda n: WORD < n < SHORT), SHORT_PIECE)):
            if at:
                self.parts.append((at, Index(at, [items[i] for i in at], ratio, recall, bits, seed, piece=piece)))
        at = of(lambda n: 0 < n <= WORD)
        if at:
            self.parts.append((at, Words(at, [items[i] for i in at])))
        self.ids = ids

    def leaks(self, texts: list[bytes]) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in texts]
        for at, part in self.parts:
            for d, f in enumerate(part.leaks(texts)):
                out[d] += [(at[i], *rest) for i, *rest in f]
        return [[(self.ids[i], *rest) for i, *rest in sorted(f)] for f in out]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", ratio: float = 0.1, recall: float = 0.999, bits: int = 3, seed: int = 5, block_items: int = 20000, out_col: str = "leaks",
) -> DataFrame:
    """``docs`` with a column ``leaks``: item, span in the folded text, edit distance."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != out_col]
    leak = T.StructType([T.StructField("item_id", benchmark.schema[item_col].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("distance", T.IntegerType())])
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out_col, T.ArrayType(leak))])
    out = docs.select(*kept)
    ordered = benchmark.select(F.col(item_col).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    n_blocks = max(1, -(-benchmark.count() // block_items))
    for k in range(n_blocks):
        block = ordered.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == k) if n_blocks > 1 else ordered
        rows = sorted(((r["i"], r["t"]) for r in block.collect()), key=lambda x: (x[0] is None, str(type(x[0])), x[0] if isinstance(x[0], int | float | str) else str(x[0]), x[1]))
        held = spark.sparkContext.broadcast(([x.asDict(True) if hasattr(x := r[0], 'asDict') else x for r in rows], [fold(r[1]) for r in rows], ratio, recall, bits, seed))
        out = _pass(out, held, kept, text_col, schema, first=k == 0)
    return out


def _pass(docs: DataFrame, held, kept: list[str], text_col: str, schema: T.StructType, first: bool) -> DataFrame:
    arrow = to_arrow_type(schema[-1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            block = block or Block(*held.value)
            found = []
            texts, size = [], 0
            for x in batch.column(kept.index(text_col)):
                t = fold(x.as_py())
                texts.append(t)
                size += len(t)
                if size > 1 << 22:
                    found += block.leaks(texts)
                    texts, size = [], 0
            if texts:
                found += block.leaks(texts)
            rows = [[dict(zip(("item_id", "start", "end", "distance"), x, strict=True)) for x in f] for f in found]
            if not first:
                rows = [a + b for a, b in zip(batch.column(len(kept)).to_pylist(), rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(rows, arrow)], names=[*kept, schema[-1].name])

    return ship(docs).mapInArrow(run, schema)
