"""Toxicity: maximum-scoring segments with extreme-value calibration.

1. Token evidence.  Words (letters only, lower case) are hashed to 2**``bits`` slots.  Slot
   counts are the training documents of each label that hold the word.  A word's score is
   its log-odds under a Dirichlet prior of mass ``prior`` split between the labels in
   proportion to their totals (an unseen word scores 0), minus ``drift``.
2. Segments.  All maximal scoring segments (Ruzzo and Tompa, linear time) of the whole text.
3. Extreme values.  The best segment of n clean words exceeds s with probability
   1 - exp(-K n exp(-lambda s)); lambda and K are the maximum-likelihood fit over clean
   training documents.  A segment is significant when lambda s > ln(K n); a document's
   evidence is the sum of those excesses.
4. A logistic curve through the logarithm of the evidence of training documents gives the score.  In steps
   3 and 4 a training document's own words are taken out of the counts first.

Bound of the fit (the only sample here): at most about ``max_train`` labelled documents,
chosen by hashed id; their ids are broadcast, their words summed on the executors.

Defined cases: null or empty text has no evidence and gets the score of that; repeated or
conflicting labels of an id: toxic if the mean is 0.5 or more; null labels are ignored; no
training rows or one label only: score 0.5 * (share of toxic rows) or 0; further columns of
the input are not carried here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import ship

CHUNK = 4096


def slots(column: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """The word slots of each row, in order."""
    for _, data, off in W.parts(column):
        h, _, _, woff = W.words(data, off, W.LETTERS)
        s = (h >> np.uint64(64 - bits)).astype(np.int64)
        for i in range(len(off) - 1):
            yield s[woff[i] : woff[i + 1]]


def segments(x: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end) of x.  Runs of words of one sign
    are joined first, so that the scan works on few items."""
    n = len(x)
    if not n:
        return []
    head = np.flatnonzero(np.concatenate([[True], (x[1:] > 0) != (x[:-1] > 0)]))
    total = np.add.reduceat(x, head)
    cum = np.cumsum(total)
    out: list[list[float]] = []  # first run, end run, cumulative before, cumulative at end
    for r in np.flatnonzero(total > 0).tolist():
        seg = [r, r + 1, cum[r] - total[r], cum[r]]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= seg[2]:
                j -= 1
            if j < 0 or out[j][3] >= seg[3]:
                out.append(seg)
                break
            seg = [out[j][0], seg[1], out[j][2], seg[3]]
            del out[j:]
    ends = np.append(head, n)
    return [(float(s[3] - s[2]), int(ends[s[0]]), int(ends[s[1]])) for s in out]


class Model:
    def __init__(self, bits: int, prior: float, drift: float, toxic: np.ndarray, clean: np.ndarray):
        self.bits, self.prior, self.drift = bits, prior, drift
        self.toxic, self.clean = toxic, clean
        self.n1, self.n0 = float(toxic.sum()), float(clean.sum())
        self.lam, self.k, self.a, self.b = 1.0, 1.0, 0.0, 0.0

    def odds(self, s: np.ndarray, own: int | None = None) -> np.ndarray:
        """Word scores; own: the label of the document, to leave it out of the counts."""
        if not self.n1 or not self.n0:
            return np.full(len(s), -self.drift)
        n1, n0 = self.toxic[s].astype(float), self.clean[s].astype(float)
        if own is not None:
            (n1 if own else n0)[:] -= 1
        r = self.n1 / (self.n1 + self.n0)
        return np.log((n1 + self.prior * r) / (n0 + self.prior * (1 - r))) - np.log(r / (1 - r)) - self.drift

    def evidence(self, n: int, scores: list[float]) -> float:
        least = np.log(max(self.k * max(n, 1), 1e-300))
        return float(sum(max(0.0, self.lam * s - least) for s in scores))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a + self.b * np.log1p(evidence))))


def fit_extremes(n: np.ndarray, m: np.ndarray) -> tuple[float, float]:
    """Maximum likelihood (lambda, K) of P(M <= m) = exp(-K n exp(-lambda m))."""
    if (m > 0).sum() < 10:  # too few to fit: as many segments a word as were seen, and one
        return 1.0, float(((m > 0).sum() + 1) / max(n.sum(), 1.0))
    def slope(lam: float) -> float:
        w = n * np.exp(-lam * (m - m.min()))
        return 1 / lam - m.mean() + (w * m).sum() / w.sum()
    lo, hi = 1e-3, 50.0
    for _ in range(80):
        mid = (lo * hi) ** 0.5
        lo, hi = (mid, hi) if slope(mid) > 0 else (lo, mid)
    lam = (lo * hi) ** 0.5
    return lam, float(len(n) / (n * np.exp(-lam * m)).sum())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton steps for P(y) = 1 / (1 + exp(-(a + b x))), b >= 0."""
    a, b = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - ridge * b])
        w = p * (1 - p) + 1e-9
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        d = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + d[0], max(0.0, b + d[1])
        if np.abs(d).max() < 1e-8:
            break
    return a, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 20, prior: float = 3.0, drift: float = 1.5, max_train: int = 100_000) -> Model:
    """The model of the labelled rows of ``docs``."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    count = known.count()
    if count > max_train:
        known = known.filter(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * max_train / count))
    # ids and labels of at most about max_train rows
    rows = ship(docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(known), F.col(id_col) == F.col("_id")).select("text", "y"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), dtype=np.int32)
        for b in batches:
            for s, y in zip(slots(b.column(0), bits), b.column(1).to_pylist(), strict=True):
                total[y][np.unique(s)] += 1
        chunk, idx, val = [], [], []
        for c in range(0, 1 << bits, CHUNK):
            part = total[:, c : c + CHUNK]
            at = np.flatnonzero(part.any(axis=0))
            if len(at):
                chunk.append(c)
                idx.append(at.astype(np.int16).tobytes())
                val.append(np.ascontiguousarray(part[:, at]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["chunk", "idx", "val"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((2, CHUNK), dtype=np.int32)
        for i, v in zip(table.column("idx").to_pylist(), table.column("val").to_pylist(), strict=True):
            at = np.frombuffer(i, np.int16).astype(np.int64)
            total[:, at] += np.frombuffer(v, np.int32).reshape(2, -1)
        at = np.flatnonzero(total.any(axis=0))
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "idx": pa.array([at.astype(np.int16).tobytes()], pa.binary()), "val": pa.array([np.ascontiguousarray(total[:, at]).tobytes()], pa.binary())})

    shape = "chunk int, idx binary, val binary"
    total = np.zeros((2, 1 << bits), dtype=np.int32)
    for r in rows.mapInArrow(count_words, shape).groupBy("chunk").applyInArrow(add, shape).collect():  # 2**bits slots at most
        at = np.frombuffer(r["idx"], np.int16).astype(np.int64) + r["chunk"]
        total[:, at] = np.frombuffer(r["val"], np.int32).reshape(2, -1)
    model = Model(bits, prior, drift, total[1], total[0])
    if not model.n1 or not model.n0:
        model.a = -50.0 if not model.n1 else 50.0
        return model
    held = docs.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            ns, ys, top = [], b.column(1).to_pylist(), []
            for s, y in zip(slots(b.column(0), bits), ys, strict=True):
                ns.append(len(s))
                top.append(max((x[0] for x in segments(m.odds(s, y))), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array(ns, pa.int32()), pa.array(ys, pa.int32()), pa.array(top, pa.float64())], names=["n", "y", "top"])

    seen = rows.mapInArrow(best, "n int, y int, top double").toPandas()  # max_train rows of three numbers
    clean = seen[(seen.y == 0) & (seen.n > 0)]
    model.lam, model.k = fit_extremes(clean.n.to_numpy(float), clean.top.to_numpy(float))
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fitted.value
        for b in batches:
            ys = b.column(1).to_pylist()
            ev = [m.evidence(len(s), [x[0] for x in segments(m.odds(s, y))]) for s, y in zip(slots(b.column(0), bits), ys, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ev, pa.float64())], names=["y", "evidence"])

    seen = rows.mapInArrow(weigh, "y int, evidence double").toPandas()  # max_train rows of two numbers
    model.a, model.b = fit_logistic(np.log1p(seen.evidence.to_numpy(float)), seen.y.to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, evidence, n_words and the significant ``segments`` (words
    first to end, score) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            ev, ns, found = [], [], []
            for s in slots(b.column(1), m.bits):
                all_ = segments(m.odds(s))
                least = np.log(max(m.k * max(len(s), 1), 1e-300))
                ev.append(m.evidence(len(s), [x[0] for x in all_]))
                ns.append(len(s))
                found.append([{"first": f, "end": e, "score": v} for v, f, e in all_ if m.lam * v > least])
            p = m.probability(np.array(ev, dtype=float))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array(ev, pa.float64()), pa.array(ns, pa.int32()), pa.array(found, kind)], names=["doc_id", "score", "predicted", "evidence", "n_words", "segments"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return ship(rows).mapInArrow(run, f"doc_id {id_type}, score double, predicted int, evidence double, n_words int, segments array<struct<first:int,end:int,score:double>>")
