"""Language ID by compression.

A language is a zstandard raw-content dictionary: training texts of that language put end
to end.  Texts and dictionaries are folded to lower-case letters and single spaces; long
texts are compressed in pieces, each with the dictionary, and the sizes added.  A text goes
to the language whose dictionary compresses it to the fewest bytes.  Where the fast level
leaves two languages within ``NARROW`` of each other, all sizes are taken again at a
thorough level, which finds shorter matches; these sizes then decide.  A text is rejected
when the best and the second best are closer than ``margin`` (as a share of the best size)
or when it has no letter.

Bound of the fit (the only sample here): the ``docs_per_lang`` different training texts of
each language whose hashes are least, each clipped to ``max_doc_bytes`` characters,
``dict_bytes`` in all.  Copies count as one text.  The least hashes are found on the
executors, salted, so that no language is gathered; what reaches the driver is bounded by
those parameters for each language.  Prediction covers every row and its whole text,
map-only.

Defined cases: null text or no letter -> ``und``, score 0, rejected; one learned language
-> that language, score 1; ties -> the language with the most training texts; no training rows ->
``und`` for all; further columns pass through.  The result columns are named by ``names``;
input columns of these names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

LEVEL, THOROUGH = 3, 12
#: Bytes of a text that are compressed at a time: with the dictionary they fit the window.
PIECE = 1 << 19
#: Sizes closer than this are taken again at the thorough level.
NARROW = 0.1
SALT = 64

#: A-Z to lower case, every other ASCII byte that is no letter to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def fold(text: bytes) -> bytes:
    """Letters only, single spaces: markup, digits and case say nothing of the language."""
    return b" ".join(text.translate(_FOLD).split())


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 160, max_doc_bytes: int = 16384, dict_bytes: int = 1 << 18) -> dict[str, bytes]:
    """Language -> dictionary content, from the rows of ``train`` with text and language."""
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null and text <> ''")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    keyed = rows.withColumn("h", F.xxhash64("text", F.lit(7)))
    least = keyed.select("lang", "h").distinct().withColumn("salt", F.pmod("h", F.lit(SALT)))
    for keys in (("lang", "salt"), ("lang",)):  # at most SALT * docs_per_lang rows a language reach the second
        least = least.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("k") <= docs_per_lang)
    picked = keyed.join(F.broadcast(least.select("lang", "h")), ["lang", "h"])
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in picked.groupBy("lang", "h").agg(F.min(F.substring("text", 1, max_doc_bytes)).alias("text")).collect():
        texts.setdefault(r["lang"], []).append((r["h"], r["text"].encode()))
    out = {}
    for lang, own in sorted(texts.items()):
        kept, size = [], 0
        for _, t in sorted(own):
            if size + len(t) > dict_bytes and kept:
                continue
            kept.append(t)
            size += len(t)
        out[lang] = b" ".join(map(fold, reversed(kept)))
    return dict(sorted(out.items(), key=lambda x: (-counts[x[0]], x[0])))


class Model:
    """Sizes of texts under each dictionary; one compressor a language, level and process."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries
        self.langs = list(dictionaries)
        self._made = {}

    def __getstate__(self):
        return self.dictionaries

    def __setstate__(self, state):
        self.__init__(state)

    def sizes(self, text: bytes, level: int = LEVEL) -> np.ndarray:
        import zstandard

        if level not in self._made:
            params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_dict_id=False, window_log=20)
            self._made[level] = []
            for k in self.langs:
                d = zstandard.ZstdCompressionDict(self.dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                self._made[level].append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        pieces = [text[i : i + PIECE] for i in range(0, max(len(text), 1), PIECE)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self._made[level]], dtype=float)

    def judge(self, text: bytes) -> tuple[str, float, float]:
        """(language, score, margin).  The score is the share of the best language when
        each weighs 2**-(bits it needs for a chunk of 32 input bytes)."""
        if not self.langs:
            return "und", 0.0, 0.0
        text = fold(text)
        s = self.sizes(text)
        if len(s) > 1 and np.diff(np.partition(s, 1)[:2])[0] < NARROW * s.min():
            s = self.sizes(text, THOROUGH)
        best = int(np.argmin(s))
        rest = np.delete(s, best)
        margin = float((rest.min() - s[best]) / s[best]) if len(rest) else 1.0
        w = np.exp2(-np.minimum((s - s[best]) * 8 * 32 / max(len(text), 32), 500))
        return self.langs[best], float(1 / w.sum()), margin


NAMES = ("lang_pred", "score", "margin", "rejected")


def predict(docs: DataFrame, model: Model, text_col: str = "text", margin: float = 0.002, names: Sequence[str] = NAMES) -> DataFrame:
    """``docs`` with lang_pred, score, margin, rejected, or as ``names`` calls them."""
    mine = list(names)
    kept = [c for c in docs.columns if c not in mine]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in zip(mine, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True)])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            text = b.column(kept.index(text_col))
            letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_pylist()
            found = [m.judge(t) if ok else ("und", 0.0, 0.0) for t, ok in zip(text.cast(pa.binary() if not pa.types.is_large_string(text.type) else pa.large_binary()).to_pylist(), letter, strict=True)]
            lang = pa.array([f[0] for f in found], pa.string())
            gap = np.array([f[2] for f in found])
            bad = (gap < margin) | np.array([f[0] == "und" for f in found], dtype=bool)
            yield pa.RecordBatch.from_arrays([*b.columns, lang, pa.array([f[1] for f in found], pa.float64()), pa.array(gap, pa.float64()), pa.array(bad)], names=[*kept, *mine])

    return ship(docs.select(*kept)).mapInArrow(run, schema)

