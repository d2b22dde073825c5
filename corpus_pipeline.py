"""Corpus pipeline: language ID, exact dedup, MinHash near-dedup, benchmark
decontamination, packing.  Part of the ``llm`` subpackage; removed together with it.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import decontam, exact_dedup, langid, near_dedup, packing
from sparkweave.llm.common import crc_mod5, cut, fresh, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects: no letter, or a narrow margin.  Null and
    empty texts are rejected; repeated rows share their fate; columns named like the
    classifier's results come back untouched; an empty table stays empty."""
    train = docs.filter(crc_mod5(F.col("doc_id")) != 0).select("text", "lang")
    names = [fresh(docs, n) for n in langid.NAMES]
    found = langid.predict(docs, langid.Model(langid.fit(train)), names=names)
    return found.filter(~F.col(names[-1])).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that of the largest id (null ids
    lose); of repeated rows one; null and empty texts are one group."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least id; null and empty
    texts have no copies and stay; a row with a null id stays if its text is empty only."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark; null and empty texts hold none;
    an empty benchmark drops none."""
    leaks = fresh(docs, "leaks")
    found = decontam.find_leaks(docs, read(spark, sf_dir, "benchmark"), out_col=leaks)
    return found.filter(F.size(leaks) == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document; null texts have no tokens, repeated
    rows and rows without id are packed once each."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminate), ("pack", pack)]

#: Compression, MinHash and dynamic programming have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
