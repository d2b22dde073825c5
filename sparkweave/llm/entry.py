"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontam, exact_dedup, langid, linededup, lm, near_dedup, packing, suffix, toxicity, urls
from .common import crc_mod5, read

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: its group of equal texts, the row that stays, the text's SHA-256.
    Null counts as empty, repeated rows are members of their group, one of them stays."""
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


OP1_SQL = f"""
with d as (select doc_id, {LOWER.format("coalesce(text, '')")} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256, octet_length(encode(t))::bigint as n_bytes
from d
"""


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages``: host, path, the longest rule that fits, the verdict.  Null or a URL
    without ``://``: empty host and path."""
    return urls.filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _op6_sql() -> str:
    fits = lambda host, path: f"(('.' || host) like '%.{host}' and starts_with(path, '{path}'))"
    cases = sorted(urls.DOMAIN_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in cases)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in cases)
    quoted = [(v, rx.replace("'", "''")) for v, rx in urls.PATTERN_RULES]
    other = " or ".join(f"regexp_matches(low, '{rx}')" for v, rx in quoted if v == "block")
    return f"""
with u as (select page_id, {LOWER.format("coalesce(url, '')")} as low,
                  case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
     p as (select page_id, low, {LOWER.format("coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '')")} as host,
                  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u)
select page_id, host, path, case {rule} end as rule, case {verdict} when {other} then 'block' else 'allow' end as verdict from p
"""


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: the size of its shingle set and its component.  Null, empty or
    blank text: 0 shingles, linked with nothing."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: tokens, length bucket, batch and slot.  Null text has 0 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: the predicted language, from rows outside the held-out fold.  Null
    text or no letter: ``und``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.Model(langid.fit(docs.filter(crc_mod5(F.col("doc_id")) != 0)))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: the benchmark items whose passages it holds.  Null and empty texts
    hold none."""
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    found = decontam.find_leaks(docs, items)
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.transform("leaks", lambda x: x["item_id"]).alias("items"),
        F.size("leaks").alias("n_items"), F.array_min(F.transform("leaks", lambda x: x["distance"])).alias("least_distance"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: bytes, bytes in repeated 400-byte strings, their runs, what is
    left, and runs of words that other rows hold.  Null counts as empty."""
    return suffix.repeated_spans(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: the score, learnt from labels outside the held-out fold.  Null and
    empty texts get the score of no evidence."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs.filter(crc_mod5(F.col("doc_id")) != 0), read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "evidence", F.size("segments").alias("n_segments"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: base and model score, learnt outside the held-out fold.  Null text
    is one token, the end."""
    return lm.score(read(spark, sf_dir, "documents"), crc_mod5(F.col("doc_id")) == 1)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: lines, lines dropped, what is left.  Null text has no line."""
    return linededup.drop_lines(read(spark, sf_dir, "documents")).drop("kept_text")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op1_exact_dedup": OP1_SQL, "op6_url_filter": _op6_sql()}
