"""Diff, patch, overlay and references of documents in long form (doc, path, type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle, shuffled

VALUE = ["type", "value"]


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc, op (added, removed, changed, moved), path, from_path, type, value.  Within a
    document, a removed and an added path of equal value are paired in order as a move."""
    x = a.select("doc", "path", F.struct(*VALUE).alias("old"))
    y = b.select("doc", "path", F.struct(*VALUE).alias("new"))
    both = x.join(y, ["doc", "path"], "full_outer")
    changed = both.filter(F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).select("doc", F.lit("changed").alias("op"), "path", F.lit(None).cast("string").alias("from_path"), "new.*")
    w = lambda v: Window.partitionBy("doc", v).orderBy("path")
    gone = both.filter("new is null").select(F.col("doc").alias("d0"), F.col("path").alias("p0"), F.col("old").alias("v0"), F.row_number().over(w("old")).alias("k0"))
    came = both.filter("old is null").select(F.col("doc").alias("d1"), F.col("path").alias("p1"), F.col("new").alias("v1"), F.row_number().over(w("new")).alias("k1"))
    pair = gone.join(came, (F.col("d0") == F.col("d1")) & F.col("v0").eqNullSafe(F.col("v1")) & (F.col("k0") == F.col("k1")), "full_outer")
    op = F.when(F.col("p1").isNull(), "removed").when(F.col("p0").isNull(), "added").otherwise("moved")
    moved = pair.select(
        F.coalesce("d0", "d1").alias("doc"), op.alias("op"), F.coalesce("p1", "p0").alias("path"), F.when(op == "moved", F.col("p0")).alias("from_path"), F.coalesce("v1", "v0").alias("v"),
    ).select("doc", "op", "path", "from_path", "v.*")
    return changed.unionByName(moved)


def patch(a: DataFrame, d: DataFrame) -> DataFrame:
    """patch(a, diff(a, b)) has the rows of b."""
    out_of = d.filter("op in ('removed', 'changed')").select("doc", "path").unionByName(d.filter("op = 'moved'").select("doc", F.col("from_path").alias("path")))
    kept = a.select("doc", "path", *VALUE).join(shuffled(out_of), ["doc", "path"], "left_anti")
    return kept.unionByName(d.filter("op <> 'removed'").select("doc", "path", *VALUE))


def missing(a: DataFrame, d: DataFrame) -> DataFrame:
    """Changes whose path is not in ``a``: a patch that does not fit."""
    need = d.filter("op in ('removed', 'changed', 'moved')").select("doc", F.coalesce("from_path", "path").alias("path"))
    return need.join(shuffled(a.select("doc", "path")), ["doc", "path"], "left_anti")


def overlay(chain: DataFrame) -> DataFrame:
    """Collapse (doc, seq, path, type, value): the last value of a path; a null deletes the
    path and what lies under it, ``x[]`` = null clears the array."""
    last = chain.groupBy("doc", "path").agg(F.max_by(F.struct("seq", *VALUE), "seq").alias("v")).select("doc", "path", "v.*")
    cuts = chain.filter("type = 'null'").select("doc", F.col("seq").alias("_s"), F.regexp_replace("path", r"\[\]$", "").alias("_p"))
    # a path is under its prefixes only: join on them, not on a pattern
    steps = F.split(F.regexp_replace("path", r"\[", ".["), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.regexp_replace(F.array_join(F.slice(steps, F.lit(1), n), "."), r"\.\[", "["))
    under = last.filter("type <> 'null'").select("doc", "path", "seq", F.explode(prefixes).alias("_p"))
    dead = under.join(shuffled(cuts), ["doc", "_p"]).filter("_s > seq").select("doc", "path").distinct()
    return last.filter("type <> 'null'").join(shuffled(dead), ["doc", "path"], "left_anti").select("doc", "path", *VALUE)


def flatten(long: DataFrame) -> DataFrame:
    return long.select("doc", "path", F.coalesce("value", F.lit("~")).alias("value"))


def chase(refs: DataFrame) -> DataFrame:
    """doc, path, target (where the chain of references leads), endless (into a cycle) of
    (doc, path, target) rows.  Pointers are doubled as often as the longest possible chain,
    all references of one document, asks for."""
    hop = settle(refs.select("doc", "path", "target").dropDuplicates(["doc", "path"]), "references")
    most = hop.groupBy("doc").count().agg(F.max("count")).first()[0] or 0
    for step in range(int(most).bit_length()):
        nxt = hop.select("doc", F.col("path").alias("target"), F.col("target").alias("_t"))
        hop = hop.join(shuffled(nxt), ["doc", "target"], "left").select("doc", "path", F.coalesce("_t", "target").alias("target"))
        if step % 3 == 2:
            hop = settle(hop, "hops")
    own = hop.select("doc", F.col("path").alias("target"), F.lit(True).alias("_on"))
    return hop.join(shuffled(own), ["doc", "target"], "left").select("doc", "path", "target", F.coalesce("_on", F.lit(False)).alias("endless"))


def resolve(long: DataFrame) -> DataFrame:
    """References replaced by the value they lead to; ``cycle`` marks those that never end."""
    hop = chase(long.filter("type = 'reference'").select("doc", "path", F.col("value").alias("target")))
    ends = long.filter("type <> 'reference'").select("doc", F.col("path").alias("target"), *VALUE)
    done = hop.join(shuffled(ends), ["doc", "target"], "left")
    return long.filter("type <> 'reference'").select("doc", "path", *VALUE, F.lit(False).alias("cycle")).unionByName(done.select("doc", "path", *VALUE, F.col("endless").alias("cycle")))
