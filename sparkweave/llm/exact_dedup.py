"""Exact dedup by deterministic block naming.

Each normalised text is cut into fixed-size byte blocks.  The distinct blocks are sorted
and numbered; then adjacent names are paired, the distinct pairs sorted and numbered, and
so on until a document is one integer.  Two texts of the same byte length get the same
integer if and only if all their blocks are equal, so the identity has no collisions.

Text is shuffled once, for the distinct blocks, and pre-aggregated before that.  The
names go back to the documents over a 64-bit digest of the block; the digest is only a
join handle, and it is checked against the names that no two blocks share one (a wider
digest is taken otherwise).  Copies are split by adaptive execution: every join reads
plain tables on both sides.

Defined cases: a null text counts as empty; empty texts are equal; of equal rows with the
same largest id (repeated rows) exactly one stays; null ids lose against any other; an
empty table gives an empty result; further columns pass through ``exact_duplicates``
untouched unless named like its own results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, drop, fresh, mark, release

DIGESTS = ("xxhash64(x)", "sha2(x, 256)")


def _bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), F.encode(text, "UTF-8").alias("b"))


def _blocks(size: int) -> str:
    """The list of a text's blocks, an empty text has one empty block."""
    return f"transform(sequence(0, greatest(cast(ceil(octet_length(b) / {size}) as int), 1) - 1), i -> substring(b, i * {size} + 1, {size}))"


def _numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """Sorted distinct keys -> integer names: the partition and the rank in it."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def text_identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8192) -> DataFrame:
    """One row per input row: uid, doc_id, text_sha256, n_bytes, name; rows have equal
    (n_bytes, name) exactly when their normalised texts are equal."""
    since = mark()
    data = _bytes(docs, id_col, text_col)
    for digest in DIGESTS:
        rows = cut(
            data.select(
                F.monotonically_increasing_id().alias("uid"), "doc_id", F.sha2("b", 256).alias("text_sha256"),
                F.octet_length("b").cast("long").alias("n_bytes"), F.expr(f"transform({_blocks(block_bytes)}, x -> {digest})").alias("hs"),
            ),
            "rows",
        )
        blocks = data.select(F.explode(F.expr(_blocks(block_bytes))).alias("x")).selectExpr(f"{digest} as h", "x as block")
        names = cut(_numbered(blocks.distinct(), "block").select("h", "name"), "names")
        clash = names.groupBy("h").count().filter("count > 1").limit(1).count()
        if not clash:
            break
        drop(rows, names)
    else:
        raise ValueError("two different blocks share a 256-bit digest")

    longest = rows.agg(F.max(F.size("hs"))).first()[0] or 1
    done = rows.filter("size(hs) = 1").select("uid", F.col("hs")[0].alias("h")).join(names, "h").select("uid", "name")
    if longest > 1:
        seqs = (
            rows.filter("size(hs) > 1").select("uid", F.posexplode("hs").alias("i", "h")).join(names, "h").groupBy("uid")
            .agg(F.expr("transform(array_sort(collect_list(struct(i, name))), x -> x.name)").alias("names"))
        )
        while True:
            seqs = cut(seqs, "sequences")
            done = done.unionByName(seqs.filter("size(names) = 1").select("uid", F.col("names")[0].alias("name")))
            if longest <= 1:
                break
            pairs = seqs.filter("size(names) > 1").select(
                "uid", F.explode(F.expr("transform(sequence(0, cast(ceil(size(names) / 2) as int) - 1), i -> struct(i, names[2 * i] as a, coalesce(get(names, 2 * i + 1), -1L) as b))")).alias("p")
            ).select("uid", "p.*")
            named = cut(_numbered(pairs.select("a", "b").distinct(), "a", "b"), "pairs")
            seqs = pairs.join(named, ["a", "b"]).groupBy("uid").agg(F.expr("transform(array_sort(collect_list(struct(i, name))), x -> x.name)").alias("names"))
            longest = (longest + 1) // 2
    out = cut(rows.drop("hs").join(done, "uid"), "identity")
    release(since, out)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8192) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_bytes for every input row."""
    rows = text_identity(docs, id_col, text_col, block_bytes)
    groups = cut(
        rows.groupBy("n_bytes", "name").agg(F.max(F.struct("doc_id", (-F.col("uid")).alias("u"))).alias("top"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    return rows.join(groups, ["n_bytes", "name"]).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("uid") == -F.col("top.u")).alias("kept"), "text_sha256", "n_bytes"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8192) -> DataFrame:
    """The input's rows and columns, one row for each distinct normalised text."""
    since = mark()
    key, id_, sha_ = (fresh(docs, n) for n in ("key", "id", "sha"))
    kept = cut(exact_duplicates(docs, id_col, text_col, block_bytes).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha_)), "kept")
    release(since, kept)
    sha = F.sha2(F.encode(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "UTF-8"), 256)
    out = docs.withColumn(key, sha)
    out = out.join(kept, (F.col(key) == F.col(sha_)) & F.col(id_col).eqNullSafe(F.col(id_)), "left_semi")
    if docs.groupBy(id_col).count().filter("count > 1").limit(1).count():  # repeated ids: one row of those that are equal
        out = out.dropDuplicates([id_col, key])
    return out.select(*docs.columns)
