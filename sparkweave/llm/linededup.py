"""Line dedup by a log-template tree.

1. A line's tokens (split at white space); a token with a digit is a variable field, <*>.
   The tree has a fixed depth: token count, then the first ``depth`` tokens; the rest of
   the way is the leaf.
2. Every masked line is counted by the documents that hold it, once a document.  Counts are
   summed on the way, so a line that a third of all documents hold is a row a task.
3. Leaves with several masked lines and enough documents are looked into.  A line of n
   tokens may differ from a similar one in at most d = n * (1 - similarity) of them, so of
   d + 1 blocks of its tokens one at least is the same in both: each line is filed under
   leaf and block, once for each block.
4. A line goes when it is held by at least ``min_docs`` documents itself, or when the lines
   of one of its groups that are similar to it are, itself among them: a line's template is
   the line with those similar to it.  Similar lines agree in at least ``similarity`` of
   their positions, fields included, and without the fields in half of them.  Their
   documents are counted together: a line of fewer than ``min_docs`` documents brings the
   keys of all of them, one of more decides alone.  No order of the lines and no size of a
   group has a say in it: groups of more than ``leaf_lines`` lines are held against each
   other slice by slice, each line until its documents are enough.
5. The lines to drop go back to the blocks of documents that hold them.

Which leaves are parsed is told to the scan by a bitmap of fixed size (2 MB); what it lets
pass by chance is removed by a join, so it only saves traffic.

Defined cases: null counts as empty: no line; blank lines are never counted nor dropped;
a repeated row is another document; an empty table gives an empty result; further columns
are not carried here.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, ship

DIGIT = re.compile(r"\d")
FIELD = re.compile(r"\S*\d\S*")
BITMAP = 24


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masked(line: str) -> list[str]:
    """Tokens with variable fields as <*>; a line that is mostly fields keeps them, so that
    it recurs only as it is."""
    if DIGIT.search(line):
        tokens = FIELD.sub("<*>", line).split()
        if 2 * tokens.count("<*>") <= len(tokens):
            return tokens
    return line.split()


def place(tokens: list[str], depth: int) -> tuple[int, int]:
    """(leaf, line key) of a masked line."""
    leaf = xxhash.xxh64_intdigest(f"{len(tokens)} " + " ".join(tokens[:depth]))
    return signed(leaf), signed(xxhash.xxh64_intdigest(" ".join(tokens)))


def groups_of(leaf: int, tokens: list[str], depth: int, similarity: float) -> set[int]:
    """The groups a line is filed under: leaf and one of d + 1 blocks of its later tokens.
    A block without tokens stands for the whole leaf."""
    later = tokens[depth:]
    n, blocks = len(later), int(len(tokens) * (1 - similarity) + 1e-9) + 1  # whole shares stay whole
    out = set()
    for i in range(blocks):
        lo, hi = i * n // blocks, (i + 1) * n // blocks
        out.add(signed(xxhash.xxh64_intdigest(f"{leaf} {i} " + " ".join(later[lo:hi]) if hi > lo else f"{leaf}")))
    return out


def apart(docs: list[int]) -> list[int]:
    """Keys of a line's documents; of equal rows, the second and later ones get keys of their
    own, the same ones in every line."""
    seen: Counter[int] = Counter()
    out = []
    for d in docs:
        out.append(signed(xxhash.xxh64_intdigest(f"{d} {seen[d]}")) if seen[d] else d)
        seen[d] += 1
    return out


def support(asked: list[tuple], lines: list[tuple], similarity: float, min_docs: int) -> list[list[int] | None]:
    """For each line (key, tokens, documents, key of each document ...) of ``asked``: the
    documents of the lines similar to it, or None where they are ``min_docs`` or more."""
    codes: dict[str, int] = {"<*>": 0}
    y = np.array([[codes.setdefault(t, len(codes)) for t in x[1]] for x in lines], dtype=np.int32)
    out: list[list[int] | None] = []
    for a in asked:
        x = np.array([codes.get(t, -1) for t in a[1]], dtype=np.int32)
        same = y == x
        held: set[int] | None = set(a[3:])
        for j in np.flatnonzero((same.sum(axis=1) >= similarity * len(x)) & (2 * same[:, x != 0].sum(axis=1) >= len(x))).tolist():
            held.update(lines[j][3:])
            if lines[j][2] >= min_docs or len(held) >= min_docs:
                held = None
                break
        out.append(held if held is None else sorted(held))
    return out


def parse(lines: list[tuple], similarity: float, min_docs: int) -> list[int]:
    """Keys of the lines (key, tokens, documents, key of each document ...) of one group, of
    fewer than ``min_docs`` documents themselves, that recur with those similar to them."""
    asked = [x for x in lines if x[2] < min_docs]
    return [x[0] for x, held in zip(asked, support(asked, lines, similarity, min_docs), strict=True) if held is None]


def recurring(texts: DataFrame, depth: int, similarity: float, min_docs: int, leaf_lines: int) -> DataFrame:
    """key of every line of ``texts`` (leaf, key, line, n, docs) that recurs with those similar to it."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [list(groups_of(leaf, line.split(" "), depth, similarity)) for leaf, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            at = np.repeat(np.arange(b.num_rows), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array([g for x in own for g in x], pa.int64()), b.column(2).take(pa.array(at)), b.column(3).take(pa.array(at))], names=["group", "key", "n"])

    # keys first: the lines themselves follow only to groups in which a template can recur
    ids = cut(ship(texts.select("leaf", "line", "key", "n")).mapInArrow(file, "group bigint, key bigint, n bigint"), "ids")
    # of groups that hold the same lines one is parsed: sets are told apart by 128 bits of hashes
    per = ids.groupBy("group").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("held"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).filter((F.col("lines") > 1) & (F.col("held") >= min_docs))
    sizes = cut(per.groupBy("lines", "x", "y").agg(F.min("group").alias("group")).select("group", "lines"), "sizes")
    filed = cut(ids.select("group", "key").join(sizes, "group").join(texts.drop("leaf"), "key").select("group", "lines", "key", "line", "n", "docs"), "filed")
    total = filed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("lines"), F.lit(0)).alias("most")).first()
    # groups that fit are looked into in bundles of a bounded number of lines
    bundles = max(1, total["rows"] // (4 * leaf_lines))

    def each(table: pa.Table) -> dict[int, list[tuple]]:
        own: dict[int, list] = {}
        for group, key, line, n, held_by in zip(*(table.column(c).to_pylist() for c in ("group", "key", "line", "n", "docs")), strict=True):
            own.setdefault(group, []).append((key, line.split(" "), n, *apart(held_by or [])))
        return own

    def keys(table: pa.Table) -> pa.Table:
        return pa.table({"key": pa.array([k for v in each(table).values() for k in parse(v, similarity, min_docs)], pa.int64())})

    found = filed.filter(F.col("lines") <= leaf_lines).withColumn("bundle", F.pmod("group", F.lit(bundles))).groupBy("bundle").applyInArrow(keys, "key bigint")
    if total["most"] <= leaf_lines:
        return found

    # larger groups: each slice by itself, then what is open yet against the other slices
    def held_by(asked: pa.Table, lines: pa.Table) -> pa.Table:
        out: list[tuple] = []
        known = each(lines)
        for group, v in each(asked).items():
            v = [x for x in v if x[2] < min_docs]
            out += [(group, x[0], held is None, held or []) for x, held in zip(v, support(v, known.get(group, []), similarity, min_docs) if group in known else [x[3:] for x in v], strict=True)]
        return pa.table({c: pa.array([x[k] for x in out], t) for k, (c, t) in enumerate((("group", pa.int64()), ("key", pa.int64()), ("enough", pa.bool_()), ("held", pa.list_(pa.int64()))))})

    shape = "group bigint, key bigint, enough boolean, held array<bigint>"
    large = filed.filter(F.col("lines") > leaf_lines).withColumn("slices", F.ceil(F.col("lines") / leaf_lines).cast("int")).withColumn("slice", F.pmod(F.xxhash64("key", F.lit(1)), "slices").cast("int"))
    first = cut(large.groupBy("group", "slice").applyInArrow(lambda t: held_by(t, t), shape), "first")
    asked = cut(large.join(first.filter(~F.col("enough")).select("group", "key"), ["group", "key"]), "asked")
    per = cut(asked.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / leaf_lines).cast("int").alias("chunks")), "chunks")
    chunk = F.pmod(F.xxhash64("key", F.lit(2)), "chunks").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda i: i != F.col("slice"))
    cols = ["group", "slice", "chunk", "key", "line", "n", "docs"]
    asked = asked.join(per, "group").withColumn("chunk", chunk).withColumn("slice", F.explode(others)).select(*cols)
    lines = large.join(per, "group").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*cols)
    by = ["group", "slice", "chunk"]
    second = asked.groupBy(*by).cogroup(lines.groupBy(*by)).applyInArrow(held_by, shape)
    both = first.unionByName(second).groupBy("group", "key").agg(F.max("enough").alias("enough"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n"))
    return found.unionByName(both.filter(F.col("enough") | (F.col("n") >= min_docs)).select("key"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, similarity: float = 0.75, min_docs: int = 5, leaf_lines: int = 2000, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text, kept_sha256 of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_key = F.xxhash64(text, F.col(id_col))
    rows = ship(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), doc_key.alias("d"), F.pmod(doc_key, F.lit(blocks)).cast("int").alias("block")))

    def scan(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[int, int], list] = {}  # (block, line) -> what is known of it
            block, docs_ = b.column(2).to_pylist(), b.column(1).to_pylist()
            for i, t in enumerate(b.column(0)):
                mine = set()
                for line in t.as_py().split("\n"):
                    tokens = masked(line)
                    if not tokens:
                        continue
                    leaf, key = place(tokens, depth)
                    if key in mine or (wanted is not None and not wanted[leaf & ((1 << BITMAP) - 1)]):
                        continue
                    mine.add(key)
                    at = (block[i] if wanted is None else 0, key)
                    if at not in seen:
                        seen[at] = [leaf, " ".join(tokens) if wanted is not None else None, 0, []]
                    v = seen[at]
                    v[2] += 1
                    if wanted is not None:  # none are needed of a line of min_docs documents
                        v[3] = [*v[3], docs_[i]] if v[2] < min_docs else []
            v = list(seen.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int64()), *(pa.array([r[c] for r in v], {1: pa.string(), 3: pa.list_(pa.int64())}.get(c, pa.int64())) for c in range(4))],
                names=["block", "key", "leaf", "line", "n", "docs"],
            )

    shape = "block int, key bigint, leaf bigint, line string, n bigint, docs array<bigint>"
    found = cut(rows.select("text", "d", "block").mapInArrow(lambda it: scan(it, None), shape).groupBy("block", "key", "leaf").agg(F.sum("n").alias("n")), "lines")
    lines = cut(found.groupBy("key", "leaf").agg(F.sum("n").alias("n")), "counts")
    leaves = cut(lines.groupBy("leaf").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("lines")).filter((F.col("lines") > 1) & (F.col("docs") >= min_docs)), "leaves")
    bits = leaves.select(F.col("leaf").bitwiseAND(F.lit((1 << BITMAP) - 1)).cast("int").alias("slot"))
    marks = bits.select(F.shiftright("slot", 15).alias("page"), (F.col("slot").bitwiseAND(F.lit((1 << 15) - 1))).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("map"))
    wanted = np.zeros(1 << BITMAP, dtype=bool)
    for r in marks.collect():  # at most 512 pages of 4 KB
        got = np.unpackbits(np.frombuffer(bytes(r["map"]), np.uint8), bitorder="little")
        wanted[r["page"] << 15 : (r["page"] << 15) + len(got)] = got.astype(bool)
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))
    texts = rows.select("text", "d", "block").mapInArrow(lambda it: scan(it, np.unpackbits(held.value).astype(bool)), shape)
    texts = texts.groupBy("leaf", "key", "line").agg(F.sum("n").alias("n"), F.when(F.sum("n") < min_docs, F.flatten(F.collect_list("docs"))).alias("docs"))  # fewer than min_docs keys a batch
    texts = cut(texts.join(leaves.select("leaf"), "leaf"), "texts")
    generic = recurring(texts, depth, similarity, min_docs, leaf_lines)
    gone = cut(lines.filter(F.col("n") >= min_docs).select("key").unionByName(generic).distinct(), "gone")
    back = cut(found.select("block", "key").join(gone, "key"), "back")
    drop(found, lines, leaves)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        bad = set(right.column("key").to_pylist())
        out = {n: [] for n in ("n_lines", "n_dropped", "kept_text", "kept_sha256")}
        for t in left.column("text"):
            t = t.as_py()
            kept, n, gone_ = [], 0, 0
            for line in t.split("\n"):
                tokens = masked(line)
                n += bool(tokens)
                if tokens and place(tokens, depth)[1] in bad:
                    gone_ += 1
                else:
                    kept.append(line)
            new = "\n".join(kept)
            for c, v in zip(out, (n, gone_, new, hashlib.sha256(new.encode()).hexdigest()), strict=True):
                out[c].append(v)
        return pa.table({"doc_id": left.column("doc_id"), "n_lines": pa.array(out["n_lines"], pa.int64()), "n_dropped": pa.array(out["n_dropped"], pa.int64()), "kept_text": pa.array(out["kept_text"], pa.string()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())})

    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, f"doc_id {id_type}, n_lines bigint, n_dropped bigint, kept_text string, kept_sha256 string")
