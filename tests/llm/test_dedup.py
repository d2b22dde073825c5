import hashlib
from collections import defaultdict

import brute
import duckdb
import numpy as np
import pyarrow as pa
from cases import EDGE
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweave.llm import entry, exact_dedup, linededup, near_dedup, suffix, words


def against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = entry.QUERIES[name](spark, sf)
    want = con.sql(entry.SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda data, cols: sorted(tuple(map(str, (r[cols.index(c)] for c in order))) for r in data)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_exact_sql(spark, sf):
    against_sql(spark, sf, "op1_exact_dedup")


def test_exact_edges(edge, empty):
    """Small blocks, so that every text takes several rounds of naming."""
    got = exact_dedup.exact_duplicates(edge, block_bytes=16).collect()
    groups = defaultdict(list)
    for i, t in EDGE:
        groups[(t or "").translate(brute.UP)].append(i)
    assert len(got) == len(EDGE)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for sha, ids in by_sha.items():
        own = [r for r in got if r["text_sha256"] == sha]
        assert len(own) == len(ids) and all(r["group_size"] == len(ids) for r in own)
        assert {r["keep_id"] for r in own} == {max((x for x in ids if x is not None), default=None)}
        assert sum(r["kept"] for r in own) == 1
    assert exact_dedup.exact_duplicates(empty).count() == 0
    stays = exact_dedup.drop_exact_duplicates(edge)
    assert stays.columns == edge.columns and stays.count() == len(groups)


def test_near_edges(edge, empty):
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(edge).collect()), key=str)
    want = []
    for (i, t), (n, members) in zip(EDGE, brute.near(EDGE), strict=True):
        least = min((EDGE[m][0] for m in members if EDGE[m][0] is not None), default=None) if n else i
        want.append((i is not None, i, n, least, i == least if n else True))
    assert got == sorted(want, key=str)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_brute(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {rows[k][0]: (n, min(rows[m][0] for m in ms) if n else rows[k][0]) for k, (n, ms) in enumerate(brute.near(rows))}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in entry.op2_minhash_near_dedup(spark, sf).collect()}
    assert got == want


def test_near_rest_shows_every_link_of_a_crowded_bucket(spark):
    """One bucket of windows of a common text, with own words mixed in: all links, ties at
    exactly 75 % among them, are shown; most other pairs are not."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (5, 7, 8, 9, 64, 79, 104)]
    for i in range(150):
        at, n, own = rng.integers(0, 30), rng.integers(5, 90), rng.integers(0, 25)
        texts.append(" ".join([f"w{k}" for k in range(at, at + n)] + [f"own{i}_{k}" for k in range(own)]))
    nodes = {near_dedup.node_of(x): (t, x) for t, x in zip(texts, words.shingle_sets(pa.array(texts)), strict=True)}
    share = lambda x, y: (100 * len(np.intersect1d(x, y)), 75 * len(np.union1d(x, y)))
    ids = sorted(nodes)
    links = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if share(nodes[a][1], nodes[b][1])[0] >= share(nodes[a][1], nodes[b][1])[1]}
    assert any(share(nodes[a][1], nodes[b][1])[0] == share(nodes[a][1], nodes[b][1])[1] for a, b in links)
    own = spark.createDataFrame([(1, bytearray(n), len(x), bytearray(n)) for n, (_, x) in nodes.items()], "bucket bigint, node binary, size bigint, label binary")
    data = spark.createDataFrame([(bytearray(n), t) for n, (t, _) in nodes.items()], "node binary, text string")
    shown = near_dedup.rest(own, data, 5, 75, len(nodes))
    got = {(bytes(r["a"]), bytes(r["b"])) for r in shown.collect()}
    assert links <= got and len(got) < len(ids) * (len(ids) - 1) / 4
    assert {(bytes(r["a"]), bytes(r["b"])) for r in near_dedup.confirm(shown, data, 5, 75).collect()} == links


def test_near_links_of_small_components_in_crowded_buckets(spark):
    """Groups of six near copies whose two buckets also hold a pair of near copies of its own."""
    rng = np.random.default_rng(7)
    rows = []
    for g in range(12):
        word = lambda n, g=g: " ".join(f"g{g}w{x}" for x in rng.integers(0, 10**6, n))
        shared, big, small = word(60), word(30), word(30)
        texts = [f"{shared} {big} {k}" for k in range(6)] + [f"{shared} {small} {k}" for k in range(2)]
        rows += [(8 * g + k, t) for k, t in enumerate(texts)]
    want = {rows[k][0]: rows[ms[0]][0] for k, (_, ms) in enumerate(brute.near(rows))}
    assert len(set(want.values())) == 24
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, bins=2, rows=1).collect()}
    assert got == want


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (8, 40, 400):
        hits = []
        for _ in range(60):
            x = rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            y = np.concatenate([x[: size * 6 // 7], rng.integers(0, 2**63, size - size * 6 // 7, dtype=np.int64).astype(np.uint64)])
            s = near_dedup.signatures([np.unique(x), np.unique(y)])
            inter, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            hits.append((s[0] == s[1]).mean() - inter / union)
        assert abs(np.mean(hits)) < 0.06


def test_suffix_edges(edge, empty):
    got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffix.repeated_spans(edge, block_bytes=4000).fillna(-1, ["doc_id"]).collect())
    assert got == sorted((-1 if r[0] is None else r[0], *r[1:]) for r in brute.repeats(EDGE))
    assert suffix.repeated_spans(empty).count() == 0


def test_suffix_brute(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {tuple(r)[:5] for r in entry.op10_suffix_dedup(spark, sf).collect()}
    assert got == set(brute.repeats(rows))


def test_passages_of_words(spark, sf):
    """Documents that share 50 words are told, those that share fewer than 30 are not."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]

    def shared(n):
        c = defaultdict(set)
        for k, (_, t) in enumerate(rows):
            w = brute.words(t)
            for j in range(len(w) - n + 1):
                c[tuple(w[j : j + n])].add(k)
        return {rows[k][0] for ks in c.values() if len(ks) > 1 for k in ks}

    for block_bytes in (8 << 20, 100_000):
        got = {r["doc_id"] for r in suffix.repeated_spans(spark.read.parquet(f"{sf}/documents.parquet"), block_bytes=block_bytes).filter("n_passages > 0").collect()}
        assert shared(50) <= got <= shared(30) and got


def test_suffix_brute_in_many_blocks_and_slices(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = suffix.repeated_spans(spark.read.parquet(f"{sf}/documents.parquet"), block_bytes=20_000, slice_entries=500)
    assert {tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()} == set(brute.repeats(rows))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(0, 2), min_size=4, max_size=4), min_size=1, max_size=12), min_size=1, max_size=6))
def test_merge_finds_exactly_the_entries_of_two_runs(runs):
    coded, kept = [], []
    for r in runs:
        x = np.array(sorted(set(map(tuple, r))), dtype=np.uint64)
        order, lcp = suffix.sort_suffixes(x)
        assert list(order) == list(range(len(x)))
        coded.append((lcp, suffix.front_code(x, lcp), np.ones(len(x), np.uint8)))
        assert (suffix.front_decode(lcp, coded[-1][1]) == x).all()
        kept.append([tuple(v) for v in x.tolist()])
    for i, hit in enumerate(suffix.merge_runs(coded)):
        assert hit.tolist() == [any(v in o for j, o in enumerate(kept) if j != i) for v in kept[i]]


def test_lines(spark, edge, empty):
    rows = [(k, f"{'abcdef'[k] * 3} {'ghijkl'[k] * 2} unlike {'mnopqr'[k] * 4}\nShared footer text here\nJob 1{k} started by user{k} on host\n\nonly{k}") for k in range(6)] + [(90, None), (91, "Shared footer text here\nShared footer text here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in linededup.drop_lines(docs).collect()}
    assert got[0]["n_lines"] == 4 and "Shared footer" not in got[0]["kept_text"] and "Job" not in got[0]["kept_text"] and got[0]["kept_text"].endswith("only0")
    assert got[90]["n_lines"] == 0 and got[91]["n_dropped"] == 2 and got[91]["kept_text"] == ""
    assert linededup.drop_lines(edge).count() == len(EDGE) and linededup.drop_lines(empty).count() == 0


def test_line_templates():
    lines = [(k, f"user {n} logged in from place {p}".split(), 2, k, k + 100) for k, (n, p) in enumerate([("ann", "x"), ("bob", "y"), ("cid", "z")])]
    assert sorted(linededup.parse([*lines, (9, "some quite different line of same length".split(), 9, 1, 2)], 0.7, 5)) == [0, 1, 2]
    assert linededup.parse(lines, 0.9, 5) == []


def test_components_of_links_that_come_in_rounds(spark):
    rng = np.random.default_rng(4)
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    label = None
    for n in (20, 12, 6):
        pairs = rng.integers(0, 60, (n, 2)).tolist()
        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        new = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in pairs if a != b], "a binary, b binary")
        label = near_dedup.joined(label, new, 100)
    got = {r["node"][0]: r["label"][0] for r in label.collect()}
    assert got == {x: find(x) for x in got} and all(x in got or find(x) == x for x in range(60))
