import random

from sparkweave.llm import linededup


def test_documents_of_a_template_are_the_union_over_its_lines(spark):
    """Variants in 4 + 4, 3 + 3 and 4 + 1 documents recur; in 2 + 2, or twice in the same 4, they don't."""
    stems = ["press here to {} our daily letter today", "all rights of {} owner stay always reserved", "please do not {} any part of this", "log in to {} the rest of it", "this page was {} once by our staff"]
    spread = [((0, 4), (4, 8)), ((0, 3), (3, 6)), ((0, 4), (7, 8)), ((0, 2), (2, 4)), ((0, 4), (0, 4))]
    lines = {k: [] for k in range(8)}
    for stem, parts in zip(stems, spread, strict=True):
        for word, (lo, hi) in zip(("alpha", "beta"), parts, strict=True):
            for k in range(lo, hi):
                lines[k].append(stem.format(word))
    docs = spark.createDataFrame([(k, "\n".join(v)) for k, v in lines.items()], "doc_id bigint, text string").repartition(3)
    kept = {line for r in linededup.drop_lines(docs).collect() for line in r["kept_text"].split("\n") if line}
    assert kept == {s.format(w) for s in stems[3:] for w in ("alpha", "beta")}


def test_repeated_rows_are_documents(spark):
    rows = [(1, "press here to alpha our daily letter today")] * 3 + [(2, "press here to beta our daily letter today")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert [r["n_dropped"] for r in linededup.drop_lines(docs).collect()] == [1] * 5


def planted(rnd, n_docs):
    """Texts, and the lines of them that are planted templates of many variants."""
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    stems = [[word() for _ in range(n)] for n in (8, 9, 12, 17, 24)]
    texts, gone = [], set()
    for k in range(n_docs):
        own = []
        for s in stems:
            t = list(s)
            for p in rnd.sample(range(3, len(t)), 1 if len(t) < 12 else 2):
                # positions differ from line to line, the share of variable ones stays within the similarity
                if p in (3, 5, len(t) - 1):
                    t[p] = word()
            own.append(" ".join(t))
            gone.add(own[-1])
        own += [" ".join([*stems[0][:3], *(word() for _ in range(5))]), word()]  # same leaf, no template
        texts.append((k, "\n".join(own)))
    return texts, gone


def test_templates_are_the_same_at_every_leaf_size(spark):
    rnd = random.Random(3)
    texts, gone = planted(rnd, 300)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    for leaf_lines in (2000, 25, 7):
        kept = {line for r in linededup.drop_lines(docs, leaf_lines=leaf_lines).collect() for line in r["kept_text"].split("\n") if line}
        assert not kept & gone, leaf_lines
        assert len(kept) == 600


def test_groups_hold_whatever_a_template_joins():
    """Two lines that agree in the share of positions and in their leaf share a group."""
    rnd = random.Random(4)
    for _ in range(400):
        n = rnd.randint(1, 26)
        a = [f"t{rnd.randrange(99)}" for _ in range(n)]
        b = list(a)
        free = list(range(3, n))
        for p in rnd.sample(free, min(len(free), int(n * 0.25 + 1e-9))):
            b[p] = "other"
        assert linededup.groups_of(1, a, 3, 0.75) & linededup.groups_of(1, b, 3, 0.75)


def test_lines_go_by_those_similar_to_them_at_every_size(spark):
    """Brute force: neither the lines' order nor a group's size has a say."""
    rnd = random.Random(5)
    texts = []
    for k in range(70):
        lines = []
        for stem in range(6):
            n = (4, 6, 8, 8, 12, 13)[stem]
            t = [f"s{'abcdef'[stem]}w{chr(97 + i)}" for i in range(n)]
            for p in rnd.sample(range(3, n), rnd.randint(0, min(4, n - 3))):
                t[p] = rnd.choice(("red", "green", "blue", "grey", "5"))
            lines.append(" ".join(t))
        texts.append((k, "\n".join(lines)))
    texts += texts[:3]
    held = {}
    for row, (_, t) in enumerate(texts):
        for line in t.split("\n"):
            held.setdefault(tuple(linededup.masked(line)), set()).add(row)
    groups = {}
    for line in held:
        for g in linededup.groups_of(linededup.place(list(line), 3)[0], list(line), 3, 0.75):
            groups.setdefault(g, []).append(line)

    def similar(a, b):
        same = [x for x, y in zip(a, b, strict=True) if x == y]
        return len(same) >= 0.75 * len(a) and 2 * sum(x != "<*>" for x in same) >= len(a)

    gone = {a for a, rows in held.items() if len(rows) >= 5}
    for lines in groups.values():
        gone |= {a for a in lines if len(set().union(*(held[b] for b in lines if similar(a, b)), held[a])) >= 5}
    assert 0 < len(gone) < len(held)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    want = {(k, "\n".join(x for x in t.split("\n") if tuple(linededup.masked(x)) not in gone)) for k, t in texts}
    for leaf_lines in (2000, 25, 7, 3):
        assert {(r["doc_id"], r["kept_text"]) for r in linededup.drop_lines(docs, leaf_lines=leaf_lines).collect()} == want, leaf_lines
