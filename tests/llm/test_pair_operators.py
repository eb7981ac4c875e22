"""Operators on pairs of documents, lines and vectors, against all pairs on small tables."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from driftwood.llm import jaccard_join, lattice, lines, passages
from driftwood.llm.components import connected_components

VOCABULARY = [f"w{i}" for i in range(400)]


def classes(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, lower, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def ascii_lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def mutate(rng, text, rate):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < rate else w for w in text.split(" "))


def corpus(seed, groups=12, size=9):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one two", "ONE  two", "one two three"]
    for _ in range(groups):
        base = " ".join(rng.choices(VOCABULARY, k=rng.randrange(5, 80)))
        texts += [base] * rng.randrange(1, 3)
        for _ in range(rng.randrange(size)):
            base = mutate(rng, base, rng.choice([0.0, 0.01, 0.03, 0.05]))
            texts.append(base)
    rng.shuffle(texts)
    return texts


def test_components_of_chains_hubs_and_repeats(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(100, 101), (7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_jaccard_join_against_all_pairs(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        sets = [shingles(t, ascii_lower) for t in texts]
        links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n", F.lit("clash")).repartition(3)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
        assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, classes(len(sets), links), strict=True))}


def test_jaccard_join_of_far_items_that_share_regions(spark):
    """Many texts of few popular lines: cells don't settle them, later rounds and windows do."""
    rng = random.Random(9)
    popular = [" ".join(rng.choices(VOCABULARY, k=9)) for _ in range(6)]
    texts = [" ".join(rng.sample(popular, rng.randrange(1, 4))) + f" {rng.choice(VOCABULARY)}" * rng.randrange(3) for _ in range(90)]
    sets = [shingles(t, ascii_lower) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(classes(len(sets), links)))


def test_pivots_without_a_cell_cost_no_distances(spark, monkeypatch):
    """Many texts that share most of a text that isn't there: all are near each other, few are linked."""
    rng, told = random.Random(4), []
    base = rng.choices(VOCABULARY, k=154)
    texts = []
    for i in range(60):
        own = list(base)
        for j in range(4):
            own[rng.randrange(38) + 38 * j] = f"own{i}x{j}"
        texts.append(" ".join(own))
    texts += [f"{texts[7]} more", f"{texts[20]} and more"]
    sets = [shingles(t, ascii_lower) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    near = sum(2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a))
    distances = jaccard_join._distances
    monkeypatch.setattr(jaccard_join, "_distances", lambda *a: told.append(distances(*a).cache()) or told[-1])
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(classes(len(sets), links)))
    assert near > 20 * len(texts) and sum(t.count() for t in told) <= 4 * len(texts)


def test_jaccard_join_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (5, "other words here"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect())
    assert got == [(-1, 2, None), (3, 2, 3), (5, 1, 3), (5, 2, 3), (8, 0, 8)]
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_lines_against_all_pairs(spark):
    rng = random.Random(3)
    texts = corpus(4, 8, 6)
    docs = [None, "", "\n\n", *("\n".join(rng.choices([t or "" for t in texts], k=rng.randrange(1, 7))) for _ in range(30)), "One line\nONE  line\nother"]
    held = [(d, n, shingles(x, str.lower)) for d, t in enumerate(docs) if t is not None for n, x in enumerate(t.split("\n"))]
    gone = {(d, n) for i, (d, n, s) in enumerate(held) if s and any(100 * len(s & r) >= 75 * len(s | r) for _, _, r in held[:i])}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").withColumns({"line": F.lit(1), "removed_lines": F.lit(2)}).repartition(3)
    out = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert {(d, n) for d, r in out.items() for n in r["removed_lines"]} == gone
    for d, t in enumerate(docs):
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)
        assert out[d]["text"] == want
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_lines_that_are_parts_of_longer_ones(spark):
    """A line of 31 words and its beginning, middle and end: tokens that no other prefix has count too."""
    rng = random.Random(12)
    docs = []
    for i in range(240):
        w = [f"z{rng.randrange(10**6)}" for _ in range(31)]
        part = (w[:25], w[3:28], w[6:])[i % 3]
        docs.append("\n".join([" ".join(w), " ".join(part)] if i % 2 else [" ".join(part), " ".join(w)]))
    shared = [f"y{i}" for i in range(31)]
    docs += [" ".join(shared[a : a + n]) for a, n in ((0, 31), (0, 25), (3, 25), (6, 25), (0, 24), (2, 28))]
    held = [(d, n, shingles(x, str.lower)) for d, t in enumerate(docs) for n, x in enumerate(t.split("\n"))]
    where: dict[str, list[int]] = {}
    for i, (_, _, s) in enumerate(held):
        for x in s:
            where.setdefault(x, []).append(i)
    gone = {(d, n) for i, (d, n, s) in enumerate(held) if any(j < i and 100 * len(s & held[j][2]) >= 75 * len(s | held[j][2]) for x in s for j in where[x])}
    assert len(gone) >= 240
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3)
    assert {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(df).collect()} == gone


def test_lines_of_rows_without_id_or_with_the_same(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e\nnew")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in lines.dedup_lines(df).collect())
    assert got == [(0, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "new")]


def test_passages_over_layers_of_partial_copies(spark):
    """Earlier documents hold overlapping parts of a passage, layer on layer; later ones hold it whole."""
    rng = random.Random(8)
    word = lambda n: [f"p{rng.randrange(10**7)}" for _ in range(n)]
    around = lambda part: " ".join([*word(60), *part, *word(60)])
    texts, want = [], set()
    for layers in (1, 2, 5):
        p = word(80)
        for _ in range(layers):
            texts += [around(p[:44]), around(p[36:])]
        texts += [around(p), around(p)]
        want.add((len(texts) - 1, len(texts) - 2))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {(r["doc_id"], r["ref_id"]): (r["start"], r["end"]) for r in passages.repeated_passages(df).collect()}
    assert want <= set(got)
    assert all(got[w] == (60, 140) for w in want)


def test_passages_that_repeat_and_those_that_dont(spark):
    rng = random.Random(6)
    many = [f"v{i}" for i in range(20_000)]
    make = lambda n: " ".join(rng.choices(many, k=n))
    shared = [make(n) for n in (60, 80, 120)]
    texts = [make(150) for _ in range(10)]
    for i, s in enumerate(shared):
        words = s.split(" ")
        words[30] = "changed"
        del words[45]
        texts += [make(40) + " " + s + " " + make(30), make(5) + " " + s, make(60) + " " + " ".join(words) + " " + make(50)]
    texts += [make(90) + " " + shared[0][:150] + " " + make(90), texts[0], texts[0].upper(), None, "", "few words", make(49)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("f1", F.lit("clash"))
    got = [r.asDict() for r in passages.repeated_passages(df).collect()]
    pairs = {(r["doc_id"], r["ref_id"]) for r in got}
    for i in range(3):
        a = 10 + 3 * i
        assert {(a + 1, a), (a + 2, a)} <= pairs
    assert {(20, 0), (21, 0)} <= pairs
    assert {d for p in pairs for d in p} == {0, 20, 21, *range(10, 19)}
    for r in got:
        x = (texts[r["doc_id"]].lower().split())[r["start"] : r["end"]]
        y = (texts[r["ref_id"]].lower().split())[r["ref_start"] : r["ref_end"]]
        assert min(len(x), len(y)) >= 50
        if r["identity"] == 1.0:
            assert x == y
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_passages_with_edits_against_all_diagonals(spark):
    """Pairs with 50 words or more from an equal word to another, 0.8 of them equal, wherever the changed ones stand."""
    rng = random.Random(11)
    many = [f"v{i}" for i in range(20_000)]
    texts = []
    for n in (50, 60, 100):
        for identity in (0.8, 0.82, 0.86, 0.88, 0.9, 0.92, 0.95):
            for even in (True, True, False, False):
                shared, edits = rng.choices(many, k=n), int(n * (1 - identity) + 1e-9)
                changed = list(shared)
                for j in [int((j + 0.5) * n / edits) for j in range(edits)] if even else rng.sample(range(n), edits):
                    changed[j] = f"other{rng.random()}"
                texts += [[*rng.choices(many, k=40), *shared, *rng.choices(many, k=30)], [*rng.choices(many, k=20), *changed, *rng.choices(many, k=50)]]
    want = set()
    for d, u in enumerate(texts):
        for r, v in enumerate(texts[:d]):
            for off in range(50 - len(u), len(v) - 49):
                lo = max(0, -off)
                a = u[lo : len(v) - off]
                if len(a) >= 50 and len(set(a) & set(v[lo + off :])) >= 40:
                    at = np.flatnonzero([p == q for p, q in zip(a, v[lo + off :])])
                    long, equal = at - at[:, None] + 1, np.arange(len(at)) - np.arange(len(at))[:, None] + 1
                    if ((long >= 50) & (equal >= 0.8 * long)).any():
                        want.add((d, r))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = passages.repeated_passages(df).collect()
    assert len(want) >= 80
    assert want == {(r["doc_id"], r["ref_id"]) for r in got}
    for r in got:
        assert min(r["end"] - r["start"], r["ref_end"] - r["ref_start"]) >= 50
        assert r["identity"] >= 0.8


def test_passages_whose_seeds_earlier_documents_have_in_parts(spark):
    rng = random.Random(12)
    many = [f"v{i}" for i in range(20_000)]
    make = lambda n: rng.choices(many, k=n)
    p, q = make(60), make(60)
    texts = [
        make(40) + p[:30] + make(40), make(40) + p[30:] + make(40), make(30) + p + make(30), make(20) + p + make(40),
        # The earliest document has the seeds in pieces first and the passage later.
        make(20) + q[30:45] + make(9) + q[45:] + make(9) + q[:15] + make(9) + q[15:30] + make(70) + q + make(20), make(25) + q + make(25),
    ]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["ref_id"], r["start"], r["end"], r["ref_start"]) for r in passages.repeated_passages(df).collect()}
    assert got == {(3, 2, 20, 80, 30), (5, 4, 25, 85, 177)}


def test_passages_that_several_earlier_documents_have(spark):
    """A passage of many documents links all of them, and one that an earlier document and another share out
    between them, each with too few of its seeds by itself, links with the other."""
    rng = random.Random(14)
    many = [f"v{i}" for i in range(20_000)]
    make = lambda n: rng.choices(many, k=n)
    p, q = make(60), make(60)
    edited = [w if i % 5 else f"e{i}" for i, w in enumerate(q[:50])] + q[50:]
    texts = [make(30) + p + make(20) for _ in range(4)] + [make(40) + q[50:] + make(40), make(20) + q + make(30), make(25) + edited + make(25)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["ref_id"]) for r in passages.repeated_passages(df).collect()}
    assert got == {(a, b) for a in range(4) for b in range(a)} | {(6, 5)}


def test_a_passage_in_a_text_of_repeated_lines(spark):
    """Places that repeat make longer chains, which must not take the passage's own diagonal away."""
    line = [f"r{i}" for i in range(5)]
    shared = line * 10 + ["end"]
    texts = [shared + [f"a{i}" for i in range(90)], shared + line * 40 + [f"b{i}" for i in range(90)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["ref_id"], r["start"], r["end"], r["ref_start"], r["ref_end"]) for r in passages.repeated_passages(df).collect()}
    assert (1, 0, 0, 51, 0, 51) in got


def test_a_chain_is_aligned_once():
    """Matches on one diagonal are one chain; of several diagonals none is told again by the Fenwick tree."""
    import pyarrow as pa

    one = [(9, 1, x, x + 5) for x in (*range(0, 12), *range(40, 52))]
    two = [(9, 2, x, x + 5) for x in range(0, 12)] + [(9, 2, x, x + 900) for x in range(400, 420)]
    rows = np.array(one + two, np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(4)], ["doc", "ref", "x", "y"])
    told = [tuple(map(str, r.values())) for b in passages._chain_batches(4, 10, 50)(iter([batch])) for r in b.to_pylist()]
    assert len(told) == len(set(told)) == 3
    assert passages.copied.__module__ == "driftwood.llm._common"


def test_chains_against_all_chains():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(1, 9)
        x, y = np.array([rng.randrange(30) for _ in range(n)]), np.array([rng.randrange(30) for _ in range(n)])
        best = 0.0
        for m in range(1, 1 << n):
            own = sorted((i for i in range(n) if m >> i & 1), key=lambda i: (x[i], y[i]))
            if all(x[a] < x[b] and y[a] < y[b] for a, b in zip(own, own[1:])):
                best = max(best, 6.0 * len(own) - passages.GAP * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(own, own[1:])))
        top = passages.chains(x, y)[0]
        score = 6.0 * len(top) - passages.GAP * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(top, top[1:]))
        assert abs(score - best) < 1e-9


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(8)
    y = rng.standard_normal((300, 8)) * 2
    p = lattice.decode_e8(y)
    whole = (p % 2 == 0).all(axis=1) | (p % 2 == 1).all(axis=1)
    assert whole.all()
    assert (p.sum(axis=1) % 4 == 0).all()
    near = p[:, None, :] + lattice.short_vectors()
    assert (((y - p / 2) ** 2).sum(axis=1)[:, None] <= ((y[:, None, :] - near / 2) ** 2).sum(axis=2) + 1e-9).all()


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((60, 32))
    close = base[rng.integers(0, 60, 120)] + rng.standard_normal((120, 32)) * rng.choice([0.05, 0.1, 0.2], (120, 1))
    x = np.concatenate((base, close, base[:5], base[:5] * 3)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 32), (n + 3, [float("nan")] * 32), (n + 4, [None] * 32), (n + 5, [float("inf")] + [1.0] * 31), (n + 6, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("label", F.lit(1))
    got = {r["vec_id"]: r for r in lattice.near_duplicates(df).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(n, dtype=bool)
    links = sum(r["n_links"] for r in got.values())
    assert links >= 0.9 * near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(n))
    assert all((r["n_links"], r["component_id"], r["kept"]) == (0, i, True) for i, r in got.items() if i >= n)
    want = classes(n, [(int(a), int(b)) for a, b in np.argwhere(near) if a > b])
    assert np.mean([got[i]["component_id"] == want[i] for i in range(n)]) > 0.9
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_vectors_meet_table_by_table(spark, monkeypatch):
    """What one table needs on disk is let go before the next one, and a pair found in all of them links once."""
    calls = []
    monkeypatch.setattr(lattice, "release", lambda s: calls.append(s), raising=False)
    x = np.random.default_rng(15).standard_normal(16)
    df = spark.createDataFrame([(i, [float(c) for c in x + 1e-4 * i]) for i in range(3)], "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in lattice.near_duplicates(df, tables=3).collect()) == [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False)]
    assert len(calls) == 3


def test_repeated_ids_of_other_vectors(spark):
    rng = np.random.default_rng(12)
    v, w = rng.standard_normal((2, 16))
    near = v + 0.01 * rng.standard_normal(16)
    rows = [(1, v), (1, w), (2, near), (3, w), (3, w), (None, v)]
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in rows], "vec_id bigint, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(df).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False)]


def test_recall_at_the_least_cosine(spark):
    """Pairs of 64 numbers at a cosine just above the threshold, where the fewest are found."""
    rng = np.random.default_rng(13)
    u, z = rng.standard_normal((2, 600, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    z -= (z * u).sum(axis=1)[:, None] * u
    z /= np.linalg.norm(z, axis=1)[:, None]
    x = np.concatenate((u, 0.9501 * u + np.sqrt(1 - 0.9501**2) * z))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in lattice.near_duplicates(df).collect()}
    assert np.mean([got[i + 600] == i for i in range(600)]) >= 0.95
