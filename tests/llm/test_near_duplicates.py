from __future__ import annotations

import random
import unicodedata

import numpy as np
from hypothesis import example, given, settings, strategies as st

from paragraf.functions.codepoints import shingle_sets, slices
from paragraf.llm import near_duplicates as nd


def grams(t, width):
    w = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t or "").lower().split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, width, limit):
    sets = {i: grams(t, width) for i, t in docs.items()}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] | sets[b] and len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b]) - 1e-12}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"slovo{i}" for i in range(90)] + ["ŽLUŤ", "žluť", "a1", "𝒜b"]
    docs = {}
    for i in range(25):
        docs[i] = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 30, 200])))
    for i in range(25, 90):
        words = docs[rng.randrange(25)].split()
        for _ in range(rng.randint(0, max(1, len(words) // 10))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs[i] = rng.choice([" ", ", ", "\n"]).join(words[: max(1, int(len(words) * rng.choice([1, 1, 0.9])))])
    return docs | {200: None, 201: "", 202: "jedno", 203: docs[24].upper()}


def test_pairs_equal_brute_force(spark):
    for seed, width, limit in ((1, 3, 0.75), (2, 5, 0.8)):
        docs = corpus(seed)
        df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs.items()] + [(3, docs[3], 1, "x"), (None, "a b c d", 1, "x")], "decision_id long, body string, id int, doc string")
        for hot in (nd.HOT, 3):
            got = {(r.id_a, r.id_b) for r in nd.similar_pairs(df, "decision_id", "body", width, limit, hot=hot).collect()}
            assert got == brute(docs, width, limit) and got


def test_every_pair_of_a_hot_gram_meets_in_one_cell():
    doc = np.arange(50, dtype=np.int64)
    row, cell, side = nd._cells(doc, np.full(50, 50), 8)
    met = {}
    for c in np.unique(cell).tolist():
        mine = [(int(r), int(s)) for r, x, s in zip(row, cell, side) if x == c]
        for i, (r, s) in enumerate(mine):
            for q, z in mine[i + 1 :]:
                if s == 0 or s != z:
                    met[r, q] = met.get((r, q), 0) + 1
    assert {tuple(sorted(k)) for k in met} == {(a, b) for a in range(50) for b in range(a + 1, 50)} and set(met.values()) == {1}


def test_overlaps_equal_set_intersection():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(0, 300))) for _ in range(30)]
    a, b = np.triu_indices(30, 1)
    for limit in (0.0, 0.3, 0.75):
        got = nd._overlaps(sets, a, b, limit)
        for i, j, n in zip(a.tolist(), b.tolist(), got.tolist()):
            both = len(np.intersect1d(sets[i], sets[j]))
            near = both >= limit / (1 + limit) * (len(sets[i]) + len(sets[j])) - 1e-6
            assert n == (both if near else -1)


def test_copies_may_be_written_out(spark):
    n = nd.EXPAND + 6
    df = spark.createDataFrame([(i, "jedna dvě tři čtyři pět") for i in range(n)], "k long, t string")
    assert nd.similar_pairs(df, "k", "t", 3, 0.75, expand=None).count() == n * (n - 1) // 2


def test_groups_are_components(spark):
    docs = corpus(3)
    df = spark.createDataFrame(list(docs.items()), "k long, t string")
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(docs, 3, 0.75):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.group_id for r in nd.groups(df, "k", "t", 3, 0.75).collect()}
    assert got == {i: root(i) for i in docs}


def test_different_texts_of_a_large_class_are_all_pairs(spark):
    n = nd.EXPAND + 3
    docs = {i: "jedna dvě tři čtyři pět" + "." * i for i in range(n)} | {n + i: "jedna dvě tři čtyři pět!" for i in range(n)} | {2 * n: "jedna dvě tři čtyři pět šest"}
    df = spark.createDataFrame(list(docs.items()), "k long, t string")
    got = {(r.id_a, r.id_b) for r in nd.similar_pairs(df, "k", "t", 3, 0.75).collect()}
    shown = [*range(n + 1), 2 * n]
    assert got == {(a, b) for a in shown for b in shown if a < b} | {(n, i) for i in range(n + 1, 2 * n)}
    assert {(r.id, r.copy_of) for r in nd.copies(df, "k", "t").collect()} == {(i, n if n <= i < 2 * n else i) for i in docs}


def test_long_chains_stay_whole(spark):
    # windows that overlap by most of their words, with the keys in random order
    rng = random.Random(4)
    keys = rng.sample(range(1000), 300)
    docs = {k: " ".join(f"w{j}" for j in range(i * 5, i * 5 + 60)) for i, k in enumerate(keys)}
    df = spark.createDataFrame(list(docs.items()), "k long, t string")
    for few in (0, nd.FEW):
        got = nd.groups(df, "k", "t", 3, 0.75, few=few).collect()
        assert {(r.group_id, r.members) for r in got} == {(min(keys), 300)} and sum(r.links for r in got) == 2 * 299


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 120)] + [(500, j) for j in range(501, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    edges = [(a, b) for a, b in edges if a != b]
    nodes, roots = nd._roots(np.array(edges))
    want = dict(zip(nodes.tolist(), roots.tolist()))
    assert all(want[a] == want[b] for a, b in edges) and all(want[i] == 0 for i in range(121)) and want[559] == 500
    links = spark.createDataFrame(edges, "doc_a long, doc_b long")
    for few in (0, 20):
        got = {r.doc: r.root for r in nd.components(links, few).collect()}
        assert len(set(zip(got.values(), (want[k] for k in got)))) == len(set(got.values())) == len(set(want.values())) and set(got) == set(want)


def test_a_large_class_is_a_star(spark):
    n = nd.EXPAND + 20
    df = spark.createDataFrame([(i, "jedna dvě tři čtyři pět") for i in range(n)] + [(n, "jedna dvě tři čtyři pět šest")], "k long, t string")
    got = {(r.id_a, r.id_b) for r in nd.similar_pairs(df, "k", "t", 3, 0.75).collect()}
    assert got == {(0, i) for i in range(1, n)} | {(0, n)}


def test_empty(spark):
    df = spark.createDataFrame([], "k long, t string")
    assert nd.similar_pairs(df, "k", "t").count() == 0 and nd.groups(df, "k", "t").count() == 0


@settings(max_examples=60)
@example(["0\U0003d0001"], 1)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=6), st.integers(1, 3))
def test_shingle_sets_follow_the_words(texts, width):
    import pyarrow as pa

    got = [s for _, _, cps, rows in slices(pa.array(texts, pa.string()), 20) for s in shingle_sets(cps, rows, width)]
    assert [len(s) for s in got] == [len(grams(t, width)) for t in texts]
    same = [s for _, _, cps, rows in slices(pa.array(texts, pa.string())) for s in shingle_sets(cps, rows, width)]
    assert all(np.array_equal(a, b) for a, b in zip(got, same, strict=True))
