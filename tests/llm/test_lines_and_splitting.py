from __future__ import annotations

import random
import re
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from paragraf.llm import repeated_lines as rl, splitting as sp

BLANK = " \t\n\r "


def brute_lines(docs, least):
    seen, where = defaultdict(set), {}
    for i, source, body in docs:
        if source is None or body is None or i is None:
            continue
        for n, line in enumerate(body.split("\n")):
            same = re.sub("[ \t\n\r 0-9]", "", line).lower()
            if len(same) >= rl.LEAST_CHARS:
                seen[source, same].add(i)
                where[i, n] = (source, same)
    return {k for k, v in where.items() if len(seen[v]) >= least}


def run(spark, docs, least):
    texts = spark.createDataFrame([(i, b, "clash") for i, _, b in docs], "decision_id long, body string, id string")
    courts = spark.createDataFrame([(i, s, "clash") for i, s, _ in docs], "id long, court string, body string")
    bodies = rl.sourced(texts, "decision_id", "body", courts, "id", "court")
    found = rl.repeated_lines(bodies, least)
    return bodies, found


def test_lines_equal_brute_force(spark):
    rng = random.Random(1)
    notice = ["© 2017 Všechna práva vyhrazena, jen se souhlasem 12", "Čtete také: nejčtenější rozhodnutí týdne", "krátký řádek", "𝄞 " * 30, "İstanbul " * 5]
    docs = []
    for i in range(60):
        own = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(8)) for _ in range(6)]
        own[rng.randint(0, 5)] = rng.choice(notice).replace("12", str(i)) + ("\r" if i % 3 else " ")
        docs.append((i, rng.choice(["Soud A", "soud b"]), "\n".join(own)))
    docs += [(900, None, "\n".join(notice)), (901, "Soud A", None), (902, "Soud A", ""), (None, "Soud A", notice[0]), (0, "Soud A", docs[0][2])]
    docs[-1] = docs[0]
    _, found = run(spark, docs, 5)
    got = {(r.id, r.line_no) for r in found.collect()}
    want = brute_lines([(i, s.lower() if s else s, b) for i, s, b in docs], 5)
    assert got == want and want


def test_clean_and_empty(spark):
    docs = [(i, " Soud  A", f"vlastní text číslo {'abcdefghij'[i]}\nspolečný dlouhý řádek pro všechny dokumenty") for i in range(10)]
    bodies, found = run(spark, docs, 10)
    assert {r.body for r in rl.without_lines(bodies, found).collect()} == {f"vlastní text číslo {c}" for c in "abcdefghij"}
    _, none = run(spark, [], 2)
    assert none.count() == 0


def test_many_chunks_and_lines_are_joined_instead(spark, monkeypatch):
    docs = [(i, "Soud A", f"vlastní text číslo {i} a něco\nspolečný dlouhý řádek pro všechny dokumenty\n{'další shodný řádek ve všech rozhodnutích' if i % 2 else 'jiný'}") for i in range(12)]
    want = brute_lines(docs, 6)
    monkeypatch.setattr(rl, "SENT", -1)
    monkeypatch.setattr(rl, "FEW", -1)
    bodies, found = run(spark, docs, 6)
    assert {(r.id, r.line_no) for r in found.collect()} == want and len(want) == 18
    report = rl.chunk_report(bodies, 6).collect()
    assert {r.source for r in report} == {"soud a"} and {6, 12} <= {r.docs for r in report}


def inside(t, p):
    if not 0 < p < len(t) or t[p - 1] in BLANK or t[p] in BLANK:
        return False
    a, e = p, p
    while a > 0 and t[a - 1] not in BLANK:
        a -= 1
    while e < len(t) and t[e] not in BLANK:
        e += 1
    return e - a <= sp.MOST


def faults(t, pieces):
    top = max(n for n, _, _ in pieces)
    by = {n: (a, e) for n, a, e in pieces}
    for n, a, e in pieces:
        if e - a > sp.MOST or a >= e or e > len(t) or inside(t, a) or inside(t, e) or (n == 0 and t[:a].strip(BLANK)) or (n == top and t[e:].strip(BLANK)) or (n > 0 and n - 1 in by and not sp.LEAST_OVERLAP <= by[n - 1][1] - a <= sp.MOST_OVERLAP):
            yield n


def text_of(rng, size):
    out = []
    while sum(map(len, out)) < size:
        out.append(rng.choice(["slovo", "věta.", "x" * rng.choice([3, 90, 300]), "𝄞ž"]) + rng.choice([" ", " ", "\n", "\n\n", " ", "\r\n"]))
    return "".join(out)


def test_pieces_are_valid_and_faults_equal_brute_force(spark):
    rng = random.Random(2)
    texts = {i: text_of(rng, rng.choice([10, 2300, 2500, 9000])) for i in range(30)} | {100: "x" * 6000, 101: "", 102: " \n ", 103: "a " * 10 + "y" * 2401 + " konec"}
    df = spark.createDataFrame([(i, t, 7) for i, t in texts.items()] + [(5, texts[5], 7), (104, None, 7), (None, "a", 7)], "decision_id long, body string, ord int")
    got = defaultdict(list)
    for r in sp.pieces(df, "decision_id", "body").collect():
        got[r.id].append((r.ord, r.char_start, r.char_end))
    assert not {101, 102, 104} & set(got)
    for i, pieces in got.items():
        assert not list(faults(texts[i], sorted(pieces))), i
    stored = [(i, n, max(0, a + rng.choice([0, 0, 0, 3, -70])), e + rng.choice([0, 0, 0, 1, 5000])) for i in got for n, a, e in got[i]]
    frame = spark.createDataFrame([*stored, stored[0], (777, 0, 0, 5), (1, None, 0, 1)], "decision_id long, ord int, char_start int, char_end int")
    bad = {(r.id, r.ord) for r in sp.invalid_pieces(df, "decision_id", "body", frame, "decision_id").collect()}
    by = defaultdict(list)
    for i, n, a, e in stored:
        by[i].append((n, a, e))
    assert bad == {(i, n) for i, p in by.items() for n in faults(texts[i], p)} | {(777, 0)}


def test_long_run(spark):
    df = spark.createDataFrame([(1, "x" * 6000)], "k long, t string")
    assert [(r.char_start, r.char_end) for r in sp.pieces(df, "k", "t").orderBy("ord").collect()][0] == (0, 2400)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.data())
def test_sparse_table_is_rightmost_maximum(strength, data):
    import numpy as np

    table = sp.SparseTable(np.array(strength), len(strength))
    lo = data.draw(st.integers(0, len(strength) - 1))
    hi = data.draw(st.integers(lo, len(strength) - 1))
    top = max(strength[lo : hi + 1])
    want = max(i for i in range(lo, hi + 1) if strength[i] == top) if top else -1
    assert table.best(lo, hi) == want
