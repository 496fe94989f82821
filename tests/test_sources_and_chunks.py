from __future__ import annotations

import json

import pytest
from hypothesis import given, settings, strategies as st

from paragraf.operators import chunks, terms
from paragraf.sources import answers
from paragraf.sources.requests import Request


def test_chunks_of_short_and_unbroken_texts():
    assert chunks.spans("  Krátký text.\n") == [(2, 14)]
    assert [b - a for a, b in chunks.spans("x" * 6000)] == [2400, 2400, 1200]
    assert chunks.spans("") == [] and chunks.spans(" \n ") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["slovo", "věta. ", "\n", " ", "x" * 500, "𝄞"]), max_size=300))
def test_chunks_cover_all_ink_in_order(parts):
    text = "".join(parts)
    got = chunks.spans(text)
    assert all(0 < b - a <= chunks.MOST for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert "".join("".join(text[a:b].split()) for a, b in got) == "".join(text.split())


def test_search_strings():
    assert terms.parse('že "kupní smlouva" a Cena cena') == terms.Terms(("cena",), (("kupní", "smlouva"),))
    assert terms.parse("a že").words == ("a", "že")
    assert terms.parse('nedokončená "fráze slov').words == ("nedokončená", "fráze", "slov")
    assert terms.parse("") == terms.Terms()


def test_matches(spark):
    df = spark.createDataFrame([(1, "Kupní smlouva zní."), (2, "smlouva kupní"), (3, None)], "k int, t string")
    assert [(r.k, r.ladder) for r in terms.matches(df, "t", '"kupní smlouva"').collect()] == [(1, "and")]
    assert {(r.k, r.ladder) for r in terms.matches(df, "t", "smlouva nic").collect()} == {(1, "or"), (2, "or")}


def test_requests_are_checked_before_planning():
    for bad in ({"since": "2021-02-30"}, {"since": "2021-01-02", "until": "2021-01-01"}, {"limit": 0}):
        with pytest.raises(ValueError):
            Request(**bad)


def test_pages_and_drift(spark):
    rows = [(1, json.dumps({"items": [{"a": "x", "b": 1}, {"a": None}]})), (2, "{broken"), (3, json.dumps({"other": 1})), (4, None)]
    got, drift = answers.json_items(spark.createDataFrame(rows, "k int, p string"), "p", "items array<struct<a: string, b: int>>", "items", ["k"])
    assert sorted((r.k, r.place, r.a, r.b) for r in got.collect()) == [(1, 0, "x", 1), (1, 1, None, None)]
    assert {r.k for r in drift.collect()} == {2, 3, 4}


def test_bindings_first_wins(spark):
    page = json.dumps({"results": {"bindings": [{"id": {"value": "1"}, "t": {"value": "a"}}, {"id": {"value": "1"}, "t": {"value": "b"}}, {"t": {"value": "c"}}, {"id": {"value": "2"}}]}})
    got = answers.bindings(spark.createDataFrame([(7, page)], "k int, p string"), "p", ["k"], ["id", "t"], "id")
    assert {(r.id, r.t) for r in got.collect()} == {("1", "a"), ("2", None)}


def test_merge_fills_gaps(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("10.1/A", "T", None), ("10.1/a ", None, 2001), (None, "Other", 2000)], "doi string, title string, year int")
    got = {r.record_key: (r.title, r.year, r.listings) for r in answers.merged(df, answers.record_key(F.col("doi"), F.col("title"), F.col("year"), F.lit("x")), ["doi", "title", "year"]).collect()}
    assert got["doi:10.1/a"] == ("T", 2001, 2) and len(got) == 2


def test_structural_chunks_keep_to_headings():
    text = "# A\n" + "Věta. " * 500 + "\n[m. č. 1] Bod.\n# B\nkrátce"
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line), chunks._kind(line)))
        at += len(line) + 1
    got = chunks.structural(lines, text)
    assert "".join("".join(text[a:b].split()) for a, b in got) == "".join(text.split()) and all(b - a <= chunks.MOST for a, b in got)
    assert text[got[-1][0] : got[-1][1]] == "# B\nkrátce"


def test_dissents(spark):
    body = "Nález.\nUplatňuji tímto odlišné stanovisko.\nO d l i š n é  s t a n o v i s k o\n" + "x" * 400 + "\n2. Odlišné stanovisko soudkyně\nkonec"
    got = chunks.dissents(spark.createDataFrame([(1, body), (2, None), (3, "nic")], "k int, t string"), "k", "t").orderBy("no").collect()
    assert [(r.no, body[r.char_start : r.char_end].split("\n")[0]) for r in got] == [(0, "O d l i š n é  s t a n o v i s k o"), (1, "2. Odlišné stanovisko soudkyně")]


def test_dissents_shuffle_no_texts(spark):
    """Headings in the row: neither the text nor its lines go through a sort, and what is near is told as before."""
    import re

    from pyspark.sql import functions as F

    def plain(t):
        heads, at = [], 0
        for line in t.split("\n"):
            letters = re.sub(r"[ \t\x0b\f\r]+", "", line)
            start = at + len(line) - len(line.lstrip(" "))
            if len(line.strip(" ")) <= chunks.MOST_HEADING and re.match("([0-9]{1,2}\\.)?odlišn[éáý]stanovisk", letters, re.I) and (not heads or start - heads[-1][0] >= chunks.SAME):
                heads.append((start, line.strip(" \r")))
            at += len(line) + 1
        return [(n, a, heads[n + 1][0] if n + 1 < len(heads) else len(t), h) for n, (a, h) in enumerate(heads)]

    head = "Odlišné stanovisko"
    texts = [
        f"{head}\r\n\t1 2 . ODLIŠNÁ STANOVISKA 𝄞\n" + "é𝄞 " * 200 + f"\n  {head} soudce \n" + "\n" * 400 + "O d l i š n ý\ts t a n o v i s k o", f"\n{head}", "", "nic", f"{head} " + "x" * 200 + f"\n123. {head}\n{head}\n" * 150,
        f"{head}\n" + ("y" * 200 + f"\n{head}\n") * 4, f"a\u2028{head}\r{head}\x85{head}", "odlišné\nstanovisko\n1.\n2. odlišné stanovisko", f"{head}\n" * 3_000,
    ]
    df = spark.createDataFrame([*enumerate(texts), (1, texts[1]), (99, None)], "k int, t string")
    got = chunks.dissents(df, "k", "t")
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, *x) for k, t in enumerate(texts) for x in plain(t))
    large = spark.range(200).select("id", F.concat(F.repeat(F.lit("řádek textu\n"), 5_000), F.lit(head)).alias("t"))
    plan = chunks.dissents(large, "id", "t")._jdf.queryExecution().executedPlan().toString()
    sorts = re.findall(r"(?:Exchange|Sort|Window) .*", plan)
    assert sorts and "_l#" not in plan and not any(re.search(r"\b_?t#", x) for x in sorts)


def test_excerpts():
    from paragraf.operators import excerpts

    text = "První odstavec o ničem.\n" + "slovo " * 100 + "smlouva a smlouvy se uzavírají. " + "jiné " * 200 + "smluvní."
    spans = excerpts.matches(text, ["smlouv"])
    assert [text[a:b] for a, b in spans] == ["smlouva", "smlouvy"]
    start, end, shown = excerpts.best_window(text, spans, 120)
    assert end - start <= 120 and "smlouva a smlouvy" in shown and shown.startswith("…") and shown.endswith("…")
    assert excerpts.best_window("Smlouva zní.", [(0, 7)], 600)[2] == "Smlouva zní." and excerpts.best_window("x", []) is None
    count, windows, told = excerpts.stretches("24. PROMLČENÍ nastalo.\njiný\nO promlceni.", "promlčení")
    assert (count, windows, told) == (2, 2, "24. PROMLČENÍ nastalo." + excerpts.GAP + "O promlceni.")
    assert excerpts.stretches("x", " ") == (0, 0, "")
