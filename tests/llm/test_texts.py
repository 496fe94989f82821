from __future__ import annotations

import random

import numpy as np

from paragraf.llm import encodings, mixing, packing, scans, sentences

CZECH = "Soud dospěl k závěru, že žaloba byla podána opožděně a řízení o náhradu škody se zastavuje. Žalovaný tvrdil, že účastník smlouvu neuzavřel."


def languages(spark):
    rows = [(i, "cs", f"{CZECH} Dne {i}. května 2010 vyložil Šárčin úřad ťukání ďáblů – č. j. {i} C 5/2010, ňadra óda Ó Ň Ď Ť Ů Ý É Á Í Ú „věc“ § 5.") for i in range(60)]
    rows += [(i, "FR", "À l'été dernier, la cour a constaté que le délai avait expiré près du théâtre où ça va.") for i in range(100, 130)] + [(1000, None, "x"), (1001, "cs", None), (1002, "und", "abc" * 30)]
    return encodings.train(spark.createDataFrame(rows, "k long, lang string, text string"), "lang", "text", "cs")


def garble(t, wrong, right):
    if right == "utf-8":
        return "".join(encodings.SETS[wrong][b] for b in t.encode())
    out = []
    for ch in t:
        try:
            out.append(encodings.SETS[wrong][ch.encode(right)[0]] if ord(ch) > 127 else ch)
        except UnicodeEncodeError:
            out.append(ch)
    return "".join(out)


def test_chains_are_undone(spark):
    known = languages(spark)
    chains = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1250", "utf-8"), ("cp437", "utf-8"), ("cp1252", "cp1250"), ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"), ("cp1250", "cp852")]
    texts = {c: garble(CZECH, *c) for c in chains} | {"twice": garble(garble(CZECH, "cp1252", "utf-8"), "cp1252", "utf-8")}
    for chain, t in texts.items():
        assert encodings.judge(t, known)[0] == CZECH, chain
    for right in (CZECH, "", "Zboží dodala dánská firma Ærøskov & Søn, což žalovaný popřel před soudem v říjnu.", "obyčejný text", "dopis SÃO Ôlho předložil účastník řízení", "p. Müller a Ţiglău předložili žalobu"):
        assert encodings.judge(right, known) is None, right
    assert encodings.judge("Rozhodnut� soudu", known) == (None, "lost")
    df = spark.createDataFrame([(1, "ok\n" + texts["twice"], 5), (2, None, 5), (3, "", 5), (4, CZECH, 5), (5, "Kup� smlouva", 5)], "k long, text string, restored int")
    got = {r.k: (r.restored, r.lost_lines) for r in encodings.wrongly_decoded(df, ["k"], "text", known).collect()}
    assert got == {1: ("ok\n" + CZECH, 0), 5: ("Kup� smlouva", 1)}
    assert encodings.wrongly_decoded(df.limit(0), ["k"], "text", known).count() == 0


def test_all_labelled_texts_train(spark, monkeypatch):
    """What stands far behind in a text, or in texts beyond some number, counts as well; a language may be trained in parts."""
    far = "Obyčejný úvod. " * 500
    rows = [(i, "cs", f"{far}\n{CZECH} Dne {i}. „věc“ Šárka Ň") for i in range(40)] + [(i, " CS", f"Obyčejný úvod číslo {i}. " + " ".join(str(i * n) for n in range(60))) for i in range(40, 1200)] + [(9999, "cs", "krátce ψ")] * 3
    df = spark.createDataFrame(rows, "k long, lang string, text string")
    known = encodings.train(df, "lang", "text", "cs")
    assert {ch for ch in CZECH + "Š„“Ň" if ch > "\x7f"} == known.plain() and {"„_", "_“"} <= known.beside  # ψ is in 3 of 1203 texts
    assert known.length(CZECH) < 0.4 * len(CZECH.encode())
    again = encodings.train(df.repartition(7), "lang", "text", "cs")
    assert again.dictionaries == known.dictionaries and again.known == known.known
    monkeypatch.setattr(encodings, "PART_BYTES", 100_000)
    monkeypatch.setattr(encodings, "MERGED", 2)
    parts = encodings.train(df, "lang", "text", "cs")
    assert parts.known == known.known and parts.length(CZECH) < 0.4 * len(CZECH.encode())
    for each in (known, parts):
        assert encodings.judge(CZECH, each) is None and encodings.judge(garble(CZECH, "cp1250", "cp852"), each)[0] == CZECH


def test_differencing_packs_all(spark):
    rng = random.Random(1)
    sizes = np.array([rng.randint(1, 900) for _ in range(150)])
    window = packing.pack(sizes, 1000)
    sums = np.bincount(window, sizes)
    assert sums.max() <= 1000 and len(sums) <= 1.15 * -(-sizes.sum() // 1000) and len(window) == len(sizes)
    rows = [(i, "ž" * rng.randint(0, 3000), 1) for i in range(120)] + [(500, None, 1), (501, "", 1), (502, "x" * 999, 1), (503, "x" * 1000, 1), (0, None, 1), (None, "abc", 1)]
    docs = spark.createDataFrame([*rows, rows[7]], "doc long, text string, size int")
    kinds = spark.createDataFrame([("a", 1000), ("b", 5000), (None, 5), ("c", 0)], "container string, capacity int")
    filled = packing.fill(docs, "doc", "text", kinds).collect()
    want = {i: len(t.encode()) + 1 for i, t, _ in rows if i is not None and t is not None}
    for kind, capacity in (("a", 1000), ("b", 5000)):
        mine = [r for r in filled if r.container == kind]
        held, windows = {}, {}
        for r in mine:
            held[r.doc] = held.get(r.doc, 0) + r.size
            place = ("full", r.doc, r.piece_no) if r.block == -1 else (r.block, r.window)
            windows[place] = windows.get(place, 0) + r.size
        assert held == want and max(windows.values()) <= capacity
        assert {r.doc for r in mine if r.pieces > 1} == {i for i, s in want.items() if s > capacity}
    assert packing.fill(docs.limit(0), "doc", "text", kinds).count() == 0


def test_many_kinds_and_tiny_texts(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(40)], "doc long, text string")
    kinds = spark.createDataFrame([(f"k{i}", 5 + i) for i in range(1001)], "container string, capacity int")
    filled = packing.fill(docs, "doc", "text", kinds)
    assert filled.select("container").distinct().count() == 1001
    got = {r.container: r for r in packing.cover(filled, kinds, 0.5).collect()}
    assert all(r.docs == 40 and r.tokens == 155 and r.overfull == 0 for r in got.values()) and got["k0"].parted == 10
    tiny = np.ones(200_000, np.int64)
    window = packing.pack(tiny, 65_536)
    assert np.bincount(window).max() <= 65_536 and len(np.unique(window)) <= 4


def test_an_unsolved_source_is_an_error(spark, monkeypatch):
    import pytest

    docs = spark.createDataFrame([(i, "x" * (10 + i), "ab"[i % 2]) for i in range(200)], "doc long, text string, source string")
    targets = mixing.wanted(spark.createDataFrame([("a", 0.3, 2), ("b", 0.7, 2)], "source string, target_share double, max_repeats int"))
    documents = mixing.sized(docs, "doc", "text", "source", targets)
    assert max(r.residual for r in mixing.solve(mixing.counted(documents), targets).collect()) <= mixing.CLOSE
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(ArithmeticError):
        mixing.solve(mixing.counted(documents), targets)


def test_mix_reaches_targets(spark):
    rng = random.Random(2)
    docs = [(i, "x" * rng.randint(10, 400), rng.choice(["a", " A", "b", "c", None])) for i in range(4000)] + [(9000, None, "a"), (9001, "", "b")]
    frame = spark.createDataFrame(docs, "doc long, text string, source string")
    targets = mixing.wanted(spark.createDataFrame([("a", 0.2, 1), ("b", 0.4, 3), ("c", 0.3, 1), ("gone", 0.1, 4), (None, 0.5, 1)], "source string, target_share double, max_repeats int"))
    documents = mixing.sized(frame, "doc", "text", "source", targets)
    selection, shares = mixing.mix(documents, targets)
    got = {r.source: r for r in shares.collect()}
    for r in got.values():
        assert r.reachable == (r.goal <= r.repeats * r.own)
        if r.reachable:
            assert abs(r.tokens - r.goal) <= 0.01 * r.goal + 400
    assert not got["gone"].reachable and max(r.copies for r in selection.collect()) <= 3
    assert mixing.mix(documents.limit(0), targets)[0].count() == 0


def units(spark, *texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, unit_no int")
    out = {}
    for r in sentences.sentence_units(df, "doc_id", "text").orderBy("doc_id", "char_start").collect():
        assert texts[r.doc_id][r.char_start : r.char_end] == r.text
        out.setdefault(r.doc_id, []).append(r.text)
    return [out.get(i, []) for i in range(len(texts))]


def test_sentences(spark):
    cases = [
        ["Podle § 5 odst. 2 písm. a) o. s. ř. soud uvedl, že Ing. J. Novák dluží 3.918,50 Kč.", "Zbytek zamítl."],
        ["Svědek uvedl: „Smlouvu jsem nečetl. Podepsal jsem ji až dne 27. 2. 2023.“", "Soud mu uvěřil (viz č. l. 5. Zbytek ne.) a rozhodl."],
        ["„To není pravda!“ namítl účastník.", "Svědek váhal… a poté mluvil?!", "Je to tak."],
        ["Am 7. Januar 2005 kam z. B. Frau Dr. Weiß, d. h. sie ging.", "Das war alles."],
        ["他知道。", "“他知道吗？”法官问道。", "证人说：「我没有。后来才签字。」", "利率为2.60%，如此……"],
        ["証人は「読んでいません。署名しました。」と述べた。", "棄却する！"],
        ["यह निर्णय है!", "डॉ. Petr की रिपोर्ट है।", "अपील खारिज।"],
        ["هذا غير صحيح!", "قال: «لم أقرأ. وقعت.»", "هل يجوز؟"],
    ]
    joined = [("" if i in (4, 5) else " ").join(c) for i, c in enumerate(cases)]
    assert units(spark, *joined) == cases
    assert units(spark, "สัญญาข้อ 10 เป็นโมฆะ ศาลยกฟ้อง", "II. Nadpis\n\na) první;\nb) druhý;\n1. Třetí bod.", None or "", " \n\t", "퟿. A. B") == [
        ["สัญญาข้อ 10 เป็นโมฆะ", "ศาลยกฟ้อง"], ["II. Nadpis", "a) první;", "b) druhý;", "1. Třetí bod."], [], [], ["퟿. A. B"],
    ]
    wrapped = "Podle přípisu nebylo sporu o tom, že předkupní právo nebylo zapsáno\ndo katastru, ač o to věřitel žádal, nikoli však k rukám soudu prvního\nstupně. Ve věci soud dospěl k závěru."
    assert units(spark, wrapped)[0] == [wrapped[:wrapped.index(" Ve věci")], "Ve věci soud dospěl k závěru."]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sentences.sentence_units(empty, "doc_id", "text").count() == 0
    nulls = spark.createDataFrame([(1, None), (None, "Ano. Ne.")], "doc_id long, text string")
    assert [r.text for r in sentences.sentence_units(nulls, "doc_id", "text").collect()] == ["Ano.", "Ne."]


def test_long_text_offsets(spark):
    t = " ".join(f"Věta číslo {i}." for i in range(9000))
    private = "Znak \uf8d8 a \uf8d2 je tu. " + t
    assert units(spark, t, private) == [[f"Věta číslo {i}." for i in range(9000)], ["Znak \uf8d8 a \uf8d2 je tu.", *(f"Věta číslo {i}." for i in range(9000))]]


def test_scans(spark):
    pages = []
    for p in range(3):
        pages.append(f"Soud dospěl k závěru, že žaloba byla podána opož-\ndění strana {'abc'[p]} nedoložila listinu ani smlouvu\nPočet hlasů:\n{p * 7 + 3}\nUčebnice řízení Novák | {10 + p}\n")
    broken = "Poslední odvo¬\n– 14 –\n\nlací řízení před souclem.\n"
    good = [(f"k{i}", None, "Řízení před soudem a soudem bylo odvolací podle zákona.\n", 1) for i in range(30)]
    clean = "[s. 5]\nText roz-\ndělený\n12"
    df = spark.createDataFrame([("a", "Učebnice řízení Novák", "".join(pages) + broken, 1), ("a", "Učebnice řízení Novák", "".join(pages) + broken, 1), ("c", None, clean, 1), ("n", None, None, 1), ("e", None, "", 1), (None, None, "x", 1), *good], "key string, title string, text string, n int")
    got = {(r.key, r.line_no, r.kind) for r in scans.noise(df, "key", "text", "title").collect()}
    assert got == {("a", 5 * p, "hyphen") for p in range(3)} | {("a", 5 * p + 4, "header") for p in range(3)} | {("a", 15, "hyphen"), ("a", 16, "pageno"), ("a", 18, "ocr")}
    text = {r.key: r.text for r in scans.repaired(df, "key", "text", "title").collect()}
    assert text["c"] == clean and text["e"] == "" and "Poslední odvolací řízení před soudem." in text["a"] and "Učebnice" not in text["a"]
    assert scans.noise(df.limit(0), "key", "text", "title").count() == 0


def test_one_marked_line_declares_nothing(spark):
    noisy = "# 5 kusů\n" + "Soud dospěl k závěru, že žaloba byla podána opož-\nděně.\n" * 12
    got = scans.noise(spark.createDataFrame([("a", noisy)], "key string, text string"), "key", "text").where("kind = 'hyphen'")
    assert {r.line_no for r in got.collect()} == set(range(1, 25, 2))


def test_marks_behind_their_letters(spark):
    good = [(f"k{i}", "Zaplatil rozhodčí nález a nový důkaz podle zákona.\n") for i in range(12)]
    hit = "Podle rozhodc\u030cí listiny\nDu°kaz provedl soud. Hodnota n° 5 je 18 °C.\nPodle c\u030c. j. 5 c\u030c-\ntenář vadc\u030c-\nnou vec\u030c odmítl"
    df = spark.createDataFrame([("a", hit), *good, ("h", "वह निर्णय है और हिन्दी में है")], "key string, text string")
    got = {(r.key, r.line_no, r.kind) for r in scans.noise(df, "key", "text").collect()}
    assert got == {("a", n, "ocr") for n in (0, 1, 2, 3, 4)} | {("a", n, "hyphen") for n in (2, 3)}
    text = {r.key: r.text for r in scans.repaired(df, "key", "text").collect()}
    assert text["a"] == "Podle rozhodčí listiny Důkaz provedl soud. Hodnota n° 5 je 18 °C. Podle č. j. 5 čtenář vadčnou več odmítl" and text["h"] == "वह निर्णय है और हिन्दी में है"
