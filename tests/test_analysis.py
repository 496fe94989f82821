from __future__ import annotations

import pytest

from paragraf.functions import analysis, queries


@pytest.mark.parametrize("word, term", [("smlouvách", "smlouv"), ("rozsudkem", "rozsudk"), ("promlčení", "promlcen"), ("vlastnického", "vlastnick"), ("2913a", "2913a"), ("č", "c"), ("", "")])
def test_index_terms(word, term):
    assert analysis.index_term(word) == term


@pytest.mark.parametrize("word, terms", [("soudců", ["soudc", "soudk"]), ("smlouvami", ["smlouv", "smluv"]), ("odpovědnost", ["odpovednost"]), ("право", [])])
def test_query_terms(word, terms):
    assert analysis.query_terms(word) == terms


FORMS = ["smlouva smlouvy smlouvě smlouvu smlouvou smlouvám smlouvách smlouvami", "rozsudek rozsudku rozsudkem rozsudky rozsudků rozsudkům", "žaloba žaloby žalobě žalobu žalobou žalob", "soud soudu soudem soudy soudů soudům soudech", "promlčení promlčením"]


@pytest.mark.parametrize("forms", FORMS)
def test_every_form_finds_every_other(forms):
    words = forms.split()
    for asked in [*words, *map(analysis.fold, words)]:
        prefixes = analysis.query_terms(asked)
        assert all(any(analysis.index_term(w).startswith(p) for p in prefixes) for w in words), (asked, prefixes)


def test_fold_covers_all_letters(spark):
    from pyspark.sql import functions as F

    from paragraf.functions.text import fold

    rows = ["þorður ħŧı ạ ḿ ǎ Žluťoučký KŮŇ Straße Łódź Ærø", "がぎ हिन्दी ё Ά", None, ""]
    got = [r.y for r in spark.createDataFrame([(r,) for r in rows], "x string").select(fold(F.col("x")).alias("y")).collect()]
    assert got == [analysis.fold(r) if r is not None else None for r in rows] and got[0] == "thordur hti a m a zlutoucky kun strasse lodz aero"


def test_terms_over_a_vocabulary(spark):
    df = spark.createDataFrame([("soudem", 1), ("soudem", 2), (None, 3), ("5", 4)], "w string, word int")
    assert {(r.word, r.term) for r in analysis.index_terms(df, "w").collect()} == {("soudem", "soud"), ("5", "5")}


def test_trees():
    every, some = queries.tree('„kupní smlouva“ soudců 5')
    assert every == "('kupn' <-> 'smlouv') & ('soudc':* | 'soudk':*) & '5'" and some == every.replace(" & ", " | ")
    assert queries.tree("") == ("", "") and queries.well_formed(every) and queries.well_formed("!'a':*AB & ('b' <2> 'c')")
    for bad in ("", "'a' &", "('a'", "'a' 'b'", "a & b", "'a')", "& 'a'"):
        assert not queries.well_formed(bad), bad
    assert queries.variants(["Kupní  smlouva", "kupní smlouva ", "", "a", "b", "c"]) == ["Kupní smlouva", "a", "b"]
    assert queries.excerpt_terms('„náhrada škody“ AND auto') == ["náhrada škody", "náhrada škody auto", "náhrada", "škody", "auto"]
    assert queries.domino('náhrada "kupní cena" žalob? § 5') == 'náhrada AND "kupní cena" AND (žalob OR žalob?) AND 5' and queries.domino('a "b (c') == "a AND b AND c"
