from __future__ import annotations

from pyspark.sql import functions as F

from paragraf.functions import identifiers as ids
from paragraf.operators import provisions, spans


def told(spark, text, year=2020):
    df = spark.createDataFrame([(1, text, year)], "k int, t string, y int")
    return [(r.act, r.provision) for r in provisions.references(df, "k", "t", "y").orderBy("n", "provision").collect()]


def test_lists_ranges_and_acts(spark):
    assert told(spark, "podle § 2913 odst. 1 písm. b) zákona č. 89/2012 Sb.") == [("zak:89/2012", "par:2913/o1/pb")]
    assert told(spark, "§§ 2910 až 2913 obč. zák.") == [("zak:40/1964", f"par:{n}") for n in range(2910, 2914)]
    assert [p for _, p in told(spark, "čl. 6 odst. 1 písm. a) až c) Listiny")] == ["cl:6/o1/pa", "cl:6/o1/pb", "cl:6/o1/pc"]
    assert [p for _, p in told(spark, "§ 5 odst. 1 a 2 o. z., § 9")] == ["par:5/o1", "par:5/o2", "par:9"]
    assert told(spark, "§ 142 o. s. ř. a dále § 151") == [("zak:99/1963", "par:142"), ("zak:99/1963", "par:151")]
    assert told(spark, "§ 1 tr. zák.", 2005) == [("zak:140/1961", "par:1")] and told(spark, "§ 1 tr. zák.", 2011) == [("zak:40/2009", "par:1")]
    assert told(spark, "§ 10 až 900") == [(None, "par:10"), (None, "par:900")] and told(spark, "nic") == [] and told(spark, None) == []


def test_definitions(spark):
    df = spark.createDataFrame([(1, "podle zákona č. 168/1999 Sb., o pojištění (dále jen „zákon o pojištění“) soud")], "k int, t string")
    assert [(r.name, r.act) for r in provisions.definitions(df, "k", "t").collect()] == [("zákon o pojištění", "zak:168/1999")]


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_identifiers(spark):
    text = "sp. zn. 29 Cdo 12/99, směrnice Rady 93/13/EHS, nařízení Rady (ES) č. 44/2001, ECLI:CZ:NS:2012:31.Nd.1195.2010.1. a doi 10.1000/abc(1)2). Zákon č. 89/2012 Sb."
    got = {(r.kind, r.ident) for r in ids.keys(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").collect()}
    assert got == {("case", "sz:29 cdo 12/1999"), ("eu", "eu:31993L0013"), ("eu", "eu:32001R0044"), ("ecli", "ecli:cz:ns:2012:31.nd.1195.2010.1"), ("doi", "doi:10.1000/abc(1)2"), ("act", "zak:89/2012")}
    own = "podle rozhodnutí č. 447/2016 a ROZHODNUTÍ RADY Č. 5/2016"
    assert [(r.kind, r.ident) for r in ids.keys(spark.createDataFrame([(1, own)], "k int, t string"), "k", "t").collect()] == [("eu", "eu:32016D0005")]
    assert one(spark, ids.celex_of_case, "C-283/81") == "61981CJ0283" and one(spark, ids.celex_of_case, "C-5/2010") == "62010CJ0005"
    assert one(spark, ids.isbn10_to_13, "80-7179-000-1") == "9788071790006" and one(spark, ids.isbn10_to_13, "12") is None
    assert one(spark, ids.displayed, "sz:ii. ús 5/2010") == "II. ÚS 5/2010" and one(spark, ids.court_of_key, "sz:2 afs 5/2010") == "nss"
    assert one(spark, ids.celex_motif, "čl. 17 odst. 2") == "*A17P2*" and one(spark, ids.procedure_form, "2016/0379(COD)") == "exact" and one(spark, ids.procedure_form, "2016/0379") == "prefix"
    assert one(spark, ids.trimmed_doi, "10.1/" + ")" * 40_000) == "10.1/"


def test_covers_and_windows(spark):
    df = spark.createDataFrame([(1, "a x b y a b"), (2, "a"), (3, None)], "k int, t string")
    got = spans.cover_density(spans.positions(df, ["k"], "t", ["a", "b"]), ["k"], ["a", "b"], 1.0).collect()
    # a x b, b y a, a b
    assert [(r.k, r.covers, r["rank"]) for r in got] == [(1, 3, round(1 / 2 + 1 / 2 + 1, 6))]
    pages = spark.createDataFrame([(1, i, s) for i, s in enumerate([30, 30, 50, 200, 10])], "k int, page int, size int")
    assert [r.window_no for r in spans.read_windows(pages, ["k"], "page", "size", 100).orderBy("page").collect()] == [0, 0, 1, 2, 3]
    cut = spark.createDataFrame([("Dlouhý text o smlouvě.",)], "t string").select(spans.whole_words(F.col("t"), F.lit(3), 12).alias("w")).first().w
    assert cut == "… text o …"


def test_accepted_numbers(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 3, 2, 2, 3])], "k int, line_no int, number int")
    assert [(r.line_no, r.number) for r in spans.accepted(rows, ["k"], "line_no", "number").orderBy("line_no").collect()] == [(0, 1), (2, 2), (4, 3)]
