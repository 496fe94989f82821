from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from paragraf.functions import text
from paragraf.operators import joins, postings, search, upkeep, usage


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_fold_and_words(spark):
    assert one(spark, text.fold, "Žluťoučký kůň Straße Łódź Ærø") == "zlutoucky kun strasse lodz aero"
    assert one(spark, text.words, "smlouvy² e-mail don't §§ —") == ["smlouvy", "e", "mail", "don", "t"]
    assert one(spark, text.fold, None) is None


def test_case_keys(spark):
    assert one(spark, text.case_key, "29 ICm 3482/2011") == "sz:29 icm 3482/2011"
    assert one(spark, text.case_key, "I. ÚS 752/23") == "sz:i. ús 752/2023"
    assert one(spark, text.case_key, "nic") is None


def test_html_text(spark):
    assert one(spark, text.html_text, "<p>A&nbsp;&amp; B</p><script>x<y</script><br>C") == "A & B\n\nC"


def test_pages_of_empty_and_long(spark):
    assert [len(p.text) for p in one(spark, lambda c: text.pages(c, 4), "abcdefghi")] == [4, 4, 1]
    assert [p.text for p in one(spark, lambda c: text.pages(c, 4), "")] == [""]


def test_bm25_ladder(spark):
    df = spark.createDataFrame([(1, "a b", 1), (2, "a a c", 2), (3, None, 3), (4, "", 4)], "k int, t string, score int")
    index = postings.build(df, "k", "t", ["score"])
    assert (index.size, index.mean) == (3, 5 / 3)
    assert {r.k for r in postings.bm25(index, ["a", "b"]).collect()} == {1}
    assert {r.k for r in postings.bm25(index, ["c", "b"]).collect()} == {1, 2}
    assert {r.k for r in postings.bm25(index, ["a", "b"], where=F.col("dl") > 2).collect()} == {2}
    assert {r.term: r.df for r in index.like("a").collect()} == {"a": 2} and postings.phrase(index, df, "t", ["a", "c"]).count() == 1
    assert postings.bm25(index, ["nic"]).count() == 0 and postings.bm25(postings.build(df.limit(0), "k", "t"), ["a"]).count() == 0


def test_a_search_reads_the_buckets_of_its_terms_only(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 9 + 1))) for i in range(50)], "k int, t string")
    index = postings.build(df, "k", "t", buckets=32)
    plan = postings.bm25(index, ["w3"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "ReadSchema: struct<t:string" not in plan
    assert index.hits(["w3"]).count() == sum(i % 9 >= 3 for i in range(50))


def test_rrf_and_interleave(spark):
    a, b = spark.createDataFrame([("x", 1)], "k string, rank int"), spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    got = {r.k: (r.score, r.channels) for r in search.fuse({"and": a, "idn": b}, "k").collect()}
    assert got == {"x": (round(1 / 61 + 1.5 / 61, 9), 2), "y": (round(1.5 / 62, 9), 1)}
    lists = spark.createDataFrame([("p", 1, 1), ("q", 1, 2), ("q", 2, 1), ("r", 2, 2)], "k string, variant int, rank int")
    assert [r.k for r in search.interleave(lists, "variant", "rank", "k").orderBy("position").collect()] == ["p", "q", "r"]


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "u int, at int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (None, 3, "c")], "u int, t int, v string")
    assert {(r.u, r["at"], r.v) for r in joins.asof(left, right, ["u"], "at", "t", ["v"]).collect()} == {(1, 5, "b"), (1, 1, None), (2, 9, None)}


def test_within_and_ancestors(spark):
    spans = spark.createDataFrame([(1, 0, 10, "a"), (1, 5, 30, "b")], "d int, s int, e int, n string")
    points = spark.createDataFrame([(1, 7), (1, 29), (1, 30)], "d int, at int")
    assert {(r["at"], r.n) for r in joins.within(points, spans, ["d"], "at", "s", "e", 8).collect()} == {(7, "a"), (7, "b"), (29, "b")}
    links = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("y", "x")], "child string, parent string")
    got = {(r.child, r.ancestor): r.distance for r in joins.ancestors(links, "child", "parent", 5).collect()}
    assert got[("c", "a")] == 2 and got[("x", "x")] == 2


def test_difference_keeps_values_and_is_stable(spark):
    old = spark.createDataFrame([(1, "a", "k"), (2, None, "k"), (4, "z", "k")], "id int, v string, kept string")
    new = spark.createDataFrame([(1, "a", None), (2, "b", "n"), (3, "c", None)], "id int, v string, kept string")
    got = {r.id: (r.change, r.kept) for r in upkeep.difference(old, new, ["id"], ["v"], ["kept"]).collect()}
    assert got == {1: ("unchanged", "k"), 2: ("changed", "n"), 3: ("inserted", None), 4: ("missing", "k")}
    assert {r.change for r in upkeep.difference(old, old, ["id"], ["v"]).collect()} == {"unchanged"}


def test_islands(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    df = spark.createDataFrame([("u", at(m)) for m in (0, 1, 3, 20, 25)], "u string, t timestamp")
    assert sorted(int((r.until - r.since).total_seconds() / 60) for r in usage.islands(df, ["u"], "t").collect()) == [8, 10]


def test_p95_and_bucket(spark):
    df = spark.createDataFrame([(float(v),) for v in [10] * 95 + [5000] * 5], "v double")
    assert df.agg(usage.histogram(F.col("v")).alias("h")).select(usage.p95(F.col("h")).alias("p")).first().p == 250
    events = spark.createDataFrame([(i, "u", dt.datetime(2024, 1, 1, 0, 0, i)) for i in range(5)], "k int, u string, t timestamp")
    assert [r.admitted for r in usage.token_bucket(events, "u", "t", "k", 2.0, 0.5).orderBy("key").collect()] == [True, True, True, False, True]
