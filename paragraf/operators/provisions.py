"""Statute references in texts: sections with their paragraphs and letters, and acts, as keys on every level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A section with an optional paragraph and letter.
REFERENCE = r"§[  ]?(\d{1,4}[a-z]?)(?:[  ]odst\.[  ](\d{1,2}))?(?:[  ]písm\.[  ]([a-z])\))?"
ACT = r"č\.[  ](\d{1,4}/\d{4})[  ]Sb\."


def keys(section: Column, paragraph: Column, letter: Column) -> Column:
    """The reference's keys on every level: par:2913, par:2913/o1, par:2913/o1/pb."""
    one = F.concat(F.lit("par:"), section)
    two = F.when(paragraph != "", F.concat(one, F.lit("/o"), paragraph))
    three = F.when(letter != "", F.concat(F.coalesce(two, one), F.lit("/p"), letter))
    return F.filter(F.array(one, two, three), lambda k: k.isNotNull())


def provision_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, provision, mentions): how often each text refers to each provision, on every level."""
    groups = [F.regexp_extract_all(F.col(text), F.lit(REFERENCE), i).alias(n) for i, n in enumerate("abc", 1)]
    rows = df.select(key, *groups).select(key, F.explode(F.arrays_zip("a", "b", "c")).alias("r"))
    return rows.select(key, F.explode(keys(F.col("r.a"), F.col("r.b"), F.col("r.c"))).alias("provision")).groupBy(key, "provision").agg(F.count("*").alias("mentions"))


def act_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, act, mentions) of the acts cited by number."""
    rows = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(ACT), 1)).alias("act"))
    return rows.groupBy(key, F.concat(F.lit("zak:"), "act").alias("act")).agg(F.count("*").alias("mentions"))

#: How acts are named after a reference.
SHORT = {"o. z.": "zak:89/2012", "o. s. ř.": "zak:99/1963", "s. ř. s.": "zak:150/2002", "tr. zák.": "zak:40/2009", "tr. ř.": "zak:141/1961", "obč. zák.": "zak:40/1964", "obch. zák.": "zak:513/1991", "zák. práce": "zak:262/2006", "ins. zák.": "zak:182/2006", "s. ř.": "zak:500/2004", "Listiny": "zak:2/1993", "Ústavy": "zak:1/1993"}
#: Codes that replaced others: before the year the older one is meant.
RECODED = {"zak:40/2009": (2010, "zak:140/1961"), "zak:262/2006": (2007, "zak:65/1965"), "zak:150/2002": (2003, "zak:99/1963")}
_B = "[ \\u00a0]"
_NUM = r"\d{1,4}[a-z]?"
_LIST = rf"(?:(?:,{_B}?|{_B}a{_B}|{_B}až{_B}|–)"
#: A section or article with its paragraphs, letters and act: lists and ranges as they are written.
GRAMMAR = (
    rf"(§§?|čl\.){_B}?({_NUM}{_LIST}{_NUM})*)(?:{_B}odst\.{_B}(\d{{1,2}}{_LIST}\d{{1,2}})*))?(?:{_B}písm\.{_B}([a-z]\){_LIST}[a-z]\))*))?"
    rf"(?:{_B}(?:zákona{_B})?č\.{_B}(\d{{1,4}}/\d{{4}}){_B}Sb\.|{_B}(" + "|".join(k.replace(".", "\\.").replace(" ", _B) for k in SHORT) + "))?"
)
#: Members of a range at most; a longer one counts by its ends.
RANGE = 30


def expanded(c: Column, letters: bool = False) -> Column:
    """The members of a list as it is written: commas and `a` part them, `až` or a dash stands for all between. Null for none."""
    items = F.split(F.regexp_replace(F.regexp_replace(c, r"[\)]", ""), r"(,[ \u00a0]?|[ \u00a0]a[ \u00a0])", ";"), ";")

    def members(item: Column) -> Column:
        ends = F.split(F.regexp_replace(item, r"[ \u00a0]až[ \u00a0]|–", ";"), ";")
        low, high = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        if letters:
            a, b = F.ascii(low), F.ascii(high)
            between = F.transform(F.sequence(a, b), lambda x: F.char(x))
        else:
            a, b = low.try_cast("int"), high.try_cast("int")
            between = F.transform(F.sequence(a, b), lambda x: x.cast("string"))
        fits = (F.size(ends) == 2) & a.isNotNull() & b.isNotNull() & (a <= b) & (b - a < RANGE)
        return F.when(fits, between).otherwise(ends)

    return F.when(c != "", F.flatten(F.transform(items, members)))


def references(df: DataFrame, key: str, text: str, year: str | None = None) -> DataFrame:
    """(key, n, act, provision): every reference of each text, lists and ranges written out, with the act that it names.

    A reference without an act takes that of the one before it in its text. `year` names the column by which a code that
    replaced another is told from it."""
    groups = F.arrays_zip(*[F.regexp_extract_all(F.col(text), F.lit(GRAMMAR), i).alias(f"g{i}") for i in range(1, 7)])
    rows = df.select(key, *([F.col(year).alias("_y")] if year else []), F.posexplode(groups).alias("n", "g"))
    named = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])[F.regexp_replace("g.g6", "\\u00a0", " ")]
    act = F.when(F.col("g.g5") != "", F.concat(F.lit("zak:"), "g.g5")).otherwise(named)
    if year:
        for new, (since, old) in RECODED.items():
            act = F.when((act == new) & (F.col("g.g5") == "") & (F.col("_y") < since), old).otherwise(act)
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("act", F.last(act, ignorenulls=True).over(upto))
    one = F.when(F.col("g.g1") == "čl.", "cl:").otherwise("par:")
    none = F.array(F.lit(None).cast("string"))
    rows = rows.select(key, "n", "act", one.alias("_k"), F.explode(expanded(F.col("g.g2"))).alias("_a"), F.coalesce(expanded(F.col("g.g3")), none).alias("_bs"), F.coalesce(expanded(F.col("g.g4"), True), none).alias("_cs"))
    rows = rows.select(key, "n", "act", "_k", "_a", F.explode("_bs").alias("_b"), "_cs").select("*", F.explode("_cs").alias("_c"))
    told = F.concat("_k", "_a", F.coalesce(F.concat(F.lit("/o"), "_b"), F.lit("")), F.coalesce(F.concat(F.lit("/p"), "_c"), F.lit("")))
    return rows.select(key, "n", "act", told.alias("provision"))


def ancestors_of(c: Column) -> Column:
    """A provision and all it lies in: par:5, par:5/o2, par:5/o2/pb."""
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def definitions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, act): short names that a text gives to the act right before them."""
    pattern = r"č\.[ \u00a0](\d{1,4}/\d{4})[ \u00a0]Sb\.[^()§]{0,80}\((?:dále|ďalej)[ \u00a0](?:jen|len)[ \u00a0][„\"]([^“”\"]{1,40})[“”\"]\)"
    rows = df.select(key, F.explode(F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(pattern), 1).alias("a"), F.regexp_extract_all(F.col(text), F.lit(pattern), 2).alias("b"))).alias("g"))
    return rows.select(key, F.col("g.b").alias("name"), F.concat(F.lit("zak:"), "g.a").alias("act")).distinct()


def resolved(names: DataFrame, name: str, acts: DataFrame, year: str) -> DataFrame:
    """names with the act of that alias in force in the year: the newest issued by then, else the oldest. acts(alias, act, issued)."""
    held = acts.groupBy(F.col("alias").alias(name)).agg(F.sort_array(F.collect_set(F.struct("issued", "act"))).alias("_a"))
    by = F.filter("_a", lambda x: x["issued"] <= F.col(year))
    return names.join(held, name, "left").withColumn("act", F.coalesce(F.try_element_at(by, F.lit(-1)), F.get("_a", F.lit(0)))["act"]).drop("_a")
