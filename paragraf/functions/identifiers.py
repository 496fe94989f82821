"""Identifiers in texts: case numbers, ECLIs, acts, EU acts, standard numbers. Each grammar is one pattern on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_S = "[ \\u00a0]"
#: What each kind of identifier looks like; the groups make its key.
CASE = rf"(?:^|[^\p{{L}}\p{{N}}])(\d{{1,3}}|[IVX]{{1,4}}\.|Pl\.){_S}(\p{{L}}{{1,5}}){_S}(\d{{1,6}})/(\d{{4}}|\d{{2}})(?:[^\d]|$)"
ECLI = r"ECLI:([A-Z]{2}):([A-Z0-9]{1,7}):(\d{4}):([A-Za-zÁ-Ž0-9.]+)"
ACT = rf"(?:č\.{_S}?)?(\d{{1,4}})/(\d{{4}}){_S}Sb\."
EU_ACT = rf"(?iu)(směrnic|nařízen|smernic|nariaden|rozhodnut\p{{L}}*{_S}(?:Rady|Komise|Evropského))\p{{L}}*(?:{_S}(?:Rady|Komise|Evropského|parlamentu|a|\(ES\)|\(EU\)|\(EHS\)|č\.))*{_S}(\d{{1,4}})/(\d{{1,4}})"
ISSN = r"(?:^|[^\d])(\d{4})-(\d{3}[\dXx])(?:[^\dXx]|$)"
DOI = r"(10\.\d{4,9}/[^\s\"<>]+)"


def year(c: Column, pivot: int = 40) -> Column:
    """Four digits for two: up to the pivot this century, beyond it the last."""
    n = c.try_cast("int")
    return F.when(F.length(c) == 2, F.when(n <= pivot, n + 2000).otherwise(n + 1900)).otherwise(n).cast("string")


def case_key(senate: Column, registry: Column, number: Column, full: Column) -> Column:
    return F.concat(F.lit("sz:"), F.lower(senate), F.lit(" "), F.lower(registry), F.lit(" "), F.regexp_replace(number, "^0+(?=.)", ""), F.lit("/"), year(full))


def eu_key(kind: Column, a: Column, b: Column) -> Column:
    """The CELEX number of an act: the year is the part of four digits, or, of two short ones, the first for a directive and
    the second for a regulation. A decision counts only where its institution is named: courts decide as well."""
    directive = F.lower(kind).rlike("^sm")
    first_is_year = (F.length(a) == 4) | ((F.length(b) != 4) & directive)
    y, n = F.when(first_is_year, a).otherwise(b), F.when(first_is_year, b).otherwise(a)
    letter = F.when(directive, "L").when(F.lower(kind).rlike("^na"), "R").otherwise("D")
    return F.concat(F.lit("eu:3"), F.when(F.length(y) == 2, F.concat(F.lit("19"), y)).otherwise(F.lpad(y, 4, "0")), letter, F.lpad(n, 4, "0"))


def _groups(text: Column, pattern: str, n: int) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), i).alias(f"g{i}") for i in range(1, n + 1)])


def keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, ident, mentions): the identifiers in each text, by kind."""
    t = F.col(text)
    found = [
        F.transform(_groups(t, CASE, 4), lambda g: F.struct(F.lit("case").alias("kind"), case_key(g["g1"], g["g2"], g["g3"], g["g4"]).alias("ident"))),
        F.transform(_groups(t, ECLI, 4), lambda g: F.struct(F.lit("ecli").alias("kind"), F.lower(F.concat_ws(":", F.lit("ecli"), g["g1"], g["g2"], g["g3"], F.rtrim(g["g4"], F.lit(".")))).alias("ident"))),
        F.transform(_groups(t, ACT, 2), lambda g: F.struct(F.lit("act").alias("kind"), F.concat(F.lit("zak:"), g["g1"], F.lit("/"), g["g2"]).alias("ident"))),
        F.transform(_groups(t, EU_ACT, 3), lambda g: F.struct(F.lit("eu").alias("kind"), eu_key(g["g1"], g["g2"], g["g3"]).alias("ident"))),
        F.transform(F.regexp_extract_all(t, F.lit(DOI), 1), lambda x: F.struct(F.lit("doi").alias("kind"), F.concat(F.lit("doi:"), F.lower(trimmed_doi(x))).alias("ident"))),
    ]
    rows = df.select(key, F.explode(F.concat(*found)).alias("i")).select(key, "i.kind", "i.ident").where("ident is not null")
    return rows.groupBy(key, "kind", "ident").agg(F.count("*").alias("mentions"))


def trimmed_doi(c: Column) -> Column:
    """A DOI without the marks behind it; a closing bracket stays if it was opened within. One pass, however many marks."""
    bare = F.regexp_replace(c, r"[.,;:!?\"'”’»\]}]+$", "")
    opened, closed = F.length(bare) - F.length(F.replace(bare, F.lit("("), F.lit(""))), F.length(bare) - F.length(F.replace(bare, F.lit(")"), F.lit("")))
    return F.when(closed > opened, F.regexp_replace(bare, r"[).,;:]+$", "")).otherwise(bare)


def issn_valid(first: Column, second: Column) -> Column:
    """Does the last character follow from the seven digits? Weights fall from 8 to 2, modulo 11, X standing for 10."""
    digits = F.concat(first, F.upper(second))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.lit(0), lambda a, i: a + F.substring(digits, i, F.lit(1)).cast("int") * (9 - i))
    check = (11 - total % 11) % 11
    return F.substring(digits, 8, 1) == F.when(check == 10, "X").otherwise(check.cast("string"))


def isbn10_to_13(c: Column) -> Column:
    """The thirteen digits of a ten-digit number: 978, its nine digits and their own check digit; null for other lengths."""
    bare = F.regexp_replace(c, "[^0-9Xx]", "")
    twelve = F.concat(F.lit("978"), F.substring(bare, 1, 9))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + F.substring(twelve, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return F.when(bare.rlike("^[0-9]{9}[0-9Xx]$"), F.concat(twelve, ((10 - total % 10) % 10).cast("string")))


def court_of_key(c: Column) -> Column:
    """Which top court a case key's registry belongs to; null for others."""
    registry = F.regexp_extract(c, r"^sz:\S+ (\p{L}+) ", 1)
    return F.when(registry == "ús", "us").when(registry.isin("cdo", "tdo", "odo", "nd", "ncu", "icdo"), "ns").when(registry.isin("as", "afs", "azs", "ads", "ans", "aos"), "nss")


def displayed(c: Column) -> Column:
    """A case key as it is written: the registry with a capital, the Constitutional Court's in capitals."""
    part = lambda i: F.regexp_extract(c, r"^sz:(\S+) (\p{L}+) (\d+)/(\d{4})$", i)
    roman = F.when(part(1).rlike("^[ivx]+\\.$"), F.upper(part(1))).otherwise(F.initcap(part(1)))
    registry = F.when(part(2) == "ús", "ÚS").otherwise(F.initcap(part(2)))
    return F.when(c.rlike(r"^sz:\S+ \p{L}+ \d+/\d{4}$"), F.concat(roman, F.lit(" "), registry, F.lit(" "), part(3), F.lit("/"), part(4)))


def celex_of_case(c: Column, pivot: int = 60) -> Column:
    """The CELEX number of a case of the Court of Justice or the General Court: C-283/81 is 61981CJ0283."""
    pattern = r"^([CT])[-‑](\d{1,4})/(\d{4}|\d{2})"
    letter, number, y = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    return F.when(c.rlike(pattern), F.concat(F.lit("6"), year(y, pivot), letter, F.lit("J"), F.lpad(number, 4, "0")))


def celex_motif(c: Column) -> Column:
    """A treaty article as a search motif: 11957E119 and part 2 is *A119P2*."""
    pattern = r"^(?:čl\.|cl\.|art\.)\s*(\d{1,3})(?:\s*odst\.\s*(\d{1,2}))?"
    article, part = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.when(c.rlike(pattern), F.concat(F.lit("*A"), article, F.when(part != "", F.concat(F.lit("P"), part)).otherwise(""), F.lit("*")))


def procedure_form(c: Column) -> Column:
    """exact for a whole procedure reference, 2016/0379(COD), prefix for one without its kind."""
    return F.when(c.rlike(r"^\d{4}/\d{4}\([A-Z]{2,3}\)$"), "exact").when(c.rlike(r"^\d{4}/\d{4}$"), "prefix")
