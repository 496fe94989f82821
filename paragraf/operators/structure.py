"""Structured texts: kinds of lines, sections, pages and margins, sanitised and stripped text, words within a section."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from paragraf.functions.text import fold

#: Lines that open a section of a decision.
MARKS = {"takto:": "vyrok", "Odůvodnění:": "oduvodneni", "Poučení:": "pouceni"}
#: Words of a search within texts at most; shorter ones than two characters don't count.
MOST_WORDS = 8


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, char_start, char_end): what precedes the first opening line is the heading; an opening line belongs to
    its section. Lines lost their white space at the end when compared; offsets are those of the text."""
    rows = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line")).withColumn("_len", F.length("line"))
    own = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    said = F.rtrim("line", F.lit(" \r"))
    mark = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])[said]
    rows = rows.select(key, "_len", (F.sum(F.col("_len") + 1).over(own) - F.col("_len") - 1).alias("_at"), F.coalesce(F.last(mark, ignorenulls=True).over(own), F.lit("zahlavi")).alias("kind"))
    return rows.groupBy(key, "kind").agg(F.min("_at").alias("char_start"), F.max(F.col("_at") + F.col("_len")).alias("char_end"))


def section_text(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(key, section): the text of one kind of section of each text that has it."""
    spans = sections(df, key, text).where(F.col("kind") == kind)
    at = F.col("char_start").cast("int")
    return df.join(spans, key).select(key, F.substring(F.col(text), at + 1, F.col("char_end").cast("int") - at).alias("section"))


def holding(c: Column, words: list[str]) -> tuple[Column, Column]:
    """(every, some): does a lower-cased text hold all, or one, of the words as they are written? The first MOST_WORDS count."""
    asked = [w.lower() for w in words if len(w) > 1][:MOST_WORDS]
    every, some = F.lit(bool(asked)), F.lit(False)
    for w in asked:
        every, some = every & F.contains(c, F.lit(w)), some | F.contains(c, F.lit(w))
    return every, some


def top_only(court: str | None, sources: list[str]) -> Column:
    """The sources asked for, without regional courts unless a court is named or their source isn't among them."""
    out = F.col("source").isin(*sources)
    if court is None and "nss" in sources:
        out = out & ~((F.col("source") == "nss") & F.coalesce(F.contains(F.lower("court"), F.lit("krajský")), F.lit(False)))
    return out


def roman(c: Column) -> Column:
    """The number that Roman digits up to X stand for; a smaller digit before a greater one is taken off. Null for others."""
    value = lambda x: F.when(x == "I", 1).when(x == "V", 5).when(x == "X", 10).otherwise(0)
    digits = F.split(c, "")
    total = F.aggregate(F.transform(digits, lambda x, i: F.when(value(x) < F.coalesce(value(F.get(digits, i + 1)), F.lit(0)), -value(x)).otherwise(value(x))), F.lit(0), lambda a, x: a + x)
    return F.when(c.rlike("^[IVX]+$"), total)


def line_kinds(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line, kind, level, label): blank, page, heading, margin or text; a heading's level, a mark's label."""
    rows = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    line = F.col("line")
    kind = F.when(F.trim(line, F.lit(" \t\r")) == "", "blank").when(line.rlike(r"^\[s\. [^\]]+\]"), "page").when(line.rlike("^#{1,6} "), "heading").when(line.rlike(r"^\[m\. č\. [0-9]+\]"), "margin").otherwise("text")
    label = F.regexp_extract(line, r"^\[(?:s|m\. č)\. ([^\]]+)\]", 1)
    return rows.select(key, "n", "line", kind.alias("kind"), F.when(line.rlike("^#{1,6} "), F.length(F.regexp_extract(line, "^(#+)", 1))).alias("level"), F.when(label != "", label).alias("label"))


def placed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line, kind, page, margin): each line with the last page and margin number so far; a heading ends the latter."""
    rows = line_kinds(df, key, text)
    own = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    margin = F.last(F.when(F.col("kind") == "margin", F.col("label")).when(F.col("kind") == "heading", ""), ignorenulls=True).over(own)
    rows = rows.select(key, "n", "line", "kind", F.last(F.when(F.col("kind") == "page", F.col("label")), ignorenulls=True).over(own).alias("page"), margin.alias("margin"))
    return rows.withColumn("margin", F.when(F.col("margin") != "", F.col("margin")))


def stripped(c: Column) -> Column:
    """The text without marks of headings, pages, margins and emphasis."""
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^(?:#{1,6} |\[s\. [^\]\n]*\] ?|\[m\. č\. [0-9]+\] ?)", ""), r"\*\*|__", "")


def sanitised(c: Column) -> Column:
    """Line feeds alone end lines; controls, marks of direction, zero-width characters and soft hyphens go, and blanks
    before line feeds."""
    bare = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"[\x00-\x08\x0b-\x1f\x7f\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\u00ad]", "")
    return F.regexp_replace(bare, r"[ \t]+\n", "\n")


def decision_kind(c: Column) -> Column:
    """The kind of decision that a word begins like, without case and marks; other words are `jine`, null stays null."""
    plain = fold(c)
    out = F.when(c.isNotNull(), "jine")
    for lead, kind in (("stanov", "stanovisko"), ("nalez", "nalez"), ("usnes", "usneseni"), ("rozsud", "rozsudek")):
        out = F.when(F.startswith(plain, F.lit(lead)), kind).otherwise(out)
    return out


def constant(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, value, constant): the most frequent value of each key, the least of equals, and whether it makes up the share."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    best = counted.groupBy(key).agg(F.max_by(F.struct(value, "_n"), F.struct("_n", -F.col(value))).alias("_b"), F.sum("_n").alias("_t"))
    return best.select(key, F.col(f"_b.{value}").alias(value), (F.col("_b._n") >= share * F.col("_t")).alias("constant"))


#: Words that tell languages of one script apart; the first of equals wins.
STOPS = {
    "cs": ["a", "se", "že", "na", "podle", "ze", "jen", "však"], "sk": ["a", "sa", "že", "na", "podľa", "zo", "iba", "však"], "en": ["the", "of", "that", "was", "to", "in", "and", "for"],
    "de": ["der", "die", "das", "dass", "von", "vom", "und", "nicht"], "fr": ["le", "la", "que", "du", "les", "était", "et", "des"],
}
#: Scripts that tell a language by themselves; kana before Han, which Japanese has too.
SCRIPTS = [("ja", "[\\u3040-\\u30ff]"), ("zh", "[\\u4e00-\\u9fff]"), ("th", "[\\u0e01-\\u0e5b]"), ("hi", "[\\u0900-\\u097f]"), ("ar", "[\\u0600-\\u06ff]")]


def _among(own: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(own)


def language(text: Column, words: Column) -> Column:
    """The language of a text by its script, else by the words that stand most often in it; null where none does."""
    counts = {lang: F.size(F.filter(words, _among(own))) for lang, own in STOPS.items()}
    most = F.greatest(*counts.values())
    out = F.lit(None).cast("string")
    for lang in reversed(STOPS):
        out = F.when(counts[lang] == most, lang).otherwise(out)
    out = F.when(most > 0, out)
    for lang, script in reversed(SCRIPTS):
        out = F.when(text.rlike(script), lang).otherwise(out)
    return out


def escaped(c: Column) -> Column:
    """Lines that look like marks of a structured text, with a backslash before."""
    return F.regexp_replace(c, r"(?m)^(#|\[s\. |\[m\. č\. |\[\^)", r"\\$1")


def sliced(df: DataFrame, key: str, text: str, first: int, last: int) -> DataFrame:
    """(key, slice): the lines of pages whose number lies in the range, in order."""
    rows = placed(df, key, text).where(F.col("page").try_cast("int").between(first, last))
    listed = F.array_sort(F.collect_list(F.struct("n", "line")))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("slice"))


def broken_words(df: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, joined, known): words that a hyphen breaks at a line's end, joined with what the next line goes on with."""
    rows = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    after = F.lead("line").over(Window.partitionBy(key).orderBy("n"))
    rows = rows.select(key, "n", F.lower(F.regexp_extract(F.rtrim("line"), r"(\p{L}+)[-¬]$", 1)).alias("_a"), F.lower(F.regexp_extract(after, r"^\s*(\p{Ll}+)", 1)).alias("_c")).where("_a <> '' and _c <> ''")
    rows = rows.select(key, "n", F.concat("_a", "_c").alias("joined"))
    return rows.join(known.select("joined", F.lit(True).alias("known")), "joined", "left").select(key, "n", "joined", F.coalesce("known", F.lit(False)).alias("known"))


def input_view(df: DataFrame, key: str, text: str, front: int = 9_000, outline: int = 3_000) -> DataFrame:
    """(key, front, outline): what proposals about a text are read from: its beginning, and its headings as far as they fit."""
    heads = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("^#{1,6} "))
    return df.select(key, F.substring(F.col(text), 1, front).alias("front"), F.substring(F.array_join(heads, "\n"), 1, outline).alias("outline"))


def proposals(df: DataFrame, key: str, text: str, title: str, year: str) -> DataFrame:
    """(key, field, value, source, confidence): what is known about a text and what its beginning says, each with how far it
    is to be trusted."""
    view = df.join(input_view(df.select(key, text), key, text), key)
    first = F.regexp_extract("outline", "^#{1,6} ([^\\n]+)", 1)
    printed = F.regexp_extract("front", "(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1)
    one = lambda field, value, source, confidence: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
    every = F.array(one("title", F.trim(title), "record", 0.95), one("title", F.when(first != "", F.trim(first)), "heading", 0.6), one("year", F.col(year), "record", 0.95), one("year", F.when(printed != "", printed), "front", 0.3))
    return view.select(key, F.explode(every).alias("p")).select(key, "p.*").where("value <> ''")


def accepted_record(df: DataFrame, key: str, longest: int = 300) -> DataFrame:
    """(key, title, year): the most trusted valid proposal of each field; a year lies between 1400 and 2100, a title is cut."""
    good = (F.col("field") != "year") | F.col("value").try_cast("int").between(1400, 2100)
    best = df.where(good).groupBy(key, "field").agg(F.max_by("value", F.struct("confidence", "value")).alias("v"))
    return best.groupBy(key).agg(F.substring(F.max(F.when(F.col("field") == "title", F.col("v"))), 1, longest).alias("title"), F.max(F.when(F.col("field") == "year", F.col("v"))).cast("int").alias("year"))
