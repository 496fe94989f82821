"""Sentence units of texts in many scripts, in SQL expressions alone.

Marks that end no sentence (in decimals, addresses, initials, abbreviations, ordinals, list marks, and inside quotation
marks and brackets) are replaced one for one by private-use characters, so that offsets stay. Then the terminators of
each script are followed by a cut, and the units between cuts get their offsets by sums of lengths. The text of a unit
is taken from the original, which restores all masked marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paragraf.session import spread

#: Private-use characters: a line break that stands for a space, the edge of a quotation, a cut, and masked marks.
SOFT, EDGE, CUT = "\uf8d0", "\uf8d1", "\uf8d2"
MARKS = ".!?…。！？।؟"
MASKED = "".join(chr(0xF8D8 + i) for i in range(len(MARKS)))
DOT = MASKED[0]
BLANK = " \t\n\r\u00a0" + SOFT
_B = "[ \\t\\u00a0" + SOFT + "]"

#: Characters by which a full line of a hard-wrapped text may fall short of the usual one: a long word didn't fit.
MARGIN = 25
#: A shorter line is a heading or the end of a paragraph.
SHORT = 30
#: Abbreviations that always belong to what follows them.
LEADING = (
    "Ing JUDr PhDr MUDr RNDr Mgr Bc doc prof Doc Prof Dr Mr Mrs Ms Mme MM St č čl Čl sp zn odst písm ust násl srov Srov např Např napr Napr resp tj tzv tzn mj cca kap roč "
    "vyd str pol bod obr tab No Nos Art Sec Sect para paras cf Cf approx pp vs Vol Fig ca gem vgl Vgl Abs Az Nr Bd Hrsg bzw env art al Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Pl डॉ د"
).split()
#: Months that German writes after an ordinal.
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
#: Where a dot ends no sentence; each is looked at only where a dot stands, so the text is read once.
_D = "[." + DOT + "]"
_NO_WORD = "(?<![\\p{L}\\p{M}\\p{N}." + DOT + "])"


#: What may start a sentence in scripts with blanks between words.
STARTS = "[\\p{Lu}\\p{Lt}\\p{Lo}\\p{N}„“«\"(\\[§‚‘¿¡]"


def _dots() -> str:
    """One pattern for the dots of decimals, dates, addresses, list marks, abbreviations, initials and ordinals."""
    after = [
        f"(?<=[^\\s{SOFT}]\\.)(?=[^\\s{SOFT}”“»’\"')\\].…!?])",  # no blank follows: decimals, addresses
        "(?<=^[ \\t]{0,8}(?:\\d{1,3}|[IVXLC]{1,6}|[A-Za-z])\\.)(?=[ \\u00a0])",  # a mark at the start of a line
        f"(?<={_NO_WORD}(?:{'|'.join(LEADING)})\\.)",
        f"(?<=(?<!\\p{{L}})[čČ]{_D}{_B}[jlp]\\.)",  # a file, a sheet, a house
        f"(?<=[,(] (?:s|S|p)\\.)(?={_B}\\d)",  # a page
        f"(?<={_NO_WORD}p\\.)(?={_B}\\d)",
        f"(?<={_NO_WORD}Co\\.)(?={_B}KG)",
        f"(?<={_NO_WORD}z\\.)(?={_B}B\\.)",
        f"(?<={_NO_WORD}d\\.)(?={_B}h\\.)",
        f"(?<={_NO_WORD}u\\.)(?={_B}a\\.)",
        f"(?<={_NO_WORD}e\\.)(?={_B}V\\.)",
        f"(?<={_NO_WORD}(?:I{{1,3}}|IV|VI{{0,3}}|IX|X{{1,3}})\\.)(?={_B}ÚS)",
        f"(?<={_NO_WORD}\\p{{Lu}}\\.)(?<!e{_D}{_B}V\\.)(?={_B}?\\p{{Lu}})",  # initials
        f"(?<=(?<![\\p{{L}}\\p{{N}}])\\d{{1,2}}\\.)(?={_B}{{0,3}}(?:\\d|(?:{MONTHS})(?!\\p{{L}})))",
        f"(?<=[ .{DOT}]\\p{{L}}{{1,2}}\\.)(?={_B}\\()",  # a short form before a bracket goes on
    ]
    # the first costs little; the others matter only before what may start a sentence
    return f"(?m)\\.(?:{after[0]}|(?=[\\s\\u00a0{SOFT}]+{STARTS})(?:" + "|".join(after[1:]) + "))"


def _mask_inside(s: Column) -> Column:
    """A bracketed or quoted stretch without marks; a quotation keeps those right before its closing mark."""
    tail = F.regexp_extract(s, f"[{MARKS}]+[\\s\\u00a0{SOFT}]*[^\\s(\\[（]$", 0)
    kept = F.concat(F.translate(F.substring(s, F.lit(1), F.length(s) - F.length(tail)), MARKS, MASKED), tail)
    return F.when(s.rlike("^[(\\[（]"), F.translate(s, MARKS, MASKED)).otherwise(kept)


def _lines(t: Column) -> Column:
    """The text, and its lines if it is hard-wrapped: a line breaks amid a sentence."""
    t = F.when(F.contains(t.cast("binary"), F.lit(b"\xef\xa3")), F.translate(t, SOFT + EDGE + CUT + MASKED, "\ufffd" * (3 + len(MASKED)))).otherwise(t)
    wrapped = t.rlike("\\n(?<=[^\\s.!?;:…]\\n)\\p{Ll}[^)]")
    return F.struct(t.alias("t"), F.when(wrapped, F.split(t, "\n", -1)).alias("lines"))


def _width(s: Column) -> Column:
    """The median length of the lines that may be full."""
    long = F.array_sort(F.filter(F.transform(s["lines"], lambda x: F.length(x)), lambda n: n >= SHORT))
    return F.struct(s["t"].alias("t"), s["lines"].alias("lines"), F.coalesce(F.try_element_at(long, F.floor(F.size(long) / 2 + 1).cast("int")), F.lit(SHORT)).alias("width"))


def _soften(s: Column) -> Column:
    """Line breaks of hard-wrapped texts that stand for a space: those after a line that is nearly as long as usual."""
    lines, width = s["lines"], s["width"]

    def joined(line: Column, i: Column) -> Column:
        after = F.coalesce(F.try_element_at(lines, (i + 2).cast("int")), F.lit(""))
        blank = after.rlike("^\\s*$")
        mark = after.rlike("^\\s*(?:[a-z]\\)|\\(\\d+\\)|[-•*–] |#)")
        full = (F.length(line) >= F.greatest(width - MARGIN, F.lit(SHORT))) & ~blank & ~(mark & ~line.rlike("(?:písm|odst|let|lit)\\.$"))
        return F.concat(line, F.when(i + 1 == F.size(lines), F.lit("")).when(full, F.lit(SOFT)).otherwise(F.lit("\n")))

    return F.when(lines.isNotNull(), F.array_join(F.transform(lines, joined), "")).otherwise(s["t"])


SPANS = "(?=[„“«「『\"(\\[（])(„[^“”„\\n]*[“”]|“[^“”\\n]*”|«[^«»\\n]*»|「[^「」\\n]*」|『[^『』\\n]*』|\"[^\"\\n]*\"|\\([^()\\n]*\\)|\\[[^\\[\\]\\n]*\\]|（[^（）\\n]*）)"


def _mask_spans(t: Column) -> Column:
    """The text with the marks inside quotations and brackets masked."""
    parts = F.split(F.regexp_replace(t, SPANS, f"{EDGE}$1{EDGE}"), EDGE, -1)
    inside = F.array_join(F.transform(parts, lambda s, i: F.when((i % 2 == 1) & s.rlike(f"[{MARKS}]"), _mask_inside(s)).otherwise(s)), "")
    return inside


def _mask_dots(t: Column) -> Column:
    return F.regexp_replace(t, _dots(), DOT)


CLOSERS = "”“»’\"'\\)\\]"
#: Terminators of scripts with blanks between words: closing marks go with them, a capital, number or opening mark follows.
SPACED = f"([.!?…।؟]+(?:[ \\u00a0]?»|[{CLOSERS}])*)(?=[\\s\\u00a0{SOFT}]+{STARTS})"
#: Terminators of scripts without: a quotation that ends in a full stop ends its sentence unless a particle follows.
UNSPACED = "((?:[。．]|…+)[。！？…]*[”」』）]*(?![”」』）とって、，])|[！？]+(?![！？。”」』）])|[！？]+[”」』）]+(?=\\s|$))"
#: In Thai a blank ends a unit unless a numeral stands beside it.
THAI = "(?<![\\p{N}\\s\\u00a0])([ \\u00a0]+)(?![\\p{N}\\s\\u00a0])"


def _cut_spaced(t: Column) -> Column:
    return F.regexp_replace(t, SPACED + "|([\\n\\r]+)", "$1$2" + CUT)


def _cut_unspaced(t: Column) -> Column:
    there = F.contains(t, F.lit("。")) | F.contains(t, F.lit("！")) | F.contains(t, F.lit("？")) | F.contains(t, F.lit("……"))
    return F.when(there, F.regexp_replace(t, UNSPACED, "$1" + CUT)).otherwise(t)


def _cut_thai(t: Column) -> Column:
    return F.when(t.rlike("[\\u0e01-\\u0e5b]"), F.regexp_replace(t, THAI, "$1" + CUT)).otherwise(t)


#: Lengths are summed in groups of so many units, and these in groups of so many again: a place is a sum of at most so many
#: of each kind, and the work grows with the units for texts of up to GROUP**3 of them.
GROUP = 64


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _sums(a: Column) -> Column:
    """The sums of GROUP entries each."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / GROUP).cast("int")), lambda g: _total(F.slice(a, g * GROUP + 1, F.lit(GROUP))))


def _lengths(t: Column) -> Column:
    parts = F.split(t, CUT, -1)
    return F.struct(parts.alias("parts"), F.transform(parts, lambda p: F.length(p)).alias("lengths"))


def _groups(s: Column) -> Column:
    return F.struct(s["parts"].alias("parts"), s["lengths"].alias("lengths"), _sums(s["lengths"]).alias("groups"))


def _heads(s: Column) -> Column:
    return F.struct(s["parts"].alias("parts"), s["lengths"].alias("lengths"), s["groups"].alias("groups"), _sums(s["groups"]).alias("heads"))


def _offsets(s: Column) -> Column:
    """For each part where it starts: sums of whole groups of groups, of groups, and of the parts of its own group before it."""

    def before(i: Column) -> Column:
        group, head = F.floor(i / GROUP).cast("int"), F.floor(i / GROUP**2).cast("int")
        return _total(F.slice(s["heads"], F.lit(1), head)) + _total(F.slice(s["groups"], head * GROUP + 1, group - head * GROUP)) + _total(F.slice(s["lengths"], group * GROUP + 1, (i % GROUP).cast("int")))

    return F.transform(s["parts"], lambda p, i: F.struct(p.alias("part"), before(i).alias("at")))


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit_no, char_start, char_end, text): the units of each text without the white space around them.

    Offsets are code points from 0; units don't overlap and hold all characters that aren't white space. Null, empty and
    blank texts have none. Repeated rows yield repeated units. No language column is read: scripts tell themselves.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull() & (F.col("t") != ""))
    # only a text that itself holds one of the private characters goes along whole; others come back from their parts
    rows = spread(rows, ["key", "t"])
    rows = rows.withColumn("whole", F.when(F.contains(F.col("t").cast("binary"), F.lit(b"\xef\xa3")), F.col("t")))
    for step in (_lines, _width, _soften, _mask_spans, _mask_dots, _cut_spaced, _cut_unspaced, _cut_thai, _lengths, _groups, _heads, _offsets):
        # exploding an array of one keeps the optimizer from writing the step out wherever the next one names its result
        rows = rows.select("key", "whole", F.explode(F.array(step(F.col("t")))).alias("t"))
    units = rows.select("key", "whole", F.posexplode("t").alias("unit_no", "u"))
    left = F.ltrim(F.col("u.part"), F.lit(BLANK))
    start = F.col("u.at") + F.length("u.part") - F.length(left)
    units = units.select(F.col("key").alias(key), "unit_no", start.alias("char_start"), F.rtrim(left, F.lit(BLANK)).alias("part"), "whole").withColumn("char_end", F.col("char_start") + F.length("part")).where("part <> ''")
    told = F.when(F.col("whole").isNotNull(), F.substring(F.col("whole"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).otherwise(F.translate("part", MASKED + SOFT, MARKS + "\n"))
    return units.select(key, "unit_no", "char_start", "char_end", told.alias("text"))


def cover(units: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, apart, whole) of each text that isn't blank, told from its units alone: they don't overlap, and put together
    they are the text without the white space."""
    rows = df.select(key, F.regexp_replace(F.col(text).cast("string"), "[ \\t\\n\\r\\u00a0]", "").alias("ink")).where("ink <> ''")
    held = units.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "text"))).alias("u"))
    steps = F.transform(F.slice("u", F.lit(2), F.greatest(F.lit(0), F.size("u") - 1)), lambda x, i: F.get("u", i)["char_end"] <= x["char_start"])
    told = F.regexp_replace(F.array_join(F.transform("u", lambda x: x["text"]), ""), "[ \\t\\n\\r\\u00a0]", "")
    return rows.join(held, key, "left").select(key, F.coalesce(F.forall(steps, lambda x: x), F.lit(False)).alias("apart"), F.coalesce(told == F.col("ink"), F.lit(False)).alias("whole"))
