"""Text of scanned pages repaired: running heads, page numbers, words broken over lines and misread characters.

Misread words are found as in text-induced corpus clean-up: every word has an anagram hash, the sum of the fifth powers
of its characters' codes, so exchanging characters moves the hash by a difference that depends on those characters only.
Rare words are joined in SQL with frequent ones by hash plus difference of each confusable pair; the candidates are
ranked by frequency and edit distance.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window, functions as F

from paragraf.session import cut

#: What is read, and what stood there.
CONFUSED = [
    ("0", "o"), ("1", "l"), ("|", "l"), ("ı", "i"), ("ri", "n"), ("cl", "d"), ("y", "v"), ("@", "a"), ("5", "s"), ("f", "t"), ("f", "ř"), ("lc", "k"), ("ii", "u"), ("rn", "m"), ("b", "h"),
    ("2", "ž"), ("é", "ě"), ("ì", "í"), ("e", "c"), ("a'", "á"), ("e'", "é"), ("i'", "í"), ("o'", "ó"), ("u'", "ú"), ("y'", "ý"), ("6", "b"), ("8", "b"), ("9", "g"), ("3", "z"), ("4", "a"),
    ("l", "i"), ("i", "l"), ("c", "e"), ("h", "b"), ("t", "f"), ("v", "y"), ("n", "ri"), ("d", "cl"), ("m", "rn"), ("k", "lc"), ("u", "ii"), ("vv", "w"), ("n", "u"), ("u", "n"), ("ě", "é"), ("í", "ì"),
]
#: Marks that a reader sets behind their letter, and the combining mark of each.
DETACHED = {"\u02c7": "\u030c", "\u02da": "\u030a", "°": "\u030a"} | {chr(c): chr(c) for c in (0x300, 0x301, 0x302, 0x303, 0x306, 0x308, 0x30A, 0x30B, 0x30C, 0x327, 0x328)}
#: A letter and the mark behind it, as read, and the letter that stood there.
_APART = [(letter + read, whole) for read, mark in DETACHED.items() for letter in "aAcCdDeEgGhHiIjJkKlLnNoOrRsStTuUwWyYzZ" if len(whole := unicodedata.normalize("NFC", letter + mark)) == 1]
#: The same as a pattern, and one that finds the marks alone; any other combining mark behind a Latin letter counts as well.
_LOOSE = "[\\p{IsLatin}&&\\p{L}][\\u0300-\\u036f]|" + "|".join(f"[{''.join(r[0] for r, _ in _APART if r[1] == m)}]{m}" for m in DETACHED if not unicodedata.combining(m))
_MARKS = f"[\\u0300-\\u036f{''.join(m for m in DETACHED if not unicodedata.combining(m))}]"
#: Marks at a break: hyphens, the not sign and the soft hyphen.
BREAKS = "-‐‑¬­"
#: The share of marked lines from which on a text is a structured one.
STRUCTURED = 0.1
#: Misread words that are broadcast to the words of the texts; more of them are joined by shuffling.
FEW = 300_000
#: A misread word's right form is so many times as frequent, and is there so often at least.
RATIO, LEAST = 12, 6
EDGES = ".,;:()„“”\"[]!?…–—/»«*^"
_BLANK = " \t\r\n \x0c"
#: Forms of a page number after a running head.
_MARK = "(?:[-–—] ?)?(?:str\\. ?)?[0-9lIıoO]{1,4}(?: ?/ ?[0-9lIıoO]{1,4})?(?: ?[-–—])?|[ivxlc]{1,7}"


def anagram(c: Column) -> Column:
    """The anagram hash of a word; codes are taken modulo 1000, so the sum of 4 000 fifth powers fits."""
    return F.aggregate(F.split(F.substring(c, 1, 4000), ""), F.lit(0).cast("long"), lambda a, x: a + F.when(x == "", F.lit(0).cast("long")).otherwise(F.pow(F.ascii(x) % 1000, F.lit(5)).cast("long")))


def _value(s: str) -> int:
    return sum((ord(x) % 1000) ** 5 for x in s)


def loose(c: Column) -> Column:
    """Does a mark stand behind its letter?"""
    return c.rlike(_MARKS) & c.rlike(_LOOSE)


def attached(c: Column) -> Column:
    """The text with every detached mark put on its letter."""
    pairs = F.array(*[F.struct(F.lit(read).alias("read"), F.lit(whole).alias("whole")) for read, whole in _APART])
    return F.when(loose(c), F.aggregate(pairs, c, lambda a, pair: F.replace(a, pair["read"], pair["whole"]))).otherwise(c)


def files(df: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """(key, title, text, scanned): one row per key. Texts of whose lines that aren't blank STRUCTURED or more are page
    markers, headings or margin numbers aren't scanned; a single such line declares nothing."""
    rows = df.select(F.col(key).cast("string").alias("key"), (F.col(title) if title else F.lit(None)).cast("string").alias("title"), F.col(text).cast("string").alias("text"))
    rows = rows.where("key is not null and text is not null").groupBy("key").agg(F.max_by("title", F.struct("text", "title")).alias("title"), F.max("text").alias("text"))
    told = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(_BLANK)) != "")
    structured = F.size(F.filter(told, lambda x: x.rlike("^(?:\\[s\\. |#{1,6} |\\[m\\. č)")))
    return rows.withColumn("scanned", structured < F.greatest(F.lit(1), STRUCTURED * F.size(told)))


def lines(texts: DataFrame) -> DataFrame:
    """(key, n, raw, s, kind) of every line of scanned files: kind blank, pageno, header or text.

    A page number stands alone on its line. A number that answers a line ending in a colon is text. A running head
    carries a page number or is set in capitals, or it equals the title or a head of the same file up to case and misread
    characters, or recurs in it.
    """
    rows = texts.where("scanned").select("key", "title", F.posexplode(F.split("text", "\n", -1)).alias("n", "raw"))
    rows = rows.withColumn("s", F.trim(F.col("raw"), F.lit(_BLANK)))
    told = F.last(F.when(F.col("s") != "", F.col("s")), ignorenulls=True).over(Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    number = F.col("s").rlike(f"^(?:{_MARK})$") & (F.col("s").rlike("[0-9]") | F.col("s").rlike("^[ivxlc]{2,7}$|^[ivx]$"))
    answer = F.col("s").rlike("^[0-9]+$") & F.coalesce(told.rlike(":$"), F.lit(False))
    marked = F.col("s").rlike(f" \\| (?:{_MARK})$|^[0-9lIıoO]{{1,4}} {{3,}}\\S|\\S {{3,}}[0-9lIıoO]{{1,4}}$") & F.col("s").rlike("\\p{L}{3}")
    head = F.regexp_replace("s", f" \\| (?:{_MARK})$|^[0-9lIıoO]{{1,4}} {{3,}}| {{3,}}[0-9lIıoO]{{1,4}}$", "")
    rows = rows.withColumn("pageno", number & ~answer).withColumn("marked", marked).withColumn("head", F.when(marked, head).otherwise(F.col("s")))
    again = F.col("s").rlike("^[\\p{Lu}\\p{N}].{11,}[^.:;,?!\\-]$") & ~F.col("pageno") & ~F.col("marked")
    capitals = ~F.col("s").rlike("\\p{Ll}") & F.col("s").rlike("\\p{Lu}{2}.*\\p{Lu}.*\\p{Lu}.*\\p{Lu}.*\\p{Lu}.*\\p{Lu}") & ~F.col("s").rlike("[.!?;,]$")
    rows = cut(rows.withColumn("marked", F.col("marked") | capitals).withColumn("head", F.lower("head")).withColumn("again", again).drop("title"))  # read for the heads, then for all lines
    recurring = rows.where("again").groupBy("key", "head").agg(F.count("*").alias("times")).where("times > 2 or (times > 1 and head rlike '[0-9–]')").select("key", "head")
    known = rows.where("marked").select("key", "head").unionByName(texts.where("scanned and length(title) >= 8").select("key", F.lower("title").alias("head"))).unionByName(recurring)
    known = known.where("length(head) >= 5").groupBy("key").agg(F.collect_set("head").alias("heads"), F.max(F.length("head")).alias("longest"))  # as many as the file has pages
    near = F.exists("heads", lambda h: (F.abs(F.length(h) - F.length("head")) <= 4) & ((h == F.col("head")) | _near(h, F.col("head"))))
    same = F.length("s").between(F.lit(5), F.col("longest") + 4) & F.coalesce(near, F.lit(False))
    kind = F.when(F.col("s") == "", "blank").when(F.col("pageno"), "pageno").when(F.col("marked"), "header").when(F.coalesce(same, F.lit(False)), "header").otherwise("text")
    return rows.join(known, "key", "left").select("key", "n", "raw", "s", kind.alias("kind"))


def _near(h: Column, line: Column) -> Column:
    """Do they differ in two characters or an eighth of the head at most? The bound is a constant, so the distance is
    looked for within it: most lines are told apart early."""
    most = F.greatest(F.lit(2), F.floor(F.length(h) * 0.12))
    return F.when(most <= 2, F.levenshtein(h, line, 2) >= 0).when(most <= 4, F.levenshtein(h, line, 4).between(F.lit(0), most)).otherwise(F.levenshtein(h, line) <= most)


def running(classified: DataFrame) -> DataFrame:
    """(key, n, s, hyphen, follows, next_n, next) of the lines of running text: whether the last word goes on, is a
    continuation, and the next line of running text."""
    own = Window.partitionBy("key").orderBy("n")
    rows = classified.where("kind = 'text'").withColumn("next", F.lead("s").over(own)).withColumn("next_n", F.lead("n").over(own))
    rows = rows.withColumn("hyphen", F.col("s").rlike(f"\\p{{L}}[|@0-9'°\u02c7\u02da\\p{{M}}]?[{BREAKS}]$") & F.coalesce(F.col("next").rlike("^[\\p{Ll}|@]"), F.lit(False)))
    return rows.withColumn("follows", F.coalesce(F.lag("hyphen").over(own), F.lit(False))).select("key", "n", "s", "hyphen", "follows", "next_n", "next")


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, "[ \\t\\u00a0]+"), lambda w: w != "")


_SPACE = " \\t\\u00a0"
_EDGE = "".join("\\" + c for c in EDGES if c not in "„“”…–—»«") + "„“”…–—»«"
#: A word without the marks around it.
_WORD = f"[^{_SPACE}{_EDGE}](?:[^{_SPACE}]*[^{_SPACE}{_EDGE}\\-])?"


def tokens(text_lines: DataFrame) -> DataFrame:
    """(key, n, token, cut, next_n): the lower-cased tokens of running text; one broken over two lines is whole, stands on
    its first line, and has the length of its first part in cut."""
    inner = F.when(F.col("follows"), F.regexp_replace("s", f"^[^{_SPACE}]*", "")).otherwise(F.col("s"))
    inner = F.when(F.col("hyphen"), F.regexp_replace(inner, f"[^{_SPACE}]*$", "")).otherwise(inner)
    plain = text_lines.select("key", "n", F.explode(F.split(F.lower(inner), f"[{_SPACE}]")).alias("token"), F.lit(0).alias("cut"), F.lit(None).cast("int").alias("next_n"))
    part = F.regexp_replace(F.element_at(_tokens(F.col("s")), -1), f"[{BREAKS}]$", "")
    broken = text_lines.where("hyphen").select("key", "n", F.lower(F.concat(part, F.element_at(_tokens(F.col("next")), 1))).alias("token"), F.length(part).alias("cut"), "next_n")
    return plain.unionByName(broken)


def vocabulary(text_lines: DataFrame) -> DataFrame:
    """(token, lead, word, whole, times): the distinct tokens of running text, the marks before each and the word without the
    marks around it, and the word with detached marks put on their letters; tokens without a word are left out."""
    counted = tokens(text_lines).where("token <> ''").groupBy("token").agg(F.count("*").alias("times"))
    rows = counted.select("token", F.length(F.regexp_extract("token", f"^[{_EDGE}]*", 0)).alias("lead"), F.regexp_extract("token", _WORD, 0).alias("word"), "times")
    return rows.where((F.length("word") >= 3) | loose(F.col("word"))).withColumn("whole", attached(F.col("word")))


def corrections(counted: DataFrame) -> DataFrame:
    """(word, right, freq, times): misread words with their best right form.

    counted(word, times) is the vocabulary. A word is joined with those whose anagram hash differs by a confusable pair's
    difference; one exchange must turn it into the other, which must be RATIO times as frequent.
    """
    valued = counted.where("length(word) between 4 and 60").withColumn("av", anagram(F.col("word")))
    rare = valued.select("word", "times", "av", F.explode(F.array(*[F.struct(F.lit(a).alias("read"), F.lit(b).alias("meant"), F.lit(_value(b) - _value(a)).alias("delta")) for a, b in CONFUSED])).alias("p"))
    rare = rare.where(F.col("word").contains(F.col("p.read"))).select("word", "times", (F.col("av") + F.col("p.delta")).alias("av"), F.col("p.read").alias("read"), F.col("p.meant").alias("meant"))
    frequent = valued.where(F.col("times") >= LEAST).select("av", F.col("word").alias("right"), F.col("times").alias("freq"))
    met = rare.join(frequent, "av").where(F.col("freq") >= RATIO * F.col("times"))
    # the pair must stand at one place: the parts before and after it are the same
    once = F.expr("exists(sequence(1, length(word)), i -> substring(word, i, length(read)) = read and concat(substring(word, 1, i - 1), meant, substring(word, i + length(read))) = right)")
    met = met.where(F.expr("length(word) - length(right)") == F.length("read") - F.length("meant")).where(F.levenshtein("word", "right") <= 2).where(once)
    return met.groupBy("word").agg(F.max_by("right", F.struct("freq", "right")).alias("right"), F.max("freq").alias("freq"), F.first("times").alias("times"))


def odd(c: Column) -> Column:
    """Does the word hold characters that no word has, as digits among letters or a mark behind its letter do?"""
    plain = c.rlike("^[\\p{L}\\p{M}0-9|@'’]+$") & c.rlike("\\p{L}.*\\p{L}")
    return loose(c) | plain & (c.rlike("[|@]") | c.rlike("\\p{L}'(?:\\p{L}|$)") | (c.rlike("[0-9]") & c.rlike("\\p{L}[0-9]{1,2}\\p{L}|^[0-9]\\p{L}{2,}|\\p{L}{2,}[0-9]$")))


def misread(text_lines: DataFrame, every: DataFrame) -> DataFrame:
    """(key, n, word, right) for each misread word of running text, on the line where the misread character stands.

    Detached marks are put on their letters before words are counted and joined, so a word may have other misreadings too.
    Words are judged once each, over the vocabulary `every`; only the misread ones are then looked for in the texts.
    """
    fixed = corrections(every.groupBy(F.col("whole").alias("word")).agg(F.sum("times").alias("times"))).select(F.col("word").alias("whole"), "right")
    strange = every.join(fixed, "whole", "left").where(F.col("right").isNotNull() | odd(F.col("word")))
    strange = cut(strange.select("token", "lead", "word", F.coalesce("right", F.when(F.col("whole") != F.col("word"), F.col("whole"))).alias("right")))
    strange = tokens(text_lines).join(F.broadcast(strange) if strange.count() <= FEW else strange, "token").withColumn("cut", F.col("cut") - F.col("lead"))
    # characters before the first difference from the right form, or before the first odd one
    agreed = F.aggregate(F.sequence(F.lit(1), F.length("word")), F.lit(0), lambda a, i: F.when((a == i - 1) & (F.substring("word", i, F.lit(1)) == F.substring("right", i, F.lit(1))), i).otherwise(a))
    before = F.length(F.regexp_extract("word", f"^(?:(?!{_LOOSE})[^0-9|@'])*", 0))
    at = F.when(F.col("right").isNull(), before).otherwise(agreed)
    return strange.select("key", F.when((F.col("cut") > 0) & (at >= F.col("cut")), F.col("next_n")).otherwise(F.col("n")).alias("n"), "word", "right")


def noise(df: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """(key, line_no, kind): the noise lines of scanned texts; kind hyphen, header, pageno or ocr.

    Null and empty texts, and structured ones, have none. Rows that repeat a key count once, with the greatest text.
    """
    classified = cut(lines(files(df, key, text, title)))  # read by each kind of noise
    edges = classified.where("kind in ('header', 'pageno')").select("key", F.col("n").alias("line_no"), "kind")
    text_lines = cut(running(classified))
    broken = text_lines.where("hyphen").select("key", F.col("n").alias("line_no"), F.lit("hyphen").alias("kind"))
    read = misread(text_lines, cut(vocabulary(text_lines))).select("key", F.col("n").alias("line_no"), F.lit("ocr").alias("kind"))
    return edges.unionByName(broken).unionByName(read).distinct()


def repaired(df: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """(key, text): scanned texts in whole paragraphs without their noise; structured texts as they are."""
    texts = files(df, key, text, title)
    classified = cut(lines(texts))
    text_lines = cut(running(classified))
    every = cut(vocabulary(text_lines))
    fixed = misread(text_lines, every).where("right is not null").select("key", "n", F.struct(attached(F.col("word")).alias("word"), "right").alias("fix")).where("fix.word <> fix.right").groupBy("key", "n").agg(F.collect_set("fix").alias("fixes"))
    whole = every.groupBy("word").agg(F.sum("times").alias("times"))
    # a break at a hyphen of the word itself keeps it, if the corpus has the hyphenated form more often
    joint = text_lines.where("hyphen").select("key", "n", F.element_at(_tokens(F.col("s")), -1).alias("a"), F.element_at(_tokens(F.col("next")), 1).alias("b"))
    joint = joint.withColumn("a", F.lower(F.ltrim(F.regexp_replace("a", f"[{BREAKS}]$", ""), F.lit(EDGES)))).withColumn("b", F.lower(F.rtrim("b", F.lit(EDGES))))
    joint = joint.join(whole.select(F.col("word").alias("w1"), F.col("times").alias("t1")), F.concat("a", "b") == F.col("w1"), "left").join(whole.select(F.col("word").alias("w2"), F.col("times").alias("t2")), F.concat_ws("-", "a", "b") == F.col("w2"), "left")
    kept = joint.groupBy("key", "n").agg(F.max(F.coalesce("t2", F.lit(0)) > F.coalesce("t1", F.lit(0))).alias("keeps"))
    blank_before = F.max(F.when(F.col("kind") == "blank", 1)).over(Window.partitionBy("key").orderBy("n").rowsBetween(-3, -1))
    starts = classified.withColumn("gap", F.coalesce(blank_before, F.lit(0)) == 1).where("kind = 'text'").select("key", "n", "raw", "gap")
    rows = text_lines.join(starts, ["key", "n"]).join(fixed, ["key", "n"], "left").join(kept, ["key", "n"], "left")
    mended = F.aggregate(F.coalesce("fixes", F.expr("array()").cast("array<struct<word:string,right:string>>")), attached(F.col("s")), lambda a, f: F.regexp_replace(a, F.concat(F.lit("(?iu)(?<![\\p{L}\\p{N}])\\Q"), f["word"], F.lit("\\E(?![\\p{L}\\p{N}])")), f["right"]))
    ended = F.lag(F.col("s").rlike("[.!?…:;][”“\"')]*$")).over(Window.partitionBy("key").orderBy("n"))
    lead = F.when(F.col("follows"), "").when((F.col("gap") & F.coalesce(ended, F.lit(True))) | F.col("raw").rlike("^ {2,}\\S"), "\n\n").otherwise(" ")
    body = F.when(F.col("hyphen") & ~F.coalesce("keeps", F.lit(False)), F.regexp_replace(mended, f"[{BREAKS}]$", "")).when(F.col("hyphen"), F.regexp_replace(mended, f"[{BREAKS}]$", "-")).otherwise(mended)
    pieces = rows.select("key", "n", F.concat(lead, body).alias("piece"))
    joined = pieces.groupBy("key").agg(F.ltrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), ""), F.lit(" \n")).alias("mended"))
    return texts.join(joined, "key", "left").select("key", F.when(F.col("scanned"), F.coalesce("mended", F.lit(""))).otherwise(F.col("text")).alias("text"))
