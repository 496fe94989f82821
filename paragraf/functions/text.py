"""Text expressions: folding, words, snippets, pages and identifiers, all on the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from paragraf.functions.analysis import JOINED



def _plain_letters() -> tuple[str, str]:
    """Lower-case letters that a base and marks make up, and their bases, for all planes' first: what stripping marks gives."""
    marked, plain = [], []
    for cp in range(0xC0, 0x10000):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000 or ch != ch.lower():
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c)[0] != "M")
        if len(bare) == 1 and bare != ch:
            marked.append(ch), plain.append(bare)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _plain_letters()
#: A word: a letter or decimal digit, then letters, digits and marks.
WORD = r"[\p{L}\p{Nd}][\p{L}\p{Nd}\p{M}]*"


def fold(c: Column) -> Column:
    """Lower case without marks, in every script; letters without a mark to strip are written out. Null stays null."""
    one = "".join(a for a, b in JOINED.items() if len(b) == 1)
    out = F.translate(F.lower(c), MARKED + one, PLAIN + "".join(JOINED[a] for a in one))
    for a, b in JOINED.items():
        out = F.replace(out, F.lit(a), F.lit(b)) if len(b) > 1 else out
    return F.regexp_replace(out, "\\p{M}+", "")


def words(c: Column) -> Column:
    """The lower-cased words of a text in order; null for null."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)


def snippet(c: Column, most: int = 400) -> Column:
    """At most so many characters, cut at the last blank if that lies beyond 60 % of them, with an ellipsis where cut."""
    head = F.substring(c, 1, most)
    cut = F.lit(most) - F.length(F.substring_index(F.reverse(head), " ", 1)) - 1
    whole = F.when(head.contains(" ") & (cut >= int(most * 0.6)), F.substring(head, F.lit(1), cut.cast("int"))).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(whole), F.lit("…")))


def pages(c: Column, size: int) -> Column:
    """The text in pages of `size` characters; an empty text has one empty page."""
    count = F.greatest(F.lit(1), F.ceil(F.length(c) / size)).cast("int")
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.struct(i.alias("page"), F.substring(c, (i - 1) * size + 1, F.lit(size)).alias("text")))


def case_key(c: Column) -> Column:
    """The key of a case number: senate, register, running number and year, lower-cased; null if it is none."""
    pattern = r"(?i)^\s*(\d{1,3}|[IVX]{1,4}\.)\s+(\p{L}{1,5})\s+(\d{1,6})/(\d{2,4})"
    year = F.regexp_extract(c, pattern, 4)
    full = F.when(F.length(year) == 2, F.when(year.try_cast("int") <= 40, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))).otherwise(year)
    return F.when(c.rlike(pattern), F.concat(F.lit("sz:"), F.lower(F.regexp_extract(c, pattern, 1)), F.lit(" "), F.lower(F.regexp_extract(c, pattern, 2)), F.lit(" "), F.regexp_extract(c, pattern, 3), F.lit("/"), full))


def ecli_court(c: Column) -> Column:
    """The court part of a European case-law identifier; null unless it is one."""
    return F.when(c.rlike("^ECLI:[A-Z]{2}:[A-Z0-9]+:[0-9]{4}:.+$"), F.split_part(c, F.lit(":"), F.lit(3)))


def check_digit_13(c: Column) -> Column:
    """The thirteenth digit that goes with twelve: weights 1 and 3 in turn."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substring(c, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return (10 - F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10) % 10


def html_text(c: Column) -> Column:
    """Plain text of HTML: scripts and styles dropped, block tags as line breaks, the common entities, blanks collapsed."""
    out = F.regexp_replace(c, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?i)<(?:br|/?(?:p|div|li|ul|ol|tr|table|h[1-6]|section|article))\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[a-zA-Z/!][^>]*>", "")
    for a, b in (("&nbsp;", " "), (" ", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.btrim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit(" \n"))
