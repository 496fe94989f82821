"""Search units of a text: pieces near a target size that end at a line, a sentence or a word."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

TARGET, LEAST, MOST = 1_400, 400, 2_400
#: Where a chunk may end, the better place first: before a line feed, after a mark that ends or parts sentences
#: and is followed by a blank, before a blank.
_LINE, _SENTENCE, _BLANK = re.compile("(?=\n)"), re.compile(r"[.!?;:][)\"“”]?(?=\s)"), re.compile(r"(?=\s)")
#: What a cut costs beyond the distance from the target, by what it falls on.
PENALTY = {"margin": 0.0, "paragraph": 0.3, "sentence": 0.6, "word": 1.2}
TAIL = 1.0


def spans(text: str, target: int = TARGET, least: int = LEAST, most: int = MOST) -> list[tuple[int, int]]:
    """(start, end) of the chunks, without the white space around them; only the last may be shorter than `least`."""
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        while text[at].isspace():
            at += 1
        if end - at <= most:
            out.append((at, end))
            break
        cut = at + most
        for mark in (_LINE, _SENTENCE, _BLANK):
            places = [m.end() for m in mark.finditer(text, at + least, at + most)]
            if places:
                cut = min(places, key=lambda p: (abs(p - at - target), p))
                break
        out.append((at, at + len(text[at:cut].rstrip())))
        at = cut
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, k, a, b) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, (a, b) in enumerate(spans(t))]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["id", "ord", "char_start", "char_end"])


def chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, ord, char_start, char_end) of each text's chunks, offsets in code points; null and blank texts have none."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null").dropDuplicates(["id"])
    return rows.mapInArrow(_run, "id long, ord int, char_start int, char_end int")


def structural(lines: list[tuple[int, int, str]], text: str, target: int = TARGET, least: int = LEAST, most: int = MOST) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a structured text, given its lines as (start, end, kind); no chunk goes over a heading.

    Within a stretch, a chunk ends where the distance from the target, as a share of it, and what the cut falls on cost
    least; a cut that leaves a short tail costs TAIL more."""
    out, stretch = [], []
    for start, end, kind in [*lines, (len(text), len(text), "heading")]:
        if kind == "heading" and stretch:
            out += _costed(text, stretch, target, least, most)
            stretch = []
        stretch.append((start, end, kind))
    return out


def _costed(text: str, lines: list[tuple[int, int, str]], target: int, least: int, most: int) -> list[tuple[int, int]]:
    out, at, stop = [], lines[0][0], lines[-1][1]
    starts = {a: ("margin" if kind == "margin" else "paragraph") for a, _, kind in lines}
    while at < stop:
        while at < stop and text[at].isspace():
            at += 1
        if at >= stop:
            break
        cut = stop
        if stop - at > most:
            lo, hi = at + least, at + most
            places = [(p, kind) for p, kind in starts.items() if lo <= p <= hi]
            places += [(m.end(), "sentence") for m in _SENTENCE.finditer(text, lo, hi)] + [(m.start(), "word") for m in _BLANK.finditer(text, lo, hi)]
            cost = lambda c: abs(c[0] - at - target) / target + PENALTY[c[1]] + (TAIL if stop - c[0] < least else 0)  # noqa: B023, E731
            cut = min(places, key=lambda c: (cost(c), c[0]))[0] if places else hi
        out.append((at, at + len(text[at:cut].rstrip())))
        at = cut
    return [(a, b) for a, b in out if b > a]


def _kind(line: str) -> str:
    return "heading" if re.match("#{1,6} ", line) else "margin" if re.match(r"\[m\. č\. [0-9]+\]", line) else "text"


def _structured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines, at = [], 0
            for line in text.split("\n"):
                lines.append((at, at + len(line), _kind(line)))
                at += len(line) + 1
            rows += [(key, n, a, b) for n, (a, b) in enumerate(structural(lines, text))]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["id", "ord", "char_start", "char_end"])


def structural_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, ord, char_start, char_end) of structured texts: never over a heading, at cheap cuts near the target."""
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null").dropDuplicates(["id"])
    return rows.mapInArrow(_structured, "id string, ord int, char_start int, char_end int")


def cover(cut: DataFrame, df: DataFrame, key: str, text: str, most: int = MOST) -> DataFrame:
    """(id, whole, bounded) of each text that isn't blank, told from its chunks alone: put together they are the text without
    white space, and none is too long."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("_t")).where("id is not null").dropDuplicates(["id"]).withColumn("_ink", F.regexp_replace("_t", r"[\s\u00a0]", "")).where("_ink <> ''")
    held = cut.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "char_start", "char_end"))).alias("c"))
    told = F.array_join(F.transform("c", lambda c: F.substring("_t", c["char_start"] + 1, c["char_end"] - c["char_start"])), "")
    fits = F.forall("c", lambda c: (c["char_end"] > c["char_start"]) & (c["char_end"] - c["char_start"] <= most))
    return rows.join(held, "id", "left").select("id", F.coalesce(F.regexp_replace(told, r"[\s\u00a0]", "") == F.col("_ink"), F.lit(False)).alias("whole"), F.coalesce(fits, F.lit(False)).alias("bounded"))


#: A heading of a dissenting opinion is a line of its own, so long at most; one so near to the last is no other.
MOST_HEADING, SAME = 160, 300
#: The letters that begin such a line, blanks apart, after a number or none.
_BLANKS = r"[ \t\x0B\f\r]*"
_HEADING = f"(?dimu)^{_BLANKS}(?:" + _BLANKS.join([r"[0-9]", r"[0-9]?", r"\.", ""]) + ")?" + _BLANKS.join([*"odlišn", "[éáý]", *"stanovisk"]) + r"[^\n]*"


def dissents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, char_start, char_end, heading) of dissenting opinions: from a heading line to the next one or to the end.

    A line is a heading if its letters begin with `odlišné stanovisko`, numbered or letter-spaced or not. Of several texts
    of a key one counts. The headings are found within each row, so that only they are shuffled, never a text or its lines."""
    lines, between = F.regexp_extract_all(text, F.lit(_HEADING), F.lit(0)), F.split(text, _HEADING, -1)
    none = F.lit(None)
    start = F.struct(F.lit(0).alias("at"), none.cast("int").alias("last"), F.array().cast("array<struct<char_start:int,heading:string>>").alias("heads"))

    def step(have: Column, x: Column) -> Column:
        line = x["line"]  # null behind the last heading
        at = have["at"] + F.length(x["before"]) + F.length(line) - F.length(F.ltrim(line))
        new = (F.length(F.trim(line)) <= MOST_HEADING) & (have["last"].isNull() | (at - have["last"] >= SAME))
        head = F.struct(at.alias("char_start"), F.trim(line, F.lit(" \r")).alias("heading"))
        return F.struct(
            (have["at"] + F.length(x["before"]) + F.coalesce(F.length(line), F.lit(0))).alias("at"), F.when(new, at).otherwise(have["last"]).alias("last"),
            F.when(new, F.concat(have["heads"], F.array(head))).otherwise(have["heads"]).alias("heads"),
        )

    heads = F.aggregate(F.zip_with(lines, between, lambda a, b: F.struct(a.alias("line"), b.alias("before"))), start, step, lambda have: have["heads"])
    rows = df.where(F.col(text).isNotNull()).select(key, F.length(text).alias("_size"), heads.alias("_heads")).dropDuplicates([key])
    rows = rows.select(key, "_size", F.posexplode("_heads").alias("no", "_head"))
    after = F.lead("_head.char_start").over(Window.partitionBy(key).orderBy("no"))
    return rows.select(key, "no", "_head.char_start", F.coalesce(after, F.col("_size")).alias("char_end"), "_head.heading")
