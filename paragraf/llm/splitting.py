"""Cutting long texts at natural boundaries, with an overlap, by range-maximum queries over boundary strengths.

Every place of a text has a strength as an end and one as a start of a piece: 0 inside a run of non-white characters,
1 inside a run longer than a piece may be, 2 at a word, 3 at a sentence, 4 at a line, 5 at a paragraph. A sparse table
over strength and place answers in two look-ups which place of any window is the strongest and, among equals, rightmost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paragraf.functions.codepoints import is_blank, slices

MOST, LEAST_OVERLAP, MOST_OVERLAP = 2_400, 80, 240
#: A piece that isn't the last is at least so long where a boundary allows it.
LEAST = 1_200
#: Marks that end a sentence, and marks that may follow them.
STOPS, CLOSERS = ".!?…。！？।؟", "\"'“”’»›)]}"


class Boundaries:
    """What the places of a slice of texts are, by flat position: one more place per text than it has characters."""

    def __init__(self, cps: np.ndarray, rows: np.ndarray, most: int = MOST):
        texts = len(rows) - 1
        self.rows, self.most = rows + np.arange(texts + 1), most  # each text gets a place of its own after its end
        size = len(cps) + texts
        where = np.arange(len(cps)) + np.repeat(np.arange(texts), np.diff(rows))
        self.cps = np.full(size, 32, np.uint32)
        self.cps[where] = cps
        self.ink = np.zeros(size + 1, bool)  # place i stands before character i; the last place of a text is blank
        self.ink[where] = ~is_blank(cps)
        self.inked = np.zeros(size + 2, np.int64)
        np.cumsum(self.ink, out=self.inked[1:])
        left = np.zeros(size + 1, bool)
        left[1:] = self.ink[:-1]
        here = np.arange(size + 1)
        begin = np.maximum.accumulate(np.where(self.ink & ~left, here, 0))
        stop = np.minimum.accumulate(np.where(~self.ink & left, here, size)[::-1])[::-1]
        self.inside = self.ink & left
        self.hard = self.inside & (np.append(stop[1:], size) - begin > most)  # the run is too long to be kept whole
        self.left = left

    def strengths(self) -> tuple[np.ndarray, np.ndarray]:
        """Strength of each place as the end and as the start of a piece."""
        size = len(self.ink) - 1
        here = np.arange(size + 1)
        feeds = np.zeros(size + 2, np.int64)
        np.cumsum(np.append(self.cps == 10, False), out=feeds[1:])
        next_ink = np.minimum.accumulate(np.where(self.ink, here, size)[::-1])[::-1]
        last_ink = np.maximum.accumulate(np.where(self.left, here, 0))
        stop = np.append(np.isin(self.cps, [ord(c) for c in STOPS]), False)
        closer = np.append(np.isin(self.cps, [ord(c) for c in CLOSERS]), False)
        ends = np.zeros(size + 1, bool)
        ends[1:] = stop[:-1]
        ends[2:] |= closer[1:-1] & stop[:-2]

        def rate(lines: np.ndarray, sentence: np.ndarray) -> np.ndarray:
            return np.where(lines >= 2, 5, np.where(lines == 1, 4, np.where(sentence, 3, 2)))

        end = np.where(self.left & ~self.ink, rate(feeds[next_ink] - feeds[here], ends), 0)
        start = np.where(self.ink & ~self.left, rate(feeds[here] - feeds[last_ink], ends[last_ink]), 0)
        return np.where(self.hard, 1, end), np.where(self.hard, 1, start)


class SparseTable:
    """Range maximum over strengths: best(lo, hi) is the rightmost of the strongest places in lo..hi, or -1."""

    def __init__(self, strength: np.ndarray, widest: int):
        self.levels = [(strength.astype(np.int64) << 40) + np.arange(len(strength))]
        while (1 << len(self.levels)) <= min(widest, len(strength)):
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def best(self, lo: int, hi: int) -> int:
        lo, hi = max(lo, 0), min(hi, len(self.levels[0]) - 1)
        if hi < lo:
            return -1
        k = min((hi - lo + 1).bit_length() - 1, len(self.levels) - 1)
        found = -1
        while lo <= hi:  # windows are at most as wide as the table, so this takes two look-ups
            found = max(found, int(self.levels[k][lo]), int(self.levels[k][max(lo, hi - (1 << k) + 1)]))
            lo += 2 << k
        return found & ((1 << 40) - 1) if found >> 40 else -1


def cut_text(end: np.ndarray, start: np.ndarray, ink: np.ndarray, most: int = MOST, least_overlap: int = LEAST_OVERLAP, most_overlap: int = MOST_OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text, by the strengths of its places and which of its characters are no white space."""
    inked = np.flatnonzero(ink)
    if not len(inked):
        return []
    at, last = int(inked[0]), int(inked[-1]) + 1
    if last - at <= most:
        return [(at, last)]
    starts = SparseTable(start, most_overlap - least_overlap + 1)
    n = len(end)
    # an end from which no start lies within the permissible overlap is no use
    any_start = np.zeros(n + 1, np.int64)
    np.cumsum(start > 0, out=any_start[1:])
    here = np.arange(n)
    fits = any_start[np.maximum(here - least_overlap + 1, 0)] > any_start[np.maximum(here - most_overlap, 0)]
    ends = SparseTable(np.where(fits, end, 0), most)
    plain = SparseTable(end, most)
    out = []
    while last - at > most:
        to = ends.best(at + least, at + most)
        if to < 0:
            to = ends.best(at + most_overlap + 1, at + most)
        if to < 0:
            to = plain.best(at + 1, at + most)
        to = at + most if to < 0 else to
        out.append((at, to))
        back = starts.best(to - most_overlap, to - least_overlap)
        if back <= at:
            back = starts.best(max(at + 1, to - most_overlap), to)
            if back <= at:
                later = np.flatnonzero(start[to:] > 0)
                back = to + int(later[0]) if len(later) else to
        at = back
    return [*out, (at, last)]


def _pieces(most: int, least_overlap: int, most_overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, last, cps, rows in slices(batch.column(1)):
                places = Boundaries(cps, rows, most)
                end, start = places.strengths()
                out = []
                for i in range(last - first):
                    lo, hi = int(places.rows[i]), int(places.rows[i + 1])
                    pieces = cut_text(end[lo:hi], start[lo:hi], places.ink[lo:hi], most, least_overlap, most_overlap)
                    out.extend((ids[first + i], k, a, b) for k, (a, b) in enumerate(pieces))
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["id", "ord", "char_start", "char_end"])

    return run


def pieces(df: DataFrame, key: str, text: str, most: int = MOST, least_overlap: int = LEAST_OVERLAP, most_overlap: int = MOST_OVERLAP) -> DataFrame:
    """(id, ord, char_start, char_end): each text in pieces of at most `most` code points, consecutive ones overlapping.

    A piece ends and starts at the strongest boundary of its window, the rightmost of equals; only runs of non-white
    characters longer than `most` are cut within. A text that fits is one piece without the white space around it;
    null, empty and blank texts have none. Rows that repeat a key and a text count once.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("body")).where("id is not null and body is not null").dropDuplicates(["id"])
    return rows.mapInArrow(_pieces(most, least_overlap, most_overlap), "id long, ord int, char_start int, char_end int")


def cover(texts: DataFrame, key: str, text: str, cut: DataFrame, most: int = MOST, least_overlap: int = LEAST_OVERLAP, most_overlap: int = MOST_OVERLAP) -> DataFrame:
    """(id, covered, bounded, overlapping) of each text that isn't blank, told from its pieces (id, ord, char_start, char_end)
    alone: they hold all that isn't white space, none is too long, and consecutive ones share as much as they must."""
    rows = texts.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("body")).where("id is not null and body is not null").dropDuplicates(["id"])
    blank = "[ \\t\\n\\r\\u00a0]"
    ink = rows.select("id", F.length("body").alias("chars"), F.length(F.regexp_extract("body", f"^{blank}*", 0)).alias("first"), F.length(F.regexp_extract("body", f"{blank}*$", 0)).alias("last")).where("first < chars")
    held = cut.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "char_start", "char_end"))).alias("p"))
    steps = F.transform(F.slice("p", F.lit(2), F.greatest(F.lit(0), F.size("p") - 1)), lambda x, i: F.get("p", i)["char_end"] - x["char_start"])
    whole = (F.get("p", F.lit(0))["char_start"] <= F.col("first")) & (F.element_at("p", -1)["char_end"] >= F.col("chars") - F.col("last")) & F.forall(steps, lambda s: s >= 0)
    rows = ink.join(held, "id", "left").select(
        "id", F.coalesce(whole, F.lit(False)).alias("covered"), F.coalesce(F.forall("p", lambda x: (x["char_end"] > x["char_start"]) & (x["char_end"] - x["char_start"] <= most)), F.lit(False)).alias("bounded"),
        F.coalesce(F.forall(steps, lambda s: s.between(least_overlap, most_overlap)), F.lit(False)).alias("overlapping"),
    )
    return rows


def _faults(most: int, least_overlap: int, most_overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, ord) of the stored pieces [(ord, start, end)] of each text that are no valid pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last, cps, rows in slices(batch.column(1)):
                stored = batch.column(2).slice(first, last - first)
                count = np.diff(stored.offsets.to_numpy())
                flat = stored.flatten()
                number, start, end = (np.asarray(flat.field(i).fill_null(-1)).astype(np.int64) for i in range(3))
                row = np.repeat(np.arange(last - first), count)
                places = Boundaries(cps, rows, most)
                base, size = places.rows[row], (rows[1:] - rows[:-1])[row]
                bad = (end - start > most) | (start >= end) | (end > size) | (start < 0)
                lo, hi = base + np.clip(start, 0, size), base + np.clip(end, 0, size)
                within = places.inside & ~places.hard
                bad |= within[lo] | within[hi]
                bad |= (number == 0) & (places.inked[lo] > places.inked[base])
                top = np.full(last - first, np.iinfo(np.int64).min)
                np.maximum.at(top, row, number)
                bad |= (number == top[row]) & (places.inked[base + size] > places.inked[hi])
                order = np.lexsort((number, row))
                r, n, s, e = row[order], number[order], start[order], end[order]
                gap = np.zeros(len(r), bool)
                shared = e[:-1] - s[1:]
                gap[1:] = (r[1:] == r[:-1]) & (n[1:] == n[:-1] + 1) & (n[1:] > 0) & ((shared < least_overlap) | (shared > most_overlap))
                bad[order] |= gap
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + row[bad]]), pa.array(number[bad].astype(np.int32))], names=["id", "ord"])

    return run


def invalid_pieces(df: DataFrame, key: str, text: str, stored: DataFrame, stored_key: str, most: int = MOST, least_overlap: int = LEAST_OVERLAP, most_overlap: int = MOST_OVERLAP) -> DataFrame:
    """(id, ord) of the rows of stored(ord, char_start, char_end) that are no valid pieces of their text.

    Uses the same boundaries as `pieces`. Stored rows that are there twice count once; those of a null or missing text
    are judged as pieces of an empty one.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("body")).where("id is not null")
    spans = (
        stored.select(F.col(stored_key).cast("long").alias("id"), F.col("ord").cast("int").alias("ord"), F.col("char_start").cast("int").alias("s"), F.col("char_end").cast("int").alias("e"))
        .where("id is not null and ord is not null")
        .groupBy("id")
        .agg(F.array_sort(F.collect_set(F.struct("ord", "s", "e"))).alias("spans"))
    )
    both = spans.join(rows, "id", "left").dropDuplicates(["id"]).select("id", F.coalesce("body", F.lit("")).alias("body"), "spans")
    return both.mapInArrow(_faults(most, least_overlap, most_overlap), "id long, ord int").distinct()
