"""Lines repeated across one source's documents, found by content-defined chunks.

A text is read as one stream without white space and digits, in lower case; line feeds mean nothing to it. A rolling
hash over GRAM characters runs along the stream, and a cut lies wherever that hash is the least of some window of WINDOW
places. The cuts depend on the content alone, so a passage that several documents share has the same cuts in all of
them. A chunk is known by the hash at its cut. For each source and chunk the distinct documents are counted.

Any stretch of GRAM + WINDOW - 1 = 25 characters holds at least one cut, and the least hash of a stretch that long is
always a cut. So a line of 25 characters or more that recurs in so many documents has, at its least hash, a chunk that
recurs in at least as many: looking at lines with a frequent chunk only loses none. Those lines are then compared whole.

The texts are read by Python twice: once for the chunks, once for the lines with a frequent chunk, which are few and are
written down before they are counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paragraf.functions.codepoints import is_blank, lowered, mix, powers, prefix_hash, slices, span_hash
from paragraf.session import cut

GRAM, WINDOW = 8, 18
LEAST_CHARS = GRAM + WINDOW - 1
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Frequent chunks, 8 bytes each, that are sent to all tasks; more of them are joined instead.
SENT = 2_000_000
#: Repeated lines, 8 bytes each, that are broadcast; more of them are joined with salted keys.
FEW, SALTS = 500_000, 16
#: Chunk counts that a task holds before it hands them on.
FOLD = 2_000_000


def source_name(c: Column) -> Column:
    """Trimmed, white space collapsed, lower-cased; blank counts as null."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(c, r"[ \t\n\r ]+", " "), r"^ | $", ""))
    return F.when(plain != "", plain)


class _Stream:
    """The streams of a slice of texts, one after another, WINDOW + GRAM empty places between them."""

    def __init__(self, cps: np.ndarray, rows: np.ndarray):
        kept = ~(is_blank(cps) | ((cps >= 48) & (cps <= 57)))
        self.before = np.zeros(len(cps) + 1, np.int64)  # kept characters before each place of the texts
        np.cumsum(kept, out=self.before[1:])
        self.pad = WINDOW + GRAM
        texts = len(rows) - 1
        size = int(self.before[-1]) + self.pad * texts
        row = np.repeat(np.arange(texts), np.diff(self.before[rows]))
        self.at = np.arange(len(row)) + row * self.pad  # place in the streams of each kept character
        values, used = np.zeros(size, np.uint32), np.zeros(size, bool)
        values[self.at], used[self.at] = lowered(cps[kept]), True
        self.total = prefix_hash(values)
        filled = np.zeros(size + 1, np.int64)
        np.cumsum(used, out=filled[1:])
        self.hash = np.full(size, LAST, np.uint64)
        if size >= GRAM:
            whole = filled[GRAM:] - filled[:-GRAM] == GRAM
            start = np.flatnonzero(whole)
            inverse = powers(size + 1)[1]
            self.hash[start] = mix((self.total[start + GRAM] - self.total[start]) * inverse[start])

    def cuts(self) -> np.ndarray:
        """Places whose hash is the least of some window of WINDOW places around them."""
        if len(self.hash) < WINDOW:
            return np.zeros(0, np.int64)
        low, high = _sliding(self.hash, np.minimum), None
        padded = np.concatenate((np.zeros(WINDOW - 1, np.uint64), low, np.zeros(WINDOW - 1, np.uint64)))
        high = _sliding(padded, np.maximum)
        return np.flatnonzero((high == self.hash) & (self.hash != LAST))


def _sliding(values: np.ndarray, least: np.ufunc) -> np.ndarray:
    """The least (or greatest) of each WINDOW places, by doubling."""
    done, out = 1, values
    while done * 2 <= WINDOW:
        out = least(out[:-done], out[done:])
        done *= 2
    return least(out[: len(values) - WINDOW + 1], out[WINDOW - done : WINDOW - done + len(values) - WINDOW + 1]) if done < WINDOW else out


def _chunk_counts(named: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(chunk of a source, documents of this task with it) for rows (id, source hash, text), one row per document; with the
    source's hash where `named`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sources, held = [], [], 0

        def counted() -> pa.RecordBatch:
            every = np.concatenate(parts)
            order = np.argsort(every) if named else None
            every = every[order] if named else np.sort(every)
            at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            columns = [pa.array(every[at].view(np.int64)), pa.array(np.diff(np.append(at, len(every))))]
            if named:
                columns.append(pa.array(np.concatenate(sources)[order][at].view(np.int64)))
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "docs", "source"][: len(columns)])

        for batch in batches:
            source = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for first, _, cps, rows in slices(batch.column(2)):
                stream = _Stream(cps, rows)
                cuts = stream.cuts()
                begin = stream.before[rows] + np.arange(len(rows)) * stream.pad
                row = np.searchsorted(begin, cuts, "right") - 1
                key = mix(stream.hash[cuts] ^ source[first + row])
                order = np.lexsort((key, row))
                key, row = key[order], row[order]
                once = np.ones(len(key), bool)
                once[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                parts.append(key[once])
                if named:
                    sources.append(source[first + row[once]])
                held += int(once.sum())
                if held > FOLD:
                    yield counted()
                    parts, sources, held = [], [], 0
        if held:
            yield counted()

    return run


def _lines(batches: Iterator[pa.RecordBatch], frequent: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(id, line_no, chunk, line, once) for each line long enough: its chunk of least hash, and the hash of the whole line.

    once is 1 for the first of a document's lines that are the same, so that its sum counts documents. Where the frequent
    chunks are given, in order, only lines with one of them come out."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        source = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for first, _, cps, rows in slices(batch.column(2)):
            stream = _Stream(cps, rows)
            feed = np.flatnonzero(cps == 10)
            start = np.union1d(rows[:-1], feed + 1)
            start = start[start < len(cps)]
            if not len(start):
                continue
            row = np.searchsorted(rows, start, "right") - 1
            # a line ends at its line feed or at the end of its text
            end = np.minimum(np.append(feed, len(cps))[np.searchsorted(feed, start)], rows[row + 1])
            number = np.arange(len(start)) - np.searchsorted(start, rows[:-1])[row]
            kept = stream.before[end] - stream.before[start]
            long = kept >= LEAST_CHARS
            start, end, row, number, kept = start[long], end[long], row[long], number[long], kept[long]
            if not len(start):
                continue
            lo = stream.before[start] + row * stream.pad
            hi = lo + kept
            spans = np.stack((lo, hi - GRAM + 1), 1).ravel()
            least = np.minimum.reduceat(np.append(stream.hash, LAST), spans)[::2]
            chunk = mix(least ^ source[first + row])
            line = mix(span_hash(stream.total, lo, hi) ^ source[first + row])
            order = np.lexsort((line, row))
            once = np.ones(len(line), np.int32)
            once[order[1:]] = ((line[order][1:] != line[order][:-1]) | (row[order][1:] != row[order][:-1])).astype(np.int32)
            if frequent is not None:
                kept = frequent[np.minimum(np.searchsorted(frequent, chunk), len(frequent) - 1)] == chunk if len(frequent) else np.zeros(len(chunk), bool)
                row, number, chunk, line, once = row[kept], number[kept], chunk[kept], line[kept], once[kept]
            yield pa.RecordBatch.from_arrays([pa.array(ids[first + row]), pa.array(number.astype(np.int32)), pa.array(chunk.view(np.int64)), pa.array(line.view(np.int64)), pa.array(once)], names=["id", "line_no", "chunk", "line", "once"])


def all_bodies(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(id, body): one row per key of `texts`, whether or not it has a source."""
    return texts.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("body")).where("id is not null and body is not null").dropDuplicates(["id"])


def sourced(texts: DataFrame, key: str, text: str, sources: DataFrame, source_key: str, source: str) -> DataFrame:
    """(id, source, body): one row per key of `texts`, with the one name that `sources` has for it; keys without are left out."""
    named = sources.select(F.col(source_key).cast("long").alias("id"), source_name(F.col(source).cast("string")).alias("source")).where("id is not null and source is not null")
    named = named.groupBy("id").agg(F.min("source").alias("source"))
    bodies = texts.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("body")).where("id is not null and body is not null")
    return bodies.join(named, "id").dropDuplicates(["id"])


def repeated_lines(bodies: DataFrame, least_docs: int = 10) -> DataFrame:
    """(id, line_no) of the lines that recur in at least least_docs documents of their source; bodies as `sourced` makes them.

    Lines count from 0 and end at line feeds. Two lines are the same if they agree without white space and the digits
    0-9 and in lower case; shorter ones than LEAST_CHARS such characters are no case. Null and empty texts have none.
    """
    rows = bodies.select("id", F.xxhash64("source").alias("source"), "body")
    chunks = cut(rows.mapInArrow(_chunk_counts(), "chunk long, docs long").groupBy("chunk").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("chunk"))
    schema = "id long, line_no int, chunk long, line long, once int"
    if chunks.count() <= SENT:
        sent = rows.sparkSession.sparkContext.broadcast(np.sort(chunks.toPandas()["chunk"].to_numpy(np.int64).view(np.uint64)))  # at most SENT entries
        lines = rows.mapInArrow(lambda batches: _lines(batches, sent.value), schema)
    else:
        lines = _among(rows.mapInArrow(_lines, schema), chunks, "chunk")
    lines = cut(lines.select("id", "line_no", "line", "once"))
    often = cut(lines.groupBy("line").agg(F.sum("once").alias("docs")).where(F.col("docs") >= least_docs).select("line"))
    return (lines.join(F.broadcast(often), "line", "left_semi") if often.count() <= FEW else _among(lines, often, "line")).select("id", "line_no")


def _among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the keys; rows of one key are spread over SALTS places, so none gathers in one task."""
    salted = rows.withColumn("_salt", F.pmod(F.col("id"), F.lit(SALTS)))
    every = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(every, [key, "_salt"], "left_semi").drop("_salt")


def without_lines(bodies: DataFrame, found: DataFrame) -> DataFrame:
    """(id, body, cut) with the found lines taken out and their number; texts without such lines stay as they are."""
    gone = found.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.array_join(F.filter(F.split("body", "\n", -1), lambda line, i: ~F.array_contains("gone", i)), "\n")
    return bodies.join(gone, "id", "left").select("id", F.when(F.col("gone").isNull(), F.col("body")).otherwise(kept).alias("body"), F.coalesce(F.size("gone"), F.lit(0)).alias("cut"))


def chunk_report(bodies: DataFrame, least_docs: int = 10) -> DataFrame:
    """(source, chunk, docs): the chunks that recur in least_docs documents of their source or more, and in how many.

    A chunk is the GRAM kept characters at a cut, in lower case without white space and digits."""
    rows = bodies.select("id", F.xxhash64("source").alias("source"), "body")
    named = bodies.select(F.xxhash64("source").alias("hash"), "source").distinct()
    chunks = rows.mapInArrow(_chunk_counts(True), "chunk long, docs long, source long")
    return chunks.groupBy("source", "chunk").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).withColumnRenamed("source", "hash").join(named, "hash").select("source", "chunk", "docs")
