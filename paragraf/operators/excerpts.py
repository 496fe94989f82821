"""Where a kept hit matches, and what of it is shown: spans by stem and identifier, the densest window, stretches around a
word. For the few rows of a result, so in Arrow batches after the limit."""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paragraf.functions.analysis import index_term

Span = tuple[int, int]
WINDOW, REACH = 600, 300
CONTEXT, PARAGRAPH, MOST_WINDOWS, MOST_MATCHES, PAGE = 500, 1_200, 8, 200, 45_000
GAP = "\n\n[…]\n\n"
_WORD = re.compile(r"[^\W_]+")
_term = lru_cache(maxsize=100_000)(index_term)


def merged(spans: list[Span]) -> list[Span]:
    """Spans in order, those that overlap joined."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def matches(text: str, terms: list[str], patterns: list[str] = []) -> list[Span]:  # noqa: B006
    """The words whose term starts with one of the terms, or equals it if that is short or holds a digit, and what the
    patterns of identifiers match."""
    whole = {t for t in terms if len(t) <= 2 or re.search("[0-9]", t)}
    leads = tuple(t for t in terms if t and t not in whole)
    found = [m.span() for m in _WORD.finditer(text) if (t := _term(m.group().lower())) in whole or (leads and t.startswith(leads))]
    return merged(found + [m.span() for p in patterns for m in re.finditer(p, text)])


#: What is left of a word at a place, and what of one stands before a place.
_REST, _LEFT, _BLANK = re.compile(r"[\w\u0300-\u036f]*"), re.compile(r"[\w\u0300-\u036f]+\Z"), re.compile(r"\s*")


def _whole_words(text: str, span: Span, hit: Span) -> Span:
    """The span without the parts of words and the blanks at its ends, but never without the hit."""
    start, end = span
    if start and _LEFT.search(text, 0, start) and _REST.match(text, start).end() > start:
        start = _REST.match(text, start).end()
    start = min(hit[0], _BLANK.match(text, start).end())
    if end < len(text) and _REST.match(text, end).end() > end and (part := _LEFT.search(text[hit[1] : end])):
        end = hit[1] + part.start()
    return start, max(hit[1], hit[1] + len(text[hit[1] : end].rstrip()))


def _densest(spans: list[Span], most: int) -> list[Span]:
    """The first of the longest runs of spans that fit into `most` characters; one at least."""
    ends = [b for _, b in spans]
    runs = [spans[i : max(i + 1, bisect.bisect_right(ends, a + most))] for i, (a, _) in enumerate(spans)]
    return max(runs, key=len)


def best_window(text: str, spans: list[Span], most: int = WINDOW) -> tuple[int, int, str] | None:
    """(start, end, excerpt) around most matches: from the paragraph's start if that is near, else with a third of the room
    before them; whole words, and an ellipsis only where running text is cut."""
    spans = [s for s in merged(spans) if 0 <= s[0] < s[1] <= len(text)]
    if not spans or most <= 0:
        return None
    run = _densest(spans, most)
    hit, lead = run[0], text.rfind("\n", 0, run[0][0]) + 1
    if hit[0] - lead > REACH or hit[1] - lead > most:
        room = max(0, most - (run[-1][1] - hit[0]))
        lead = max(0, min(hit[0] - room // 3, len(text) - most))
    start, end = _whole_words(text, (lead, min(len(text), lead + most)), hit)
    before, after = text[:start].rpartition("\n")[2], text[end:].partition("\n")[0]
    return start, end, f"{'…' if before.strip() else ''}{text[start:end]}{'…' if after.strip() else ''}"


def folded(text: str) -> str:
    """Without case and marks, character for character."""
    return "".join(ch.lower() if ch < "\x80" else (low if len(low := unicodedata.normalize("NFD", ch)[0].lower()) == 1 else ch) for ch in text)


def _paragraph(text: str, a: int, b: int) -> Span:
    """What of its paragraph is shown around a match: from its start if that is near, and some characters behind."""
    first, last = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    return (first if a - first <= PARAGRAPH else max(0, a - CONTEXT)), min(len(text) if last < 0 else last, b + CONTEXT)


def stretches(text: str, word: str, most: int = PAGE) -> tuple[int, int, str]:
    """(matches, windows, shown text): paragraphs around each match of a word, whatever its case and marks; near ones joined."""
    needle = folded(word.strip())
    hits = list(itertools.islice(re.finditer(re.escape(needle), folded(text)), MOST_MATCHES)) if needle else []
    windows: list[Span] = []
    for a, b in (_paragraph(text, *m.span()) for m in hits):
        touches = windows and a <= windows[-1][1]
        windows[-1:] = [(windows[-1][0], max(windows[-1][1], b))] if touches else [*windows[-1:], (a, b)]
    edge = lambda i: "" if i in (0, len(text)) or "\n" in text[max(0, i - 1) : i + 1] else "…"
    parts = [edge(a) + text[a:b] + edge(b) for a, b in windows[:MOST_WINDOWS]]
    sizes = itertools.accumulate(len(p) + len(GAP) for p in parts)
    fitting = sum(size - len(GAP) <= most for size in sizes)
    shown = GAP.join(parts[:fitting]) if fitting or not parts else parts[0][:most] + "…"
    return len(hits), len(windows), shown


def shown(df: DataFrame, key: str, text: str, terms: list[str], most: int = WINDOW) -> DataFrame:
    """(key, hits, excerpt) of the rows of a result; rows without a match have no excerpt."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matches(t or "", terms) for t in batch.column(1).to_pylist()]
            told = [best_window(t or "", s, most) for t, s in zip(batch.column(1).to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int32()), pa.array([w[2] if w else None for w in told], pa.string())], names=["key", "hits", "excerpt"])

    return df.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, hits int, excerpt string").withColumnRenamed("key", key)


def around(df: DataFrame, key: str, text: str, word: str) -> DataFrame:
    """(key, matches, windows, excerpt) of a word within each text; texts without it are left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [stretches(t or "", word) for t in batch.column(1).to_pylist()]
            keep = pa.array([i for i, t in enumerate(told) if t[0]], pa.int32())
            told = [t for t in told if t[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), pa.array([t[0] for t in told], pa.int32()), pa.array([t[1] for t in told], pa.int32()), pa.array([t[2] for t in told], pa.string())], names=["key", "matches", "windows", "excerpt"])

    return df.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, matches int, windows int, excerpt string").withColumnRenamed("key", key)
