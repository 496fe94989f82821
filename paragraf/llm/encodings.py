"""Texts decoded with a wrong character set: found and restored by the shortest description.

Every chain of wrong decodings that a line could have gone through is undone. Each candidate is compressed with the
zstandard dictionary of each language whose script it shows; characters that the language's texts don't know cost
extra, and so does every step of the chain. The candidate with the shortest description wins; a tie, and no gain, leave
the line as it is.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from paragraf.functions.codepoints import slices
from paragraf.session import cut

DICTIONARY_BYTES = 48_000
#: A dictionary is trained on about so many bytes of distinct lines at once; of a larger language, one on each such part, and
#: so many of these are trained into one, again and again until one is left.
PART_BYTES, MERGED = 4_000_000, 64
#: Bytes that a step of a chain, an unknown letter or control, another unknown symbol, a lost character and another
#: language than the home language cost.
STEP_COST, UNKNOWN_COST, SYMBOL_COST, LOST_COST, LANGUAGE_COST = 1.0, 2.5, 0.5, 1.0, 2.0
#: A character is known to a language if so many of its labelled texts have it or more, and so large a share of them.
KNOWN_TEXTS, LABELLED_SHARE = 3, 0.0075
#: A character, or a symbol beside a letter, costs nothing in the field either if so large a share of all its texts has it.
KNOWN_SHARE = 0.1
LOST = "�"
#: Judgements that a task remembers: the same line, as a notice of a site, is judged once.
REMEMBERED = 100_000


def _charmap(name: str) -> str:
    """The 256 characters of a single-byte set; a byte that it leaves undefined stands for the control of that number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


SETS = {name: _charmap(name) for name in ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp437", "cp850", "cp852")}
#: What a text was decoded with, and what it should have been decoded with.
STEPS = [
    ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1250", "utf-8"), ("iso8859-2", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("cp852", "utf-8"),
    ("cp1252", "cp1250"), ("latin-1", "cp1250"), ("cp1252", "iso8859-2"), ("latin-1", "iso8859-2"), ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"),
    ("cp1250", "cp852"), ("iso8859-2", "cp852"), ("cp1252", "cp852"), ("latin-1", "cp852"), ("cp437", "cp852"), ("cp850", "cp852"), ("cp852", "cp1250"), ("cp852", "iso8859-2"),
]
_ENCODERS = {name: codecs.charmap_build(chars) for name, chars in SETS.items()}


@cache
def _table(wrong: str, right: str, known: frozenset[str]) -> tuple[dict[int, str], frozenset[str]]:
    """What each character becomes when bytes of `right` read as `wrong` are read rightly, and the characters that such a
    text can't hold: those of `right` would have come out as others. What `right` lacks stayed as it was."""
    own = {ch for ch in SETS[right][128:] if ch.isprintable() or ch == "\xa0"}
    moves = {}
    for was, now in zip(SETS[wrong][128:], SETS[right][128:], strict=True):
        if now in own and not (was in known and now not in known and was not in own):
            moves[ord(was)] = now
    return moves, frozenset(own - {chr(c) for c in moves})


def _undo(text: str, wrong: str, right: str, known: frozenset[str]) -> tuple[str, bool] | None:
    """The text before the step, and whether nothing was lost; None if it can't have gone through it."""
    if right != "utf-8":
        moves, never = _table(wrong, right, known)
        return (text.translate(moves), True) if never.isdisjoint(text) else None
    try:
        raw = codecs.charmap_encode(text, "strict", _ENCODERS[wrong])[0]
    except UnicodeEncodeError:
        return None
    try:
        return raw.decode("utf-8"), True
    except UnicodeDecodeError:
        out = raw.decode("utf-8", "replace")
        # bytes lost on the way: some characters must still have come through
        return (out, False) if out.count(LOST) < len(text) - len(out) + out.count(LOST) else None


def candidates(text: str, known: frozenset[str] = frozenset()) -> list[tuple[str, int, bool, tuple[str, ...]]]:
    """(text, steps, lossless, chain) for every chain of up to two steps; utf-8 read as another set is what recurs."""
    out, seen = [], {text}
    first = []
    for wrong, right in STEPS:
        if (got := _undo(text, wrong, right, known)) and got[0] not in seen:
            seen.add(got[0])
            first.append((got[0], 1, got[1], (f"{wrong}>{right}",)))
    out.extend(first)
    for got, _, whole, chain in first:
        if chain[0].endswith("utf-8") and not got.isascii():
            for wrong, right in STEPS:
                if right == "utf-8" and (more := _undo(got, wrong, right, known)) and more[0] not in seen:
                    seen.add(more[0])
                    out.append((more[0], 2, whole and more[1], (*chain, f"{wrong}>{right}")))
    return out


_SYMBOL = re.compile(r"(?<=[^\W\d_])[^\w\s\x00-\x7f]|[^\w\s\x00-\x7f](?=[^\W\d_])")


def _sides(text: str) -> Iterator[str]:
    """Each symbol beyond ASCII that touches a letter, with the side on which it does."""
    for m in _SYMBOL.finditer(text):
        if m.start() and text[m.start() - 1].isalpha():
            yield "_" + m.group()
        if m.end() < len(text) and text[m.end()].isalpha():
            yield m.group() + "_"


@dataclass
class Languages:
    """A dictionary and the known characters of each language; small enough to travel with the task."""

    dictionaries: dict[str, bytes]
    known: dict[str, frozenset[str]]
    home: str
    beside: frozenset[str] = frozenset()  # symbols seen directly before ("x_") or after ("_x") a letter
    labelled: frozenset[str] = frozenset()  # characters of the home language by its labelled texts alone
    compressors: dict[str, zstandard.ZstdCompressor] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "known": self.known, "home": self.home, "beside": self.beside, "labelled": self.labelled, "compressors": {}}

    def length(self, text: str) -> float:
        """Bytes that describe the text in the language that describes it best."""
        raw = text.encode("utf-8", "surrogatepass")
        other = {ch for ch in text if ch > "\x7f" and ch != LOST}
        best = float("inf")
        for lang, known in self.known.items():
            strange = other - known
            if lang != self.home and (strange or not other - self.known[self.home]):
                continue  # another language is asked only for characters that it knows and the home language doesn't
            if lang not in self.compressors:
                rules = zstandard.ZstdCompressionParameters.from_level(3, write_checksum=False, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                self.compressors[lang] = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(self.dictionaries[lang]), compression_params=rules)
            cost = sum(text.count(ch) * (UNKNOWN_COST if ch.isalpha() or ch < "\xa0" else SYMBOL_COST) for ch in strange)
            cost += UNKNOWN_COST * sum(side not in self.beside for side in _sides(text)) + LOST_COST * text.count(LOST)
            best = min(best, len(self.compressors[lang].compress(raw)) + cost + LANGUAGE_COST * (lang != self.home))
        return best

    def plain(self) -> frozenset[str]:
        """Characters of the home language's labelled texts: a line of these alone needs no look. What is frequent in the
        field to be judged isn't among them, as it may be frequent because it was decoded wrongly."""
        return self.labelled


def _labelled(df: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, text) of all texts whose language is told."""
    rows = df.select(F.lower(F.trim(lang)).alias("lang"), F.col(text).cast("string").alias("text"))
    return rows.where("lang is not null and lang <> 'und' and text <> ''")


def _trained(pieces: list[bytes]) -> bytes:
    """A dictionary of the pieces; of few long ones, of their stretches."""
    whole = b"".join(pieces)
    for each in (pieces, [whole[i : i + 64] for i in range(0, len(whole), 64)]):
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, each, k=256, d=8, level=3).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(dict.fromkeys(pieces))[:DICTIONARY_BYTES] or b" " * 16  # too little text to train on: its own bytes serve


def _train_part(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    """The dictionary of a part's lines; one that stands often counts once more whenever its number doubles."""
    part = part.sort_by([("h", "ascending"), ("line", "ascending")])
    pieces = [line.encode() for line, n in zip(part["line"].to_pylist(), part["n"].to_pylist(), strict=True) for _ in range(n.bit_length())]
    return pa.table({"lang": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int64()), "dictionary": [_trained(pieces)]})


def _merge_parts(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    """The dictionary of what the parts' dictionaries hold; one alone stays as it is."""
    each = parts.sort_by("part")["dictionary"].to_pylist()
    one = each[0] if len(each) == 1 else _trained([x[i : i + 256] for x in each for i in range(0, len(x), 256)])
    return pa.table({"lang": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int64()), "dictionary": [one]})


def _dictionaries(rows: DataFrame) -> dict[str, bytes]:
    """The dictionary of each language, of all lines of all its texts."""
    lines = rows.select("lang", F.explode(F.split("text", "\n", -1)).alias("line")).where("line <> ''").groupBy("lang", "line").agg(F.count("*").alias("n"))
    lines = cut(lines.withColumn("h", F.xxhash64("line")))
    many = {r.lang: r.size // PART_BYTES + 1 for r in lines.groupBy("lang").agg(F.sum(F.octet_length("line")).alias("size")).toLocalIterator()}
    if not many:
        return {}
    parts = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    schema = "lang string, part long, dictionary binary"
    out, most = lines.withColumn("part", F.pmod("h", parts[F.col("lang")])).groupBy("lang", "part").applyInArrow(_train_part, schema), max(many.values())
    while most > 1:
        most = -(-most // MERGED)
        out = out.groupBy("lang", F.expr(f"part div {MERGED}").alias("into")).applyInArrow(_merge_parts, schema)
    return {r.lang: bytes(r.dictionary) for r in out.toLocalIterator()}


def _marks(text: str) -> set[str]:
    """The characters beyond ASCII of a text, and its symbols with the sides on which they touch a letter, as _sides has them."""
    chars = {ch for ch in set(text) if ch > "\x7f"}
    out = set(chars)
    for ch in chars:
        at = -1 if ch.isalnum() or ch.isspace() else text.find(ch)
        while at >= 0:
            if at and text[at - 1].isalpha():
                out.add("_" + ch)
            if at + 1 < len(text) and text[at + 1].isalpha():
                out.add(ch + "_")
            at = text.find(ch, at + 1)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, mark, texts) of a task: the texts of each language with each mark, and all its texts under the empty mark."""
    often: Counter[tuple[str, str]] = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            often[lang, ""] += 1
            often.update((lang, mark) for mark in _marks(text))
    langs, marks = [lang for lang, _ in often], [mark for _, mark in often]
    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(marks, pa.string()), pa.array(list(often.values()), pa.int64())], names=["lang", "mark", "texts"])


def _often(rows: DataFrame) -> dict[str, dict[str, int]]:
    """The number of texts of each language with each mark, counted over all of (lang, text); all texts under the empty mark."""
    out: dict[str, dict[str, int]] = {}
    counted = rows.mapInArrow(_counted, "lang string, mark string, texts long").groupBy("lang", "mark").agg(F.sum("texts").alias("texts"))
    for r in counted.toLocalIterator():  # as many as the alphabets have
        out.setdefault(r.lang, {})[r.mark] = r.texts
    return out


def usual(df: DataFrame, text: str) -> set[str]:
    """The marks that KNOWN_SHARE of all texts have or more, counted over whole texts."""
    often = _often(df.select(F.lit("").alias("lang"), F.col(text).cast("string").alias("text")).where("text <> ''")).get("", {})
    return {mark for mark, n in often.items() if mark and n >= KNOWN_SHARE * often[""]}


def train(df: DataFrame, lang: str, text: str, home: str, own: DataFrame | None = None, own_text: str = "text") -> Languages:
    """Dictionaries and known characters from all labelled texts; all texts of `own`, the field to be judged in the home
    language, say which characters are usual in it: these cost nothing, but a line with them is judged like any other."""
    rows = _labelled(df, lang, text)
    dictionaries, counts = _dictionaries(rows), _often(rows)
    counts.setdefault(home, {"": 0})
    known, sides = {}, {}
    for name, often in counts.items():
        if name not in dictionaries:
            dictionaries[name] = _trained([bytes(range(32, 127))])
        least = max(min(KNOWN_TEXTS, often[""]), LABELLED_SHARE * often[""])
        seen = {mark for mark, n in often.items() if mark and n >= least}
        known[name] = frozenset(mark for mark in seen if len(mark) == 1 and mark != LOST)
        sides[name] = {mark for mark in seen if len(mark) == 2}
    labelled = known[home]
    also = usual(own, own_text) if own is not None else set()
    known[home] = labelled | {mark for mark in also if len(mark) == 1 and mark != LOST}
    beside = sides[home] | {mark for mark in also if len(mark) == 2}
    return Languages(dictionaries, known, home, frozenset(side for side in beside if (side[0] if side[1] == "_" else side[1]) in known[home]), labelled)


def judge(line: str, languages: Languages) -> tuple[str | None, str] | None:
    """(original or None where something was lost, chain) if the line was decoded wrongly, else None.

    A replacement character is a loss by itself; the chain of the shortest description is named with it, if there is one."""
    if line.isascii() or not any(ch > "\x7f" and ch not in languages.plain() for ch in line):
        return None
    best, won = languages.length(line), None
    for text, steps, whole, chain in candidates(line, languages.known[languages.home]):
        cost = languages.length(text) + STEP_COST * steps
        if cost < best:
            best, won = cost, (text if whole else None, " ".join(chain))
    if LOST in line:
        return None, won[1] if won else "lost"
    return won


def _run(languages: Languages, keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strange = np.ones(0x110000, bool)  # beyond ASCII, and not among what the labelled texts hold
        strange[:128] = False
        strange[[ord(ch) for ch in languages.plain()]] = False
        judged: dict[str, tuple[str | None, str] | None] = {}
        for batch in batches:
            column = batch.column(keys)
            found: dict[int, list[tuple[int, int, tuple[str | None, str]]]] = {}
            for first, last, cps, rows in slices(column):
                hit = np.flatnonzero(strange[cps])
                if not len(hit):
                    continue
                # a line starts after the feed before it or where its text does
                feed = np.flatnonzero(cps == 10)
                before, after = np.append(-1, feed), np.append(feed, len(cps))
                place = np.searchsorted(feed, hit)
                row = np.searchsorted(rows, hit, "right") - 1
                start, end = np.maximum(before[place] + 1, rows[row]), np.minimum(after[place], rows[row + 1])
                new = np.flatnonzero(np.append(True, start[1:] != start[:-1]))
                for r, a, b in zip(row[new].tolist(), start[new].tolist(), end[new].tolist(), strict=True):
                    line = cps[a:b].tobytes().decode("utf-32-le")
                    if line not in judged:
                        if len(judged) >= REMEMBERED:
                            judged.clear()
                        judged[line] = judge(line, languages)
                    if judged[line]:
                        found.setdefault(first + r, []).append((a - int(rows[r]), b - int(rows[r]), judged[line]))
            order = sorted(found)
            restored = []
            for i in order:
                text, parts, at = column[i].as_py(), [], 0
                for a, b, (right, _) in found[i]:
                    parts += [text[at:a], text[a:b] if right is None else right]
                    at = b
                restored.append("".join(parts) + text[at:])
            at = pa.array(order, pa.int32())
            lost = [sum(got[0] is None for _, _, got in found[i]) for i in order]
            chains = [sorted({got[1] for _, _, got in found[i]}) for i in order]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(at) for k in range(keys)] + [pa.array(restored, pa.string()), pa.array(lost, pa.int32()), pa.array(chains, pa.list_(pa.string()))],
                names=[*batch.schema.names[:keys], "restored", "lost_lines", "chains"],
            )

    return run


def wrongly_decoded(df: DataFrame, keys: list[str], text: str, languages: Languages) -> DataFrame:
    """The rows whose text was decoded wrongly in part: their keys, the text restored as far as nothing was lost, the number
    of lines that can't be restored, and the chains found.

    Each line is judged by itself. Null and empty texts are no case; rows are judged one by one, so repeated ones recur.
    """
    rows = df.select(*keys, F.col(text).cast("string").alias("text")).where("text <> ''")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*keys).dtypes)
    return rows.mapInArrow(_run(languages, len(keys)), f"{schema}, restored string, lost_lines int, chains array<string>")
