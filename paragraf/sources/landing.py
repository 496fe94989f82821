"""Landed pages and files: HTML listings, text of HTML, character sets, kinds of files, partitioned tables, seeks."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: What the first bytes of a file say.
MAGIC = {"25504446": "pdf", "504B0304": "zip", "7B5C727466": "rtf", "D0CF11E0": "doc", "89504E47": "png", "FFD8FF": "jpeg"}
#: Byte order marks and the sets they stand for.
MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
_META = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([\w-]{1,40})", re.I)
BLOCKS = frozenset("p div li ul ol tr table h1 h2 h3 h4 h5 h6 br section article".split())
SILENT = frozenset(("script", "style", "noscript"))


def after(df: DataFrame, key: str, last: int, size: int) -> DataFrame:
    """The next batch of a scan that goes by key: rows beyond the last key seen, in order of the number."""
    return df.where(F.col(key) > last).orderBy(key).limit(size)


def kind_of(content: Column) -> Column:
    """What a file is by its first bytes; html or text where these say nothing."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.when(looks_like_html(F.decode(F.substring(content, 1, 4000), "ISO-8859-1")), "html").otherwise("text")
    for magic, kind in MAGIC.items():
        out = F.when(F.startswith(head, F.lit(magic)), kind).otherwise(out)
    return F.when(F.length(content) > 0, out)


def looks_like_html(c: Column) -> Column:
    """Is there a tag within the first hundred thousand characters? Tags count up to 200 characters, so this is linear."""
    return F.substring(c, 1, 100_000).rlike("<[a-zA-Z/!][^<>]{0,200}>")


def fragment_text(c: Column) -> Column:
    """The text of a fragment without tags, entities and carriage returns, which needs no parser; null for others."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), "[ \\t]+", " "), " ?\\n ?", "\n"), "\\n{3,}", "\n\n"), F.lit(" \n"))
    return F.when(~c.rlike("[<&\\r\\x00]"), plain)


def charset(content: bytes, header: str | None) -> str:
    """By byte order mark, else the header, else a meta tag, else UTF-8; unknown names count as none."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return name
    told = [(m[1] if header and (m := re.search(r"charset=\s*[\"']?([\w-]+)", header, re.I)) else None), (m[1].decode() if (m := _META.search(content[:4096])) else None)]
    for name in told:
        try:
            if name:
                return codecs.lookup(name).name
        except LookupError:
            continue
    return "utf-8"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for content, header in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = None if content is None else content.decode(charset(content, header), "replace").removeprefix("\ufeff")
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "text"])


def decoded(df: DataFrame, key: str, content: str, header: str) -> DataFrame:
    """(key, text) of landed bytes, decoded by what they or their header say; what can't be read becomes U+FFFD."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), content, header).mapInArrow(_decode, f"key {kind}, text string").withColumnRenamed("key", key)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.silent = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in SILENT
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.silent = max(0, self.silent - (tag in SILENT))
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(data)


def html_text(html: str) -> str:
    """The text of a page: scripts and styles dropped, blocks on lines of their own, blanks collapsed, one blank line at most."""
    p = _Text()
    p.feed(html)
    p.close()
    text = re.sub(r"[ \t\r]+", " ", "".join(p.out).replace("\u00a0", " "))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", text)).strip(" \n")


class _Marked(_Text):
    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        if re.fullmatch("h[1-6]", tag):
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("- ")


def structured(html: str) -> str:
    """The text of a page with headings and list items marked as in a structured text."""
    p = _Marked()
    p.feed(html)
    p.close()
    text = re.sub(r"[ \t\r]+", " ", "".join(p.out).replace("\u00a0", " "))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", text)).strip(" \n")


class _Cells(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag == "td" and self.rows:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "td" and self.cell is not None:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, places, cells = [], [], []
        for i, html in enumerate(batch.column(1).to_pylist()):
            p = _Cells()
            p.feed(html or "")
            p.close()
            for n, row in enumerate(r for r in p.rows if r):
                keys.append(i), places.append(n), cells.append(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), pa.array(places, pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=["key", "place", "cells"])


def listing(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, cells): the rows of the tables of landed pages, their cells as text; rows without cells don't count."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), html).mapInArrow(_pages, f"key {kind}, place int, cells array<string>").withColumnRenamed("key", key)


def page_texts(df: DataFrame, key: str, html: str, read: Callable[[str], str] = html_text) -> DataFrame:
    """(key, text) of landed pages, plain or, with `structured`, marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if h is None else read(h) for h in batch.column(1).to_pylist()], pa.string())], names=["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), html).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def rtf_text(c: Column) -> Column:
    """The text of simple RTF: unicode escapes and paragraph marks read, groups of settings and control words dropped."""
    out = F.regexp_replace(c, r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{[^{}]*\})*\}", "")
    out = F.regexp_replace(out, r"\\par[d]?\b ?", "\n")
    parts = F.split(out, r"\\u(?=\d)")
    told = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.decode(F.unhex(F.lpad(F.hex(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")), 4, "0")), "UTF-16BE"), F.regexp_replace(p, r"^\d+\??", ""))))
    out = F.regexp_replace(F.array_join(told, ""), r"\\[a-z]+-?\d* ?", "")
    return F.btrim(F.regexp_replace(out, r"[{}]", ""), F.lit(" \n"))
