"""A search string as words, phrases and identifiers, and texts matched with it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from paragraf.functions.text import WORD, words

MOST_CHARS, MOST_OPERANDS, MOST_PHRASE = 1_000, 16, 12
#: Words that say nothing alone.
STOP = frozenset("a aby ale ani až by byl byla bylo co do i jak jako je jeho jejich k ke který která které na ne nebo o od po pod podle pro při s se si tak to u v ve z za ze že".split())
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Terms:
    """Single words and phrases; every and any say how they are joined."""

    words: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = field(default=())

    def every(self, c: Column) -> Column:
        """Does the text hold all of them?"""
        out = F.lit(bool(self.words or self.phrases))
        for test in self._tests(c):
            out = out & test
        return out

    def any(self, c: Column) -> Column:
        """Does the text hold one of them?"""
        out = F.lit(False)
        for test in self._tests(c):
            out = out | test
        return out

    def _tests(self, c: Column) -> list[Column]:
        # one string of words with a blank on either side: a phrase is then a substring
        line = F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
        return [line.contains(f" {' '.join(p)} ") for p in [*((w,) for w in self.words), *self.phrases]]


def parse(search: str) -> Terms:
    """Quoted stretches are phrases; an unmatched quote is a blank. Stop words are dropped outside phrases unless nothing
    else is left. Words count once, in order; there are bounds on characters, operands and words of a phrase."""
    search = search[:MOST_CHARS]
    phrases, rest, parts = [], [], re.split(r"[\"„“”]", search)
    for i, part in enumerate(parts):
        found = [w.lower() for w in _WORD.findall(part)]
        if i % 2 and i < len(parts) - 1:
            if len(found) > 1:
                phrases.append(tuple(found[:MOST_PHRASE]))
            else:
                rest.extend(found)
        else:
            rest.extend(found)
    rest = list(dict.fromkeys(rest))
    telling = [w for w in rest if w not in STOP]
    kept = telling if telling or phrases else rest
    phrases = list(dict.fromkeys(phrases))[:MOST_OPERANDS]
    return Terms(tuple(kept[: MOST_OPERANDS - len(phrases)]), tuple(phrases))


def matches(df: DataFrame, text: str, search: str) -> DataFrame:
    """The rows that hold every term of the search, or, if none does, those that hold one; `ladder` says which."""
    terms = parse(search)
    every = df.where(terms.every(F.col(text)))
    return every.withColumn("ladder", F.lit("and")) if not every.isEmpty() else df.where(terms.any(F.col(text))).withColumn("ladder", F.lit("or"))


__all__ = ["MOST_CHARS", "STOP", "Terms", "WORD", "matches", "parse"]
