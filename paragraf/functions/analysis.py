"""Czech words to index terms: stems of words with their marks, then folded. Words are stemmed once each, over a vocabulary."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Letters of the stemming rules.
VOWELS, SYLLABIC = "aeiouyáéěíóúůý", "lr"
BEFORE_EV, BEFORE_EN = "hknrtz", "bcdhkprstvzčšž"
#: Case endings that go, that go and harden what stands before e, and that go and harden what stands before i.
DROPPED = "a ama ata ěte atech ách ých mi ami ými ěmi ěti ovi ětem ám ém ým ěm ům atům o ého us at u ému ou y aty á é ové ý ě ů".split()
BEFORE_E = "e ech emi em".split()
BEFORE_I = "i ích ími ím ího ímu í".split()
#: Endings of words in -e, -et-, which keep the -et unless the stem ends in one of these.
WITH_ET, NO_ET, YET_ET = "ete etem eti".split(), ("l", "s", "č", "ř", "ž"), ("tl", "es", "eč")
#: Endings whose e was put in, and endings in a softened t.
INSERTED, SOFT_T = "eb ec ek ěk eň et ev".split(), "ť ťmi".split()
LONGEST = 48
_DIGIT = re.compile(r"\d")
_EVERY = sorted([*DROPPED, *BEFORE_E, *BEFORE_I, *WITH_ET, *INSERTED, *SOFT_T], key=len, reverse=True)
#: Letters that have no mark to strip.
JOINED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ħ": "h", "ŧ": "t"}


def fold(word: str) -> str:
    """Lower case without marks."""
    bare = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c)[0] != "M")
    return "".join(JOINED.get(c, c) for c in bare)


def _region(word: str) -> int:
    """Where endings may begin: behind the first consonant after the first syllable, behind three letters at least."""
    at = 1
    if word[0] not in VOWELS:
        while at < len(word) and word[at] not in VOWELS + SYLLABIC:
            at += 1
        at += 1
    while at < len(word) and word[at] in VOWELS:
        at += 1
    return max(3, at + 1) if at < len(word) else len(word)


def _hard(stem: str, before_i: bool) -> str:
    """The stem as it is without the softening of its ending."""
    if before_i and stem.endswith("čt"):
        return stem[:-2] + "ck"
    if before_i and stem.endswith("št"):
        return stem if stem.endswith(("dešt", "lešt", "išt", "poušt", "ášt", "íšt")) else stem[:-2] + "sk"
    if stem.endswith("c"):
        return stem if stem.endswith(("nc", "avc", "ovc")) and not stem.endswith("ínc") else stem[:-1] + "k"
    return stem


def _without_inserted(stem: str, ending: str) -> str | None:
    """The word without an e that was put in before its last consonant; None where the e belongs to it."""
    last, consonant = ending[-1], bool(stem) and stem[-1] not in VOWELS
    if last == "b":
        return stem + "b" if consonant and not stem.endswith("tř") else None
    if last == "c":
        return _hard(stem + "c", False) if consonant else None
    if ending == "ěk":
        return stem[:-1] + "ňk" if stem.endswith("n") else None
    if last == "k":
        return stem + "k" if consonant and not stem.endswith(("obl", "sn", "dot")) else None
    if last == "ň":
        return stem + "n" if stem[-1:] and stem[-1] in BEFORE_EN else None
    if last == "t":
        return stem + "t" if stem.endswith(("uc", "h", "ok", "kar", "č")) else None
    return stem + "v" if stem[-1:] and stem[-1] in BEFORE_EV else None


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-cased word with its marks: a case ending, then a possessive one, is taken off."""
    if len(word) < 3:
        return word
    region = _region(word)
    ending = next((e for e in _EVERY if word.endswith(e) and len(word) - len(e) >= region), None)
    out = word
    if ending is not None:
        bare = word[: -len(ending)]
        if ending in INSERTED:
            out = _without_inserted(bare, ending) or word
        elif ending in WITH_ET:
            out = bare if bare.endswith(NO_ET) and not bare.endswith(YET_ET) else bare + "et"
        elif ending in SOFT_T:
            out = bare + "t"
        else:
            out = _hard(bare, ending in BEFORE_I) if ending in BEFORE_E or ending in BEFORE_I else bare
    for possessive in ("ov", "ův", "in"):
        if out.endswith(possessive) and len(out) - 2 >= region:
            return _hard(out[:-2], True) if possessive == "in" else out[:-2]
    return out


def index_term(word: str) -> str:
    """What a word is found by: its stem, folded; words with digits, very short and very long ones are only folded."""
    word = unicodedata.normalize("NFC", word.lower())
    return fold(word) if len(word) < 2 or len(word) > LONGEST or _DIGIT.search(word) else fold(stem(word))


#: Endings of folded words, by how long a word must be at least.
_LIGHT = [
    (8, "atech".split()), (7, "etem atum".split()),
    (6, "ech ich eho emi emu ete eti iho imi imu ach ata aty ych ama ami ove ovi ymi".split()), (5, "em im um at am os us ym mi ou".split()),
]
#: Endings before which a stem is softened, and short stems in which an e may stand or not.
SOFTENING = re.compile("(?:i|ich|iho|im|imi|imu|in[aeouy]?|inou|inach|inami)$")
WITH_OR_WITHOUT_E = re.compile("([aeiouy][b-df-hj-np-tv-z])([bcktv])")
#: Stems that no rule leads to each other.
TWINS = {"smlouv": "smluv", "smluv": "smlouv"}


def light_stem(folded: str) -> str:
    """The stem of a word typed without marks: one case ending or a last vowel, then -ov or -in, then an e put in."""
    for least, endings in _LIGHT:
        if len(folded) >= least and (hit := next((e for e in endings if folded.endswith(e)), None)):
            folded = folded[: -len(hit)]
            break
    else:
        folded = folded[:-1] if len(folded) > 3 and folded[-1] in "aeiouy" else folded
    folded = folded[:-2] if len(folded) > 5 and folded.endswith(("ov", "in")) else folded
    return without_e(folded)


def without_e(w: str) -> str:
    """A folded word without an e put in before its last consonant, as the stems have it."""
    if len(w) < 4 or w[-2] != "e" or w[-1] not in "bcktv":
        return w
    head, consonant = w[:-2], w[-3].isascii() and w[-3].isalpha() and w[-3] not in "aeiouy"
    fits = {
        "b": consonant and not head.endswith("tr"), "c": consonant, "k": consonant and not head.endswith(("dot", "obl", "sn")),
        "t": head.endswith(("uc", "c", "h", "ok", "kar")), "v": head[-1] in BEFORE_EV,
    }
    return head + w[-1] if fits[w[-1]] else w


def query_terms(word: str, most: int = 4) -> list[str]:
    """The prefixes by which a word of a search is looked for, the likeliest first; none for a word without Latin letters.

    A word with marks is stemmed as the index does it; one typed without them may have had some, so the spellings that its
    other forms can have are tried too. A prefix of another one covers it."""
    word = unicodedata.normalize("NFC", word.lower())
    bare = fold(word)
    exact = len(word) <= 2 or len(word) > LONGEST or bool(_DIGIT.search(word))
    first = index_term(word) if exact or bare != word else light_stem(bare)
    if exact or len(first) <= 2:
        return [first] if re.fullmatch("[a-z0-9]+", first) else []
    tried = [first] + ([index_term(word)] if bare == word else [])
    softened = bare == word and SOFTENING.search(word)
    for t in list(tried):
        tried += [TWINS[t]] if t in TWINS else []
        tried += [t[:-1] + {"c": "k", "k": "c"}[t[-1]]] if t[-1] in "ck" else []
        tried += [t[:-1] + "k"] if softened and t.endswith(("ct", "st")) else []
        if m := WITH_OR_WITHOUT_E.fullmatch(t):
            tried += [f"{m[1]}e{m[2]}"] + ([f"{m[1]}ec"] if m[2] == "k" else [])
        tried.append(without_e(t))
    good = [t for t in dict.fromkeys(tried) if len(t) >= min(3, len(first)) and re.fullmatch("[a-z0-9]+", t)]
    kept = [t for t in good if not any(o != t and t.startswith(o) for o in good)]
    kept.sort(key=lambda t: not first.startswith(t))
    return kept[:most]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([index_term(w) for w in said], pa.string())], names=["word", "term"])


def index_terms(vocabulary: DataFrame, word: str) -> DataFrame:
    """(word, term) of the distinct words of a table; join it to the words of the texts."""
    return vocabulary.select(word).where(f"`{word}` is not null").distinct().mapInArrow(_run, "word string, term string")
