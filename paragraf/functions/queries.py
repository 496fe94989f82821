"""Search strings to trees of operators, and what is well formed."""

from __future__ import annotations

import re

from paragraf.functions.analysis import index_term, query_terms

MOST_CHARS, MOST_OPERANDS, MOST_PHRASE = 1_000, 16, 12
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.|'')+'(?::\*?[A-D]*\*?)?)|(<->|<\d+>)|([&|!()]))")
_WORD = re.compile(r"[^\W_]+")


def tree(search: str, weights: str = "") -> tuple[str, str]:
    """(every, any): the search with all operands joined by & and by |. Quoted stretches are phrases, an unmatched quote is a
    blank; a word is looked for by prefix, by all its spellings, in the weights given."""
    parts = re.split(r"[\"„“”]", search[:MOST_CHARS])
    operands: list[str] = []
    for i, part in enumerate(parts):
        found = _WORD.findall(part.lower())
        if i % 2 and i < len(parts) - 1 and len(found) > 1:
            operands.append("(" + " <-> ".join(f"'{index_term(w)}'{':' + weights if weights else ''}" for w in found[:MOST_PHRASE]) + ")")
            continue
        for w in found:
            spelt = [f"'{t}':{'' if len(t) <= 2 or re.search('[0-9]', t) else '*'}{weights}".rstrip(":") for t in query_terms(w)]
            if spelt:
                operands.append(spelt[0] if len(spelt) == 1 else "(" + " | ".join(spelt) + ")")
    operands = list(dict.fromkeys(operands))[:MOST_OPERANDS]
    return " & ".join(operands), " | ".join(operands)


def well_formed(query: str) -> bool:
    """Is it a query: quoted terms with marks, joined by &, | and distances, with ! and brackets? Empty is none."""
    tokens, at = [], 0
    while at < len(query):
        if query[at:].isspace():
            break
        if not (m := _TOKEN.match(query, at)):
            return False
        tokens.append("term" if m[1] else "near" if m[2] else m[3])
        at = m.end()
    depth, want = 0, True  # a term is wanted, or an operator
    for t in tokens:
        if want:
            if t == "term":
                want = False
            elif t == "(":
                depth += 1
            elif t != "!":
                return False
        elif t in ("&", "|", "near"):
            want = True
        elif t == ")" and depth:
            depth -= 1
        else:
            return False
    return bool(tokens) and not want and not depth


def variants(searches: list[str], most: int = 3) -> list[str]:
    """The searches with white space collapsed, each once whatever its case, the first few."""
    seen: dict[str, str] = {}
    for s in searches:
        plain = re.sub(r"\s+", " ", s).strip()
        if plain:
            seen.setdefault(plain.lower(), plain)
    return list(seen.values())[:most]


def excerpt_terms(search: str) -> list[str]:
    """What an excerpt should show: the phrases, the whole search without operators, then its words of four letters or more."""
    phrases = [p for p in re.findall(r"[\"„“]([^\"„“”]+)[\"“”]", search) if p.strip()]
    bare = re.sub(r"\b(?:AND|OR|NOT|NEAR)\b|[\"„“”()*?&|!]", " ", search)
    whole = re.sub(r"\s+", " ", bare).strip()
    return list(dict.fromkeys([*phrases, *([whole] if whole else []), *[w for w in _WORD.findall(whole) if len(w) >= 4]]))


def domino(search: str) -> str:
    """The search in the words of a full-text form: all words joined by AND, phrases kept, `word?` also without its mark,
    § left out, unbalanced quotes and brackets dropped."""
    text = search.replace("§", " ")
    text = text.replace('"', " ") if text.count('"') % 2 else text
    text = re.sub("[()]", " ", text) if text.count("(") != text.count(")") else text
    out: list[str] = []
    for token in re.findall(r'"[^"]+"|[()]|[^\s()"]+', text):
        if token.upper() in ("AND", "OR", "NOT"):
            out.append(token.upper())
            continue
        if out and token != ")" and out[-1] not in ("AND", "OR", "NOT", "("):
            out.append("AND")
        out.append(f"({token[:-1]} OR {token})" if token.endswith("?") and len(token) > 1 else token)
    return " ".join(out)


def escaped(clause: str, marks: str = r'\"():') -> str:
    """A value within a clause of a catalogue's language."""
    return "".join("\\" + c if c in marks else c for c in clause)


def catalogue(title: str | None, author: str | None, since: int | None, until: int | None) -> str:
    """Clauses of a library catalogue: fields with escaped values, and both bounds of the years whenever one is asked."""
    parts = [f"{field},contains,{escaped(value, ',;')}" for field, value in (("title", title), ("creator", author)) if value]
    if since is not None or until is not None:
        if since is not None and until is not None and since > until:
            raise ValueError("the range ends before it begins")
        parts.append(f"dr_s,exact,{since or 1000:04d}0101;dr_e,exact,{until or 9999:04d}1231")
    if not parts:
        raise ValueError("nothing is asked")
    return ";AND;".join(parts)


def sparql(words: list[str], limit: int, most: int = 8) -> str:
    """A search of titles in SPARQL: all words, those of four letters or more by their stem, one row more than asked."""
    asked = [re.sub(r"[^\w]", "", w.lower()) for w in words]
    asked = [w for w in dict.fromkeys(asked) if w][:most]
    if not asked:
        raise ValueError("nothing is asked")
    tests = " AND ".join(f'"{w}*"' if len(w) >= 4 else f'"{w}"' for w in asked)
    return f"SELECT ?work (SAMPLE(?t) AS ?title) WHERE {{ ?work cdm:work_title ?t . ?t bif:contains '{tests}' }} GROUP BY ?work LIMIT {limit + 1}"


def item_filter(include: list[str], exclude: list[str], every: list[str], some: list[str], none: list[str]) -> dict[str, list[str]]:
    """The parameters of a reference manager: types all included or all excluded, tags that all, any or none must hold; a tag
    that starts with a dash is meant literally."""
    if include and exclude:
        raise ValueError("types are included or excluded, not both")
    literal = lambda tag: "\\" + tag if tag.startswith("-") else tag
    types = [" || ".join(include)] if include else [f"-{t}" for t in exclude]
    tags = [literal(t) for t in every] + ([" || ".join(literal(t) for t in some)] if some else []) + [f"-{t}" for t in none]
    return {"itemType": types, "tag": tags}


def planned(search: str, keys: list[str]) -> str:
    """How a search is answered: by identifiers alone, by words alone, or by both."""
    words = [w for w in _WORD.findall(search.lower()) if len(w) > 1]
    return "both" if words and keys else "keys" if keys else "words" if words else "nothing"
