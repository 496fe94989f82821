from __future__ import annotations

import json

from hypothesis import HealthCheck, given, settings, strategies as st

from paragraf.operators import nested

SCHEMA = "record_id long, feed string, payload string, value string, id long"


def walk(value, out, path="$", indices=()):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    out.append((path, indices, kind, value if kind == "string" else None))
    if isinstance(value, dict):
        for k, v in value.items():
            walk(v, out, f"{path}.{k}", indices)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            walk(v, out, path + "[]", (*indices, i))


text = st.text(st.characters(codec="utf-8"), max_size=6)
values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | text, lambda x: st.lists(x, max_size=3) | st.dictionaries(text, x, max_size=3), max_leaves=12)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(values.filter(lambda v: not isinstance(v, str)), min_size=1, max_size=4), st.sampled_from([None, 2]), st.booleans())
def test_index_equals_parser(payloads, indent, ascii_only):
    import pyarrow as pa

    texts = [json.dumps(p, indent=indent, ensure_ascii=ascii_only) for p in payloads]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(["f"] * len(texts)), pa.array(texts, pa.string())], names=["id", "label", "payload"])
    got = [r for b in nested._run()(iter([batch])) for r in b.to_pylist()]
    for i, p in enumerate(payloads):
        want = []
        walk(p, want)
        mine = [(r["path"], tuple(r["indices"]), r["kind"], r["value"] if r["kind"] == "string" else None) for r in got if r["id"] == i]
        assert mine == want
        numbers = [r for r in got if r["id"] == i]
        assert all(r["parent"] == -1 or numbers[r["parent"]]["depth"] == r["depth"] - 1 for r in numbers)


def rows_of(payloads, wanted=None):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(payloads)), pa.int64()), pa.array(["f"] * len(payloads)), pa.array(payloads, pa.string())], names=["id", "label", "payload"])
    return [r for b in nested._run(wanted)(iter([batch])) for r in b.to_pylist()]


def innermost(payload):
    """The value that the parser of the standard library finds, or None if the payload isn't complete JSON."""

    def refuse(word):
        raise ValueError(word)

    while True:
        try:
            value = json.loads(payload, parse_constant=refuse)
        except ValueError:
            return None
        if not isinstance(value, str):
            return (value,)
        payload = value


@settings(max_examples=300, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from('{}[]:,"\\ \n1-0.eE+tnulfas\x01ěu'), max_size=14), min_size=1, max_size=5), values, st.data())
def test_complete_is_what_the_parser_takes(texts, value, data):
    whole = json.dumps(value, ensure_ascii=data.draw(st.booleans()))
    at = data.draw(st.integers(0, len(whole)))
    texts += [whole[:at], whole[:at] + data.draw(st.sampled_from('{}[]:,"\\1')) + whole[at:], whole[:at] + whole[at + 1 :], json.dumps(whole)]
    got = {r["id"] for r in rows_of(texts)}
    assert got == {i for i, t in enumerate(texts) if innermost(t)}


def test_wrapped_often_and_nested_deeply():
    inner = json.dumps([{"stadiumMaterialuHistoria": [{"stadium": {"nazov": "A"}}]}])
    wrapped = inner
    for _ in range(12):
        wrapped = json.dumps(wrapped)
    deep = "[" * 20_000 + "]" * 20_000
    both = '[{"a":' + "[" * 20_000 + "]" * 20_000 + "}," + inner[1:]
    got = rows_of([wrapped, deep, both], frozenset({"$[].stadiumMaterialuHistoria[].stadium.nazov", "$"}))
    assert [(r["id"], r["path"], tuple(r["indices"]), r["value"]) for r in got] == [
        (1, "$", (), None), (2, "$", (), None), (2, "$[].stadiumMaterialuHistoria[].stadium.nazov", (1, 0), "A"),
        (0, "$", (), None), (0, "$[].stadiumMaterialuHistoria[].stadium.nazov", (0, 0), "A"),
    ]
    whole = rows_of(["[" * 3000 + "]" * 3000])
    assert len(whole) == 3000 and whole[-1]["path"] == "$" + "[]" * 2999 and whole[-1]["indices"] == [0] * 2999


def test_lone_surrogates_are_replaced():
    assert [r["value"] for r in rows_of(['["\\ud800x"]'])] == [None, "\ufffdx"]


def test_edge_payloads(spark):
    good = json.dumps([{"stadiumMaterialuHistoria": [{"stadium": {"nazov": "A\"\\\\{"}}, None, {"stadium": {"nazov": "  "}}]}, {"stadiumMaterialuHistoria": {"stadium": {"nazov": "B"}}}])
    rows = [(1, "lp-dokumenty", good, "x", 0), (1, "lp-dokumenty", good, "x", 0), (2, "lp-dokumenty", None, None, 0), (3, "lp-dokumenty", "", None, 0), (4, "lp-dokumenty", good[:-2], None, 0), (5, "lp-dokumenty", json.dumps(good), None, 0), (None, "lp-dokumenty", good, None, 0), (6, None, good, None, 0), (7, "lp-dokumenty", "[" * 40 + "]" * 40, None, 0)]
    values = nested.nodes(spark.createDataFrame(rows, SCHEMA), "record_id", "feed", "payload")
    got = sorted((r.record_id, r.parent_no, r.child_no, r.name) for r in nested.children(values).collect())
    assert got == [(i, p, c, n) for i in (1, 5) for p, c, n in ((0, 0, 'A"\\\\{'), (1, 0, "B"))]
    assert {r.id for r in values.select("id").distinct().collect()} == {1, 5, 6, 7}


def test_single_string_and_creators(spark):
    cdi = json.dumps({"docs": [{"pnx": {"search": {"creatorcontrib": "One"}}}, {"pnx": {"search": {"creatorcontrib": [None, "", "Two"]}}}, {"pnx": None}]})
    items = json.dumps([{"data": {"creators": [{"name": None, "lastName": "L"}, {"firstName": " "}, None, {"firstName": "F", "lastName": "L"}]}}, {"data": {"creators": None}}, {}])
    df = spark.createDataFrame([(1, "search-cdi-article", cdi, "", 0), (2, "items-search", items, "", 0)], SCHEMA)
    got = {(r.record_id, r.child, r.parent_no, r.child_no) for r in nested.children(nested.nodes(df, "record_id", "feed", "payload")).collect()}
    assert got == {(1, "contrib", 0, 0), (1, "contrib", 1, 2), (2, "creator", 0, 0), (2, "creator", 0, 3)}


def test_empty(spark):
    assert nested.nodes(spark.createDataFrame([], SCHEMA), "record_id", "feed", "payload").count() == 0
