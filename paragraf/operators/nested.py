"""Deeply nested JSON as related flat tables, by structural indexing of whole columns.

All payloads of a batch form one array of bytes. Bitmaps of backslash runs and quotes give the strings, those of brackets,
colons and commas outside strings the structure, and prefix sums over the brackets the depth of every place. Sorting the
tokens by record, depth and place puts each after the bracket that holds it, so parents follow from a running maximum; no
character is looked at one by one. The same bitmaps tell whether a payload is complete JSON: what may follow what is a
table over neighbouring tokens and the bracket around them. The rows that come out carry their parent's number, so any
level can be joined to the one above it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

NODES = "id long, label string, node int, parent int, depth int, path string, indices array<int>, key string, pos int, kind string, value string"
#: Bytes indexed at once; a longer single payload is taken alone.
SLICE_BYTES = 2_000_000
#: Bytes of paths and positions written out at once; a very deep record has far more of them than it has characters.
WRITE_BYTES = 16_000_000
#: Scalars other than strings.
_SCALAR = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
_OPEN_OBJECT, _OPEN_ARRAY, _CLOSE_OBJECT, _CLOSE_ARRAY, _COLON, _COMMA, _STRING, _PLAIN = range(1, 9)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_HEX, _AFTER_SLASH = _table("0123456789abcdefABCDEF"), _table('"\\/bfnrtu')
_TYPES = np.zeros(256, np.int8)
_TYPES[list(b"{[}]:,")] = (_OPEN_OBJECT, _OPEN_ARRAY, _CLOSE_OBJECT, _CLOSE_ARRAY, _COLON, _COMMA)


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of each span as one Arrow column of text."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, slashes: np.ndarray) -> pa.Array:
    """What the strings between quotes say; those with escapes are read as one list. A lone surrogate is U+FFFD."""
    escaped = slashes[end] > slashes[start]
    plain = _gather(data, start[~escaped], end[~escaped])
    if not escaped.any():
        return plain
    held = _gather(data, start[escaped], end[escaped])
    told = json.loads('["' + '","'.join(held.to_pylist()) + '"]')
    try:
        told = pa.array(told, pa.large_string())
    except UnicodeEncodeError:
        told = pa.array([s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for s in told], pa.large_string())
    place = np.empty(len(start), np.int64)
    place[~escaped], place[escaped] = np.arange(len(plain)), len(plain) + np.arange(len(told))
    return pa.concat_arrays([plain, told]).take(pa.array(place))


class _Index:
    """Structure of payloads lying one after another, each followed by a line feed, and which of them are complete JSON.

    starts are the payloads' first places and, last, the end of the data."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        size, records = len(data), len(starts) - 1
        here = np.arange(size, dtype=np.int64)
        self.data = data
        slash = data == 0x5C
        self.slashes = np.zeros(size + 1, np.int64)
        np.cumsum(slash, out=self.slashes[1:])
        escaped = np.zeros(size, bool)
        if slash.any():
            plain = np.maximum.accumulate(np.where(~slash, here, -1))
            escaped[1:] = ((here[:-1] - plain[:-1]) & 1).astype(bool)  # an odd number of backslashes stands before
        quote = (data == 0x22) & ~escaped
        count = np.zeros(size + 1, np.int64)
        np.cumsum(quote, out=count[1:])
        held = np.diff(starts)
        odd = ((count[1:] - np.repeat(count[starts[:-1]], held)) & 1).astype(bool)  # within a string, its first quote included
        outside = ~odd & ~quote
        types = np.where(outside, _TYPES[data], 0)
        blank = outside & ((data == 32) | (data == 9) | (data == 10) | (data == 13))
        other = outside & (types == 0) & ~blank
        first = other.copy()
        first[1:] &= ~other[:-1]
        types[quote & odd] = _STRING
        types[first] = _PLAIN
        token = np.flatnonzero(types)
        kind = types[token]
        row = np.searchsorted(starts, token, "right") - 1
        n = len(token)
        bad = np.zeros(records, bool)
        # strings: they end, hold no control characters, and escape only what may be escaped
        bad |= ((count[starts[1:]] - count[starts[:-1]]) & 1).astype(bool)
        wrong = odd & (data < 32)
        if slash.any():
            wrong |= odd & escaped & ~_AFTER_SLASH[data]
            u = np.flatnonzero(odd & escaped & (data == 0x75))
            for k in range(1, 5):
                wrong[u[~_HEX[data[np.minimum(u + k, size - 1)]]]] = True
        bad[np.searchsorted(starts, np.flatnonzero(wrong), "right") - 1] = True
        # scalars are numbers or one of three words
        quotes, stops = np.flatnonzero(quote), np.flatnonzero(~other)
        end = token.copy()
        is_string, is_plain = kind == _STRING, kind == _PLAIN
        following = np.searchsorted(quotes, token[is_string]) + 1
        end[is_string] = np.append(quotes, size)[following]
        end[is_plain] = stops[np.searchsorted(stops, token[is_plain])]
        said = _gather(data, token[is_plain], end[is_plain])
        bad[row[is_plain][~np.asarray(pc.match_substring_regex(said, _SCALAR))]] = True
        # brackets around each token; a closing bracket lies within its own
        opens, closes = (kind == _OPEN_OBJECT) | (kind == _OPEN_ARRAY), (kind == _CLOSE_OBJECT) | (kind == _CLOSE_ARRAY)
        depth = np.cumsum(opens.astype(np.int64) - closes)
        bounds = np.searchsorted(token, starts)
        before = np.append(0, depth)[bounds[:-1]]
        level = depth - before[row] - opens + closes
        bad[row[closes & (level < 1)]] = True
        level = np.maximum(level, 0)
        # the bracket that holds each token: the last one before it that opens its level
        rulers = np.flatnonzero(opens)
        deep = int(level.max(initial=0)) + 2
        group = np.concatenate((row * deep + level, row[rulers] * deep + level[rulers] + 1))
        place = np.concatenate((np.arange(n), rulers))
        mark = np.concatenate((np.full(n, -1), rulers))
        order = np.lexsort((mark < 0, place, group))
        filled = np.maximum.accumulate(np.where(mark[order] >= 0, np.arange(len(order)), -1))
        holder = np.full(len(order), -1)
        holder[order] = np.where(filled >= 0, mark[order][np.maximum(filled, 0)], -1)
        ruler = np.where(level > 0, holder[:n], -1)
        within = np.where(ruler >= 0, kind[np.maximum(ruler, 0)], 0)
        # what may follow what
        leads = np.zeros(n, bool)
        leads[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        prior = np.where(leads, 0, np.append(0, kind[:-1]))
        in_object, in_array, alone = within == _OPEN_OBJECT, within == _OPEN_ARRAY, within == 0
        key = is_string & in_object & ((prior == _OPEN_OBJECT) | (prior == _COMMA))
        ended = (prior == _CLOSE_OBJECT) | (prior == _CLOSE_ARRAY) | (prior == _PLAIN) | (prior == _STRING)
        after_key = np.append(False, key[:-1]) & ~leads
        ended &= ~after_key
        begins = opens | is_plain | (is_string & ~key)
        fine = np.where(begins, (in_object & (prior == _COLON)) | (in_array & ((prior == _OPEN_ARRAY) | (prior == _COMMA))) | (alone & (prior == 0)), True)
        fine &= np.where(kind == _COMMA, ~alone & ended, True)
        fine &= np.where(kind == _COLON, in_object & after_key, True)
        fine &= np.where(kind == _CLOSE_OBJECT, in_object & ((prior == _OPEN_OBJECT) | ended), True)
        fine &= np.where(kind == _CLOSE_ARRAY, in_array & ((prior == _OPEN_ARRAY) | ended), True)
        bad[row[~fine]] = True
        bad |= (bounds[:-1] == bounds[1:]) | (np.append(0, depth)[bounds[1:]] != before)
        self.complete = ~bad
        #: Payloads that are one string, and what it says.
        one = self.complete & (bounds[1:] - bounds[:-1] == 1)
        lone = bounds[:-1][one]
        self.wrapped = np.flatnonzero(one)[kind[lone] == _STRING]
        lone = lone[kind[lone] == _STRING]
        self.inner = _strings(data, token[lone] + 1, end[lone], self.slashes)
        # the values of complete payloads that aren't one string, in order
        shown = self.complete.copy()
        shown[self.wrapped] = False
        kept = np.flatnonzero(begins & shown[row])
        number = np.full(n, -1)
        number[kept] = np.arange(len(kept))
        self.row, self.level, self.kind, self.at, self.end = row[kept], level[kept], kind[kept], token[kept], end[kept]
        self.parent = np.where(ruler[kept] >= 0, number[np.maximum(ruler[kept], 0)], -1)
        self.in_array = in_array[kept]
        # a key stands two tokens before its value
        self.keyed = in_object[kept]
        named = np.maximum(kept - 2, 0)
        self.key_at, self.key_end = token[named] + 1, end[named]


def _positions(parent: np.ndarray) -> np.ndarray:
    """The place of each value among its parent's."""
    n = len(parent)
    order = np.argsort(parent, kind="stable")
    new = np.ones(n, bool)
    new[1:] = parent[order][1:] != parent[order][:-1]
    pos = np.zeros(n, np.int64)
    pos[order] = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    pos[parent < 0] = 0
    return pos


class _Paths:
    """Paths as numbers: each is a step below another, and is spelt only where it is written out."""

    def __init__(self, x: _Index, keys: pa.Array):
        n = len(x.at)
        coded = keys.dictionary_encode()
        self.keys = coded.dictionary.to_pylist()
        step = np.zeros(n, np.int64)
        step[x.keyed] = np.asarray(coded.indices).astype(np.int64) + 1
        self.of, self.indexed = np.zeros(n, np.int64), np.zeros(n, np.int64)
        above, steps, chars, levels = [np.full(1, -1)], [np.zeros(1, np.int64)], [np.ones(1, np.int64)], [np.zeros(1, np.int64)]
        sizes = np.array([2, *(len(k) + 1 for k in self.keys)])
        known = 1
        by_level = np.argsort(x.level, kind="stable")
        bounds = np.searchsorted(x.level[by_level], np.arange(int(x.level.max(initial=0)) + 2))
        low = np.ones(1, np.int64)  # characters of the paths of the level above, which start at `base`
        base = 0
        for depth, (lo, hi) in enumerate(zip(bounds[1:-1].tolist(), bounds[2:].tolist(), strict=True), 1):
            nodes = by_level[lo:hi]
            parents = x.parent[nodes]
            new, inverse = np.unique(self.of[parents] * len(sizes) + step[nodes], return_inverse=True)
            self.of[nodes] = known + inverse
            self.indexed[nodes] = self.indexed[parents] + x.in_array[nodes]
            above.append(new // len(sizes)), steps.append(new % len(sizes))
            low, base = low[above[-1] - base] + sizes[steps[-1]], known
            chars.append(low), levels.append(np.full(len(new), depth))
            known += len(new)
        self.above, self.step, self.chars, self.depth = (np.concatenate(c) for c in (above, steps, chars, levels))
        self._spelt = {0: "$"}

    def spell(self, path: int) -> str:
        if (told := self._spelt.get(path)) is not None:
            return told
        parts, p = [], path
        while p:
            s = int(self.step[p])
            parts.append("." + self.keys[s - 1] if s else "[]")
            p = int(self.above[p])
        told = "$" + "".join(reversed(parts))
        if len(told) < 1000:
            self._spelt[path] = told
        return told


def _write(x: _Index, ids: pa.Array, labels: pa.Array, wanted: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    n = len(x.at)
    if not n:
        return
    keys = _strings(x.data, x.key_at[x.keyed], x.key_end[x.keyed], x.slashes)
    paths, pos = _Paths(x, keys), _positions(x.parent)
    first = np.searchsorted(x.row, np.arange(len(ids)))
    key_no = np.cumsum(x.keyed) - 1
    chosen = np.arange(n)
    if wanted is not None:  # only what is asked for is spelt and written
        longest = max(map(len, wanted), default=0)
        there = [p for p in np.unique(paths.of).tolist() if paths.chars[p] <= longest and paths.spell(p) in wanted]
        chosen = np.flatnonzero(np.isin(paths.of, there))
    upto = np.cumsum(paths.chars[paths.of[chosen]] + 4 * paths.indexed[chosen])
    cuts = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(WRITE_BYTES, int(upto[-1]) if len(upto) else 0, WRITE_BYTES)), [len(chosen)])))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at = chosen[lo:hi]
        count = paths.indexed[at]
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(count, out=offsets[1:])
        flat = np.zeros(int(offsets[-1]), np.int32)
        node, slot, live = at.copy(), offsets[1:] - 1, np.flatnonzero(count)
        while len(live):
            here = x.in_array[node[live]]
            flat[slot[live[here]]] = pos[node[live[here]]]
            slot[live[here]] -= 1
            node[live] = x.parent[node[live]]
            live = live[slot[live] >= offsets[live]]
        string, plain = x.kind[at] == _STRING, x.kind[at] == _PLAIN
        said = _strings(x.data, x.at[at][string] + 1, x.end[at][string], x.slashes)
        bare = _gather(x.data, x.at[at][plain], x.end[at][plain])
        lead = x.data[x.at[at]]
        null, truth = plain & (lead == 0x6E), plain & ((lead == 0x74) | (lead == 0x66))
        place = np.full(len(at), -1)
        place[string], place[plain] = np.arange(len(said)), len(said) + np.arange(len(bare))
        place[null] = -1
        values = pa.concat_arrays([said, bare]).take(pa.array(place, mask=place < 0))
        kinds = np.select([x.kind[at] == _OPEN_OBJECT, x.kind[at] == _OPEN_ARRAY, string, null, truth], np.arange(5), 5)
        spelt, inverse = np.unique(paths.of[at], return_inverse=True)
        own = pa.array(np.where(x.keyed[at], key_no[at], 0), mask=~x.keyed[at])
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(x.row[at])), labels.take(pa.array(x.row[at])), pa.array((at - first[x.row[at]]).astype(np.int32)),
                pa.array(np.where(x.parent[at] >= 0, x.parent[at] - first[x.row[at]], -1).astype(np.int32)), pa.array(x.level[at].astype(np.int32)),
                pa.array([paths.spell(p) for p in spelt.tolist()], pa.string()).take(pa.array(inverse)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
                keys.take(own).cast(pa.string()), pa.array(pos[at].astype(np.int32)),
                pa.array(["object", "array", "string", "null", "boolean", "number"]).take(pa.array(kinds)), values.cast(pa.string()),
            ],
            names=["id", "label", "node", "parent", "depth", "path", "indices", "key", "pos", "kind", "value"],
        )


def _indexed(ids: pa.Array, labels: pa.Array, payloads: pa.Array, wanted: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """The rows of a column of payloads; those that are strings are looked into until none is."""
    while len(ids):
        lines = pc.binary_join_element_wise(payloads.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        raw = np.frombuffer(lines.buffers()[2], np.uint8)
        deeper, row = [], 0
        while row < len(lines):
            end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
            end = min(max(end, row + 1), len(lines))
            x = _Index(raw[offsets[row] : offsets[end]], (offsets[row : end + 1] - offsets[row]).astype(np.int64))
            yield from _write(x, ids.slice(row, end - row), labels.slice(row, end - row), wanted)
            deeper.append((row + x.wrapped, x.inner))
            row = end
        at = pa.array(np.concatenate([rows for rows, _ in deeper]))
        ids, labels, payloads = ids.take(at), labels.take(at), pa.concat_arrays([inner for _, inner in deeper])


def _run(wanted: frozenset[str] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _indexed(batch.column(0), batch.column(1), batch.column(2), wanted)

    return run


def nodes(df: DataFrame, key: str, label: str, payload: str, paths: list[str] | None = None) -> DataFrame:
    """One row per JSON value: its number and its parent's within the record, path, array positions, key, kind and value.

    Null, empty and incomplete payloads have no rows; a payload that is a JSON string holding JSON, however often wrapped,
    counts as the innermost one. Rows delivered twice (same key, label and payload) count once. Array positions count from
    0 and include nulls. An object that repeats a key yields a row for each. Nesting may be as deep as it likes. With
    `paths`, only the values at these are written out, with their numbers and positions among all.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(payload).cast("string").alias("payload"))
    return rows.where("id is not null and payload is not null").distinct().mapInArrow(_run(frozenset(paths) if paths is not None else None), NODES)


def named(c: Column) -> Column:
    """Is it text that isn't blank?"""
    return F.coalesce(c.rlike("[^ \\t\\n\\r\\u00a0]"), F.lit(False))


#: For each feed: the path of an item, and of the values that name a child of it.
LP, CDI, ITEMS = "lp-dokumenty", "search-cdi-article", "items-search"
ITEM_PATHS = {LP: "$[]", CDI: "$.docs[]", ITEMS: "$[]"}
CHILD_PATHS = [
    (LP, "stadium", "$[].stadiumMaterialuHistoria[].stadium.nazov"),
    (LP, "stadium", "$[].stadiumMaterialuHistoria.stadium.nazov"),
    (CDI, "contrib", "$.docs[].pnx.search.creatorcontrib[]"),
    (CDI, "contrib", "$.docs[].pnx.search.creatorcontrib"),
    (ITEMS, "creator", "$[].data.creators[].name"),
    (ITEMS, "creator", "$[].data.creators[].firstName"),
    (ITEMS, "creator", "$[].data.creators[].lastName"),
]


def items(values: DataFrame) -> DataFrame:
    """(record_id, feed, item_no, kind): the documents, articles or library items of each record."""
    one_of = F.lit(False)
    for feed, path in ITEM_PATHS.items():
        one_of = one_of | ((F.col("label") == feed) & (F.col("path") == path))
    return values.where(one_of).select(F.col("id").alias("record_id"), F.col("label").alias("feed"), F.col("indices")[0].alias("item_no"), "kind")


def children(values: DataFrame) -> DataFrame:
    """(record_id, child, parent_no, child_no, name): the named children, each with the number of the item that holds it."""
    child = F.lit(None).cast("string")
    for feed, name, path in CHILD_PATHS:
        child = F.when((F.col("label") == feed) & (F.col("path") == path), F.lit(name)).otherwise(child)
    rows = values.where(F.col("kind") == "string").where(named(F.col("value"))).withColumn("child", child).where(F.col("child").isNotNull())
    # a single object or string instead of a list is child 0
    return rows.select(F.col("id").alias("record_id"), "child", F.col("indices")[0].alias("parent_no"), F.coalesce(F.try_element_at("indices", F.lit(2)), F.lit(0)).alias("child_no"), F.col("key").alias("field"), F.col("value").alias("name"))
