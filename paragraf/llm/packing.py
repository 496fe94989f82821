"""Filling containers of fixed capacity by Karmarkar-Karp differencing.

Texts fall by a hash of their key into blocks of WINDOWS containers' worth of tokens, so no block grows with the data and
blocks are packed side by side. Within a block, multiway differencing starts from each item as a partition of its own with
the item in one window, and merges the two partitions of largest imbalance, the fuller windows of one with the emptier
ones of the other, until one is left: windows of nearly equal size. If one exceeds the capacity, there are too few.
Tiny items are bundled beforehand, so a block has at most some thousand partitions however small its texts are.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from paragraf.session import cut

#: Containers' worth of tokens that a block is planned for.
WINDOWS = 32
#: Items of less than this part of the capacity are bundled up to it before differencing.
BUNDLE = 64
#: Kinds of container, a table of settings that travels with the plan; more of them raise an error.
MOST_KINDS = 10_000


def size_in_tokens(text: Column) -> Column:
    """Tokens of a byte-level tokenizer: bytes in UTF-8 and one end token; null for null."""
    return F.octet_length(text).cast("long") + 1


def difference(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """The items of each of so many windows, by multiway differencing; window sums come out nearly equal."""
    if windows == 1:
        return [list(range(len(sizes)))]
    heap: list[tuple[int, int, np.ndarray, list[list[int]]]] = []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size, i, sums, [[i]] + [[] for _ in range(windows - 1)]))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a, held_a = heapq.heappop(heap)
        _, _, b, held_b = heapq.heappop(heap)
        sums = a + b[::-1]  # both fall: the fullest of one with the emptiest of the other
        order = np.argsort(-sums, kind="stable")
        merged = [held_a[k] + held_b[windows - 1 - k] for k in order.tolist()]
        sums = sums[order] - sums[order[-1]]  # only differences matter
        heapq.heappush(heap, (-int(sums[0]), count, sums, merged))
        count += 1
    return heap[0][3] if heap else [[] for _ in range(windows)]


def bundles(sizes: np.ndarray, most: int) -> np.ndarray:
    """The bundle of each item: consecutive items smaller than `most` share one while they stay below twice that."""
    small = sizes < most
    upto = np.cumsum(np.where(small, sizes, 0))
    # an item of `most` or more stands alone; small ones are numbered by how often `most` fits into the sum before them
    part = np.where(small, (upto - sizes) // most, -1 - np.arange(len(sizes)))
    return np.unique(part, return_inverse=True)[1]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item: as few windows as differencing needs so that none exceeds the capacity; no item does."""
    if not len(sizes):
        return np.zeros(0, np.int32)
    bundle = bundles(sizes, max(1, capacity // BUNDLE))
    return _pack(np.bincount(bundle, sizes).astype(np.int64), capacity)[bundle]


def _pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    out = np.zeros(len(sizes), np.int32)
    windows = max(1, int(-(-int(sizes.sum()) // capacity)))
    while True:
        held = difference(sizes, windows)
        worst = max(int(sizes[h].sum()) if h else 0 for h in held)
        if worst <= capacity:
            break
        windows += max(1, (worst - capacity) * windows // (4 * capacity))
    for k, items in enumerate([h for h in held if h]):
        out[items] = k
    return out


def _pack_block(frame: pd.DataFrame) -> pd.DataFrame:
    capacity = int(frame["capacity"].iloc[0])
    frame = frame.sort_values(["size", "doc", "piece_no"], ascending=[False, True, True], kind="stable", ignore_index=True)
    frame["window"] = pack(frame["size"].to_numpy(np.int64), capacity)
    return frame[["container", "block", "window", "doc", "piece_no", "pieces", "size"]]


def fill(df: DataFrame, key: str, text: str, kinds: DataFrame) -> DataFrame:
    """(container, block, window, doc, piece_no, pieces, size): which text or piece lies in which window of each kind.

    kinds(container, capacity) is a small table of settings. A text larger than the capacity is cut into pieces of the
    capacity and a rest; each full piece has a window of its own, the rest is packed like a whole text. A null text has
    no size and lies nowhere, an empty one has size 1. Rows that repeat a key and size are packed once. Kinds without a
    name or with a capacity that isn't positive are left out, and more than MOST_KINDS of them are refused.
    """
    rows = kinds.select(F.col("container").cast("string").alias("container"), F.col("capacity").cast("long").alias("capacity")).where("container is not null and capacity > 0").distinct()
    settings = rows.orderBy("container", "capacity").limit(MOST_KINDS + 1).collect()
    if len(settings) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of container")
    sizes = cut(df.select(F.col(key).cast("long").alias("doc"), size_in_tokens(F.col(text).cast("string")).alias("whole")).where("doc is not null and whole is not null").distinct())
    total = int(sizes.agg(F.coalesce(F.sum("whole"), F.lit(0)).alias("n")).first()["n"])
    told = json.dumps([{"container": r.container, "capacity": r.capacity, "blocks": max(1, -(-total // (r.capacity * WINDOWS)))} for r in settings])
    each = sizes.select("doc", "whole", F.explode(F.from_json(F.lit(told), "array<struct<container: string, capacity: bigint, blocks: bigint>>")).alias("k")).select("doc", "whole", "k.*")
    pieces = each.withColumn("pieces", F.ceil(F.col("whole") / F.col("capacity")).cast("int"))
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece_no"))
    pieces = pieces.withColumn("size", F.least(F.col("capacity"), F.col("whole") - F.col("piece_no") * F.col("capacity")))
    full = pieces.where("size = capacity").select("container", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("window"), "doc", "piece_no", "pieces", "size")
    rest = pieces.where("size < capacity").withColumn("block", F.expr("pmod(xxhash64(doc, container), blocks)"))
    packed = rest.select("container", "capacity", "block", "doc", "piece_no", "pieces", "size").groupBy("container", "block").applyInPandas(_pack_block, "container string, block long, window int, doc long, piece_no int, pieces int, size long")
    return full.unionByName(packed)


def oversized(filled: DataFrame) -> DataFrame:
    """(container, doc): the texts that lie in more than one piece, being larger than a container."""
    return filled.where("pieces > 1").select("container", "doc").distinct()


def _windows(filled: DataFrame) -> DataFrame:
    whole = F.when(F.col("block") == -1, F.struct(F.lit(-1).cast("long").alias("block"), F.col("doc").alias("w"), F.col("piece_no").alias("p"))).otherwise(F.struct(F.col("block"), F.col("window").cast("long").alias("w"), F.lit(0).alias("p")))
    return filled.groupBy("container", whole.alias("w")).agg(F.sum("size").alias("tokens"))


def report(filled: DataFrame) -> DataFrame:
    """(container, windows, tokens, largest) of each kind."""
    return _windows(filled).groupBy("container").agg(F.count("*").alias("windows"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))


def cover(filled: DataFrame, kinds: DataFrame, spare: float = 0.1) -> DataFrame:
    """(container, docs, tokens, overfull, parted, tight): what holds of any good filling, told from the windows alone.

    Documents and tokens placed, windows over capacity, documents in several pieces, and whether no more windows are used
    than a share of `spare` beyond the least possible."""
    capacity = kinds.select("container", F.col("capacity").cast("long").alias("capacity")).where("container is not null and capacity > 0").distinct()
    windows = _windows(filled).join(capacity, "container").groupBy("container", "capacity").agg(F.count("*").alias("windows"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"))
    docs = filled.groupBy("container", "doc").agg(F.count("*").alias("n")).groupBy("container").agg(F.count("*").alias("docs"), F.count_if(F.col("n") > 1).alias("parted"))
    tight = F.col("windows") <= F.ceil(F.col("tokens") / F.col("capacity")) * (1 + spare) + 1
    return windows.join(docs, "container").select("container", "docs", "tokens", "overfull", "parted", tight.alias("tight"))
