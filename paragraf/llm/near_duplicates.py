"""Near-duplicate texts: a blocked sparse product of the document by n-gram incidence matrix with itself.

The columns (n-grams) fall into BLOCKS blocks by their hash. If two rows' overlap reaches the limit over all columns, it
reaches it in at least one block: the shares can't all lie below their mean. So each block is joined by itself, with the
rows' sizes in that block. There, two rows similar enough share one of the rarest n-grams of each, as many as the size
leaves over; they meet at it. A pair that meets is discarded when its sizes differ too much, or when the parity bitmaps
of its rows differ in more bits than the sizes allow n-grams to differ. For what is left the overlap is accumulated block
by block over all columns, and a pair is discarded as soon as what it has and what is still to come can't reach the limit.
Every bound follows from sizes alone, so no pair is lost; the order of the columns only decides how much work there is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paragraf.functions.codepoints import BASE, UNICODE, mix, same_unicode, shingle_sets, shingle_table, slices
from paragraf.session import cut

#: Frequent n-grams that are known to all tasks, by falling frequency: 12 bytes each.
FREQUENT = 262_144
#: A task reports the n-grams that at least so many of its texts hold.
LOCAL_LEAST = 4
#: An n-gram that more texts hold is split into cells of about so many rows, each pair of cells a group of its own.
HOT = 20_000
#: Bytes of the incidence that a task reads, and up to which that rises once there are so many tasks; the width of a row
#: as it is written.
TASK_BYTES, MOST_BYTES, MANY_TASKS, ROW_BYTES = 8_000_000, 64_000_000, 4_096, 20
#: Entries after which a task folds its counts.
FOLD = 1_000_000
#: Characters of texts worked on at once, and rows of the incidence.
CHARS, ROWS = 300_000, 100_000
#: Keys with one and the same text that are written out as all pairs; more of them as a star.
EXPAND = 64
#: Texts with a candidate pair that are broadcast to find their bodies.
FEW = 500_000
#: Blocks of columns, a power of two: of the usual text each holds some dozens of n-grams, which 64 bits tell apart.
BLOCKS = 16
#: Bits of a parity bitmap, which shares a number with the size above it and two bits for a side below; a size that doesn't
#: fit there sets no bound.
BITS, SIDE, MOST = 46, 2, (1 << 15) - 1


def _fingerprints(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number for each set of n-grams, lying one after another: equal sets have equal numbers."""
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams), out=total[1:])
    return mix((total[bounds[1:]] - total[bounds[:-1]]) ^ np.diff(bounds).astype(np.uint64)).view(np.int64)


def _blocks(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block and parity bit of each n-gram; blocks don't fall along sorted n-grams."""
    return (grams >> np.uint64(65 - BLOCKS.bit_length())).astype(np.int64), (grams >> np.uint64(20)) % np.uint64(BITS)


def _bitmaps(grams: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A parity bitmap of each whole set, of a power of two bits, at least twice as many as n-grams. A longer bitmap folds
    into a shorter one by joining its halves with exclusive or, so any two can be compared."""
    size = np.diff(bounds)
    bits = np.maximum(8, np.ceil(np.log2(np.maximum(1, 2 * size))).astype(np.int64))
    row = np.repeat(np.arange(len(size)), size)
    out: list[bytes] = [b""] * len(size)
    for k in np.unique(bits).tolist():  # sets of one length at a time
        mine = np.flatnonzero(bits == k)
        place = np.full(len(size), -1)
        place[mine] = np.arange(len(mine))
        here = place[row] >= 0
        bit = ((grams[here] >> np.uint64(8)) & np.uint64((1 << k) - 1)).astype(np.int64)
        odd = np.bincount((place[row[here]] << k) + bit, minlength=len(mine) << k) & 1
        packed = np.packbits(odd.astype(np.uint8)).tobytes()
        step = (1 << k) // 8
        for j, i in enumerate(mine.tolist()):
            out[i] = packed[j * step : (j + 1) * step]
    return pa.array(out, pa.binary())


def _signatures(width: int, unicode: str = UNICODE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (0, id, fingerprint, size, bits) for the texts and (1, n-gram, 0, texts, null) for those frequent in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same_unicode(unicode)
        names, parts, held = ["kind", "a", "b", "n", "bits"], [], 0
        grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def fold() -> None:
            nonlocal grams, counts, parts, held
            if parts:
                new = np.sort(np.concatenate(parts))
                at = np.flatnonzero(np.concatenate(([True], new[1:] != new[:-1])))
                every = np.concatenate((grams, new[at]))
                amount = np.concatenate((counts, np.diff(np.append(at, len(new)))))
                order = np.argsort(every, kind="stable")
                every, amount = every[order], amount[order]
                at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
                grams, counts = every[at], np.add.reduceat(amount, at)
                if len(grams) > FOLD:  # an n-gram met once so far is taken for rare: this orders columns, no more
                    grams, counts = grams[counts > 1], counts[counts > 1]
            parts, held = [], 0

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, cps, rows in slices(batch.column(1), CHARS):
                every, bounds = shingle_table(cps, rows, width)
                parts.append(every)
                held += len(every)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(last - first, np.int8)), pa.array(ids[first:last].astype(np.int64)), pa.array(_fingerprints(every, bounds)), pa.array(np.diff(bounds).astype(np.int32)), _bitmaps(every, bounds)], names=names)
            if held > FOLD:
                fold()
        fold()
        keep = counts >= LOCAL_LEAST
        grams, counts = grams[keep], counts[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(grams), np.int8)), pa.array(grams.view(np.int64)), pa.array(np.zeros(len(grams), np.int64)), pa.array(counts.astype(np.int32)), pa.nulls(len(grams), pa.binary())], names=names)

    return run


def _rarest(grams: np.ndarray, bounds: np.ndarray, limit: float, frequent: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, about, texts) for the sorted n-grams of texts lying one after another: of each text and block the rarest,
    so many that similar texts meet at one; about holds the n-grams that the text has in the block, their parity bitmap and
    two free bits; texts is how many hold the n-gram, as far as it is frequent."""
    n = len(grams)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    block, bit = _blocks(grams)
    own = row * BLOCKS + block
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    size = np.diff(np.append(first, n))
    parity = np.bitwise_xor.reduceat(np.uint64(1) << bit, first)
    weight = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        weight = np.where(frequent[at] == grams, texts[at], 0)
    which = np.repeat(np.arange(len(first)), size)
    order = np.arange(n)
    heavy = np.flatnonzero(np.maximum.reduceat(weight, first) > 0)  # only where a frequent n-gram stands does the order change
    mixed = np.isin(which, heavy)
    order[mixed] = order[mixed][np.lexsort((weight[mixed], which[mixed]))]
    take = size - np.ceil(limit * size - 1e-9).astype(np.int64) + 1
    chosen = order[np.arange(n) - first[which] < take[which]]
    about = (np.minimum(size, MOST) << BITS + SIDE) | (parity.view(np.int64) << SIDE)
    return row[chosen], grams[chosen], about[which[chosen]], weight[chosen]


def _cells(doc: np.ndarray, texts: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, side) for the rows of the incidence: a row of a hot n-gram goes to one cell for each bucket of its rows.

    The texts of a hot n-gram fall into buckets of about `hot`; the cell of two buckets holds the rows of both, so every
    pair meets in one cell. The side of a row is 0 in a bucket's own cell, where all meet, else 1 or 2, where only the sides
    meet. Other rows have the cell 0."""
    row, cell, sides = [np.flatnonzero(texts <= hot)], [np.zeros(int((texts <= hot).sum()), np.int64)], [np.zeros(int((texts <= hot).sum()), np.int64)]
    for i in np.flatnonzero(texts > hot).tolist():
        buckets = -(-int(texts[i]) // hot)
        own = int(mix(doc[i : i + 1].view(np.uint64))[0] % np.uint64(buckets))
        other = np.arange(buckets)
        low, high = np.minimum(other, own), np.maximum(other, own)
        side = np.where(other == own, 0, np.where(own < other, 1, 2))
        row.append(np.full(buckets, i)), cell.append(1 + high * (high + 1) // 2 + low), sides.append(side)
    return np.concatenate(row), np.concatenate(cell), np.concatenate(sides)


def _incidence(width: int, limit: float, frequent: np.ndarray, texts: np.ndarray, hot: int, unicode: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (n-gram, fingerprint, size and bits) of each different text: its rarest n-grams of each block. A cell of a hot
    n-gram counts as an n-gram of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same_unicode(unicode)
        seen: set[int] = set()
        for batch in batches:
            for _, _, cps, rows in slices(batch.column(1), CHARS):
                every, bounds = shingle_table(cps, rows, width)
                docs, size = _fingerprints(every, bounds), np.diff(bounds)
                new = np.array([n > 0 and d not in seen and not seen.add(d) for d, n in zip(docs.tolist(), size.tolist(), strict=True)], bool)
                every, docs = every[np.repeat(new, size)], docs[new]
                if not len(docs):
                    continue
                place, grams, about, held = _rarest(every, np.append(0, np.cumsum(size[new])), limit, frequent, texts)
                doc = docs[place]
                row, cell, side = _cells(doc, held, hot)
                gram = grams[row]
                gram = np.where(cell > 0, mix(gram + cell.astype(np.uint64) * np.uint64(BASE)), gram)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(doc[row]), pa.array(about[row] | side)], names=["gram", "doc", "about"])

    return run


def _meetings(limit: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs that meet, for rows sorted by n-gram and size, and that the bounds of their block allow."""
    apart = (1 - limit) / (1 + limit)  # the share of both sizes that may lie outside the overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def pairs(own: np.ndarray, doc: np.ndarray, about: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.ones(len(own), bool)  # the same text from two tasks
            new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
            own, side, doc, about = own[new], about[new] & ((1 << SIDE) - 1), doc[new], about[new] >> SIDE
            alone = np.ones(len(own), bool)
            alone[:-1] &= own[1:] != own[:-1]
            alone[1:] &= own[1:] != own[:-1]
            own, side, doc, about = own[~alone], side[~alone], doc[~alone], about[~alone]
            n, bits = about >> BITS, about & ((1 << BITS) - 1)
            left, right, held, lag = [], [], 0, 1
            live = np.arange(len(own))
            while len(live):
                live = live[live + lag < len(own)]
                live = live[own[live] == own[live + lag]]
                live = live[(n[live] >= limit * n[live + lag] - 1e-9) | (n[live + lag] >= MOST)]  # sorted by size: the first that is too large ends it
                near = live[(np.bitwise_count(bits[live] ^ bits[live + lag]) <= apart * (n[live] + n[live + lag]) + 1e-9) | (n[live + lag] >= MOST)]
                near = near[(side[near] == 0) | (side[near] != side[near + lag])]
                a, b = doc[near], doc[near + lag]
                left.append(np.where(a < b, a, b))
                right.append(np.where(a < b, b, a))
                held += len(near)
                lag += 1
                if held > 1_000_000:
                    yield table(left, right)
                    left, right, held = [], [], 0
            if held:
                yield table(left, right)

        def table(left: list, right: list) -> pa.RecordBatch:
            a, b = np.concatenate(left), np.concatenate(right)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at])], names=["doc_a", "doc_b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            columns = [np.concatenate((r, *(b.column(i).to_numpy(zero_copy_only=False) for b in held))) for i, r in enumerate(rest)]
            held = []
            whole = int(np.searchsorted(columns[0], columns[0][-1], "left"))  # the last n-gram may go on in the next batch
            yield from pairs(*(c[:whole] for c in columns))
            rest = [c[whole:] for c in columns]
        yield from pairs(*(np.concatenate((r, *(b.column(i).to_numpy(zero_copy_only=False) for b in held))) for i, r in enumerate(rest)))

    return run


def _allowed(limit: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs (doc_a, doc_b, n_a, n_b, bits_a, bits_b) that sizes and bitmaps of the whole sets allow."""
    apart = (1 - limit) / (1 + limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            a, b = (batch.column(i).to_pylist() for i in (4, 5))
            sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
            differ = np.zeros(len(na), np.int64)
            for la, lb in np.unique(sizes, axis=0).tolist():
                rows = np.flatnonzero((sizes[:, 0] == la) & (sizes[:, 1] == lb))
                x, y = (np.frombuffer(b"".join([own[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), -1) for own in (a, b))
                while x.shape[1] != y.shape[1]:
                    half = max(x.shape[1], y.shape[1]) // 2
                    x, y = (v[:, :half] ^ v[:, half:] if v.shape[1] > half else v for v in (x, y))
                differ[rows] = np.bitwise_count(x ^ y).sum(1)
            near = (differ <= apart * (na + nb) + 1e-9) & (np.minimum(na, nb) >= limit * np.maximum(na, nb) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["doc_a", "doc_b"]).filter(pa.array(near))

    return run


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """The n-grams that each pair of sets has in common, added up block by block; -1 once a pair can't reach the limit."""
    size = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    start = np.append(0, np.cumsum(size))
    block = _blocks(every)[0]
    within = np.zeros((len(sets), BLOCKS), np.int64)
    np.add.at(within, (np.repeat(np.arange(len(sets)), size), block), 1)
    begin = start[:-1, None] + np.cumsum(within, 1) - within
    shared, left_a, left_b = np.zeros(len(a), np.int64), size[a].copy(), size[b].copy()
    need = np.ceil(limit / (1 + limit) * (size[a] + size[b]) - 1e-6)
    live = np.arange(len(a))
    for k in range(BLOCKS):
        live = live[shared[live] + np.minimum(left_a[live], left_b[live]) >= need[live]]
        if not len(live):
            break
        docs = np.concatenate((a[live], b[live]))
        count = within[docs, k]
        pair = np.repeat(np.tile(live, 2), count)
        at = np.arange(int(count.sum())) + np.repeat(begin[docs, k] - np.append(0, np.cumsum(count)[:-1]), count)
        gram = every[at]
        order = np.lexsort((gram, pair))
        pair, gram = pair[order], gram[order]
        both = (pair[1:] == pair[:-1]) & (gram[1:] == gram[:-1])
        shared += np.bincount(pair[1:][both], minlength=len(a))
        left_a[live] -= within[a[live], k]
        left_b[live] -= within[b[live], k]
    out = np.full(len(a), -1, np.int64)
    live = live[shared[live] >= need[live]]
    out[live] = shared[live]
    return out


def _similarity(width: int, limit: float, unicode: str = UNICODE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_a, doc_b, similarity) of the two texts in each row, of those that reach the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same_unicode(unicode)
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            docs, first, ends = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            texts = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(first))
            sets = [s for _, _, cps, rows in slices(texts, CHARS) for s in shingle_sets(cps, rows, width)]
            a, b = ends.reshape(2, -1)
            both = _overlaps(sets, a, b, limit)
            size = np.array([len(s) for s in sets], np.int64)
            near = both >= 0
            values = both[near] / np.maximum(1, size[a[near]] + size[b[near]] - both[near])
            yield pa.RecordBatch.from_arrays([pa.array(keys[0][near]), pa.array(keys[1][near]), pa.array(values)], names=["doc_a", "doc_b", "similarity"])

    return run


def similar_classes(df: DataFrame, key: str, text: str, width: int = 5, limit: float = 0.8, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Classes of texts with equal n-gram sets, and all pairs of classes whose similarity reaches the limit.

    Returns (members, links): members(id, doc, n), one row per key with its class and the size of its set; links(doc_a,
    doc_b, similarity) between classes, doc_a < doc_b. The similarity is the share of the distinct runs of `width` words
    (maximal runs of letters and digits, lower-cased) of either text that both hold. Null and empty texts, and those of
    fewer than `width` words, have n = 0 and no link. Rows that repeat a key count once; null keys are left out. A class
    is known by a 64-bit fingerprint; two sets that share one but differ in size or bitmap raise an error.
    """
    spark = df.sparkSession
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("body")).where(F.col("id").isNotNull())
    signed = cut(texts.mapInArrow(_signatures(width), "kind tinyint, a long, b long, n int, bits binary"))
    members = signed.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.min_by("b", F.struct("n", "b")).alias("doc"), F.min("n").alias("n"))
    counts = cut(signed.where("kind = 1").groupBy("a").agg(F.sum("n").alias("texts")).where(f"texts >= {2 * LOCAL_LEAST}"))
    # the count from which on there are FREQUENT at most, told from a histogram: no task sends its own list to the driver
    step, held, least = F.floor(F.log2("texts") * 16), 0, 1
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("texts").alias("least")).orderBy(F.desc("step")).collect():  # 16 rows for each power of two
        if held + r.n > FREQUENT:
            least = least if held else r.least
            break
        held, least = held + r.n, r.least
    top = counts.where(F.col("texts") >= least).limit(FREQUENT).toPandas() if held else counts.limit(0).toPandas()
    order = np.argsort(top["a"].to_numpy(np.int64).view(np.uint64))
    frequent = spark.sparkContext.broadcast((top["a"].to_numpy(np.int64).view(np.uint64)[order], top["texts"].to_numpy(np.int64)[order]))  # at most FREQUENT entries

    unicode = UNICODE

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _incidence(width, limit, *frequent.value, hot, unicode)(batches)

    size = signed.where("kind = 0").agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("grams")).first()
    rows = size["grams"] * (1 - limit) + BLOCKS * size["texts"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(rows * ROW_BYTES / TASK_BYTES), max(MANY_TASKS, int(rows * ROW_BYTES / MOST_BYTES))) + 1)  # grows with the data, so tasks don't
    incidence = texts.mapInArrow(blocks, "gram long, doc long, about long").repartition(tasks, "gram").sortWithinPartitions("gram", "about", "doc")
    met = incidence.mapInArrow(_meetings(limit), "doc_a long, doc_b long").distinct()
    own = F.struct("n", "bits")
    signature = signed.where("kind = 0 and n > 0").groupBy(F.col("b").alias("doc")).agg(F.min(own).alias("least"), F.max(own).alias("most"))
    clash = F.raise_error(F.concat(F.lit("two sets of n-grams have the fingerprint "), F.col("doc"))).cast("boolean")
    signature = signature.where(F.when(F.col("least") == F.col("most"), True).otherwise(clash)).select("doc", "least.n", "least.bits")
    sides = [signature.select(F.col("doc").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab"]
    both = met.join(sides[0], "doc_a").join(sides[1], "doc_b").select("doc_a", "doc_b", "n_a", "n_b", "bits_a", "bits_b")
    near = cut(both.mapInArrow(_allowed(limit), "doc_a long, doc_b long"))
    ends = near.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).distinct()
    one = members.join(ends, "doc", "left_semi").groupBy("doc").agg(F.min("id").alias("id"))
    if ends.count() <= FEW:  # 16 bytes each; beyond that the texts are shuffled to them
        one = F.broadcast(one)
    bodies = texts.join(one, "id").groupBy("doc").agg(F.first("body").alias("body"))
    both = near.join(bodies.select(F.col("doc").alias("doc_a"), F.col("body").alias("text_a")), "doc_a").join(bodies.select(F.col("doc").alias("doc_b"), F.col("body").alias("text_b")), "doc_b")
    links = both.select("doc_a", "doc_b", "text_a", "text_b").mapInArrow(_similarity(width, limit), "doc_a long, doc_b long, similarity double").where(F.col("similarity") >= limit - 1e-12)
    return members, links


def copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, copy_of, keys): for each key the least key with the very same text, and the number of keys with it."""
    texts = df.select(F.col(key).cast("long").alias("id"), F.sha2(F.col(text).cast("string"), 256).alias("hash")).where("id is not null and hash is not null")
    texts = texts.groupBy("id").agg(F.min("hash").alias("hash"))
    return texts.join(texts.groupBy("hash").agg(F.min("id").alias("copy_of"), F.count("*").alias("keys")), "hash").select("id", "copy_of", "keys")


def similar_pairs(df: DataFrame, key: str, text: str, width: int = 5, limit: float = 0.8, expand: int | None = EXPAND, hot: int = HOT) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of keys whose texts are similar enough, each pair by itself.

    Texts with equal n-gram sets form a class. Of a text that more than `expand` keys have, the least key stands for the
    others, which are paired with it alone: `copies` names them. With None, all copies are written out as pairs. All other pairs within a class and between linked
    classes are written out, those of different texts with equal sets as well.
    """
    members, links = similar_classes(df, key, text, width, limit, hot)
    most = (1 << 62) if expand is None else expand
    members = cut(members.where("n > 0"))
    linked = links.select("doc_a", "doc_b")
    sizes = members.groupBy("doc").agg(F.count("*").alias("size"))
    large = members.join(sizes.where(f"size > {most}"), "doc", "left_semi").select(F.col("id").alias(key))
    large = cut(large)
    if large.count() <= FEW:  # 8 bytes each; the bodies stay where they are
        large = F.broadcast(large)
    same = cut(copies(df.join(large, key, "left_semi"), key, text))  # the texts of large classes only
    hidden = same.where(f"keys > {most} and id > copy_of").select("id", "copy_of")
    star = hidden.select(F.col("copy_of").alias("id_a"), F.col("id").alias("id_b"))
    shown = cut(members.join(hidden, "id", "left_anti").groupBy("doc").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    within = shown.where("size(ids) > 1").select(F.explode("ids").alias("id_a"), "ids").select("id_a", F.explode(F.filter("ids", lambda b: b > F.col("id_a"))).alias("id_b"))

    across = (
        linked.join(shown.select(F.col("doc").alias("doc_a"), F.col("ids").alias("ids_a")), "doc_a")
        .join(shown.select(F.col("doc").alias("doc_b"), F.col("ids").alias("ids_b")), "doc_b")
        .select(F.explode("ids_a").alias("a"), "ids_b")
        .select("a", F.explode("ids_b").alias("b"))
        .select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    )
    return star.unionByName(within).unionByName(across).distinct()


def _roots(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the edges (a row each), and the least end of the component that each lies in."""
    nodes, ends = np.unique(edges, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        least, most = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, most, least)  # old roots are hooked, so whole trees move
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(doc, root) for every end of links(doc_a, doc_b): ends that are connected, however long the way, have one root.

    In each round every node moves to the first of itself and its neighbours in a random order of that round, and on to
    where that one moves; the links are then drawn between those nodes, and links within one are dropped. A node is the
    first with probability 1/2 at most and the last in order never stays, so every round shrinks what is left, and rounds
    grow with the logarithm of its size. They end when no link is left; `few` links or less are connected on the driver.
    """
    spark = links.sparkSession
    edges = cut(links.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).where("a <> b").distinct())
    label = links.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).distinct().withColumn("root", F.col("doc"))
    turn = 0
    while left := edges.count():
        if left <= few:  # 16 bytes each
            pairs = edges.toPandas().to_numpy(np.int64)
            moved = spark.createDataFrame(pa.table(dict(zip(("node", "to"), _roots(pairs), strict=True))))
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("node"))
            first = cut(both.groupBy("a").agg(F.min(place("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", place("a"))["node"].alias("to")))
            moved = cut(first.join(first.select(F.col("node").alias("to"), F.col("to").alias("on")), "to").select("node", F.col("on").alias("to")))
        label = cut(label.join(moved, F.col("root") == F.col("node"), "left").select("doc", F.coalesce("to", "root").alias("root")))
        ends = [moved.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab"]
        edges = cut(edges.join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        turn += 1
    return label


def groups(df: DataFrame, key: str, text: str, width: int = 5, limit: float = 0.8, few: int = FEW) -> DataFrame:
    """(id, group_id, links, members) for every key: groups are connected over links, group_id is the least key."""
    members, links = similar_classes(df, key, text, width, limit)
    members = cut(members)
    links = cut(links.select("doc_a", "doc_b"))
    degree = links.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("links"))
    held = members.where("n > 0").join(components(links, few), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    least = held.groupBy("root").agg(F.min("id").alias("label"))
    label = held.select("doc", "root").distinct().join(least, "root").select("doc", "label")
    out = members.join(label, "doc", "left").join(degree, "doc", "left")
    out = out.select("id", F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("id")).alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return out.join(out.groupBy("group_id").agg(F.count("*").alias("members")), "group_id").select("id", "group_id", "links", "members")
