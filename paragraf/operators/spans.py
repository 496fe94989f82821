"""Spans of texts: blocks and pages that overlap them, passages and their words, rankings by how close words stand, windows
around hits. Offsets are code points, spans are half open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paragraf.functions.text import WORD, words

#: Code points of a stored block.
BLOCK = 12_000


def blocks(df: DataFrame, key: str, text: str, size: int = BLOCK) -> DataFrame:
    """(key, block_no, block_start, block_end, block): the texts in stored blocks of `size` code points."""
    rows = df.select(key, F.col(text).alias("_t")).where("length(_t) > 0")
    rows = rows.select(key, "_t", F.explode(F.sequence(F.lit(0), F.floor((F.length("_t") - 1) / size).cast("int"))).alias("block_no"))
    start = F.col("block_no") * size
    return rows.select(key, "block_no", start.alias("block_start"), F.least(start + size, F.length("_t")).alias("block_end"), F.substring("_t", start + 1, F.lit(size)).alias("block"))


def read_spans(stored: DataFrame, spans: DataFrame, key: str, by: list[str], start: str, end: str, size: int = BLOCK) -> DataFrame:
    """(key, by, span_text) of many spans at once, from the blocks that overlap them only: equal keys and block numbers.

    A span whose blocks don't follow each other without a gap, or that isn't as long as it says, has no text."""
    asked = spans.where(F.col(end) > F.col(start)).select(key, *by, F.col(start).alias("_s"), F.col(end).alias("_e"))
    asked = asked.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("_s") / size).cast("int"), F.floor((F.col("_e") - 1) / size).cast("int"))))
    low, high = F.greatest(F.col("_s"), F.col("block_start")), F.least(F.col("_e"), F.col("block_end"))
    parts = asked.join(stored, [key, "block_no"]).withColumn("_p", F.struct("block_no", F.substring("block", low - F.col("block_start") + 1, high - low).alias("part")))
    whole = parts.groupBy(key, *by, "_s", "_e").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["part"]), "").alias("span_text"))
    return whole.where(F.length("span_text") == F.col("_e") - F.col("_s")).select(key, *by, "span_text")


def overlapping(pages: DataFrame, spans: DataFrame, by: list[str], start: str, end: str, page_start: str, page_end: str, width: int, closed: bool = True) -> DataFrame:
    """The pages that each span touches, bin by bin; where `closed`, a page that starts where the span ends counts too."""
    last = F.col(end) if closed else F.col(end) - 1
    a = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), last) / width))))
    b = pages.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(page_start) / width), F.floor(F.greatest(F.col(page_start), F.col(page_end) - 1) / width))))
    meets = (F.col(page_end) > F.col(start)) & ((F.col(page_start) <= F.col(end)) if closed else (F.col(page_start) < F.col(end)))
    return a.join(b, [*by, "_bin"]).where(meets).drop("_bin").distinct()


def positions(df: DataFrame, by: list[str], text: str, terms: list[str]) -> DataFrame:
    """(by, pos, term): where the terms stand among a passage's words."""
    rows = df.select(*by, F.posexplode(words(F.col(text))).alias("pos", "term"))
    return rows.where(F.col("term").isin(terms))


def cover_density(places: DataFrame, by: list[str], terms: list[str], weight: float = 0.1) -> DataFrame:
    """(by, covers, rank): passages that hold every term, ranked by their shortest stretches that do.

    A cover ends where the last missing term comes in and starts as late as it can; each adds the weight over one more than
    the words between its terms."""
    upto = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = [F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(upto).alias(f"_l{i}") for i, t in enumerate(terms)]
    rows = places.select(*by, "pos", *seen).where(" and ".join(f"_l{i} is not null" for i in range(len(terms))))
    rows = rows.withColumn("_from", F.least(*[F.col(f"_l{i}") for i in range(len(terms))]) if len(terms) > 1 else F.col("_l0"))
    covers = rows.groupBy(*by, "_from").agg(F.min("pos").alias("_to"))
    noise = F.greatest(F.lit(0), F.col("_to") - F.col("_from") - (len(terms) - 1))
    return covers.groupBy(*by).agg(F.count("*").alias("covers"), F.round(F.sum(F.lit(weight) / (1 + noise)), 6).alias("rank"))


def densest(df: DataFrame, by: list[str], at: str, width: int) -> DataFrame:
    """(by, window_start, hits): of the stretches of `width` that start at a hit the one with most hits, the first of equals."""
    within = Window.partitionBy(*by).orderBy(at).rangeBetween(0, width)
    rows = df.select(*by, F.col(at).alias("_at"), F.count("*").over(within).alias("hits"))
    return rows.groupBy(*by).agg(F.min_by(F.struct(F.col("_at").alias("window_start"), "hits"), F.struct(-F.col("hits"), F.col("_at"))).alias("_b")).select(*by, "_b.*")


def following(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str]) -> DataFrame:
    """left with `take` of the nearest right row of the same key at or after it; null where there is none."""
    from paragraf.operators.joins import asof

    flipped = right.withColumn("_neg", -F.col(right_at))
    return asof(left.withColumn("_neg_l", -F.col(left_at)), flipped, by, "_neg_l", "_neg", take).drop("_neg_l")


def snapped(text: Column, at: Column, before: int, most: int) -> Column:
    """A stretch around a place, white space collapsed."""
    start = F.greatest(F.lit(0), at - before)
    return F.btrim(F.regexp_replace(F.substring(text, start + 1, F.lit(most)), "[ \\t\\n\\r\\u00a0]+", " "), F.lit(" "))


def whole_words(text: Column, start: Column, most: int) -> Column:
    """A window of whole words with an ellipsis where running text is cut."""
    raw = F.substring(text, start + 1, F.lit(most))
    left = F.when((start > 0) & F.substring(text, start, F.lit(1)).rlike("[\\p{L}\\p{N}]"), F.regexp_replace(raw, "^[\\p{L}\\p{N}]+", "")).otherwise(raw)
    cut = (start + most) < F.length(text)
    right = F.when(cut & F.substring(text, start + most + 1, F.lit(1)).rlike("[\\p{L}\\p{N}]"), F.regexp_replace(left, "[\\p{L}\\p{N}]+\\z", "")).otherwise(left)
    told = F.btrim(F.regexp_replace(right, "[ \\t\\n\\r\\u00a0]+", " "), F.lit(" "))
    return F.concat(F.when(start > 0, F.lit("… ")).otherwise(""), told, F.when(cut, F.lit(" …")).otherwise(""))


def read_windows(pages: DataFrame, by: list[str], page: str, size: str, most: int) -> DataFrame:
    """(by, page, window_no): consecutive pages packed into windows of at most `most` characters; a longer page is alone.

    Each document's pages are gone through in order on the JVM, as one array."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col(size).cast("long").alias("size"))))
    start = F.struct(F.lit(0).alias("no"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<page: int, no: int>>").alias("out"))

    def step(state: Column, p: Column) -> Column:
        opens = (F.size(state["out"]) > 0) & (state["held"] + p["size"] > most)
        no = state["no"] + opens.cast("int")
        held = F.when(opens, p["size"]).otherwise(state["held"] + p["size"])
        return F.struct(no.alias("no"), held.alias("held"), F.concat(state["out"], F.array(F.struct(p["page"].cast("int").alias("page"), no.alias("no")))).alias("out"))

    rows = pages.groupBy(*by).agg(listed.alias("p")).select(*by, F.explode(F.aggregate("p", start, step, lambda s: s["out"])).alias("w"))
    return rows.select(*by, F.col("w.page").alias(page), F.col("w.no").alias("window_no"))


def budgeted(df: DataFrame, order: list[Column], size: Column, most: int, at_least: int = 1) -> DataFrame:
    """The first rows of a list, cut to some hundred before, whose sizes together stay within a budget; one at least."""
    own = Window.partitionBy(F.lit(0)).orderBy(*order)
    rows = df.withColumn("_n", F.row_number().over(own)).withColumn("_sum", F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("_sum") <= most) | (F.col("_n") <= at_least)).drop("_n", "_sum")


def accepted(numbers: DataFrame, by: list[str], place: str, number: str) -> DataFrame:
    """(by, place, number) of the rows whose number is the next expected one: 1 first, then one more than the last accepted."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(number).cast("int").alias("number"))))
    start = F.struct(F.lit(1).alias("want"), F.array().cast("array<struct<place: int, number: int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        fits = x["number"] == state["want"]
        out = F.when(fits, F.concat(state["out"], F.array(F.struct(x["place"].cast("int").alias("place"), x["number"].alias("number"))))).otherwise(state["out"])
        return F.struct((state["want"] + fits.cast("int")).alias("want"), out.alias("out"))

    rows = numbers.groupBy(*by).agg(listed.alias("p")).select(*by, F.explode(F.aggregate("p", start, step, lambda s: s["out"])).alias("w"))
    return rows.select(*by, F.col("w.place").alias(place), F.col("w.number").alias(number))


__all__ = ["BLOCK", "WORD", "accepted", "blocks", "budgeted", "cover_density", "densest", "following", "overlapping", "positions", "read_spans", "read_windows", "snapped", "whole_words"]
