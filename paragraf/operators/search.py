"""Scores to one ranking: channels are fused, variants interleaved, hits capped per document and lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Constant of reciprocal rank fusion, and the channels' weights.
RRF = 60
WEIGHTS = {"and": 1.0, "or": 0.5, "idn": 1.5, "meta": 0.8}


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with the rank of each row, within groups or, for lists cut to a few hundred rows before, over all."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)))


def per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return ranked(df, order, by, "_n").where(F.col("_n") <= k).drop("_n")


def fuse(channels: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, score, channels) by weighted reciprocal ranks; each channel gives (key, rank)."""
    union = None
    for name, df in channels.items():
        part = df.select(key, (F.lit(WEIGHTS[name]) / (RRF + F.col("rank"))).alias("part"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy(key).agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("channels"))


def interleave(lists: DataFrame, variant: str, rank: str, key: str) -> DataFrame:
    """(key, variant, rank, position): the lists' first, then their second entries and so on; the first of a key wins."""
    first = lists.groupBy(key).agg(F.min(F.struct(F.col(rank).alias("rank"), F.col(variant).alias("variant"))).alias("best")).select(key, "best.*")
    return ranked(first, [F.col("rank"), F.col("variant")], name="position")


def combined(df: DataFrame, by: str, lexical: Column, keys: Column, prior: Column, order: list[Column], per_key: float = 0.5, digits: int = 6) -> DataFrame:
    """The best passage of each document, with score = (lexical + per_key for each key that it shares) x prior."""
    scored = df.withColumn("score", F.round((lexical + per_key * keys) * prior, digits)).where("score > 0")
    return per_group(scored, [by], [F.desc("score"), *order], 1)


def more(shown: DataFrame, uncapped: DataFrame, by: str) -> DataFrame:
    """shown with `more`: how many of a document's hits aren't among those shown."""
    total = uncapped.groupBy(by).agg(F.count("*").alias("_total"))
    held = shown.groupBy(by).agg(F.count("*").alias("_shown"))
    return shown.join(total.join(held, by), by).withColumn("more", F.col("_total") - F.col("_shown")).drop("_total", "_shown")


def merged_variants(lists: DataFrame, variant: str, rank: str, key: str, score: str, channels: str) -> DataFrame:
    """(key, position, score, channels): documents of several variants' lists, rank by rank and variant by variant; each has
    its best score and all channels that found it."""
    first = interleave(lists, variant, rank, key).select(key, "position")
    rest = lists.groupBy(key).agg(F.max(score).alias("score"), F.array_join(F.array_sort(F.collect_set(channels)), ",").alias("channels"))
    return first.join(rest, key)


def saturated(df: DataFrame, by: str, depth: int) -> DataFrame:
    """(by, hits, saturated): is a channel's list as long as it may be, so that there may be more?"""
    return df.groupBy(by).agg(F.count("*").alias("hits"), (F.count("*") >= depth).alias("saturated"))


def with_total(df: DataFrame, order: list[Column], k: int, offset: int = 0) -> DataFrame:
    """A page of df with `total`, the number of all rows; counted by itself, so that no task sees all rows."""
    page = top(df, order, k + offset).offset(offset).withColumn("_one", F.lit(1))
    return page.join(F.broadcast(df.agg(F.count("*").alias("total"), F.lit(1).alias("_one"))), "_one").drop("_one")  # one row


def order(mode: str, date: str, score: str = "score", key: str = "doc_id") -> list[Column]:
    """What a list is sorted by: relevance, newest or year; the key breaks every tie."""
    by = {
        "relevance": [F.desc(score), F.desc_nulls_last(date), F.asc(key)],
        "newest": [F.desc_nulls_last(date), F.desc(score), F.asc(key)],
        "year": [F.desc_nulls_last(F.year(date)), F.asc(key)],
    }
    if mode not in by:
        raise ValueError(f"no such order: {mode}")
    return by[mode]


def recall(wanted: DataFrame, rank: str, cuts: list[int]) -> DataFrame:
    """One row: the share of the wanted rows whose rank is within each cut, and the mean of one over the rank, 0 for none."""
    shares = [F.round(F.count_if(F.col(rank) <= k) / F.count("*"), 6).alias(f"recall_{k}") for k in cuts]
    return wanted.agg(*shares, F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))), F.lit(0.0)), 6).alias("reciprocal"))
