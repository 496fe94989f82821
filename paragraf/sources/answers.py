"""Landed answers of upstream sources as rows: JSON pages, SPARQL results, and merges of what several sources list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def json_items(df: DataFrame, payload: str, schema: str, items: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, drift): one row per item of each page, and the pages that don't have the expected shape.

    `schema` is the page's DDL, `items` the field with its list. Nothing is dropped silently: a page is in one of the two.
    """
    parsed = df.select(*keep, payload, F.from_json(F.col(payload), schema, {"mode": "PERMISSIVE"}).alias("_page"))
    good = F.col(f"_page.{items}").isNotNull()
    rows = parsed.where(good).select(*keep, F.posexplode(f"_page.{items}").alias("place", "item")).select(*keep, "place", "item.*")
    return rows, parsed.where(~F.coalesce(good, F.lit(False))).select(*keep, payload)


def bindings(df: DataFrame, payload: str, keep: list[str], names: list[str], key: str) -> DataFrame:
    """The bindings of SPARQL results, one row per key and answer; the first of a key wins. Unbound names are null."""
    page = F.from_json(F.col(payload), "results struct<bindings: array<map<string, struct<value: string>>>>")
    rows = df.select(*keep, F.posexplode(page["results"]["bindings"]).alias("_n", "_b")).select(*keep, "_n", *[F.try_element_at("_b", F.lit(n))["value"].alias(n) for n in names])
    rest = [n for n in names if n != key]
    return rows.where(F.col(key).isNotNull()).groupBy(*keep, key).agg(F.min_by(F.struct(*rest), F.col("_n")).alias("_r")).select(*keep, key, "_r.*")


def record_key(doi: Column, title: Column, year: Column, author: Column) -> Column:
    """What two listings of one work share: the DOI without case, else title, year and author folded to plain words."""
    plain = F.regexp_replace(F.lower(F.concat_ws("|", F.trim(title), year.cast("string"), F.trim(author))), r"\s+", " ")
    bare = F.lower(F.trim(doi))
    return F.when(bare != "", F.concat(F.lit("doi:"), bare)).otherwise(F.concat(F.lit("t:"), plain))


def merged(df: DataFrame, key: Column, fields: list[str]) -> DataFrame:
    """One row per key: the richest listing, its gaps filled from the others; ties go to the least values."""
    rich = F.lit(0)
    for f in fields:
        rich = rich + F.col(f).isNotNull().cast("int")
    rows = df.select(key.alias("_key"), rich.alias("_rich"), *fields)
    best = F.struct(-F.col("_rich"), *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    return rows.groupBy(F.col("_key").alias("record_key")).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), best)).alias(f) for f in fields], F.count("*").alias("listings"))
