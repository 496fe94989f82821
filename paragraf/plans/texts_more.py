"""Queries of chunks, search strings and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.operators import chunks, terms
from paragraf.plans.catalogue import query, table
from paragraf.sources.answers import merged, record_key
from paragraf.sources.requests import Request


@query("X10_chunks")
def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunks(table(spark, d, "decision_text"), "decision_id", "body").withColumnRenamed("id", "decision_id")


_W = r"' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{Nd}][\p{L}\p{Nd}\p{M}]*'), ' ') || ' '"


@query("X8_phrase_and_words", f"WITH w AS (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, 'and' AS ladder FROM w WHERE contains(w, ' smlouva ') AND contains(w, ' bylo prokázáno ')")
def phrase_and_words(spark: SparkSession, d: str) -> DataFrame:
    return terms.matches(table(spark, d, "documents").where("text is not null"), "text", 'že "bylo prokázáno" smlouva').select("doc_id", "ladder")


@query("F1_request", "SELECT id FROM decision WHERE contains(lower(court), 'okresní') AND source IN ('justice', 'ns') AND decided_on >= DATE '2015-01-01' AND decided_on <= DATE '2020-12-31'")
def request(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision").where(Request(court="Okresní", sources=("justice", "ns"), since="2015-01-01", until="2020-12-31").predicate()).select("id")


