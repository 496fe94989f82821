"""Queries over nested upstream records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.operators import nested
from paragraf.plans.catalogue import query, table

JSON_ROWS = r"""
WITH whole AS (SELECT DISTINCT record_id, feed, payload FROM upstream_record WHERE payload IS NOT NULL AND json_valid(payload)),
doc AS (SELECT record_id, feed, CASE WHEN json_type(payload) = 'VARCHAR' THEN CASE WHEN json_valid(payload->>'$') THEN payload->>'$' END ELSE payload END AS j FROM whole),
item AS (
  SELECT record_id, feed, unnest(CAST(l AS JSON[])) AS item, generate_subscripts(CAST(l AS JSON[]), 1) - 1 AS item_no
  FROM (SELECT record_id, feed, CASE feed WHEN 'search-cdi-article' THEN j->'$.docs' ELSE j->'$' END AS l FROM doc WHERE j IS NOT NULL)
  WHERE json_type(l) = 'ARRAY'),
kid AS (
  SELECT record_id, feed, item_no, CASE feed WHEN 'lp-dokumenty' THEN item->'$.stadiumMaterialuHistoria' WHEN 'search-cdi-article' THEN item->'$.pnx.search.creatorcontrib' ELSE item->'$.data.creators' END AS k FROM item),
one AS (
  SELECT record_id, feed, item_no, unnest(CAST(k AS JSON[])) AS v, generate_subscripts(CAST(k AS JSON[]), 1) - 1 AS child_no FROM kid WHERE json_type(k) = 'ARRAY'
  UNION ALL SELECT record_id, feed, item_no, k, 0 FROM kid WHERE json_type(k) IN ('OBJECT', 'VARCHAR') AND feed <> 'items-search'),
text AS (
  SELECT record_id, 'stadium' AS child, item_no, child_no, 'nazov' AS field, v->'$.stadium.nazov' AS t FROM one WHERE feed = 'lp-dokumenty'
  UNION ALL SELECT record_id, 'contrib', item_no, child_no, NULL, v FROM one WHERE feed = 'search-cdi-article'
  UNION ALL SELECT record_id, 'creator', item_no, child_no, 'name', v->'$.name' FROM one WHERE feed = 'items-search'
  UNION ALL SELECT record_id, 'creator', item_no, child_no, 'firstName', v->'$.firstName' FROM one WHERE feed = 'items-search'
  UNION ALL SELECT record_id, 'creator', item_no, child_no, 'lastName', v->'$.lastName' FROM one WHERE feed = 'items-search'),
named AS (SELECT record_id, child, CAST(item_no AS INTEGER) AS parent_no, CAST(child_no AS INTEGER) AS child_no, field, t->>'$' AS name FROM text
  WHERE json_type(t) = 'VARCHAR' AND regexp_matches(t->>'$', '[^ \t\n\r\x{A0}]'))
"""


def _values(spark: SparkSession, d: str, paths: list[str]) -> DataFrame:
    return nested.nodes(table(spark, d, "upstream_record"), "record_id", "feed", "payload", paths)


CHILDREN, ITEMS = [path for _, _, path in nested.CHILD_PATHS], sorted(set(nested.ITEM_PATHS.values()))


@query("p2_found", JSON_ROWS + "SELECT DISTINCT record_id, child, parent_no, child_no FROM named")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.children(_values(spark, d, CHILDREN)).select("record_id", "child", "parent_no", "child_no").distinct()


@query("p2_children", JSON_ROWS + "SELECT DISTINCT record_id, child, parent_no, child_no, name FROM named")
def p2_children(spark: SparkSession, d: str) -> DataFrame:
    return nested.children(_values(spark, d, CHILDREN)).select("record_id", "child", "parent_no", "child_no", "name").distinct()


@query("p2_items", JSON_ROWS + "SELECT DISTINCT record_id, feed, CAST(item_no AS INTEGER) AS item_no FROM item")
def p2_items(spark: SparkSession, d: str) -> DataFrame:
    return nested.items(_values(spark, d, ITEMS)).select("record_id", "feed", "item_no").distinct()


@query(
    "p2_records",
    JSON_ROWS + "SELECT r.record_id, CAST(coalesce(n, 0) AS BIGINT) AS items FROM (SELECT DISTINCT record_id FROM upstream_record WHERE record_id IS NOT NULL) r LEFT JOIN (SELECT record_id, count(DISTINCT item_no) AS n FROM item GROUP BY record_id) USING (record_id)",
)
def p2_records(spark: SparkSession, d: str) -> DataFrame:
    every = table(spark, d, "upstream_record").where("record_id is not null").select("record_id").distinct()
    held = nested.items(_values(spark, d, ITEMS)).groupBy("record_id").agg(F.count_distinct("item_no").alias("items"))
    return every.join(held, "record_id", "left").select("record_id", F.coalesce("items", F.lit(0)).cast("long").alias("items"))
