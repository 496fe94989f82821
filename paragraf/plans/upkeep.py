"""Queries of upkeep over the decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.operators import joins, upkeep
from paragraf.plans.catalogue import query, table


def _current(spark: SparkSession, d: str) -> DataFrame:
    return joins.latest(table(spark, d, "decision"), ["source", "source_id"], F.struct("last_seen_at", "id"))


CURRENT = "cur AS (SELECT * FROM decision QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY last_seen_at DESC, id DESC) = 1)"


@query("SK1_current_rows", f"WITH {CURRENT} SELECT source, source_id, id, case_number, last_seen_at FROM cur")
def current_rows(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).select("source", "source_id", "id", "case_number", "last_seen_at")


@query(
    "SK1_upsert_diff",
    """WITH old AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 7 <> 0), new AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE coalesce(n.c_acctbal, o.c_acctbal) END AS c_acctbal,
CASE WHEN o.c_custkey IS NULL THEN 'inserted' WHEN n.c_custkey IS NULL THEN 'missing' WHEN o.c_name IS NOT DISTINCT FROM n.c_name AND o.c_acctbal IS NOT DISTINCT FROM n.c_acctbal THEN 'unchanged' ELSE 'changed' END AS change
FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey""",
)
def upsert_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    moved = F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).when(F.col("c_custkey") % 11 == 0, None).otherwise(F.col("c_acctbal"))
    new = rows.where("c_custkey % 3 <> 0").withColumn("c_acctbal", moved)  # a perturbed copy: what a second delivery looks like
    return upkeep.difference(rows.where("c_custkey % 7 <> 0"), new, ["c_custkey"], ["c_name", "c_acctbal"], ["c_acctbal"]).select("c_custkey", "c_acctbal", "change")


@query("SK3_blob_dedup", "SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def blob_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("sha"), "doc_id")
    return rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("A6_type_histogram", f"WITH {CURRENT} SELECT source, coalesce(decision_type, '?') AS kind, count(*) AS n FROM cur GROUP BY ALL")
def type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).groupBy("source", F.coalesce("decision_type", F.lit("?")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "A4_conditional_counts",
    "SELECT c_custkey, count(o_orderkey) AS orders, count(*) FILTER (o_totalprice > 150000) AS large, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (year(o_orderdate) = 1995) AS in_1995 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
)
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_totalprice") > 150000).alias("large"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.count_if(F.year("o_orderdate") == 1995).alias("in_1995"))
    return table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left").na.fill(0)


@query(
    "SK8_backoff",
    "WITH f AS (SELECT user_id, count(*) AS attempts, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT user_id, attempts, last + to_hours(CAST(least(168, pow(2, least(attempts, 20))) AS INTEGER)) AS next_try FROM f",
)
def backoff(spark: SparkSession, d: str) -> DataFrame:
    failed = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts"), F.max("ts").alias("last"))
    return failed.select("user_id", "attempts", upkeep.next_try(F.col("last"), F.col("attempts")).alias("next_try"))


@query("PR5_plausible_dates", f"WITH {CURRENT} SELECT id, CASE WHEN decided_on >= DATE '1990-01-01' AND decided_on <= CAST(first_seen_at AS DATE) THEN decided_on END AS decided_on, coalesce(decided_on < DATE '1990-01-01' OR decided_on > CAST(first_seen_at AS DATE), FALSE) AS implausible FROM cur")
def plausible_dates(spark: SparkSession, d: str) -> DataFrame:
    seen = F.col("first_seen_at").cast("date")
    good = (F.col("decided_on") >= F.lit("1990-01-01").cast("date")) & (F.col("decided_on") <= seen)
    bad = F.coalesce((F.col("decided_on") < F.lit("1990-01-01").cast("date")) | (F.col("decided_on") > seen), F.lit(False))
    return _current(spark, d).select("id", F.when(good, F.col("decided_on")).alias("decided_on"), bad.alias("implausible"))
