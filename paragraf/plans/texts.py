"""Queries of text expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.functions import text as t
from paragraf.plans.catalogue import query, table

_FOLD = "strip_accents(lower({}))"


@query("F6_folded_filter", f"SELECT id FROM decision WHERE {_FOLD.format("concat_ws(' ', court, case_number, legal_sentence)")} LIKE '%spravni soud%'")
def folded_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision").where(t.fold(F.concat_ws(" ", "court", "case_number", "legal_sentence")).contains("spravni soud")).select("id")


@query("PR9_pages", "SELECT doc_id, CAST(p AS INTEGER) AS page, substr(text, (p - 1) * 1000 + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(1, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)) + 1)) AS p FROM documents WHERE text IS NOT NULL)")
def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(t.pages(F.col("text"), 1000)).alias("p")).select("doc_id", "p.page", "p.text")


@query(
    "PR1_case_keys",
    r"""WITH p AS (SELECT id, case_number AS c, regexp_extract(case_number, '^\s*(\d{1,3}|[IVXivx]{1,4}\.)\s+(\p{L}{1,5})\s+(\d{1,6})/(\d{2,4})', ['s', 'r', 'n', 'y']) AS m FROM decision WHERE regexp_matches(case_number, '^\s*(\d{1,3}|[IVXivx]{1,4}\.)\s+(\p{L}{1,5})\s+(\d{1,6})/(\d{2,4})'))
SELECT id, 'sz:' || lower(m.s) || ' ' || lower(m.r) || ' ' || m.n || '/' || CASE WHEN length(m.y) = 2 THEN CASE WHEN CAST(m.y AS INTEGER) <= 40 THEN '20' ELSE '19' END || m.y ELSE m.y END AS key FROM p""",
)
def case_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision").select("id", t.case_key(F.col("case_number")).alias("key")).where("key is not null")


@query("PR3_ecli_court", "SELECT id, split_part(ecli, ':', 3) AS code FROM decision WHERE regexp_matches(ecli, '^ECLI:[A-Z]{2}:[A-Z0-9]+:[0-9]{4}:.+$')")
def ecli_court(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision").select("id", t.ecli_court(F.col("ecli")).alias("code")).where("code is not null")


@query("PR11_billable_pages", "SELECT doc_id, greatest(1, CAST(ceil(length(text) / 3600.0) AS BIGINT)) AS pages FROM documents WHERE text IS NOT NULL")
def billable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.greatest(F.lit(1), F.ceil(F.length("text") / 3600)).cast("long").alias("pages"))


@query(
    "X17_check_digit",
    "WITH d AS (SELECT o_orderkey, lpad(CAST(978000000000 + o_orderkey AS VARCHAR), 12, '0') AS s FROM orders) SELECT o_orderkey, CAST((10 - (" + " + ".join(f"CAST(s[{i}] AS INTEGER) * {3 if i % 2 == 0 else 1}" for i in range(1, 13)) + ") % 10) % 10 AS INTEGER) AS digit FROM d",
)
def check_digit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", t.check_digit_13(F.lpad((F.lit(978000000000) + F.col("o_orderkey")).cast("string"), 12, "0")).cast("int").alias("digit"))


@query("F18_pattern_filter", "SELECT id FROM decision WHERE regexp_matches(lower(court), '(nejvyšší|ústavní)')")
def pattern_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision").where(F.col("court").rlike("(?iu)(nejvyšší|ústavní)")).select("id")


@query("T4_page", "SELECT id, decided_on FROM (SELECT DISTINCT id, decided_on FROM decision WHERE decided_on IS NOT NULL) ORDER BY decided_on DESC, id LIMIT 20 OFFSET 40")
def page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision").where("decided_on is not null").select("id", "decided_on").distinct().orderBy(F.desc("decided_on"), "id").offset(40).limit(20)


@query("W10_span_merge", """WITH s AS (SELECT DISTINCT decision_id, char_start, char_end FROM decision_chunk WHERE char_end > char_start),
f AS (SELECT *, CASE WHEN char_start > max(char_end) OVER (PARTITION BY decision_id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY decision_id ORDER BY char_start, char_end ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT decision_id, min(char_start) AS span_start, max(char_end) AS span_end FROM g GROUP BY decision_id, island""")
def span_merge(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    spans = table(spark, d, "decision_chunk").where("char_end > char_start").select("decision_id", "char_start", "char_end").distinct()
    own = Window.partitionBy("decision_id").orderBy("char_start", "char_end")
    reach = F.max("char_end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("fresh", F.when(F.col("char_start") > reach, 1).otherwise(0)).withColumn("island", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("decision_id", "island").agg(F.min("char_start").alias("span_start"), F.max("char_end").alias("span_end")).drop("island")


