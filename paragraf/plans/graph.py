"""Queries of the citation graph, of hierarchies, and joins over spans and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.operators import joins
from paragraf.plans.catalogue import query, table

EDGES = "cite AS (SELECT DISTINCT citing_id, key, mentions, first_at FROM decision_citation), own AS (SELECT DISTINCT id, 'ecli:' || lower(substr(ecli, 6)) AS key FROM decision WHERE ecli LIKE 'ECLI:%' UNION SELECT DISTINCT id, 'sz:' || lower(n) FROM (SELECT id, unnest(case_numbers) AS n FROM decision) WHERE n IS NOT NULL)"


def _cites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision_citation").select("citing_id", "key", "mentions", "first_at").distinct()


def _own(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision")
    by_ecli = rows.where(F.col("ecli").startswith("ECLI:")).select("id", F.concat(F.lit("ecli:"), F.lower(F.expr("substring(ecli, 6)"))).alias("key"))
    by_case = rows.select("id", F.explode("case_numbers").alias("n")).where("n is not null").select("id", F.concat(F.lit("sz:"), F.lower("n")).alias("key"))
    return by_ecli.unionByName(by_case).distinct()


@query("J6_dangling_keys", f"WITH {EDGES} SELECT key, count(DISTINCT citing_id) AS citing FROM cite WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.key = cite.key) GROUP BY key")
def dangling(spark: SparkSession, d: str) -> DataFrame:
    return _cites(spark, d).join(_own(spark, d), "key", "left_anti").groupBy("key").agg(F.count_distinct("citing_id").alias("citing"))


@query("A1_key_counts", "SELECT key, count(DISTINCT citing_id) AS decisions, CAST(sum(mentions) AS BIGINT) AS mentions, min(first_at) AS first_at FROM (SELECT DISTINCT citing_id, key, mentions, first_at FROM decision_citation) GROUP BY key")
def key_counts(spark: SparkSession, d: str) -> DataFrame:
    return _cites(spark, d).groupBy("key").agg(F.count_distinct("citing_id").alias("decisions"), F.sum("mentions").alias("mentions"), F.min("first_at").alias("first_at"))


@query("A2_mentions", "SELECT decision_id, key, count(*) AS mentions, min(char_start) AS first_at FROM (SELECT DISTINCT decision_id, ord, char_start, unnest(ident_keys) AS key FROM decision_chunk) GROUP BY ALL")
def mentions(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "decision_chunk").select("decision_id", "ord", "char_start", F.explode("ident_keys").alias("key")).distinct()
    return keys.groupBy("decision_id", "key").agg(F.count("*").alias("mentions"), F.min("char_start").alias("first_at"))


@query(
    "J5_having_keys",
    "SELECT DISTINCT decision_id, ord FROM decision_chunk WHERE list_has_any(ident_keys, (SELECT list(key) FROM (SELECT unnest(ident_keys) AS key, count(*) AS n FROM decision_chunk GROUP BY 1 ORDER BY n DESC, key LIMIT 5)))",
)
def having_keys(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "decision_chunk")
    wanted = chunks.select(F.explode("ident_keys").alias("key")).groupBy("key").count().orderBy(F.desc("count"), "key").limit(5)
    return joins.having_any(chunks.select("decision_id", "ord", "ident_keys"), "ident_keys", wanted, "key", ["decision_id", "ord"]).select("decision_id", "ord").distinct()


@query(
    "F16_leaf_keys",
    "WITH k AS (SELECT DISTINCT source, string_split(rtrim(replace(url, 'https://', ''), '/'), '/')[1] AS a, replace(url, 'https://', '') AS b FROM decision WHERE url IS NOT NULL), p AS (SELECT a AS path FROM k UNION SELECT b FROM k) SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p AS q WHERE starts_with(q.path, p.path || '/'))",
)
def leaf_keys(spark: SparkSession, d: str) -> DataFrame:
    whole = F.replace("url", F.lit("https://"), F.lit(""))
    rows = table(spark, d, "decision").where("url is not null").select(whole.alias("path")).distinct()
    every = rows.unionByName(rows.select(F.substring_index("path", "/", 1).alias("path"))).distinct()
    # every proper prefix that ends before a slash is no leaf
    parts = F.split("path", "/")
    inner = every.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("prefix"), "path").where("prefix <> path").select("prefix").distinct()
    return every.join(inner, every["path"] == inner["prefix"], "left_anti")


@query(
    "J11_subtree",
    """WITH RECURSIVE link AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
up(child, ancestor, distance) AS (SELECT child, parent, 1 FROM link UNION ALL SELECT up.child, link.parent, distance + 1 FROM up JOIN link ON link.child = up.ancestor WHERE distance < 32) SELECT child, ancestor, min(distance) AS distance FROM up GROUP BY ALL""",
)
def subtree(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    return joins.ancestors(nations.unionByName(suppliers), "child", "parent")


@query(
    "J7_asof_view",
    """SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof_view(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return joins.asof(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views.withColumnRenamed("ts", "at"), ["user_id"], "ts", "at", ["view_id"]).drop("ts")


@query(
    "J9_offsets_in_chunks",
    "SELECT DISTINCT c.citing_id, c.key, k.ord FROM (SELECT DISTINCT citing_id, key, first_at FROM decision_citation) c JOIN (SELECT DISTINCT decision_id, ord, char_start, char_end FROM decision_chunk WHERE char_end > char_start) k ON k.decision_id = c.citing_id AND c.first_at >= k.char_start AND c.first_at < k.char_end",
)
def offsets_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "decision_chunk").where("char_end > char_start").select(F.col("decision_id").alias("citing_id"), "ord", "char_start", "char_end").distinct()
    points = table(spark, d, "decision_citation").select("citing_id", "key", "first_at").distinct()
    return joins.within(points, chunks, ["citing_id"], "first_at", "char_start", "char_end", 4096).select("citing_id", "key", "ord").distinct()


@query("J12_court_codes", "SELECT d.id, coalesce(min(CASE WHEN regexp_matches(d.ecli, '^ECLI:[A-Z]{2}:[A-Z0-9]+:[0-9]{4}:.+$') THEN split_part(d.ecli, ':', 3) END), min(n.code)) AS code FROM decision d LEFT JOIN justice_court_name n ON n.name = trim(d.court) WHERE d.source = 'justice' GROUP BY d.id")
def court_codes(spark: SparkSession, d: str) -> DataFrame:
    from paragraf.functions.text import ecli_court

    names = table(spark, d, "justice_court_name").select(F.col("name").alias("court_name"), "code")
    rows = table(spark, d, "decision").where("source = 'justice'").select("id", ecli_court(F.col("ecli")).alias("by_ecli"), F.trim("court").alias("court_name"))
    return rows.join(names, "court_name", "left").groupBy("id").agg(F.coalesce(F.min("by_ecli"), F.min("code")).alias("code"))


@query(
    "V1_version_on_date",
    """WITH v AS (SELECT l_partkey, l_shipdate AS since, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL), r AS (SELECT l_partkey, since, lead(since) OVER (PARTITION BY l_partkey ORDER BY since) AS until, price FROM v)
SELECT l_partkey, price, until IS NULL AS newest FROM r WHERE since <= TIMESTAMP '1996-06-30' AND (until IS NULL OR until > TIMESTAMP '1996-06-30')""",
)
def version_on_date(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "lineitem").groupBy("l_partkey", F.col("l_shipdate").alias("since")).agg(F.max("l_extendedprice").alias("price"))
    rows = rows.withColumn("until", F.lead("since").over(Window.partitionBy("l_partkey").orderBy("since")))
    at = F.lit("1996-06-30").cast("timestamp_ntz")
    return rows.where((F.col("since") <= at) & (F.col("until").isNull() | (F.col("until") > at))).select("l_partkey", "price", F.col("until").isNull().alias("newest"))
