"""Queries of the remaining aggregate, ordering and list shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paragraf.operators import search
from paragraf.plans.catalogue import query, table


@query("A7_best_alias", "WITH n AS (SELECT court_code AS act, trim(court) AS alias, count(*) AS seen FROM decision WHERE court_code IS NOT NULL AND court IS NOT NULL GROUP BY ALL) SELECT act, arg_min(alias, (-seen, length(alias), alias)) AS alias FROM n GROUP BY act")
def best_alias(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "decision").where("court_code is not null and court is not null").groupBy(F.col("court_code").alias("act"), F.trim("court").alias("alias")).agg(F.count("*").alias("seen"))
    return seen.groupBy("act").agg(F.min_by("alias", F.struct(-F.col("seen"), F.length("alias"), "alias")).alias("alias"))


@query("A8_alias_lists", "SELECT court_code, string_agg(kind, ',' ORDER BY kind) AS kinds, bool_or(kind = 'rozsudek') AS has_judgment FROM (SELECT DISTINCT court_code, decision_type AS kind FROM decision WHERE court_code IS NOT NULL AND decision_type IS NOT NULL) GROUP BY court_code")
def alias_lists(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "decision").where("court_code is not null and decision_type is not null").select("court_code", F.col("decision_type").alias("kind")).distinct()
    return kinds.groupBy("court_code").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"), F.bool_or(F.col("kind") == "rozsudek").alias("has_judgment"))


@query("T9_suggest", """WITH p AS (SELECT p_partkey, p_name, count(l_orderkey) AS cited FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE contains(lower(p_name), 'a') GROUP BY ALL)
SELECT p_partkey, p_name, cited, CASE WHEN lower(p_name) = 'a' THEN 0 WHEN starts_with(lower(p_name), 'a') THEN 1 ELSE 2 END AS tier FROM p ORDER BY tier, cited DESC, length(p_name), p_partkey LIMIT 12""")
def suggest(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("cited"))
    name = F.lower("p_name")
    rows = table(spark, d, "part").where(F.contains(name, F.lit("a"))).select("p_partkey", "p_name").join(cited, "p_partkey", "left").na.fill(0, ["cited"])
    tier = F.when(name == "a", 0).when(F.startswith(name, F.lit("a")), 1).otherwise(2)
    return search.top(rows.withColumn("tier", tier), [F.asc("tier"), F.desc("cited"), F.length("p_name"), F.asc("p_partkey")], 12)


@query("T5_has_more", "WITH t AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id FROM decision WHERE decision_type = 'nalez')) SELECT id, (SELECT count(*) FROM t) > 10 AS more FROM t WHERE n <= 10")
def has_more(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "decision").where("decision_type = 'nalez'").select("id").distinct().orderBy("id").limit(11)  # one more than shown tells
    numbered = search.ranked(asked, [F.asc("id")], name="n")
    return numbered.withColumn("more", F.max("n").over(Window.partitionBy(F.lit(0))) > 10).where("n <= 10").select("id", "more")


@query("U3_keys_without_own", "SELECT DISTINCT decision_id, ord, list_sort(list_filter(list_distinct(ident_keys), lambda k: k <> 'par:160')) AS keys FROM decision_chunk WHERE list_contains(ident_keys, 'par:160')")
def keys_without_own(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision_chunk").where(F.array_contains("ident_keys", "par:160"))
    return rows.select("decision_id", "ord", F.array_sort(F.array_except("ident_keys", F.array(F.lit("par:160")))).alias("keys")).distinct()


@query("F10_key_prefix", "SELECT DISTINCT decision_id, ord FROM decision_chunk WHERE len(list_filter(ident_keys, lambda k: starts_with(k, 'par:28'))) > 0")
def key_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision_chunk").where(F.exists("ident_keys", lambda k: F.startswith(k, F.lit("par:28")))).select("decision_id", "ord").distinct()


@query("J1_late_texts", "WITH h AS (SELECT id, max(decided_on) AS decided_on FROM decision WHERE decision_type = 'rozsudek' GROUP BY id ORDER BY decided_on DESC NULLS LAST, id LIMIT 20) SELECT h.id, CAST(max(length(body)) AS INTEGER) AS chars FROM h LEFT JOIN decision_text ON decision_id = h.id GROUP BY h.id")
def late_texts(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "decision").where("decision_type = 'rozsudek'").groupBy("id").agg(F.max("decided_on").alias("decided_on")).orderBy(F.desc_nulls_last("decided_on"), "id").limit(20)
    # twenty hits are broadcast to the texts, so no text moves but theirs
    texts = table(spark, d, "decision_text").select(F.col("decision_id").alias("id"), F.length("body").alias("chars")).join(F.broadcast(hits.select("id")), "id")
    return hits.select("id").join(texts.groupBy("id").agg(F.max("chars").alias("chars")), "id", "left")


@query("G3_weighted_mode", "WITH b AS (SELECT source, CAST(round(length(text) / 100.0) AS BIGINT) AS bucket, sum(length(text)) AS weight FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY ALL) SELECT source, arg_max(bucket, (weight, bucket)) AS bucket FROM b GROUP BY source")
def weighted_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null and source is not null").groupBy("source", F.round(F.length("text") / 100).cast("long").alias("bucket")).agg(F.sum(F.length("text")).alias("weight"))
    return rows.groupBy("source").agg(F.max_by("bucket", F.struct("weight", "bucket")).alias("bucket"))


@query("G10_nth_label", "SELECT id, case_number, CAST(row_number() OVER (PARTITION BY case_number ORDER BY id) AS INTEGER) AS nth FROM (SELECT DISTINCT id, case_number FROM decision WHERE case_number IS NOT NULL)")
def nth_label(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision").where("case_number is not null").select("id", "case_number").distinct()
    return search.ranked(rows, [F.asc("id")], ["case_number"], "nth")


@query("G17_changed_since", "SELECT id, max(last_changed_at) AS changed, max(gone_at) IS NOT NULL AS gone FROM decision WHERE last_changed_at > TIMESTAMP '2018-01-01' OR gone_at > TIMESTAMP '2018-01-01' GROUP BY id")
def changed_since(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit("2018-01-01").cast("timestamp_ntz")
    rows = table(spark, d, "decision").where((F.col("last_changed_at") > since) | (F.col("gone_at") > since))
    return rows.groupBy("id").agg(F.max("last_changed_at").alias("changed"), F.max("gone_at").isNotNull().alias("gone"))


@query("G18_sibling_names", "WITH n AS (SELECT c_custkey, c_nationkey, c_mktsegment AS name, row_number() OVER (PARTITION BY c_nationkey, lower(c_mktsegment) ORDER BY c_custkey) AS k FROM customer) SELECT c_custkey, CASE WHEN k = 1 THEN name ELSE name || ' (' || k || ')' END AS name FROM n")
def sibling_names(spark: SparkSession, d: str) -> DataFrame:
    rows = search.ranked(table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("name"), F.lower("c_mktsegment").alias("low")), [F.asc("c_custkey")], ["c_nationkey", "low"], "k")
    return rows.select("c_custkey", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), "k", F.lit(")"))).alias("name"))


@query("G24_offsets", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS BIGINT) AS char_start FROM l")
def offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("n"), F.length("line").alias("chars"))
    upto = F.sum(F.col("chars") + 1).over(Window.partitionBy("doc_id").orderBy("n"))
    return rows.select("doc_id", "n", (upto - F.col("chars") - 1).alias("char_start"))


@query("W8_running_max", "SELECT decision_id, ord, char_start < max(char_end) OVER (PARTITION BY decision_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS overlaps FROM (SELECT DISTINCT decision_id, ord, char_start, char_end FROM decision_chunk)")
def running_max(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision_chunk").select("decision_id", "ord", "char_start", "char_end").distinct()
    reach = F.max("char_end").over(Window.partitionBy("decision_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("decision_id", "ord", (F.col("char_start") < reach).alias("overlaps"))


@query("A9_nested_view", "SELECT decision_id, string_agg(ord || ':' || char_start || '-' || char_end, ' ' ORDER BY ord) AS pieces FROM (SELECT DISTINCT decision_id, ord, char_start, char_end FROM decision_chunk) GROUP BY decision_id")
def nested_view(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision_chunk").select("decision_id", "ord", "char_start", "char_end").distinct()
    listed = F.array_sort(F.collect_list(F.struct("ord", "char_start", "char_end")))
    return rows.groupBy("decision_id").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["ord"], F.lit(":"), x["char_start"], F.lit("-"), x["char_end"])), " ").alias("pieces"))


@query("T10_sample", "SELECT id, source FROM (SELECT DISTINCT id, source FROM decision) ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 20")
def sample(spark: SparkSession, d: str) -> DataFrame:
    """A pilot of twenty rows, the same on every run: a limit that is the feature."""
    return table(spark, d, "decision").select("id", "source").distinct().orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(20)


@query("A16_strictest", "SELECT user_id, max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS mode, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS share FROM events GROUP BY user_id")
def strictest(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return table(spark, d, "events").groupBy("user_id").agg(F.max(mode).alias("mode"), F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)), 6).alias("share"))


@query("G5_edges", "SELECT source, CAST(quantile_disc(length(text), 0.2) AS INTEGER) AS low, CAST(quantile_disc(length(text), 0.8) AS INTEGER) AS high FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source HAVING count(*) >= 12")
def edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null and source is not null").select("source", F.length("text").alias("n"))
    return rows.groupBy("source").agg(F.expr("percentile_disc(0.2) within group (order by n)").cast("int").alias("low"), F.expr("percentile_disc(0.8) within group (order by n)").cast("int").alias("high"), F.count("*").alias("k")).where("k >= 12").drop("k")
