"""Queries of stored state: children, counters, registries, scopes, versions, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paragraf.operators import joins, search, upkeep, usage
from paragraf.plans.catalogue import query, table
from paragraf.plans.upkeep import CURRENT, _current

CUT = "TIMESTAMP '2024-01-10'"


def _cut():
    return F.lit("2024-01-10").cast("timestamp_ntz")


@query(
    "SK2_replace_children",
    "WITH c AS (SELECT DISTINCT decision_id, source, ord, char_start, char_end FROM decision_chunk), p AS (SELECT DISTINCT decision_id FROM decision_text WHERE source = 'ns'), t AS (SELECT decision_id, max(length(body)) AS n FROM decision_text WHERE source = 'ns' AND length(body) > 0 GROUP BY 1) SELECT decision_id, ord, char_start, char_end FROM c WHERE decision_id NOT IN (SELECT decision_id FROM p) UNION ALL SELECT decision_id, CAST(i AS INTEGER), CAST(i * 2000 AS INTEGER), CAST(least(i * 2000 + 2000, n) AS INTEGER) FROM (SELECT *, unnest(range((n - 1) // 2000 + 1)) AS i FROM t)",
)
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "decision_chunk").select("decision_id", "source", "ord", "char_start", "char_end").distinct().drop("source")
    texts = table(spark, d, "decision_text").where("source = 'ns'")
    sizes = texts.where("length(body) > 0").groupBy("decision_id").agg(F.max(F.length("body")).alias("n"))
    new = sizes.select("decision_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 2000).cast("int"))).alias("ord"))
    new = new.select("decision_id", "ord", (F.col("ord") * 2000).alias("char_start"), F.least(F.col("ord") * 2000 + 2000, "n").alias("char_end"))
    return upkeep.replace_children(old, new, "decision_id", texts)


@query("SK4_usage_daily", f"WITH e AS (SELECT *, ts < {CUT} AS stored FROM events) SELECT CAST(ts AS DATE) AS day, event_type, round(sum(value), 4) AS amount FROM e WHERE stored OR (value > 0 AND NOT isnan(value) AND NOT isinf(value)) GROUP BY ALL")
def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", F.col("value").alias("amount"), "ts")
    stored = rows.where(F.col("ts") < _cut()).groupBy("day", "event_type").agg(F.sum("amount").alias("amount"))
    return upkeep.add_counters(stored, rows.where(F.col("ts") >= _cut()), ["day", "event_type"], "amount").withColumn("amount", F.round("amount", 4))


@query("SK5_refund", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), b AS (SELECT user_id, CAST(floor(sum(value) / 10) AS BIGINT) AS back FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, greatest(0, n - coalesce(back, 0)) AS n FROM c LEFT JOIN b USING (user_id)")
def refund(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    counts = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    back = rows.where("event_type = 'error'").groupBy("user_id").agg(F.floor(F.sum("value") / 10).alias("n"))
    return upkeep.refunded(counts, back, ["user_id"], "n")


@query("SK6_aliases_grown", "WITH a AS (SELECT court_code, trim(court) AS alias, count(*) AS seen, source FROM decision WHERE court_code IS NOT NULL AND court IS NOT NULL GROUP BY ALL) SELECT court_code, alias, max(seen) AS seen FROM a WHERE court_code IN (SELECT code FROM justice_court_name) AND source IN ('justice', 'ns', 'nss', 'us', 'sdeu') GROUP BY 1, 2")
def aliases_grown(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "decision").where("court_code is not null and court is not null").groupBy("court_code", F.trim("court").alias("alias"), "source").agg(F.count("*").alias("seen"))
    known = table(spark, d, "justice_court_name").select(F.col("code").alias("court_code"))
    return upkeep.grown(seen.where("source = 'justice'"), seen.where("source <> 'justice'"), ["court_code", "alias"], "seen", known, "court_code")


@query("SK7_last_load_wins", "SELECT id, arg_max(url, (last_seen_at, coalesce(url, ''))) AS url, max(last_seen_at) AS last_seen_at FROM (SELECT id, coalesce(url, '') AS url, last_seen_at FROM decision WHERE last_seen_at IS NOT NULL) GROUP BY id")
def last_load_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision").where("last_seen_at is not null").select("id", F.coalesce("url", F.lit("")).alias("url"), "last_seen_at")
    return upkeep.last_wins(rows, ["id"], F.struct("last_seen_at", "url"))


@query("SK9_run_ledger", "SELECT source, CAST(date_trunc('month', first_seen_at) AS DATE) AS month, count(DISTINCT id) AS stored, count(DISTINCT id) FILTER (gone_at IS NOT NULL) AS gone, max(published_on) AS cursor FROM decision GROUP BY ALL")
def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision")
    return rows.groupBy("source", F.to_date(F.date_trunc("month", "first_seen_at")).alias("month")).agg(F.count_distinct("id").alias("stored"), F.count_distinct(F.when(F.col("gone_at").isNotNull(), F.col("id"))).alias("gone"), F.max("published_on").alias("cursor"))


@query("SK10_filters_on_texts", f"WITH {CURRENT}, t AS (SELECT decision_id, max(char_count) AS char_count FROM decision_text GROUP BY 1) SELECT decision_id, char_count, decided_on, decision_type, court_code FROM t LEFT JOIN cur ON cur.id = decision_id")
def filters_on_texts(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "decision_text").groupBy("decision_id").agg(F.max("char_count").alias("char_count"))
    return texts.join(_current(spark, d).select(F.col("id").alias("decision_id"), "decided_on", "decision_type", "court_code"), "decision_id", "left")


@query("J14_recounted", "WITH t AS (SELECT decision_id, max(char_count) AS stored, max(length(body)) AS n FROM decision_text GROUP BY 1), s AS (SELECT decision_id, count(DISTINCT ord) AS pieces, max(char_end) AS reach FROM decision_chunk GROUP BY 1) SELECT s.decision_id, CAST(n AS INTEGER) AS reach FROM s JOIN t USING (decision_id) WHERE reach IS DISTINCT FROM n")
def recounted(spark: SparkSession, d: str) -> DataFrame:
    """Stored counters that differ from what a recount gives, with the true value: how far the pieces of each text reach."""
    stored = table(spark, d, "decision_chunk").groupBy("decision_id").agg(F.max("char_end").alias("reach"))
    truth = table(spark, d, "decision_text").groupBy("decision_id").agg(F.max(F.length("body")).alias("reach"))
    return upkeep.corrected(stored, truth, ["decision_id"], ["reach"])


@query("SK11_retention", "SELECT event_type, count(*) AS n, min(ts) AS oldest FROM events WHERE ts > (SELECT max(ts) FROM events) - to_days(CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 7 ELSE 20 END) GROUP BY event_type")
def retention(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    now = rows.agg(F.max("ts").alias("t")).first().t
    days = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", 7).otherwise(20)
    return upkeep.retained(rows, "ts", F.lit(now).cast("timestamp_ntz"), days).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


@query("SK13_versioned_save", f"WITH {CURRENT}, e AS (SELECT DISTINCT id, min(parser_version) OVER (PARTITION BY id) AS asked FROM decision) SELECT cur.id, CASE WHEN asked = parser_version THEN 'edited' ELSE category END AS category, parser_version + CAST(coalesce(asked = parser_version, FALSE) AS INTEGER) AS parser_version FROM cur LEFT JOIN e USING (id)")
def versioned_save(spark: SparkSession, d: str) -> DataFrame:
    edits = table(spark, d, "decision").groupBy("id").agg(F.min("parser_version").alias("parser_version"), F.lit("edited").alias("category"))
    return upkeep.versioned(_current(spark, d).select("id", "category", "parser_version"), edits, ["id"], "parser_version", ["category"])[0]


BLOCKED = "bad AS (SELECT sha256(text) AS h FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"


def _copied(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h")


@query("F23_blocked_hash", f"WITH {BLOCKED} SELECT doc_id, source FROM documents WHERE text IS NULL OR sha256(text) NOT IN (SELECT h FROM bad)")
def unblocked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "text")
    return upkeep.without_blocked(rows, F.sha2("text", 256), _copied(spark, d)).select("doc_id", "source")


@query("SK14_takedown", f"WITH {BLOCKED} SELECT coalesce(lower(trim(source)), '?') AS tenant, count(*) AS held, count(*) FILTER (sha256(text) IN (SELECT h FROM bad)) AS removed FROM documents WHERE text IS NOT NULL GROUP BY 1")
def taken_down(spark: SparkSession, d: str) -> DataFrame:
    """How many copies of blocked contents each tenant loses."""
    rows = table(spark, d, "documents").where("text is not null").select(F.coalesce(F.lower(F.trim("source")), F.lit("?")).alias("tenant"), "text")
    left = upkeep.without_blocked(rows, F.sha2("text", 256), _copied(spark, d)).groupBy("tenant").agg(F.count("*").alias("left"))
    held = rows.groupBy("tenant").agg(F.count("*").alias("held"))
    return held.join(left, "tenant", "left").select("tenant", "held", (F.col("held") - F.coalesce("left", F.lit(0))).alias("removed"))


@query("J13_copies_elsewhere", "WITH t AS (SELECT DISTINCT sha256(text) AS h, doc_id, lower(trim(source)) AS s FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), n AS (SELECT h, count(DISTINCT s) AS sources FROM t GROUP BY h) SELECT doc_id, sources - 1 AS elsewhere FROM t JOIN n USING (h) WHERE sources > 1")
def copies_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null and source is not null").select(F.sha2("text", 256).alias("h"), "doc_id", F.lower(F.trim("source")).alias("s"))
    spread = rows.groupBy("h").agg(F.count_distinct("s").alias("sources")).where("sources > 1")  # counted, so no pairs of copies are made
    return rows.join(spread, "h").select("doc_id", (F.col("sources") - 1).alias("elsewhere"))


@query("F13_tenant_scope", "WITH d AS (SELECT doc_id, lower(trim(source)) AS tenant FROM documents), asked AS (SELECT DISTINCT tenant FROM d WHERE contains(tenant, 'sb')), policy AS (SELECT DISTINCT tenant FROM d WHERE tenant < 'v') SELECT doc_id, tenant FROM d WHERE tenant IN (SELECT tenant FROM asked) AND tenant IN (SELECT tenant FROM policy)")
def tenant_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("tenant"))
    return upkeep.scoped(rows, "tenant", rows.where(F.contains("tenant", F.lit("sb"))), rows.where("tenant < 'v'"))


@query("F14_lifecycle", f"WITH {CURRENT} SELECT id FROM cur WHERE text_sha256 IS NOT NULL AND gone_at IS NULL AND decision_type IS NOT NULL")
def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).where("text_sha256 is not null and gone_at is null and decision_type is not null").select("id")


@query("F15_stale_rows", f"WITH {CURRENT}, st AS (SELECT decision_id, min(sha256(body)) AS h, max(CASE WHEN char_count > 3000 THEN 9 ELSE 8 END) AS v FROM decision_text WHERE body IS NOT NULL GROUP BY 1) SELECT cur.id FROM cur LEFT JOIN st ON st.decision_id = cur.id WHERE cur.text_sha256 IS NOT NULL AND (st.h IS NULL OR st.h <> cur.text_sha256 OR st.v <> 9)")
def stale_rows(spark: SparkSession, d: str) -> DataFrame:
    """The state is a table of its own: what text each derivation saw, and by which version it was made."""
    texts = table(spark, d, "decision_text").where("body is not null")
    state = texts.groupBy(F.col("decision_id").alias("id")).agg(F.min(F.sha2("body", 256)).alias("text_sha256"), F.max(F.when(F.col("char_count") > 3000, 9).otherwise(8)).alias("version"))
    rows = _current(spark, d).where("text_sha256 is not null").select("id", "text_sha256")
    return upkeep.stale(rows, state, ["id"], "text_sha256", 9).select("id")


QUEUE = """q AS (SELECT user_id, event_type, ts, sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM events WHERE event_type IN ('error', 'purchase')),
l AS (SELECT user_id, max(since) AS since FROM q GROUP BY 1), r AS (SELECT user_id, count(*) AS attempts, max(ts) AS last FROM q JOIN l USING (user_id, since) WHERE event_type = 'error' GROUP BY 1)"""


def _queue(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return usage.retry_queue(table(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], "ts", kind == "error", kind == "purchase")


@query("ST3_retry_queue", f"WITH {QUEUE} SELECT user_id, attempts, last FROM r")
def retry_queue(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d)


@query("F19_due_rows", f"WITH {QUEUE} SELECT user_id, attempts FROM r WHERE last + to_hours(CAST(least(168, pow(2, least(attempts, 20))) AS INTEGER)) <= (SELECT max(ts) FROM events)")
def due_rows(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "events").agg(F.max("ts").alias("t")).first().t
    return _queue(spark, d).where(upkeep.next_try(F.col("last"), F.col("attempts")) <= F.lit(now).cast("timestamp_ntz")).select("user_id", "attempts")


@query("ST4_paused", "WITH r AS (SELECT user_id, ts, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS failures, max(ts) + INTERVAL 5 MINUTE AS until FROM r WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 2")
def paused(spark: SparkSession, d: str) -> DataFrame:
    return usage.paused(table(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], "ts", F.col("event_type") == "error", 2, 5)


@query("ST6_derivation_budget", f"WITH {CURRENT} SELECT source, id FROM cur WHERE parser_version < 9 QUALIFY row_number() OVER (PARTITION BY source ORDER BY last_seen_at, id) <= 15")
def derivation_budget(spark: SparkSession, d: str) -> DataFrame:
    """Outdated rows, the oldest first, as many a day and source as the budget allows."""
    rows = _current(spark, d).where("parser_version < 9").select("source", "id", "last_seen_at")
    return search.per_group(rows, ["source"], [F.asc("last_seen_at"), F.asc("id")], 15).select("source", "id")


@query("V2_current_and_future", "WITH v AS (SELECT DISTINCT l_partkey, CAST(l_shipdate AS DATE) AS since FROM lineitem) SELECT l_partkey, max(since) FILTER (since <= DATE '1996-06-30') AS current, coalesce(string_agg(CAST(since AS VARCHAR), ' ' ORDER BY since) FILTER (since > DATE '1996-06-30'), '') AS future FROM v GROUP BY l_partkey")
def current_and_future(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("since")).distinct()
    at = F.lit("1996-06-30").cast("date")
    later = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("since") > at, F.col("since")))), lambda x: x.cast("string")), " ")
    return rows.groupBy("l_partkey").agg(F.max(F.when(F.col("since") <= at, F.col("since"))).alias("current"), later.alias("future"))


@query("V3_in_force_by_year", "WITH act AS (SELECT DISTINCT l_partkey, year(l_shipdate) AS y FROM lineitem), ask AS (SELECT DISTINCT l_partkey, year(o_orderdate) AS asked FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT ask.l_partkey, asked, coalesce(max(y) FILTER (y <= asked), max(y)) AS issued FROM ask JOIN act USING (l_partkey) GROUP BY ALL" )
def in_force_by_year(spark: SparkSession, d: str) -> DataFrame:
    """The newest issued by the year, else the newest of all."""
    rows = table(spark, d, "lineitem")
    acts = rows.groupBy("l_partkey").agg(F.collect_set(F.year("l_shipdate")).alias("years"))
    asked = rows.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_partkey", F.year("o_orderdate").alias("asked")).distinct()
    by = F.array_max(F.filter("years", lambda y: y <= F.col("asked")))
    return asked.join(acts, "l_partkey").select("l_partkey", "asked", F.coalesce(by, F.array_max("years")).alias("issued"))


@query("U10_merged_keys", "SELECT DISTINCT decision_id, ord, array_to_string(list_sort(list_distinct(list_concat(list_filter(ident_keys, lambda k: NOT starts_with(k, 'par:1')), ['meta:' || source]))), ' ') AS keys FROM decision_chunk WHERE ident_keys IS NOT NULL")
def merged_keys(spark: SparkSession, d: str) -> DataFrame:
    old = F.filter("ident_keys", lambda k: F.startswith(k, F.lit("par:1")))
    keys = upkeep.merged_keys(F.col("ident_keys"), old, F.array(F.concat(F.lit("meta:"), "source")))
    return table(spark, d, "decision_chunk").where("ident_keys is not null").select("decision_id", "ord", F.array_join(F.array_sort(keys), " ").alias("keys")).distinct()


@query("U4_distinct_first", "WITH r AS (SELECT DISTINCT decision_id, ord, ident_keys FROM decision_chunk), u AS (SELECT decision_id, ord, unnest(ident_keys) AS k, generate_subscripts(ident_keys, 1) AS n FROM r), f AS (SELECT decision_id, ord, k, min(n) AS n FROM u GROUP BY ALL) SELECT decision_id, ord, string_agg(k, ' ' ORDER BY n) AS keys FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY decision_id, ord ORDER BY n) <= 3) GROUP BY ALL")
def distinct_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision_chunk").select("decision_id", "ord", "ident_keys").distinct().where("size(ident_keys) > 0")
    return rows.select("decision_id", "ord", F.array_join(F.slice(F.array_distinct("ident_keys"), 1, 3), " ").alias("keys"))


@query("U6_merged_cases", "WITH n AS (SELECT DISTINCT unnest(case_numbers) AS case_number, id, source FROM decision) SELECT case_number, count(DISTINCT id) AS decisions, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM n WHERE case_number IS NOT NULL GROUP BY case_number")
def merged_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision").select(F.explode("case_numbers").alias("case_number"), "id", "source").where("case_number is not null")
    return rows.groupBy("case_number").agg(F.count_distinct("id").alias("decisions"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query(
    "U7_merged_records",
    """WITH r AS (SELECT DISTINCT id, case WHEN ecli LIKE 'ECLI:%' THEN 'doi:' || lower(trim(ecli)) ELSE 't:' || regexp_replace(lower(concat_ws('|', trim(court), CAST(year(decided_on) AS VARCHAR), trim(case_number))), '\\s+', ' ', 'g') END AS record_key,
case_number, legal_sentence, CAST(case_number IS NOT NULL AS INTEGER) + CAST(legal_sentence IS NOT NULL AS INTEGER) AS rich FROM decision)
SELECT record_key, count(*) AS listings, arg_min(case_number, (-rich, coalesce(case_number, ''), coalesce(legal_sentence, ''))) FILTER (case_number IS NOT NULL) AS case_number, arg_min(legal_sentence, (-rich, coalesce(case_number, ''), coalesce(legal_sentence, ''))) FILTER (legal_sentence IS NOT NULL) AS legal_sentence FROM r GROUP BY record_key""",
)
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    from paragraf.sources.answers import merged, record_key

    rows = table(spark, d, "decision").select("id", "ecli", "court", "decided_on", "case_number", "legal_sentence")
    named = F.when(F.col("ecli").startswith("ECLI:"), F.col("ecli"))
    key = record_key(named, F.col("court"), F.year("decided_on"), F.col("case_number"))
    rows = rows.select("id", key.alias("k"), "case_number", "legal_sentence").distinct()
    return merged(rows, F.col("k"), ["case_number", "legal_sentence"]).select("record_key", "listings", "case_number", "legal_sentence")


@query("A13_known_totals", "SELECT decision_id, max(char_count) AS known FROM decision_text GROUP BY decision_id")
def known_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision_text").groupBy("decision_id").agg(F.max("char_count").alias("known"))


@query("A18_total", "SELECT key, count(DISTINCT citing_id) AS total FROM decision_citation GROUP BY key HAVING count(DISTINCT citing_id) > 1")
def total(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision_citation").groupBy("key").agg(F.count_distinct("citing_id").alias("total")).where("total > 1")


@query("A14_keys_ranked", """WITH k AS (SELECT DISTINCT decision_id, ord, unnest(ident_keys) AS key FROM decision_chunk), n AS (SELECT decision_id, key, count(*) AS chunks, min(ord) AS first_ord FROM k GROUP BY ALL)
SELECT decision_id, key, chunks, first_ord, CAST(row_number() OVER (PARTITION BY decision_id ORDER BY chunks DESC, first_ord, key) AS INTEGER) AS place FROM n QUALIFY place <= 500""")
def keys_ranked(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "decision_chunk").select("decision_id", "ord", F.explode("ident_keys").alias("key")).distinct()
    counted = keys.groupBy("decision_id", "key").agg(F.count("*").alias("chunks"), F.min("ord").alias("first_ord"))
    return search.ranked(counted, [F.desc("chunks"), F.asc("first_ord"), F.asc("key")], ["decision_id"], "place").where("place <= 500")


@query("A11_daily_vector", "WITH m AS (SELECT max(CAST(ts AS DATE)) AS m FROM events), u AS (SELECT DISTINCT user_id FROM events), n AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT u.user_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ' ' ORDER BY i DESC) AS days FROM u CROSS JOIN (SELECT unnest(range(7)) AS i) CROSS JOIN m LEFT JOIN n ON n.user_id = u.user_id AND n.day = m.m - CAST(i AS INTEGER) GROUP BY u.user_id")
def daily_vector(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    newest = rows.agg(F.max("day").alias("m")).first().m
    counts = [F.count_if(F.col("day") == F.date_sub(F.lit(newest), i)).cast("string") for i in range(6, -1, -1)]
    return rows.groupBy("user_id").agg(F.concat_ws(" ", *counts).alias("days"))


@query("G2_corrections", f"WITH {CURRENT}, old AS (SELECT * FROM decision QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_seen_at, coalesce(court, ''), coalesce(case_number, '')) = 1) SELECT cur.id, cur.decision_type, cur.published_on FROM old JOIN cur USING (id) WHERE (old.decision_type, old.published_on) IS DISTINCT FROM (cur.decision_type, cur.published_on)")
def corrections(spark: SparkSession, d: str) -> DataFrame:
    first = F.struct("last_seen_at", F.coalesce("court", F.lit("")), F.coalesce("case_number", F.lit("")))
    old = table(spark, d, "decision").groupBy("id").agg(F.min_by(F.struct("decision_type", "published_on"), first).alias("r")).select("id", "r.*")
    return upkeep.corrected(old, _current(spark, d), ["id"], ["decision_type", "published_on"])


@query("G14_tag_predicates", "SELECT DISTINCT decision_id, ord FROM decision_chunk WHERE list_has_any(ident_keys, ['par:160', 'par:2828', 'par:1741', 'par:73']) AND NOT list_contains(ident_keys, 'par:2') AND len(ident_keys) >= 2")
def tag_predicates(spark: SparkSession, d: str) -> DataFrame:
    some = F.array(*[F.lit(k) for k in ("par:160", "par:2828", "par:1741", "par:73")])
    return table(spark, d, "decision_chunk").where(F.arrays_overlap("ident_keys", some) & ~F.array_contains("ident_keys", "par:2") & (F.size("ident_keys") >= 2)).select("decision_id", "ord").distinct()


@query("G15_docket_scan", "WITH k AS (SELECT DISTINCT id, 'sz:' || lower(unnest(case_numbers)) AS key FROM decision UNION SELECT DISTINCT id, lower(ecli) FROM decision WHERE ecli LIKE 'ECLI:%') SELECT id, count(*) AS keys FROM k WHERE regexp_matches(key, '(^sz:2[0-9] |:2018:)') GROUP BY id")
def docket_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision")
    keys = rows.select("id", F.explode("case_numbers").alias("n")).select("id", F.concat(F.lit("sz:"), F.lower("n")).alias("key")).unionByName(rows.where(F.col("ecli").startswith("ECLI:")).select("id", F.lower("ecli").alias("key"))).distinct()
    return keys.where(F.col("key").rlike("(^sz:2[0-9] |:2018:)")).groupBy("id").agg(F.count("*").alias("keys"))


@query("G6_masked_lines", "WITH l AS (SELECT decision_id, unnest(string_split(body, chr(10))) AS line FROM decision_text WHERE body IS NOT NULL), m AS (SELECT regexp_replace(trim(line, ' ' || chr(13)), '[0-9]+', '#', 'g') AS line, count(DISTINCT decision_id) AS docs FROM l WHERE length(trim(line, ' ' || chr(13))) >= 5 GROUP BY 1) SELECT line, docs FROM m WHERE docs >= 5")
def masked_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision_text").where("body is not null").select("decision_id", F.explode(F.split("body", "\n", -1)).alias("line")).select("decision_id", F.trim("line", F.lit(" \r")).alias("line"))
    masked = rows.where(F.length("line") >= 5).select("decision_id", F.regexp_replace("line", "[0-9]+", "#").alias("line"))
    return masked.groupBy("line").agg(F.count_distinct("decision_id").alias("docs")).where("docs >= 5")


@query("G4_gap_mode", "WITH g AS (SELECT citing_id, first_at - lag(first_at) OVER (PARTITION BY citing_id ORDER BY first_at, key) AS gap FROM (SELECT DISTINCT citing_id, key, first_at FROM decision_citation)), n AS (SELECT citing_id, gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY ALL) SELECT DISTINCT ON (citing_id) citing_id, gap, n FROM n ORDER BY citing_id, n DESC, gap")
def gap_mode(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent gap between neighbours of each text, the smaller of equals."""
    rows = table(spark, d, "decision_citation").select("citing_id", "key", "first_at").distinct()
    gap = F.col("first_at") - F.lag("first_at").over(Window.partitionBy("citing_id").orderBy("first_at", "key"))
    counted = rows.select("citing_id", gap.alias("gap")).where("gap > 0").groupBy("citing_id", "gap").agg(F.count("*").alias("n"))
    return counted.groupBy("citing_id").agg(F.max_by(F.struct("gap", "n"), F.struct("n", -F.col("gap"))).alias("b")).select("citing_id", "b.*")


@query("G16_tree_paths", """WITH RECURSIVE link AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || r_regionkey, NULL FROM region),
t(node, path, depth) AS (SELECT child, child, 0 FROM link WHERE parent IS NULL UNION ALL SELECT child, path || '/' || child, depth + 1 FROM t JOIN link ON parent = node WHERE depth < 32) SELECT node, path, depth FROM t""")
def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit(None).cast("string").alias("parent"))
    return joins.paths(nations.unionByName(suppliers).unionByName(regions), "child", "parent")
