"""Queries of landed pages and files. The pages are made of the tables, so that what comes back can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.plans.catalogue import query, table
from paragraf.session import partitioned
from paragraf.sources import answers, landing


@query("SC1_keyset_batch", "SELECT DISTINCT id FROM decision WHERE id > 1500 ORDER BY id LIMIT 50")
def keyset_batch(spark: SparkSession, d: str) -> DataFrame:
    return landing.after(table(spark, d, "decision").select("id").distinct(), "id", 1500, 50)


@query("SC2_partition_scan", "SELECT source, decision_id, ord FROM decision_chunk WHERE source IN ('ns', 'us')")
def partition_scan(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by source, written once in folders; a scan of two sources opens two of them."""
    return partitioned(table(spark, d, "decision_chunk").select("source", "decision_id", "ord"), ["source"]).where(F.col("source").isin("ns", "us")).select("source", "decision_id", "ord")


@query("SC7_json_pages", "SELECT DISTINCT record_id, CAST(payload->>'$.info.total' AS BIGINT) AS total, CAST(json_array_length(payload->'$.docs') AS INTEGER) AS docs FROM upstream_record WHERE feed = 'search-cdi-article' AND json_valid(payload) AND json_type(payload) = 'OBJECT' AND json_type(payload->'$.docs') = 'ARRAY'")
def json_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "upstream_record").where("feed = 'search-cdi-article' and payload is not null").select("record_id", "payload").distinct()
    page = F.from_json("payload", "info struct<total: bigint>, docs array<struct<pnx: struct<search: struct<title: array<string>>>>>", {"mode": "PERMISSIVE"})
    whole = F.try_parse_json("payload").isNotNull()  # a page that was cut off is drift, not a short page
    return rows.where(whole).select("record_id", page.alias("p")).where("p.docs is not null").select("record_id", F.col("p.info.total").alias("total"), F.size("p.docs").alias("docs"))


@query("SC8_sparql_bindings", "SELECT r_regionkey, CAST(n_nationkey AS VARCHAR) AS id, n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def sparql_bindings(spark: SparkSession, d: str) -> DataFrame:
    """One answer for each region; every binding comes twice, and the first counts."""
    one = F.struct(F.struct(F.col("n_nationkey").cast("string").alias("value")).alias("id"), F.struct(F.col("n_name").alias("value")).alias("label"))
    twice = F.struct(F.struct(F.col("n_nationkey").cast("string").alias("value")).alias("id"), F.struct(F.lit("later").alias("value")).alias("label"))
    pages = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.concat(F.collect_list(one), F.collect_list(twice)).alias("b"))
    pages = pages.select("r_regionkey", F.to_json(F.struct(F.struct(F.col("b").alias("bindings")).alias("results"))).alias("payload"))
    return answers.bindings(pages, "payload", ["r_regionkey"], ["id", "label"], "id")


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query("SC9_html_listing", r"SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS place, CAST(n_nationkey AS VARCHAR) AS id, trim(n_name) AS name FROM nation")
def html_listing(spark: SparkSession, d: str) -> DataFrame:
    row = F.concat(F.lit("<tr class='x'><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td><a href='#'> "), _escaped(F.col("n_name")), F.lit("</a>\n</td></tr>"))
    pages = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    pages = pages.select("n_regionkey", F.concat(F.lit("<html><script>x<y</script><table><tr><th>id</th></tr>"), "rows", F.lit("</table>")).alias("html"))
    return landing.listing(pages, "n_regionkey", "html").select("n_regionkey", "place", F.get("cells", F.lit(0)).alias("id"), F.get("cells", F.lit(1)).alias("name"))


_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query("SC10_html_text", f"SELECT doc_id, {_PLAIN} AS text FROM documents WHERE text IS NOT NULL")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<html><head><style>p { x }</style></head><body><div><b>"), _escaped(F.col("text")), F.lit("</b></div><script>var a = '<p>';</script></body>"))
    return landing.page_texts(table(spark, d, "documents").where("text is not null").select("doc_id", page.alias("html")), "doc_id", "html")


@query("SC11_fragment_text", f"SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[<&\\r\\x00]') THEN {_PLAIN} END AS text FROM documents WHERE text IS NOT NULL")
def fragment_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", landing.fragment_text(F.col("text")).alias("text"))


@query("SC12_charsets", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def charsets(spark: SparkSession, d: str) -> DataFrame:
    """Texts landed in three sets, told by a mark, by the header, and by nothing."""
    text = F.col("text")
    kind = F.pmod("doc_id", F.lit(3))
    content = F.when(kind == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(kind == 1, F.encode(text, "UTF-16BE")).otherwise(F.encode(text, "UTF-8"))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", content.alias("content"), F.when(kind == 1, "text/html; charset=utf-16-be").alias("header"))
    return landing.decoded(rows, "doc_id", "content", "header")


@query("SC13_looks_like_html", "SELECT key, regexp_matches(substr(text, 1, 100000), '<[a-zA-Z/!][^<>]{0,200}>') AS html FROM (SELECT key, max(text) AS text FROM files_eval WHERE text IS NOT NULL GROUP BY key)")
def looks_like_html(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "files_eval").where("text is not null").groupBy("key").agg(F.max("text").alias("text"))
    return rows.select("key", landing.looks_like_html(F.col("text")).alias("html"))


@query("SC14_file_kinds", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'rtf' WHEN 2 THEN 'html' ELSE 'text' END AS kind FROM documents WHERE text IS NOT NULL AND NOT contains(text, '<')")
def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = F.pmod("doc_id", F.lit(4))
    lead = F.when(n == 0, "%PDF-1.7\n").when(n == 1, "{\\rtf1 ").when(n == 2, "<html><body>").otherwise("x ")
    rows = table(spark, d, "documents").where("text is not null").where(~F.col("text").contains("<"))
    return rows.select("doc_id", landing.kind_of(F.encode(F.concat(lead, "text"), "UTF-8")).alias("kind"))


@query("SC15_rtf_text", "SELECT c_custkey, c_name || chr(10) || c_mktsegment || ' ž' AS text FROM customer")
def rtf_text(spark: SparkSession, d: str) -> DataFrame:
    rtf = F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}\\f0\\fs24 "), "c_name", F.lit("\\par "), F.lit("{\\b "), "c_mktsegment", F.lit("} \\u382?}"))
    return table(spark, d, "customer").select("c_custkey", landing.rtf_text(rtf).alias("text"))


@query("SC20_act_aliases", r"WITH a AS (SELECT DISTINCT p_partkey AS act, 'zákon č. ' || p_size || '/2001 Sb., ' || p_name || ' (' || p_brand || ')' AS title FROM part) SELECT act, regexp_extract(title, 'Sb\., (.*) \(', 1) AS name, regexp_extract(title, '\(([^()]+)\)$', 1) AS short FROM a")
def act_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Registry items as JSON, and from each the act's name and its short one."""
    title = F.concat(F.lit("zákon č. "), "p_size", F.lit("/2001 Sb., "), "p_name", F.lit(" ("), "p_brand", F.lit(")"))
    items = table(spark, d, "part").select(F.to_json(F.struct(F.col("p_partkey").alias("act"), title.alias("title"))).alias("item")).distinct()
    acts = items.select(F.from_json("item", "act bigint, title string").alias("i")).select("i.*")
    return acts.select("act", F.regexp_extract("title", r"Sb\., (.*) \(", 1).alias("name"), F.regexp_extract("title", r"\(([^()]+)\)$", 1).alias("short"))



@query("SC17_structured_html", "SELECT c_custkey, '## ' || c_name || chr(10) || chr(10) || c_mktsegment || chr(10) || chr(10) || '- a' || chr(10) || chr(10) || '- b' AS text FROM customer")
def structured_html(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<h2>"), _escaped(F.col("c_name")), F.lit("</h2><p><i>"), _escaped(F.col("c_mktsegment")), F.lit("</i></p><ul><li>a</li><li>b</li></ul>"))
    return landing.page_texts(table(spark, d, "customer").select("c_custkey", html.alias("html")), "c_custkey", "html", landing.structured)
