"""Queries of words, structured texts and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paragraf.functions import analysis, queries, text as t
from paragraf.operators import structure
from paragraf.plans.catalogue import query, table
from paragraf.plans.retrieval import BODY, bodies

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}][\p{L}\p{Nd}\p{M}]*')"
_JOINED = "strip_accents(w)"
for _a, _b in analysis.JOINED.items():
    _JOINED = f"replace({_JOINED}, '{_a}', '{_b}')"


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(t.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("X1_fold", rf"SELECT DISTINCT w, regexp_replace({_JOINED}, '\p{{M}}', '', 'g') AS folded FROM (SELECT unnest({_WORDS}) AS w FROM documents)")
def fold(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(spark, d).select("w", t.fold(F.col("w")).alias("folded"))


@query("X2_vocabulary", f"SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM documents) GROUP BY w")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(spark, d)


@query("X3_index_terms")
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct word of the Czech texts with the term that it is found by."""
    rows = table(spark, d, "documents").where(F.lower("lang") == "cs").select(F.explode(t.words(F.col("text"))).alias("w"))
    return analysis.index_terms(rows, "w")


@query("X4_stem_counts")
def stem_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each term stands in the texts: words are counted, then stemmed once each, then joined."""
    words = _vocabulary(spark, d)
    return words.join(analysis.index_terms(words, "w").withColumnRenamed("word", "w"), "w").groupBy("term").agg(F.sum("n").alias("n"))


@query("X9_weighted_positions", f"WITH w AS (SELECT doc_id, unnest({_WORDS}) AS term, generate_subscripts({_WORDS}, 1) AS pos, len(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[\\p{{L}}\\p{{Nd}}][\\p{{L}}\\p{{Nd}}\\p{{M}}]*')) AS head FROM documents WHERE text IS NOT NULL) SELECT doc_id, term, string_agg(pos || CASE WHEN pos <= head THEN 'A' ELSE 'D' END, ',' ORDER BY pos) AS positions FROM w WHERE term IN ('soud', 'smlouva', 'court') GROUP BY ALL")
def weighted_positions(spark: SparkSession, d: str) -> DataFrame:
    head = F.size(t.words(F.split_part("text", F.lit("\n"), F.lit(1))))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", head.alias("head"), F.posexplode(t.words(F.col("text"))).alias("p", "term")).where(F.col("term").isin("soud", "smlouva", "court"))
    at = F.struct((F.col("p") + 1).alias("p"), F.when(F.col("p") < F.col("head"), "A").otherwise("D").alias("w"))
    return rows.groupBy("doc_id", "term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda x: F.concat(x["p"].cast("string"), x["w"])), ",").alias("positions"))


@query("F5_words_in_texts", r"WITH v AS (SELECT doc_id, lower(text) AS v FROM documents WHERE text IS NOT NULL) SELECT doc_id, (contains(v, 'soud') AND contains(v, '100 %')) AS every_word FROM v WHERE contains(v, 'soud') OR contains(v, '100 %')")
def words_in_texts(spark: SparkSession, d: str) -> DataFrame:
    every, some = structure.holding(F.lower("text"), ["soud", "100 %", "a"])
    rows = table(spark, d, "documents").where("text is not null")
    return rows.where(some).select("doc_id", every.alias("every_word"))


@query("F7_top_courts", "SELECT DISTINCT id FROM decision WHERE source IN ('ns', 'nss', 'us') AND NOT (source = 'nss' AND coalesce(contains(lower(court), 'krajský'), FALSE))")
def top_courts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision").where(structure.top_only(None, ["ns", "nss", "us"])).select("id").distinct()


@query("F8_court_codes", "SELECT DISTINCT id FROM decision WHERE court_code IN ('OSDO', 'KSJE', 'OSVR')")
def court_codes(spark: SparkSession, d: str) -> DataFrame:
    from paragraf.sources.requests import Request

    return table(spark, d, "decision").where(Request(courts=("OSDO", "KSJE", "OSVR")).predicate()).select("id").distinct()


@query("F17_words_in_names", "WITH a AS (SELECT code, string_agg(DISTINCT lower(name), ' ') AS names FROM justice_court_name GROUP BY code) SELECT code FROM a WHERE contains(names, 'soud') AND contains(names, 'okresní')")
def words_in_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "justice_court_name").groupBy("code").agg(F.array_join(F.collect_set(F.lower("name")), " ").alias("names"))
    return names.where(F.forall(F.array(F.lit("soud"), F.lit("okresní")), lambda w: F.contains(F.col("names"), w))).select("code")


@query("F20_real_dates", "SELECT event_id, try_cast('2023-' || lpad(CAST(event_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(event_id % 33 AS VARCHAR), 2, '0') AS DATE) AS day FROM events")
def real_dates(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("2023-"), F.lpad((F.col("event_id") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("event_id") % 33).cast("string"), 2, "0"))
    return table(spark, d, "events").select("event_id", said.try_cast("date").alias("day"))


@query("F21_refined", f"WITH c AS (SELECT DISTINCT unnest(case_numbers) AS n, id, decision_type, decided_on FROM decision) SELECT n, count(*) FILTER (decision_type = 'rozsudek' AND decided_on >= DATE '2015-01-01') AS kept, count(*) FILTER (NOT coalesce(decision_type = 'rozsudek' AND decided_on >= DATE '2015-01-01', FALSE)) AS removed FROM c WHERE n IS NOT NULL GROUP BY n")
def refined(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision").select(F.explode("case_numbers").alias("n"), "id", "decision_type", "decided_on").where("n is not null").distinct()
    good = F.coalesce((F.col("decision_type") == "rozsudek") & (F.col("decided_on") >= F.lit("2015-01-01").cast("date")), F.lit(False))
    return rows.groupBy("n").agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("removed"))


@query("F25_well_formed", "SELECT * FROM (VALUES ('''a'' & ''b''', TRUE), ('''a'' &', FALSE), ('(''a'' | !''b'':*A)', TRUE), ('''a'' ''b''', FALSE), ('', FALSE), ('''a'' <-> ''b''', TRUE)) v(query, good)")
def well_formed(spark: SparkSession, d: str) -> DataFrame:
    asked = ["'a' & 'b'", "'a' &", "('a' | !'b':*A)", "'a' 'b'", "", "'a' <-> 'b'"]
    return spark.createDataFrame([(q, queries.well_formed(q)) for q in asked], "query string, good boolean")


@query("U9_variants", "SELECT * FROM (VALUES (CAST(0 AS INTEGER), 'Kupní smlouva'), (1, 'cena'), (2, 'dílo')) v(place, search)")
def search_variants(spark: SparkSession, d: str) -> DataFrame:
    told = queries.variants(["Kupní  smlouva", "kupní smlouva", "cena", " ", "dílo", "čtvrtá"])
    return spark.createDataFrame(list(enumerate(told)), "place int, search string")


@query("Q1_full_text_form", "SELECT 'náhrada \"kupní cena\" žalob? § 5' AS search, 'náhrada AND \"kupní cena\" AND (žalob OR žalob?) AND 5' AS form")
def full_text_form(spark: SparkSession, d: str) -> DataFrame:
    asked = 'náhrada "kupní cena" žalob? § 5'
    return spark.createDataFrame([(asked, queries.domino(asked))], "search string, form string")


@query("X8_query_tree", "SELECT '\"kupní smlouva\" 5 soudem' AS search, '(''kupn'' <-> ''smlouv'') & ''5'' & ''soud'':*' AS every, '(''kupn'' <-> ''smlouv'') | ''5'' | ''soud'':*' AS some")
def query_tree(spark: SparkSession, d: str) -> DataFrame:
    asked = '"kupní smlouva" 5 soudem'
    return spark.createDataFrame([(asked, *queries.tree(asked))], "search string, every string, some string")


SECTIONS = rf"""{BODY}, l AS (SELECT decision_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM body),
o AS (SELECT decision_id, n, length(line) AS size, rtrim(line, chr(13) || ' ') AS line, sum(length(line) + 1) OVER (PARTITION BY decision_id ORDER BY n) - length(line) - 1 AS pos FROM l),
k AS (SELECT *, CASE WHEN line = 'takto:' THEN 'vyrok' WHEN line = 'Odůvodnění:' THEN 'oduvodneni' WHEN line = 'Poučení:' THEN 'pouceni' END AS mark FROM o),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY decision_id ORDER BY n ROWS UNBOUNDED PRECEDING), 'zahlavi') AS kind FROM k),
section AS (SELECT decision_id, kind, CAST(min(pos) AS BIGINT) AS char_start, CAST(max(pos + size) AS BIGINT) AS char_end FROM s GROUP BY ALL)"""


@query("X27_sections", f"WITH {SECTIONS} SELECT decision_id, kind, char_start, char_end FROM section")
def sections(spark: SparkSession, d: str) -> DataFrame:
    return structure.sections(bodies(spark, d), "decision_id", "body")


@query("PR7_verdict", f"WITH {SECTIONS} SELECT decision_id, substr(body, char_start + 1, char_end - char_start) AS verdict FROM section JOIN body USING (decision_id) WHERE kind = 'vyrok'")
def verdict(spark: SparkSession, d: str) -> DataFrame:
    return structure.section_text(bodies(spark, d), "decision_id", "body", "vyrok").withColumnRenamed("section", "verdict")


@query("R8_words_in_verdict", f"WITH {SECTIONS}, v AS (SELECT decision_id, lower(substr(body, char_start + 1, char_end - char_start)) AS v FROM section JOIN body USING (decision_id) WHERE kind = 'vyrok'), h AS (SELECT decision_id, contains(v, 'zamítá') AND contains(v, 'povinen') AS every FROM v WHERE contains(v, 'zamítá') OR contains(v, 'povinen')) SELECT decision_id FROM h WHERE every OR NOT (SELECT bool_or(every) FROM h)")
def words_in_verdict(spark: SparkSession, d: str) -> DataFrame:
    verdicts = structure.section_text(bodies(spark, d), "decision_id", "body", "vyrok")
    every, some = structure.holding(F.lower("section"), ["zamítá", "povinen"])
    both = verdicts.where(every)
    return (both if not both.isEmpty() else verdicts.where(some)).select("decision_id")


@query("X29_roman_numbers", f"WITH {BODY}, l AS (SELECT decision_id, unnest(string_split(body, chr(10))) AS line FROM body), r AS (SELECT decision_id, regexp_extract(line, '^([IVX]+)\\. ', 1) AS r FROM l WHERE regexp_matches(line, '^[IVX]+\\. ')) SELECT decision_id, r AS roman, CAST(list_position(['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV'], r) AS INTEGER) AS number, count(*) AS lines FROM r GROUP BY ALL")
def roman_numbers(spark: SparkSession, d: str) -> DataFrame:
    lines = bodies(spark, d).select("decision_id", F.explode(F.split("body", "\n", -1)).alias("line")).where(F.col("line").rlike(r"^[IVX]+\. "))
    rows = lines.select("decision_id", F.regexp_extract("line", r"^([IVX]+)\. ", 1).alias("roman")).groupBy("decision_id", "roman").agg(F.count("*").alias("lines"))
    return rows.select("decision_id", "roman", structure.roman(F.col("roman")).alias("number"), "lines")


FILES = "f AS (SELECT key, max(text) AS text FROM files_eval WHERE text IS NOT NULL AND key IS NOT NULL GROUP BY key)"
LINES = f"{FILES}, l AS (SELECT key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM f)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files_eval").where("text is not null and key is not null").groupBy("key").agg(F.max("text").alias("text"))


@query("X28_line_kinds", rf"WITH {LINES} SELECT key, CAST(n AS INTEGER) AS n, CASE WHEN trim(line, ' ' || chr(9) || chr(13)) = '' THEN 'blank' WHEN regexp_matches(line, '^\[s\. [^\]]+\]') THEN 'page' WHEN regexp_matches(line, '^#{{1,6}} ') THEN 'heading' WHEN regexp_matches(line, '^\[m\. č\. [0-9]+\]') THEN 'margin' ELSE 'text' END AS kind, CASE WHEN regexp_matches(line, '^#{{1,6}} ') THEN CAST(length(regexp_extract(line, '^(#+)', 1)) AS INTEGER) END AS level, nullif(regexp_extract(line, '^\[(?:s|m\. č)\. ([^\]]+)\]', 1), '') AS label FROM l")
def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    return structure.line_kinds(_files(spark, d), "key", "text").select("key", "n", "kind", "level", "label")


@query("X13_page_of_line", rf"WITH {LINES}, k AS (SELECT key, n, CASE WHEN regexp_matches(line, '^\[s\. [^\]]+\]') THEN regexp_extract(line, '^\[s\. ([^\]]+)\]', 1) END AS page, CASE WHEN regexp_matches(line, '^\[m\. č\. [0-9]+\]') THEN regexp_extract(line, '^\[m\. č\. ([0-9]+)\]', 1) WHEN regexp_matches(line, '^#{{1,6}} ') THEN '-' END AS margin FROM l), w AS (SELECT key, n, last_value(page IGNORE NULLS) OVER u AS page, last_value(margin IGNORE NULLS) OVER u AS margin FROM k WINDOW u AS (PARTITION BY key ORDER BY n ROWS UNBOUNDED PRECEDING)) SELECT key, CAST(n AS INTEGER) AS n, page, nullif(margin, '-') AS margin FROM w")
def page_of_line(spark: SparkSession, d: str) -> DataFrame:
    return structure.placed(_files(spark, d), "key", "text").select("key", "n", "page", "margin")


@query("PR14_pinpoints", rf"WITH {LINES}, k AS (SELECT key, n, CASE WHEN regexp_matches(line, '^\[s\. [^\]]+\]') THEN regexp_extract(line, '^\[s\. ([^\]]+)\]', 1) END AS page, CASE WHEN regexp_matches(line, '^\[m\. č\. [0-9]+\]') THEN regexp_extract(line, '^\[m\. č\. ([0-9]+)\]', 1) WHEN regexp_matches(line, '^#{{1,6}} ') THEN '-' END AS margin FROM l), w AS (SELECT key, n, last_value(page IGNORE NULLS) OVER u AS page, last_value(margin IGNORE NULLS) OVER u AS margin FROM k WINDOW u AS (PARTITION BY key ORDER BY n ROWS UNBOUNDED PRECEDING)) SELECT key, CAST(n AS INTEGER) AS n, concat_ws(', ', 's. ' || page, 'm. č. ' || nullif(margin, '-')) AS pinpoint FROM w WHERE page IS NOT NULL")
def pinpoints(spark: SparkSession, d: str) -> DataFrame:
    """Where a line stands, as it is cited: its page and its margin number."""
    rows = structure.placed(_files(spark, d), "key", "text").where("page is not null")
    return rows.select("key", "n", F.concat_ws(", ", F.concat(F.lit("s. "), "page"), F.concat(F.lit("m. č. "), "margin")).alias("pinpoint"))


@query("G9_headings_by_words", rf"WITH {LINES}, h AS (SELECT key, n, regexp_replace(line, '^#+ ', '') AS heading FROM l WHERE regexp_matches(line, '^#{{1,6}} ')), m AS (SELECT * FROM h WHERE contains(strip_accents(lower(heading)), 'stav')) SELECT key, heading, count(*) AS found FROM m GROUP BY ALL")
def headings_by_words(spark: SparkSession, d: str) -> DataFrame:
    rows = structure.line_kinds(_files(spark, d), "key", "text").where("kind = 'heading'").select("key", F.regexp_replace("line", "^#+ ", "").alias("heading"))
    return rows.where(t.fold(F.col("heading")).contains("stav")).groupBy("key", "heading").agg(F.count("*").alias("found"))


@query("X30_stripped", rf"WITH {FILES} SELECT key, regexp_replace(regexp_replace(text, '(?m)^(?:#{{1,6}} |\[s\. [^\]\n]*\] ?|\[m\. č\. [0-9]+\] ?)', '', 'g'), '\*\*|__', '', 'g') AS text FROM f")
def stripped(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("key", structure.stripped(F.col("text")).alias("text"))


@query("X31_sanitised", r"SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\x{0}-\x{8}\x{B}-\x{1F}\x{7F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{AD}]', '', 'g'), '[ \t]+\n', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL")
def sanitised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", structure.sanitised(F.col("text")).alias("text"))


@query("X38_numbered_paragraph", rf"WITH {BODY} SELECT decision_id, regexp_extract(chr(10) || body || chr(10), '(?s)\n1\. (.*?)\n2\. ', 1) AS paragraph FROM body WHERE regexp_matches(chr(10) || body || chr(10), '(?s)\n1\. .*?\n2\. ')")
def numbered_paragraph(spark: SparkSession, d: str) -> DataFrame:
    whole = F.concat(F.lit("\n"), "body", F.lit("\n"))
    rows = bodies(spark, d).where(whole.rlike("(?s)\\n1\\. .*?\\n2\\. "))
    return rows.select("decision_id", F.regexp_extract(whole, "(?s)\\n1\\. (.*?)\\n2\\. ", 1).alias("paragraph"))


@query("PR4_type_vocabulary", "SELECT DISTINCT metadata.type AS said, CASE WHEN starts_with(strip_accents(lower(metadata.type)), 'rozsud') THEN 'rozsudek' WHEN starts_with(strip_accents(lower(metadata.type)), 'usnes') THEN 'usneseni' WHEN starts_with(strip_accents(lower(metadata.type)), 'nalez') THEN 'nalez' WHEN starts_with(strip_accents(lower(metadata.type)), 'stanov') THEN 'stanovisko' WHEN metadata.type IS NOT NULL THEN 'jine' END AS kind FROM justice_finaldoc")
def type_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "justice_finaldoc").select(F.col("metadata.type").alias("said")).distinct().select("said", structure.decision_kind(F.col("said")).alias("kind"))


@query("PR6_mapped_records", "SELECT uuid AS source_id, min(metadata.ecli) AS ecli, min(metadata.decisionAt) AS decided_on, min(metadata.caseNumber.senate || ' ' || metadata.caseNumber.registry || ' ' || metadata.caseNumber.index || '/' || metadata.caseNumber.year) AS case_number FROM justice_finaldoc GROUP BY uuid")
def mapped_records(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("metadata.caseNumber")
    number = F.when(c["senate"].isNotNull() & c["registry"].isNotNull() & c["index"].isNotNull() & c["year"].isNotNull(), F.concat(c["senate"].cast("string"), F.lit(" "), c["registry"], F.lit(" "), c["index"].cast("string"), F.lit("/"), c["year"].cast("string")))
    rows = table(spark, d, "justice_finaldoc").select(F.col("uuid").alias("source_id"), F.col("metadata.ecli").alias("ecli"), F.col("metadata.decisionAt").alias("decided_on"), number.alias("case_number"))
    return rows.groupBy("source_id").agg(F.min("ecli").alias("ecli"), F.min("decided_on").alias("decided_on"), F.min("case_number").alias("case_number"))


@query("G7_label_offsets", f"WITH {BODY}, num AS (SELECT decision_id, line_no, CAST(regexp_extract(line, '^(\\d{{1,4}})\\. ', 1) AS INTEGER) AS number FROM (SELECT decision_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no FROM body) WHERE regexp_matches(line, '^\\d{{1,4}}\\. ')), o AS (SELECT decision_id, number - row_number() OVER (PARTITION BY decision_id ORDER BY line_no) AS shift FROM num), g AS (SELECT decision_id, shift, count(*) AS n FROM o GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY decision_id) AS total FROM g) SELECT DISTINCT ON (decision_id) decision_id, shift, n * 10 >= total * 7 AS constant FROM c ORDER BY decision_id, n DESC, shift")
def label_offsets(spark: SparkSession, d: str) -> DataFrame:
    """One constant offset between printed numbers and places, if it explains seven tenths of them."""
    lines = bodies(spark, d).select("decision_id", F.posexplode(F.split("body", "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike(r"^\d{1,4}\. "))
    place = F.row_number().over(Window.partitionBy("decision_id").orderBy("line_no"))
    shifts = lines.select("decision_id", (F.regexp_extract("line", r"^(\d{1,4})\. ", 1).cast("int") - place).cast("long").alias("shift"))
    return structure.constant(shifts, "decision_id", "shift", 0.7)
