"""Queries of planning, citing, slicing and reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.functions import analysis, identifiers as ids, queries, text as t
from paragraf.operators import search, structure, terms
from paragraf.operators.provisions import SHORT
from paragraf.plans.catalogue import query, table
from paragraf.plans.language import FILES, LINES, _files, _vocabulary
from paragraf.plans.references import _re
from paragraf.plans.retrieval import BODY, bodies
from paragraf.plans.search import _bm25_sql, opened
from paragraf.plans.upkeep import CURRENT, _current

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}][\p{L}\p{Nd}\p{M}]*')"


@query(
    "A5_status_report",
    f"""WITH {CURRENT}, t AS (SELECT decision_id, max(char_count) AS chars FROM decision_text GROUP BY 1), c AS (SELECT decision_id, count(DISTINCT ord) AS chunks FROM decision_chunk GROUP BY 1), k AS (SELECT citing_id, count(DISTINCT key) AS cites FROM decision_citation GROUP BY 1)
SELECT source, count(*) AS decisions, count(t.decision_id) AS texts, count(*) FILTER (chars < 500) AS short_texts, count(*) FILTER (gone_at IS NOT NULL) AS gone, count(DISTINCT lower(trim(court))) AS courts, min(decided_on) AS oldest, max(decided_on) AS newest, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(cites), 0) AS BIGINT) AS citations, count(*) FILTER (decided_on IS NULL) AS undated, CAST(min(parser_version) AS INTEGER) AS oldest_version
FROM cur LEFT JOIN t ON t.decision_id = cur.id LEFT JOIN c ON c.decision_id = cur.id LEFT JOIN k ON k.citing_id = cur.id GROUP BY source""",
)
def status_report(spark: SparkSession, d: str) -> DataFrame:
    """Eleven measures of each source; each fact is counted by decision first, so every table is read once."""
    texts = table(spark, d, "decision_text").groupBy(F.col("decision_id").alias("id")).agg(F.max("char_count").alias("chars"), F.lit(1).alias("held"))
    chunks = table(spark, d, "decision_chunk").groupBy(F.col("decision_id").alias("id")).agg(F.count_distinct("ord").alias("chunks"))
    cites = table(spark, d, "decision_citation").groupBy(F.col("citing_id").alias("id")).agg(F.count_distinct("key").alias("cites"))
    rows = _current(spark, d).join(texts, "id", "left").join(chunks, "id", "left").join(cites, "id", "left")
    return rows.groupBy("source").agg(
        F.count("*").alias("decisions"), F.count("held").alias("texts"), F.count_if(F.col("chars") < 500).alias("short_texts"), F.count_if(F.col("gone_at").isNotNull()).alias("gone"),
        F.count_distinct(F.lower(F.trim("court"))).alias("courts"), F.min("decided_on").alias("oldest"), F.max("decided_on").alias("newest"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("cites"), F.lit(0)).alias("citations"), F.count_if(F.col("decided_on").isNull()).alias("undated"), F.min("parser_version").alias("oldest_version"),
    )


@query(
    "A15_recall",
    f"WITH {_bm25_sql(['smlouva'], extra=', doc_kind')}, r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM hit QUALIFY rank <= 100), g AS (SELECT doc_id FROM documents WHERE doc_kind = 'rozsudek' AND contains(lower(text), 'smlouva')), j AS (SELECT rank FROM g LEFT JOIN r USING (doc_id)) SELECT round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_10, round(count(*) FILTER (rank <= 50) / count(*), 6) AS recall_50, round(coalesce(avg(CASE WHEN rank IS NOT NULL THEN 1.0 / rank ELSE 0 END), 0), 6) AS reciprocal FROM j",
)
def recall(spark: SparkSession, d: str) -> DataFrame:
    from paragraf.operators import postings

    by = [F.desc("score"), F.asc("doc_id")]
    hits = search.ranked(search.top(postings.bm25(opened(spark, d), ["smlouva"]), by, 100), by).select("doc_id", "rank")
    good = table(spark, d, "documents").where((F.col("doc_kind") == "rozsudek") & F.lower("text").contains("smlouva")).select("doc_id")
    return search.recall(good.join(F.broadcast(hits), "doc_id", "left"), "rank", [10, 50])


@query("R29_weight_filter", f"WITH w AS (SELECT doc_id, unnest({_WORDS}) AS term, generate_subscripts({_WORDS}, 1) AS pos, len(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[\\p{{L}}\\p{{Nd}}][\\p{{L}}\\p{{Nd}}\\p{{M}}]*')) AS head FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) FILTER (pos <= head) AS in_head, count(*) FILTER (pos > head) AS behind FROM w WHERE term = 'soud' GROUP BY doc_id HAVING count(*) FILTER (pos > head) > 0")
def weight_filter(spark: SparkSession, d: str) -> DataFrame:
    """Hits outside the first line only: a search that leaves one weight out."""
    head = F.size(t.words(F.split_part("text", F.lit("\n"), F.lit(1))))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", head.alias("head"), F.posexplode(t.words(F.col("text"))).alias("p", "term")).where("term = 'soud'")
    return rows.groupBy("doc_id").agg(F.count_if(F.col("p") < F.col("head")).alias("in_head"), F.count_if(F.col("p") >= F.col("head")).alias("behind")).where("behind > 0")


@query("R27_name_suggest", "WITH n AS (SELECT name, min(code) AS code FROM justice_court_name GROUP BY name), c AS (SELECT court_code, count(DISTINCT id) AS decisions FROM decision GROUP BY 1) SELECT name, code, coalesce(decisions, 0) AS decisions, CASE WHEN starts_with(strip_accents(lower(name)), 'okres') THEN 0 ELSE 1 END AS tier FROM n LEFT JOIN c ON court_code = code WHERE contains(strip_accents(lower(name)), 'o') ORDER BY tier, decisions DESC, length(name), name LIMIT 12")
def name_suggest(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "justice_court_name").groupBy("name").agg(F.min("code").alias("code"))
    cited = table(spark, d, "decision").groupBy(F.col("court_code").alias("code")).agg(F.count_distinct("id").alias("decisions"))
    plain = t.fold(F.col("name"))
    rows = names.where(plain.contains("o")).join(cited, "code", "left").select("name", "code", F.coalesce("decisions", F.lit(0)).alias("decisions"), F.when(F.startswith(plain, F.lit("okres")), 0).otherwise(1).alias("tier"))
    return search.top(rows, [F.asc("tier"), F.desc("decisions"), F.length("name"), F.asc("name")], 12)


@query("X6_query_terms", "SELECT * FROM (VALUES ('soudců', 'soudc soudk'), ('smlouvami', 'smlouv smluv'), ('odpovědnost', 'odpovednost'), ('2913a', '2913a')) v(word, terms)")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(w, " ".join(analysis.query_terms(w))) for w in ("soudců", "smlouvami", "odpovědnost", "2913a")], "word string, terms string")


@query("X5_light_stems", "SELECT * FROM (VALUES ('rozsudek', 'rozsudk'), ('smlouvami', 'smlouv'), ('zalobach', 'zalob'), ('pocet', 'poct')) v(word, stem)")
def light_stems(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(w, analysis.light_stem(w)) for w in ("rozsudek", "smlouvami", "zalobach", "pocet")], "word string, stem string")


@query("X7_telling_words", f"SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM documents) WHERE w NOT IN ({', '.join(repr(w) for w in sorted(terms.STOP))}) GROUP BY w HAVING count(*) >= 20")
def telling_words(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(spark, d).where(~F.col("w").isin(*sorted(terms.STOP)) & (F.col("n") >= 20))


@query("X34_excerpt_terms", "SELECT * FROM (VALUES (CAST(0 AS INTEGER), 'náhrada škody'), (1, 'náhrada škody auto'), (2, 'náhrada'), (3, 'škody'), (4, 'auto')) v(place, term)")
def excerpt_terms(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(queries.excerpt_terms("„náhrada škody“ AND auto"))), "place int, term string")


@query("X11_first_chunk_keys", f"WITH own AS (SELECT id, list_sort(list_distinct(list_transform(flatten(list(case_numbers)), lambda n: 'sz:' || lower(n)))) AS own FROM decision WHERE case_numbers IS NOT NULL GROUP BY id), c AS (SELECT DISTINCT decision_id, ord, ident_keys FROM decision_chunk WHERE ident_keys IS NOT NULL) SELECT decision_id, ord, array_to_string(list_sort(list_distinct(list_concat(ident_keys, CASE WHEN ord = 0 THEN coalesce(own, []) ELSE [] END))), ' ') AS keys FROM c LEFT JOIN own ON id = decision_id")
def first_chunk_keys(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk carries the decision's own keys beside those in its text."""
    own = table(spark, d, "decision").select(F.col("id").alias("decision_id"), F.explode("case_numbers").alias("n")).where("n is not null").groupBy("decision_id").agg(F.collect_set(F.concat(F.lit("sz:"), F.lower("n"))).alias("own"))
    chunks = table(spark, d, "decision_chunk").where("ident_keys is not null").select("decision_id", "ord", "ident_keys").distinct().join(own, "decision_id", "left")
    keys = F.array_union("ident_keys", F.when(F.col("ord") == 0, F.coalesce("own", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    return chunks.select("decision_id", "ord", F.array_join(F.array_sort(keys), " ").alias("keys"))


@query("X14_meta_keys", "WITH k AS (SELECT id, 'sz:' || lower(unnest(case_numbers)) AS key FROM decision UNION SELECT id, lower(ecli) FROM decision WHERE ecli LIKE 'ECLI:%') SELECT id, string_agg(key, ' ' ORDER BY key) AS keys FROM (SELECT DISTINCT * FROM k WHERE key IS NOT NULL) GROUP BY id")
def meta_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision")
    keys = rows.select("id", F.explode("case_numbers").alias("n")).select("id", F.concat(F.lit("sz:"), F.lower("n")).alias("key")).unionByName(rows.where(F.col("ecli").startswith("ECLI:")).select("id", F.lower("ecli").alias("key"))).where("key is not null")
    return keys.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("key")), " ").alias("keys"))


@query("X18_eu_acts", "WITH e AS (SELECT event_id, 10 + user_id % 89 AS y, 1 + event_id % 900 AS n FROM events) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'eu:319' || y || 'L' || lpad(CAST(n AS VARCHAR), 4, '0') ELSE 'eu:32016R' || lpad(CAST(n AS VARCHAR), 4, '0') END AS ident FROM e")
def eu_acts(spark: SparkSession, d: str) -> DataFrame:
    """Directives by year and number, regulations by number and year, as they are written in texts."""
    y, n = (F.lit(10) + F.col("user_id") % 89).cast("string"), (F.lit(1) + F.col("event_id") % 900).cast("string")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("podle směrnice Rady "), y, F.lit("/"), n, F.lit("/EHS."))).otherwise(F.concat(F.lit("nařízení Komise (EU) č. "), n, F.lit("/2016 a dále")))
    rows = table(spark, d, "events").select("event_id", text.alias("text"))
    return ids.keys(rows, "event_id", "text").where("kind = 'eu'").select("event_id", "ident")


@query("X19_without_identifiers", rf"WITH {BODY} SELECT decision_id, regexp_replace(regexp_replace(body, '{_re(ids.ECLI)}', ' ', 'g'), '{_re(ids.ACT)}', ' ', 'g') AS text FROM body")
def without_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return bodies(spark, d).select("decision_id", F.regexp_replace(F.regexp_replace("body", ids.ECLI, " "), ids.ACT, " ").alias("text"))


_SHORT = "|".join(k.replace(".", "[.]").replace(" ", "[ \\x{A0}]") for k in SHORT)


@query("X20_abbreviated_acts", f"WITH {BODY}, m AS (SELECT decision_id, replace(unnest(regexp_extract_all(body, '({_SHORT})', 1)), chr(160), ' ') AS name FROM body) SELECT decision_id, name, (MAP {{{', '.join(f"'{k}': '{v}'" for k, v in SHORT.items())}}})[name] AS act, count(*) AS mentions FROM m GROUP BY ALL")
def abbreviated_acts(spark: SparkSession, d: str) -> DataFrame:
    pattern = "(" + _SHORT.replace("\\x{A0}", "\\u00a0") + ")"
    rows = bodies(spark, d).select("decision_id", F.explode(F.regexp_extract_all("body", F.lit(pattern), 1)).alias("name")).withColumn("name", F.replace("name", F.lit(" "), F.lit(" ")))
    act = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])[F.col("name")]
    return rows.groupBy("decision_id", "name", act.alias("act")).agg(F.count("*").alias("mentions"))


@query("X36_joined_words", rf"WITH {LINES}, w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '\p{{L}}+'))) AS w FROM f), b AS (SELECT key, n, lower(regexp_extract(rtrim(line), '(\p{{L}}+)[-¬]$', 1)) AS a, lower(regexp_extract(lead(line) OVER (PARTITION BY key ORDER BY n), '^\s*(\p{{Ll}}+)', 1)) AS c FROM l) SELECT key, CAST(n AS INTEGER) AS n, a || c AS joined, (a || c) IN (SELECT w FROM w) AS known FROM b WHERE a <> '' AND c <> ''")
def joined_words(spark: SparkSession, d: str) -> DataFrame:
    """Words broken over two lines, joined, and whether the texts know the whole word."""
    files = _files(spark, d)
    return structure.broken_words(files, files.select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("w")).select(F.lower("w").alias("joined")).distinct(), "key", "text")


@query("PR13_citation_lines", "SELECT DISTINCT key, concat_ws('. ', nullif(upper(coalesce(array_to_string(meta.authors, ', '), '')), ''), nullif(trim(meta.title), ''), CAST(meta.year AS VARCHAR)) AS line FROM files_eval WHERE key IS NOT NULL AND meta IS NOT NULL")
def citation_lines(spark: SparkSession, d: str) -> DataFrame:
    authors, title = F.upper(F.coalesce(F.array_join("meta.authors", ", "), F.lit(""))), F.trim("meta.title")
    line = F.concat_ws(". ", F.when(authors != "", authors), F.when(title != "", title), F.col("meta.year").cast("string"))
    return table(spark, d, "files_eval").where("key is not null and meta is not null").select("key", line.alias("line")).distinct()


@query("PR16_procedure_forms", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'exact' WHEN event_id % 3 = 1 THEN 'prefix' END AS form FROM events")
def procedure_forms(spark: SparkSession, d: str) -> DataFrame:
    n = F.lpad((F.col("event_id") % 1000).cast("string"), 4, "0")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("2016/"), n, F.lit("(COD)"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("2016/"), n)).otherwise(F.concat(F.lit("COM "), n))
    return table(spark, d, "events").select("event_id", ids.procedure_form(said).alias("form"))


@query("PR20_motifs", "SELECT event_id, '*A' || (1 + user_id % 300) || CASE WHEN event_id % 2 = 0 THEN 'P' || (1 + event_id % 9) ELSE '' END || '*' AS motif FROM events")
def motifs(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("čl. "), (F.lit(1) + F.col("user_id") % 300).cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" odst. "), (F.lit(1) + F.col("event_id") % 9).cast("string"))).otherwise(""))
    return table(spark, d, "events").select("event_id", ids.celex_motif(said).alias("motif"))


@query("SC18_escaped_lines", rf"WITH {FILES} SELECT key, regexp_replace(text, '(?m)^(#|\[s\. |\[m\. č\. |\[\^)', '\\\1', 'g') AS text FROM f")
def escaped_lines(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("key", structure.escaped(F.col("text")).alias("text"))


@query("SC19_page_slice", rf"WITH {LINES}, k AS (SELECT key, n, line, CASE WHEN regexp_matches(line, '^\[s\. [^\]]+\]') THEN regexp_extract(line, '^\[s\. ([^\]]+)\]', 1) END AS page FROM l), w AS (SELECT key, n, line, last_value(page IGNORE NULLS) OVER (PARTITION BY key ORDER BY n ROWS UNBOUNDED PRECEDING) AS page FROM k) SELECT key, string_agg(line, chr(10) ORDER BY n) AS slice FROM w WHERE try_cast(page AS INTEGER) BETWEEN 100 AND 300 GROUP BY key")
def page_slice(spark: SparkSession, d: str) -> DataFrame:
    return structure.sliced(_files(spark, d), "key", "text", 100, 300)


@query("U8_record_keys", "SELECT DISTINCT id, CASE WHEN trim(ecli) <> '' THEN 'doi:' || lower(trim(ecli)) WHEN case_number IS NOT NULL THEN 't:' || regexp_replace(lower(concat_ws('|', trim(case_number), CAST(year(decided_on) AS VARCHAR), trim(court))), '\\s+', ' ', 'g') END AS record_key FROM decision")
def record_keys(spark: SparkSession, d: str) -> DataFrame:
    from paragraf.sources.answers import record_key

    key = record_key(F.coalesce("ecli", F.lit("")), F.col("case_number"), F.year("decided_on"), F.col("court"))
    rows = table(spark, d, "decision")
    return rows.select("id", F.when((F.trim("ecli") != "") | F.col("case_number").isNotNull(), key).alias("record_key")).distinct()


@query("F22_blank_shares", f"WITH {LINES} SELECT key, round(count(*) FILTER (trim(line, ' ' || chr(9) || chr(13)) = '') / count(*), 6) AS share, bool_or(regexp_matches(lower(line), '(ignore (all )?previous instructions|system prompt)')) AS flagged FROM l GROUP BY key")
def blank_shares(spark: SparkSession, d: str) -> DataFrame:
    lines = _files(spark, d).select("key", F.explode(F.split("text", "\n", -1)).alias("line"))
    flagged = F.lower("line").rlike("(ignore (all )?previous instructions|system prompt)")
    return lines.groupBy("key").agg(F.round(F.count_if(F.trim("line", F.lit(" \t\r")) == "") / F.count("*"), 6).alias("share"), F.bool_or(flagged).alias("flagged"))


@query("G22_canary", "SELECT event_id, CASE WHEN value IS NULL OR event_type = 'view' THEN NULL ELSE event_type <> 'error' AND regexp_matches(props, '\"k\": [0-9]+') END AS healthy FROM events")
def canary(spark: SparkSession, d: str) -> DataFrame:
    """True if the answer was good and holds its marker, null if the request itself failed."""
    good = (F.col("event_type") != "error") & F.col("props").rlike('"k": [0-9]+')
    return table(spark, d, "events").select("event_id", F.when(F.col("value").isNotNull() & (F.col("event_type") != "view"), good).alias("healthy"))


@query("R15_plans", "SELECT * FROM (VALUES ('kupní smlouva', 'words'), ('§ 5', 'keys'), ('náhrada škody § 5', 'both'), ('', 'nothing')) v(search, plan)")
def plans(spark: SparkSession, d: str) -> DataFrame:
    asked = [("kupní smlouva", ["x"][:0]), ("§ 5", ["par:5"]), ("náhrada škody § 5", ["par:5"]), ("", [])]
    return spark.createDataFrame([(s, queries.planned(s, k)) for s, k in asked], "search string, plan string")


@query("Q5_sparql_search", """SELECT 'SELECT ?work (SAMPLE(?t) AS ?title) WHERE { ?work cdm:work_title ?t . ?t bif:contains ''"ochrana*" AND "dat"'' } GROUP BY ?work LIMIT 21' AS form""")
def sparql_search(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(queries.sparql(["Ochrana", "dat", "dat"], 20),)], "form string")


@query("Q10_catalogue_search", "SELECT 'title,contains,kupní\\,smlouva;AND;dr_s,exact,20010101;dr_e,exact,99991231' AS form")
def catalogue_search(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(queries.catalogue("kupní,smlouva", None, 2001, None),)], "form string")


@query("Q12_item_filter", "SELECT 'book || thesis' AS types, 'a & \\-b & c || d & -e' AS tags")
def item_filter(spark: SparkSession, d: str) -> DataFrame:
    got = queries.item_filter(["book", "thesis"], [], ["a", "-b"], ["c", "d"], ["e"])
    return spark.createDataFrame([(" & ".join(got["itemType"]), " & ".join(got["tag"]))], "types string, tags string")


@query("X35_language", """WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{L}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, text, """ + ", ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in own)}], x))) AS {lang}" for lang, own in structure.STOPS.items()) + f""" FROM w), g AS (SELECT *, greatest({', '.join(structure.STOPS)}) AS top FROM s)
SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{{3040}}-\\x{{30FF}}]') THEN 'ja' WHEN regexp_matches(text, '[\\x{{4E00}}-\\x{{9FFF}}]') THEN 'zh' WHEN regexp_matches(text, '[\\x{{E01}}-\\x{{E5B}}]') THEN 'th' WHEN regexp_matches(text, '[\\x{{900}}-\\x{{97F}}]') THEN 'hi' WHEN regexp_matches(text, '[\\x{{600}}-\\x{{6FF}}]') THEN 'ar' WHEN top = 0 THEN NULL """ + " ".join(f"WHEN {lang} = top THEN '{lang}'" for lang in structure.STOPS) + """ END AS guess FROM g""")
def language(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.explode(F.array(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))).alias("w"))
    return rows.select("doc_id", structure.language(F.col("text"), F.col("w")).alias("guess"))


PROPOSED = rf"""f AS (SELECT key, max(text) AS text, max_by(meta.title, text) AS title, max_by(meta.year, text) AS year FROM (SELECT DISTINCT key, text, meta FROM files_eval WHERE text IS NOT NULL AND key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY text DESC, meta IS NULL) = 1) GROUP BY key),
v AS (SELECT *, substr(text, 1, 9000) AS front, substr(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}} ')), chr(10)), 1, 3000) AS outline FROM f),
p AS (SELECT key, 'title' AS field, trim(title) AS value, 'record' AS source, 0.95 AS confidence FROM v UNION ALL SELECT key, 'title', trim(regexp_extract(outline, '^#{{1,6}} ([^\n]+)', 1)), 'heading', 0.6 FROM v UNION ALL SELECT key, 'year', CAST(year AS VARCHAR), 'record', 0.95 FROM v UNION ALL SELECT key, 'year', regexp_extract(front, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)', 1), 'front', 0.3 FROM v),
proposed AS (SELECT * FROM p WHERE value <> '')"""


def _described(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "files_eval").where("text is not null and key is not null")
    return rows.groupBy("key").agg(F.max_by(F.struct("text", F.col("meta.title").alias("title"), F.col("meta.year").alias("year")), F.struct("text", F.col("meta").isNotNull())).alias("r")).select("key", "r.*")


@query("PR19_input_view", f"WITH {PROPOSED} SELECT key, front, outline FROM v")
def input_view(spark: SparkSession, d: str) -> DataFrame:
    return structure.input_view(_described(spark, d), "key", "text")


@query("PR17_proposals", f"WITH {PROPOSED} SELECT key, field, value, source, CAST(confidence AS DOUBLE) AS confidence FROM proposed")
def proposals(spark: SparkSession, d: str) -> DataFrame:
    return structure.proposals(_described(spark, d), "key", "text", "title", "year")


@query("PR18_accepted_record", f"WITH {PROPOSED}, g AS (SELECT * FROM proposed WHERE field <> 'year' OR try_cast(value AS INTEGER) BETWEEN 1400 AND 2100), b AS (SELECT key, field, arg_max(value, (confidence, value)) AS v FROM g GROUP BY ALL) SELECT key, substr(max(v) FILTER (field = 'title'), 1, 300) AS title, CAST(max(v) FILTER (field = 'year') AS INTEGER) AS year FROM b GROUP BY key")
def accepted_record(spark: SparkSession, d: str) -> DataFrame:
    return structure.accepted_record(structure.proposals(_described(spark, d), "key", "text", "title", "year"), "key")


@query("R22_page_or_excerpt", f"WITH {BODY} SELECT decision_id, CASE WHEN contains(strip_accents(lower(body)), 'vydrzeni') THEN 'excerpt' ELSE 'page' END AS mode, CASE WHEN contains(strip_accents(lower(body)), 'vydrzeni') THEN NULL ELSE substr(body, 1, 45000) END AS page FROM body")
def page_or_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """A text is shown around a word where it stands there, else from its first page."""
    held = t.fold(F.col("body")).contains("vydrzeni")
    return bodies(spark, d).select("decision_id", F.when(held, "excerpt").otherwise("page").alias("mode"), F.when(~held, F.substring("body", 1, 45_000)).alias("page"))


@query(
    "R10_lanes_merged",
    f"WITH {_bm25_sql(['soud'], 'source IS NOT NULL', ', source')}, l AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM hit QUALIFY rank <= 2) SELECT source, doc_id, CAST(row_number() OVER (ORDER BY rank, source) AS INTEGER) AS position FROM l",
)
def lanes_merged(spark: SparkSession, d: str) -> DataFrame:
    """Two hits of each source, the first ones of all before the second ones: one plan, no lane waits for another."""
    from paragraf.operators import postings

    hits = postings.bm25(opened(spark, d), ["soud"], ["source"], where=F.col("source").isNotNull())
    lanes = search.ranked(search.per_group(hits, ["source"], [F.desc("score"), F.asc("doc_id")], 2), [F.desc("score"), F.asc("doc_id")], ["source"])
    return search.interleave(lanes, "source", "rank", "doc_id").select(F.col("variant").alias("source"), "doc_id", "position")


@query("G13_parents_of_hits", "WITH h AS (SELECT DISTINCT decision_id, ord FROM decision_chunk WHERE list_has_any(ident_keys, ['par:160', 'par:1741', 'par:2246', 'par:2828'])), c AS (SELECT id, max(case_number) AS case_number FROM decision GROUP BY id) SELECT decision_id, case_number, count(*) AS hits, min(ord) AS first_hit FROM h LEFT JOIN c ON id = decision_id GROUP BY ALL")
def parents_of_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of passages grouped under the decision that holds them."""
    keys = F.array(*[F.lit(k) for k in ("par:160", "par:1741", "par:2246", "par:2828")])
    hits = table(spark, d, "decision_chunk").where(F.arrays_overlap("ident_keys", keys)).select("decision_id", "ord").distinct().groupBy("decision_id").agg(F.count("*").alias("hits"), F.min("ord").alias("first_hit"))
    names = table(spark, d, "decision").groupBy(F.col("id").alias("decision_id")).agg(F.max("case_number").alias("case_number"))
    return hits.join(names, "decision_id", "left").select("decision_id", "case_number", "hits", "first_hit")


@query("X22_definitions", "SELECT DISTINCT p_partkey, p_brand AS name, 'zak:' || p_size || '/2001' AS act FROM part")
def definitions(spark: SparkSession, d: str) -> DataFrame:
    """Short names that texts give to acts, in texts made of the parts."""
    from paragraf.operators import provisions

    text = F.concat(F.lit("podle zákona č. "), "p_size", F.lit("/2001 Sb., o věci "), F.lit("(dále jen „"), "p_brand", F.lit("“), a dále"))
    return provisions.definitions(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")
