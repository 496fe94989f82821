"""Queries of passages: channels, covers, windows, pages and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paragraf.operators import chunks, excerpts as shown, joins, postings, search, spans
from paragraf.plans.catalogue import query, table
from paragraf.plans.search import TERMS, WORDS_SQL, _bm25_sql, _documents, opened

BODY = "body AS (SELECT decision_id, any_value(body) AS body FROM decision_text WHERE body IS NOT NULL GROUP BY 1)"
CHUNK = f"{BODY}, chunk AS (SELECT DISTINCT decision_id, ord, char_start, char_end FROM decision_chunk WHERE char_end > char_start), piece AS (SELECT c.*, substr(body, char_start + 1, char_end - char_start) AS piece FROM chunk c JOIN body USING (decision_id))"
PIECE_WORDS = r"regexp_extract_all(lower(piece), '[\p{L}\p{Nd}][\p{L}\p{Nd}\p{M}]*')"


def bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision_text").where("body is not null").select("decision_id", "body").dropDuplicates(["decision_id"])


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision_chunk").where("char_end > char_start").select("decision_id", "ord", "char_start", "char_end").distinct()


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("char_start") + 1
    return _chunks(spark, d).join(bodies(spark, d), "decision_id").select("decision_id", "ord", "char_start", "char_end", F.substring("body", at, F.col("char_end") - F.col("char_start")).alias("piece"))


@query("R2_within", f"WITH {_bm25_sql(['soud'])}, top AS (SELECT doc_id FROM hit ORDER BY score DESC, doc_id LIMIT 1000) SELECT doc_id FROM documents WHERE contains(text, 'smlouv') AND doc_id IN (SELECT doc_id FROM top)")
def within(spark: SparkSession, d: str) -> DataFrame:
    candidates = search.top(postings.bm25(opened(spark, d), ["soud"]), [F.desc("score"), F.asc("doc_id")], 1000)
    # a thousand keys go to the texts
    return _documents(spark, d).where(F.col("text").contains("smlouv")).join(F.broadcast(candidates.select("doc_id")), "doc_id", "left_semi").select("doc_id")


COVER_SQL = f"""{CHUNK}, w AS (SELECT decision_id, ord, unnest({PIECE_WORDS}) AS term, generate_subscripts({PIECE_WORDS}, 1) - 1 AS pos FROM piece),
p AS (SELECT *, max(CASE WHEN term = 'soud' THEN pos END) OVER u AS a, max(CASE WHEN term = 'účastníci' THEN pos END) OVER u AS b FROM w WHERE term IN ('soud', 'účastníci') WINDOW u AS (PARTITION BY decision_id, ord ORDER BY pos ROWS UNBOUNDED PRECEDING)),
c AS (SELECT decision_id, ord, least(a, b) AS f, min(pos) AS t FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
cover AS (SELECT decision_id, ord, count(*) AS covers, round(sum(0.1 / (1 + greatest(0, t - f - 1))), 6) AS rank FROM c GROUP BY ALL)"""


def _covers(spark: SparkSession, d: str) -> DataFrame:
    terms = ["soud", "účastníci"]
    both = opened(spark, d, "decision_text").counts(terms).where(F.col("matched") == 2).select("decision_id")
    places = spans.positions(_pieces(spark, d).join(both, "decision_id", "left_semi"), ["decision_id", "ord"], "piece", terms)
    return spans.cover_density(places, ["decision_id", "ord"], terms)


@query("R3_chunk_channel", f"WITH {COVER_SQL} SELECT decision_id, ord, covers, rank FROM cover")
def chunk_channel(spark: SparkSession, d: str) -> DataFrame:
    return _covers(spark, d)


KEYS = ("par:160", "par:1741", "par:2246", "par:2828")
PRIOR_SQL = "prior AS (SELECT id, max(CASE decision_type WHEN 'nalez' THEN 2.0 WHEN 'stanovisko' THEN 1.5 ELSE 1.0 END) AS prior FROM decision GROUP BY id)"


@query(
    "R5_best_passage",
    f"""WITH {COVER_SQL}, {PRIOR_SQL}, key AS (SELECT DISTINCT decision_id, ord, len(list_intersect(ident_keys, {list(KEYS)})) AS keys FROM decision_chunk WHERE list_has_any(ident_keys, {list(KEYS)})),
s AS (SELECT decision_id, ord, round((coalesce(rank, 0) + 0.5 * coalesce(keys, 0)) * prior, 8) AS score FROM cover FULL JOIN key USING (decision_id, ord) JOIN prior ON id = decision_id)
SELECT DISTINCT ON (decision_id) decision_id, ord, score FROM s WHERE score > 0 ORDER BY decision_id, score DESC, ord""",
)
def best_passage(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in KEYS])
    shared = table(spark, d, "decision_chunk").where(F.arrays_overlap("ident_keys", keys)).select("decision_id", "ord", F.size(F.array_intersect("ident_keys", keys)).alias("keys")).distinct()
    prior = F.max(F.when(F.col("decision_type") == "nalez", 2.0).when(F.col("decision_type") == "stanovisko", 1.5).otherwise(1.0))
    priors = table(spark, d, "decision").groupBy(F.col("id").alias("decision_id")).agg(prior.alias("prior"))
    rows = _covers(spark, d).join(shared, ["decision_id", "ord"], "full").join(priors, "decision_id")
    best = search.combined(rows, "decision_id", F.coalesce("rank", F.lit(0.0)), F.coalesce("keys", F.lit(0)), F.col("prior"), [F.asc("ord")], digits=8)
    return best.select("decision_id", "ord", "score")


SOURCE = "sbirka-krasov.example"


@query(
    "R7_small_scope",
    f"""WITH {_bm25_sql(['soud', 'zákona'], f"lower(trim(source)) = '{SOURCE}'")}, h AS (SELECT doc_id FROM hit WHERE matched = 2 ORDER BY score DESC, doc_id LIMIT 20),
s AS (SELECT doc_id FROM documents WHERE lower(trim(source)) = '{SOURCE}' AND contains(lower(text), 'soud') AND contains(lower(text), 'zákona') ORDER BY doc_id LIMIT 20)
SELECT doc_id FROM h WHERE (SELECT count(*) FROM h) >= (SELECT count(*) FROM s) UNION ALL SELECT doc_id FROM s WHERE (SELECT count(*) FROM h) < (SELECT count(*) FROM s)""",
)
def small_scope(spark: SparkSession, d: str) -> DataFrame:
    """Too few ranked hits in a small source: its texts are searched whole, which counts if that finds more."""
    mine = F.lower(F.trim("source")) == SOURCE
    ranked = postings.bm25(opened(spark, d), ["soud", "zákona"], where=mine).where("matched = 2")
    hits = search.top(ranked, [F.desc("score"), F.asc("doc_id")], 20).select("doc_id")
    scope = _documents(spark, d).where(mine)
    if hits.count() >= 20 or scope.limit(5001).count() > 5000:
        return hits
    low = F.lower("text")
    exact = scope.where(low.contains("soud") & low.contains("zákona")).select("doc_id").orderBy("doc_id").limit(20)
    return exact if exact.count() > hits.count() else hits


@query("R9_channel", f"WITH {_bm25_sql(['soud', 'smlouva'], name='a')}, {_bm25_sql(['contract', 'soud'], name='b')}, {_bm25_sql(['nicnenalezeno'], name='c')} SELECT 'soud smlouva' AS search, CASE WHEN max(matched) = 2 THEN 'and' WHEN count(*) > 0 THEN 'or' END AS channel FROM a UNION ALL SELECT 'contract soud', CASE WHEN max(matched) = 2 THEN 'and' WHEN count(*) > 0 THEN 'or' END FROM b UNION ALL SELECT 'nicnenalezeno', CASE WHEN max(matched) = 1 AND count(*) > 0 THEN 'and' END FROM c")
def channel(spark: SparkSession, d: str) -> DataFrame:
    rows = [(s, postings.ladder(opened(spark, d).counts(s.split()), len(s.split()))[1]) for s in ("soud smlouva", "contract soud", "nicnenalezeno")]
    return spark.createDataFrame(rows, "search string, channel string")


COUNTS_SQL = f"""{CHUNK}, n AS (SELECT decision_id, ord, len(list_filter({PIECE_WORDS}, lambda x: x = 'soud')) AS a, len(list_filter({PIECE_WORDS}, lambda x: x = 'účastníci')) AS b FROM piece),
key AS (SELECT DISTINCT decision_id, ord, len(list_intersect(ident_keys, {list(KEYS)})) AS score FROM decision_chunk WHERE list_has_any(ident_keys, {list(KEYS)})),
hit AS (SELECT 'and' AS channel, decision_id, ord, a + b AS score FROM n WHERE a > 0 AND b > 0 UNION ALL SELECT 'or', decision_id, ord, a + b FROM n WHERE a + b > 0 UNION ALL SELECT 'idn', decision_id, ord, score FROM key)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """(channel, decision_id, ord, score) of three channels over the passages."""
    places = spans.positions(_pieces(spark, d), ["decision_id", "ord"], "piece", ["soud", "účastníci"])
    held = places.groupBy("decision_id", "ord").agg(F.count("*").alias("score"), F.count_distinct("term").alias("terms"))
    some = held.select(F.lit("or").alias("channel"), "decision_id", "ord", "score")
    every = held.where("terms = 2").select(F.lit("and").alias("channel"), "decision_id", "ord", "score")
    keys = F.array(*[F.lit(k) for k in KEYS])
    shared = table(spark, d, "decision_chunk").where(F.arrays_overlap("ident_keys", keys)).select(F.lit("idn").alias("channel"), "decision_id", "ord", F.size(F.array_intersect("ident_keys", keys)).cast("long").alias("score")).distinct()
    return every.unionByName(some).unionByName(shared)


@query("R11_channels", f"WITH {COUNTS_SQL}, c AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY channel, decision_id ORDER BY score DESC, ord) <= 3) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY channel ORDER BY score DESC, decision_id, ord) <= 60")
def channels(spark: SparkSession, d: str) -> DataFrame:
    capped = search.per_group(_hits(spark, d), ["channel", "decision_id"], [F.desc("score"), F.asc("ord")], 3)
    return search.per_group(capped, ["channel"], [F.desc("score"), F.asc("decision_id"), F.asc("ord")], 60)


@query("R14_more_in_document", f"WITH {COUNTS_SQL}, o AS (SELECT * FROM hit WHERE channel = 'or'), s AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY score DESC, ord) <= 2) SELECT decision_id, ord, score, (SELECT count(*) FROM o WHERE o.decision_id = s.decision_id) - count(*) OVER (PARTITION BY decision_id) AS more FROM s")
def more_in_document(spark: SparkSession, d: str) -> DataFrame:
    every = _hits(spark, d).where("channel = 'or'").select("decision_id", "ord", "score")
    shown = search.per_group(every, ["decision_id"], [F.desc("score"), F.asc("ord")], 2)
    return search.more(shown, every, "decision_id").select("decision_id", "ord", "score", "more")


@query("R17_saturated", f"WITH {COUNTS_SQL}, c AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY channel ORDER BY score DESC, decision_id, ord) <= 60) SELECT channel, count(*) AS hits, count(*) >= 60 AS saturated FROM c GROUP BY channel")
def saturated(spark: SparkSession, d: str) -> DataFrame:
    return search.saturated(search.per_group(_hits(spark, d), ["channel"], [F.desc("score"), F.asc("decision_id"), F.asc("ord")], 60), "channel", 60)


@query("R12_meta_channel", "WITH m AS (SELECT id, max(CAST(list_contains(case_numbers, '20 Co 2392/2018') AS INTEGER)) AS key, max(CAST(contains(lower(court), 'krajský') AS INTEGER) + CAST(contains(lower(legal_sentence), 'smlouv') AS INTEGER)) AS rank FROM decision GROUP BY id) SELECT id, coalesce(key, 0) AS key, coalesce(rank, 0) AS rank FROM m WHERE key = 1 OR rank > 0 ORDER BY key DESC NULLS LAST, rank DESC NULLS LAST, id LIMIT 60")
def meta_channel(spark: SparkSession, d: str) -> DataFrame:
    rank = F.contains(F.lower("court"), F.lit("krajský")).cast("int") + F.contains(F.lower("legal_sentence"), F.lit("smlouv")).cast("int")
    rows = table(spark, d, "decision").groupBy("id").agg(F.max(F.array_contains("case_numbers", "20 Co 2392/2018").cast("int")).alias("key"), F.max(rank).alias("rank"))
    rows = rows.select("id", F.coalesce("key", F.lit(0)).alias("key"), F.coalesce("rank", F.lit(0)).alias("rank")).where("key = 1 or rank > 0")
    return search.top(rows, [F.desc("key"), F.desc("rank"), F.asc("id")], 60)


@query(
    "R16_variant_merge",
    f"""WITH {_bm25_sql(["smlouva"], name="a")}, {_bm25_sql(["žaloba"], name="b")},
l AS (SELECT doc_id, 1 AS variant, 'x' AS channel, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a QUALIFY rank <= 40 UNION ALL SELECT doc_id, 2, 'y', score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 40),
f AS (SELECT doc_id, variant, rank FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank, variant) = 1),
g AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY rank, variant) AS INTEGER) AS position FROM f)
SELECT doc_id, position, max(score) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM l JOIN g USING (doc_id) GROUP BY doc_id, position""",
)
def variant_merge(spark: SparkSession, d: str) -> DataFrame:
    lists = None
    for variant, (term, name) in enumerate([("smlouva", "x"), ("žaloba", "y")], 1):
        by = [F.desc("score"), F.asc("doc_id")]
        part = search.ranked(search.top(postings.bm25(opened(spark, d), [term]), by, 40), by).select("doc_id", F.lit(variant).alias("variant"), F.lit(name).alias("channel"), "rank", "score")
        lists = part if lists is None else lists.unionByName(part)
    return search.merged_variants(lists, "variant", "rank", "doc_id", "score", "channel")


@query("W3_page_with_total", "SELECT citing_id, mentions, count(*) OVER () AS total FROM (SELECT DISTINCT citing_id, key, mentions, first_at FROM decision_citation WHERE key = 'sz:31 cdo 7412/2011') ORDER BY mentions DESC, citing_id, first_at LIMIT 20 OFFSET 20")
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision_citation").where("key = 'sz:31 cdo 7412/2011'").select("citing_id", "key", "mentions", "first_at").distinct()
    return search.with_total(rows, [F.desc("mentions"), F.asc("citing_id"), F.asc("first_at")], 20, 20).select("citing_id", "mentions", "total")


@query("R23_passages_before", f"WITH chunk AS (SELECT DISTINCT decision_id, char_start FROM decision_chunk), cite AS (SELECT DISTINCT citing_id, key, first_at FROM decision_citation), s AS (SELECT decision_id, list(char_start) AS starts FROM chunk GROUP BY 1) SELECT citing_id, key, first_at, CAST(len(list_filter(starts, lambda x: x <= first_at)) AS INTEGER) AS before FROM cite JOIN s ON decision_id = citing_id")
def passages_before(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "decision_chunk").groupBy(F.col("decision_id").alias("citing_id")).agg(F.collect_set("char_start").alias("starts"))
    cites = table(spark, d, "decision_citation").select("citing_id", "key", "first_at").distinct()
    return cites.join(starts, "citing_id").select("citing_id", "key", "first_at", F.size(F.filter("starts", lambda s: s <= F.col("first_at"))).alias("before"))


@query("R24_excerpts", rf"""WITH {BODY} SELECT decision_id, trim(regexp_replace(substr(body, greatest(instr(body, 'úrok z prodlení') - 1 - 150, 0) + 1, 450), '[ \t\n\r\x{{A0}}]+', ' ', 'g'), ' ') AS excerpt FROM body WHERE contains(body, 'úrok z prodlení')""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    at = F.instr("body", "úrok z prodlení") - 1
    return bodies(spark, d).where(F.col("body").contains("úrok z prodlení")).select("decision_id", spans.snapped(F.col("body"), at, 150, 450).alias("excerpt"))


@query("W11_densest_cluster", "WITH c AS (SELECT DISTINCT citing_id, key, first_at FROM decision_citation), n AS (SELECT citing_id, first_at AS window_start, count(*) OVER (PARTITION BY citing_id ORDER BY first_at RANGE BETWEEN CURRENT ROW AND 600 FOLLOWING) AS hits FROM c) SELECT DISTINCT ON (citing_id) citing_id, window_start, hits FROM n ORDER BY citing_id, hits DESC, window_start")
def densest_cluster(spark: SparkSession, d: str) -> DataFrame:
    return spans.densest(table(spark, d, "decision_citation").select("citing_id", "key", "first_at").distinct(), ["citing_id"], "first_at", 600)


_CUT = r"""CASE WHEN window_start > 0 AND regexp_matches(substr(body, window_start, 1), '[\p{L}\p{N}]') THEN regexp_replace(substr(body, window_start + 1, 400), '^[\p{L}\p{N}]+', '') ELSE substr(body, window_start + 1, 400) END"""


@query(
    "R18_best_window",
    rf"""WITH {BODY}, c AS (SELECT DISTINCT citing_id, key, first_at FROM decision_citation), n AS (SELECT citing_id, first_at AS window_start, count(*) OVER (PARTITION BY citing_id ORDER BY first_at RANGE BETWEEN CURRENT ROW AND 400 FOLLOWING) AS hits FROM c),
b AS (SELECT DISTINCT ON (citing_id) citing_id, window_start, hits FROM n ORDER BY citing_id, hits DESC, window_start),
l AS (SELECT citing_id, window_start, hits, body, {_CUT} AS l FROM b JOIN body ON decision_id = citing_id),
r AS (SELECT *, CASE WHEN window_start + 400 < length(body) AND regexp_matches(substr(body, window_start + 401, 1), '[\p{{L}}\p{{N}}]') THEN regexp_replace(l, '[\p{{L}}\p{{N}}]+$', '') ELSE l END AS r FROM l)
SELECT citing_id, hits, CASE WHEN window_start > 0 THEN '… ' ELSE '' END || trim(regexp_replace(r, '[ \t\n\r\x{{A0}}]+', ' ', 'g'), ' ') || CASE WHEN window_start + 400 < length(body) THEN ' …' ELSE '' END AS excerpt FROM r""",
)
def best_window(spark: SparkSession, d: str) -> DataFrame:
    best = spans.densest(table(spark, d, "decision_citation").select("citing_id", "key", "first_at").distinct(), ["citing_id"], "first_at", 400)
    texts = bodies(spark, d).withColumnRenamed("decision_id", "citing_id")
    return best.join(texts, "citing_id").select("citing_id", "hits", spans.whole_words(F.col("body"), F.col("window_start"), 400).alias("excerpt"))


@query("SC4_spans_from_blocks", f"WITH {CHUNK} SELECT decision_id, ord, piece AS span_text FROM piece WHERE char_end <= (SELECT length(body) FROM body WHERE body.decision_id = piece.decision_id)")
def spans_from_blocks(spark: SparkSession, d: str) -> DataFrame:
    stored = spans.blocks(bodies(spark, d), "decision_id", "body")
    return spans.read_spans(stored, _chunks(spark, d), "decision_id", ["ord"], "char_start", "char_end").select("decision_id", "ord", "span_text")


@query("SC3_block_range", f"WITH {BODY} SELECT decision_id, substr(body, 2001, 11000) AS span_text FROM body WHERE length(body) >= 13000")
def block_range(spark: SparkSession, d: str) -> DataFrame:
    texts = bodies(spark, d)
    stored = spans.blocks(texts, "decision_id", "body")
    asked = texts.select("decision_id", F.lit(2000).alias("s"), F.lit(13000).alias("e"))
    return spans.read_spans(stored, asked, "decision_id", [], "s", "e")


@query("X32_storage_blocks", f"WITH {BODY} SELECT decision_id, CAST(n AS INTEGER) AS block_no, CAST(least((n + 1) * 12000, length(body)) AS INTEGER) AS block_end FROM (SELECT *, unnest(range((length(body) - 1) // 12000 + 1)) AS n FROM body WHERE length(body) > 0)")
def storage_blocks(spark: SparkSession, d: str) -> DataFrame:
    return spans.blocks(bodies(spark, d), "decision_id", "body").select("decision_id", "block_no", "block_end")


@query("SC5_pages_around", f"WITH {BODY}, page AS (SELECT decision_id, p AS page, p * 1000 AS s, least(p * 1000 + 1000, length(body)) AS e FROM (SELECT *, unnest(range((length(body) - 1) // 1000 + 1)) AS p FROM body WHERE length(body) > 0)), chunk AS (SELECT DISTINCT decision_id, ord, char_start, char_end FROM decision_chunk WHERE char_end > char_start) SELECT DISTINCT chunk.decision_id, ord, char_start, CAST(page AS INTEGER) AS page FROM chunk JOIN page ON page.decision_id = chunk.decision_id AND e > char_start AND s <= char_end")
def pages_around(spark: SparkSession, d: str) -> DataFrame:
    pages = spans.blocks(bodies(spark, d), "decision_id", "body", 1000).select("decision_id", F.col("block_no").alias("page"), F.col("block_start").alias("s"), F.col("block_end").alias("e"))
    return spans.overlapping(pages, _chunks(spark, d), ["decision_id"], "char_start", "char_end", "s", "e", 2000).select("decision_id", "ord", "char_start", "page").distinct()


@query("J8_passage_at", "WITH chunk AS (SELECT decision_id, char_start, max(ord) AS ord FROM decision_chunk GROUP BY ALL), cite AS (SELECT DISTINCT citing_id, key, first_at FROM decision_citation) SELECT citing_id, key, first_at, ord FROM cite ASOF LEFT JOIN chunk ON decision_id = citing_id AND first_at >= char_start")
def passage_at(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "decision_chunk").groupBy(F.col("decision_id").alias("citing_id"), "char_start").agg(F.max("ord").alias("ord"))
    cites = table(spark, d, "decision_citation").select("citing_id", "key", "first_at").distinct()
    return joins.asof(cites, starts, ["citing_id"], "first_at", "char_start", ["ord"])


@query("J16_nearest_following", "WITH chunk AS (SELECT decision_id, char_start, max(ord) AS ord FROM decision_chunk GROUP BY ALL), cite AS (SELECT DISTINCT citing_id, key, first_at FROM decision_citation) SELECT citing_id, key, first_at, ord FROM cite ASOF LEFT JOIN chunk ON decision_id = citing_id AND first_at <= char_start")
def nearest_following(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "decision_chunk").groupBy(F.col("decision_id").alias("citing_id"), "char_start").agg(F.max("ord").alias("ord"))
    cites = table(spark, d, "decision_citation").select("citing_id", "key", "first_at").distinct()
    return spans.following(cites, starts, ["citing_id"], "first_at", "char_start", ["ord"])


@query("J10_request_order", "WITH asked AS (SELECT unnest([1016, 1004, 1033, 999999, 1010]) AS id, generate_subscripts([1016, 1004, 1033, 999999, 1010], 1) - 1 AS place) SELECT CAST(place AS INTEGER) AS place, asked.id, max(case_number) AS case_number FROM asked LEFT JOIN decision USING (id) GROUP BY ALL")
def request_order(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in (1016, 1004, 1033, 999999, 1010)])).alias("place", "id"))
    held = table(spark, d, "decision").join(F.broadcast(asked), "id", "left_semi").groupBy("id").agg(F.max("case_number").alias("case_number"))
    return asked.join(held, "id", "left").select("place", "id", "case_number")


@query("F12_in_section", f"WITH {BODY}, sec AS (SELECT decision_id, instr(body, 'Odůvodnění:') - 1 AS s, length(body) AS e FROM body WHERE contains(body, 'Odůvodnění:')) SELECT DISTINCT c.decision_id, ord FROM decision_chunk c JOIN sec ON sec.decision_id = c.decision_id AND char_start >= s AND char_start < e")
def in_section(spark: SparkSession, d: str) -> DataFrame:
    sections = bodies(spark, d).where(F.col("body").contains("Odůvodnění:")).select("decision_id", (F.instr("body", "Odůvodnění:") - 1).alias("s"), F.length("body").alias("e"))
    return table(spark, d, "decision_chunk").join(sections, "decision_id").where("char_start >= s and char_start < e").select("decision_id", "ord").distinct()


NUMBERED = r"num AS (SELECT decision_id, line_no, CAST(regexp_extract(line, '^(\d{1,4})\. ', 1) AS INTEGER) AS number FROM (SELECT decision_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no FROM body) WHERE regexp_matches(line, '^\d{1,4}\. '))"


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    lines = bodies(spark, d).select("decision_id", F.posexplode(F.split("body", "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike(r"^\d{1,4}\. "))
    return lines.select("decision_id", "line_no", F.regexp_extract("line", r"^(\d{1,4})\. ", 1).cast("int").alias("number"))


@query("W7_accepted_numbers", f"WITH RECURSIVE {BODY}, {NUMBERED}, a(decision_id, line_no, number) AS (SELECT decision_id, min(line_no), 1 FROM num WHERE number = 1 GROUP BY 1 UNION ALL SELECT * FROM (SELECT a.decision_id, min(num.line_no) AS l, a.number + 1 AS n FROM a JOIN num ON num.decision_id = a.decision_id AND num.number = a.number + 1 AND num.line_no > a.line_no GROUP BY a.decision_id, a.number)) SELECT decision_id, CAST(line_no AS INTEGER) AS line_no, number FROM a")
def accepted_numbers(spark: SparkSession, d: str) -> DataFrame:
    return spans.accepted(_numbered(spark, d), ["decision_id"], "line_no", "number")


@query("W9_number_so_far", f"WITH {BODY}, {NUMBERED}, l AS (SELECT decision_id, unnest(range(len(string_split(body, chr(10))))) AS line_no FROM body) SELECT l.decision_id, CAST(l.line_no AS INTEGER) AS line_no, last_value(number IGNORE NULLS) OVER (PARTITION BY l.decision_id ORDER BY l.line_no ROWS UNBOUNDED PRECEDING) AS number FROM l LEFT JOIN num ON num.decision_id = l.decision_id AND num.line_no = l.line_no")
def number_so_far(spark: SparkSession, d: str) -> DataFrame:
    lines = bodies(spark, d).select("decision_id", F.posexplode(F.split("body", "\n", -1)).alias("line_no", "line"))
    number = F.when(F.col("line").rlike(r"^\d{1,4}\. "), F.regexp_extract("line", r"^(\d{1,4})\. ", 1)).cast("int")
    upto = Window.partitionBy("decision_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("decision_id", "line_no", F.last(number, ignorenulls=True).over(upto).alias("number"))


@query("T12_read_windows", f"""WITH RECURSIVE {BODY}, page AS (SELECT decision_id, CAST(n AS INTEGER) AS page, length(line) + 1 AS size FROM (SELECT decision_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS n FROM body)),
w(decision_id, page, held, window_no) AS (SELECT decision_id, page, size, 0 FROM page WHERE page = 0 UNION ALL SELECT p.decision_id, p.page, CASE WHEN held + size > 4000 THEN size ELSE held + size END, window_no + CAST(held + size > 4000 AS INTEGER) FROM w JOIN page p ON p.decision_id = w.decision_id AND p.page = w.page + 1)
SELECT decision_id, page, window_no FROM w""")
def read_windows(spark: SparkSession, d: str) -> DataFrame:
    lines = bodies(spark, d).select("decision_id", F.posexplode(F.split("body", "\n", -1)).alias("page", "line")).select("decision_id", "page", (F.length("line") + 1).alias("size"))
    return spans.read_windows(lines, ["decision_id"], "page", "size", 4000)


@query("T11_size_budget", f"WITH {_bm25_sql(['smlouva'])}, t AS (SELECT doc_id, score FROM hit ORDER BY score DESC, doc_id LIMIT 100), s AS (SELECT t.doc_id, score, sum(length(text)) OVER (ORDER BY score DESC, t.doc_id ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY score DESC, t.doc_id) AS n FROM t JOIN documents USING (doc_id)) SELECT doc_id, score FROM s WHERE upto <= 20000 OR n = 1")
def size_budget(spark: SparkSession, d: str) -> DataFrame:
    by = [F.desc("score"), F.asc("doc_id")]
    hits = search.top(postings.bm25(opened(spark, d), ["smlouva"]), by, 100).select("doc_id", "score")
    sized = _documents(spark, d).select("doc_id", F.length("text").alias("size")).join(F.broadcast(hits), "doc_id")  # a hundred hits
    return spans.budgeted(sized, by, F.col("size"), 20_000).select("doc_id", "score")


@query("T2_newest_or_relevant", f"WITH {_bm25_sql(TERMS)} SELECT doc_id, score, published_on FROM hit JOIN documents USING (doc_id) ORDER BY published_on DESC NULLS LAST, score DESC, doc_id LIMIT 20")
def newest(spark: SparkSession, d: str) -> DataFrame:
    hits = postings.bm25(opened(spark, d), TERMS).select("doc_id", "score")
    return search.top(hits.join(_documents(spark, d).select("doc_id", "published_on"), "doc_id"), search.order("newest", "published_on"), 20)


@query("T8_sort_presets", "SELECT doc_id, published_on FROM documents ORDER BY year(published_on) DESC NULLS LAST, doc_id LIMIT 20")
def presets(spark: SparkSession, d: str) -> DataFrame:
    return search.top(_documents(spark, d).select("doc_id", "published_on"), search.order("year", "published_on"), 20)


@query("T6_upstream_page", "SELECT id FROM (SELECT DISTINCT id FROM decision) ORDER BY id LIMIT 7 OFFSET 21")
def upstream_page(spark: SparkSession, d: str) -> DataFrame:
    """Page 4 of 7 rows, served from upstream pages of 10."""
    from paragraf.sources.requests import upstream_pages

    pages, skip = upstream_pages(4, 7, 10)
    rows = table(spark, d, "decision").select("id").distinct().orderBy("id").offset((pages[0] - 1) * 10).limit(len(pages) * 10)
    return rows.orderBy("id").offset(skip).limit(7)


@query("X10_cover", rf"WITH {BODY} SELECT decision_id AS id, TRUE AS whole, TRUE AS bounded FROM body WHERE regexp_matches(body, '[^\s\x{{A0}}]')")
def chunk_cover(spark: SparkSession, d: str) -> DataFrame:
    texts = bodies(spark, d)
    return chunks.cover(chunks.chunks(texts, "decision_id", "body"), texts, "decision_id", "body")


@query("X12_structural_chunks")
def structural_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.structural_chunks(_files(spark, d), "key", "text")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files_eval").where("text is not null and key is not null").groupBy("key").agg(F.max("text").alias("text"))


@query("X12_cover", r"WITH f AS (SELECT key, max(text) AS text FROM files_eval WHERE text IS NOT NULL AND key IS NOT NULL GROUP BY key) SELECT key AS id, TRUE AS whole, TRUE AS bounded FROM f WHERE regexp_matches(text, '[^\s\x{A0}]')")
def structural_cover(spark: SparkSession, d: str) -> DataFrame:
    return chunks.cover(chunks.structural_chunks(_files(spark, d), "key", "text"), _files(spark, d), "key", "text")


@query("X26_dissents", f"WITH {BODY} SELECT decision_id, CAST(0 AS INTEGER) AS no, CAST(length(body) + 1 AS INTEGER) AS char_start, CAST(2 * length(body) + 36 AS INTEGER) AS char_end, 'Odlišné stanovisko soudce J. Nováka' AS heading FROM body")
def dissents(spark: SparkSession, d: str) -> DataFrame:
    """Each body with a dissenting opinion behind it, as long as itself."""
    own = table(spark, d, "decision_text").where("body is not null")  # the operator takes one text of each key
    rows = own.select("decision_id", F.concat("body", F.lit("\nOdlišné stanovisko soudce J. Nováka\n"), F.expr("substring(body, 1, length(body) - 1)")).alias("text"))
    return chunks.dissents(rows, "decision_id", "text")


@query("R19_matches")
def word_matches(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best hits of a search, how often its words stand in each, and the best window."""
    hits = search.top(postings.bm25(opened(spark, d), ["smlouva"]), [F.desc("score"), F.asc("doc_id")], 20).select("doc_id")
    return shown.shown(_documents(spark, d).select("doc_id", "text").join(F.broadcast(hits), "doc_id"), "doc_id", "text", ["smlouv", "smluv"])


_FOLDED = "strip_accents(lower(body))"


@query("R20_stretches", f"WITH {BODY}, m AS (SELECT decision_id, CAST((length({_FOLDED}) - length(replace({_FOLDED}, 'promlceni', ''))) / 9 AS INTEGER) AS matches FROM body) SELECT decision_id, least(matches, 200) AS matches FROM m WHERE matches > 0")
def stretches(spark: SparkSession, d: str) -> DataFrame:
    # lower-casing may lengthen a text, folding must not: only the count is compared
    return shown.around(bodies(spark, d), "decision_id", "body", "promlčení").select("decision_id", "matches")


@query("R21_first_term", f"WITH {BODY} SELECT decision_id, CASE WHEN contains(body, 'vydržení') THEN 'vydržení' WHEN contains(body, 'promlčení') THEN 'promlčení' WHEN contains(body, 'služebnost') THEN 'služebnost' END AS term FROM body")
def first_term(spark: SparkSession, d: str) -> DataFrame:
    """The first of the terms that a text holds is the one its preview shows."""
    terms = F.array(*[F.lit(t) for t in ("vydržení", "promlčení", "služebnost")])
    return bodies(spark, d).select("decision_id", F.get(F.filter(terms, lambda t: F.contains(F.col("body"), t)), F.lit(0)).alias("term"))


@query("R28_within_document", f"WITH {BODY}, l AS (SELECT decision_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no FROM body WHERE decision_id = (SELECT min(decision_id) FROM body WHERE contains(body, 'promlčení'))) SELECT CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE contains(strip_accents(lower(line)), 'promlceni')")
def within_document(spark: SparkSession, d: str) -> DataFrame:
    """One document, the first that holds the word, line by line: its text is read, no index."""
    from paragraf.functions.text import fold

    texts = bodies(spark, d)
    first = texts.where(F.col("body").contains("promlčení")).agg(F.min("decision_id").alias("decision_id"))
    lines = texts.join(F.broadcast(first), "decision_id", "left_semi").select(F.posexplode(F.split("body", "\n", -1)).alias("line_no", "line"))
    return lines.where(fold(F.col("line")).contains("promlceni"))
