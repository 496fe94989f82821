"""The queries of this folder's operators over the test tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.llm import encodings, mixing, near_duplicates, packing, repeated_lines, scans, sentences, splitting
from paragraf.plans.catalogue import Query, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _court_bodies(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.sourced(table(spark, d, "decision_text"), "decision_id", "body", table(spark, d, "decision"), "id", "court")


P1_LINES = r"""
WITH court AS (
  SELECT id, min(lower(trim(regexp_replace(court, '[ \t\n\r\x{A0}]+', ' ', 'g'), ' '))) AS court FROM decision WHERE court IS NOT NULL GROUP BY id),
body AS (SELECT decision_id, any_value(body) AS body FROM decision_text WHERE body IS NOT NULL GROUP BY decision_id),
line AS (
  SELECT decision_id, court, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no
  FROM body JOIN court ON id = decision_id),
kept AS (
  SELECT decision_id, court, line_no, lower(regexp_replace(line, '[ \t\n\r\x{A0}0-9]', '', 'g')) AS same FROM line),
often AS (SELECT court, same FROM kept WHERE length(same) >= 25 GROUP BY court, same HAVING count(DISTINCT decision_id) >= 10),
found AS (SELECT DISTINCT decision_id, CAST(line_no AS INTEGER) AS line_no FROM kept JOIN often USING (court, same))
"""


@query("p1_found", P1_LINES + "SELECT decision_id, line_no FROM found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(_court_bodies(spark, d)).select(F.col("id").alias("decision_id"), "line_no").distinct()


@query(
    "p1_clean",
    P1_LINES.replace("FROM body JOIN court", "FROM body LEFT JOIN court")
    + """SELECT decision_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS body, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS cut
FROM (SELECT line.decision_id, line.line, line.line_no, found.line_no IS NOT NULL AS gone FROM line LEFT JOIN found ON found.decision_id = line.decision_id AND found.line_no = line.line_no)
GROUP BY decision_id""",
)
def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """All bodies; those without a court pass as they are."""
    found = repeated_lines.repeated_lines(_court_bodies(spark, d))
    return repeated_lines.without_lines(repeated_lines.all_bodies(table(spark, d, "decision_text"), "decision_id", "body"), found).withColumnRenamed("id", "decision_id")


@query("p1_chunks")
def p1_chunks(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.chunk_report(_court_bodies(spark, d)).withColumnRenamed("source", "court")


_W = r"[^ \t\n\r\x{A0}]"


def _inside(p: str) -> str:
    """Does the place lie inside a run of non-white characters that could be kept whole?"""
    left = f"length(regexp_extract(substr(body, greatest({p} - 2400, 0) + 1, least({p}, 2400)), '{_W}*$'))"
    right = f"length(regexp_extract(substr(body, {p} + 1, 2400), '^{_W}*'))"
    return f"({p} > 0 AND {p} < length(body) AND {left} > 0 AND {right} > 0 AND {left} + {right} <= 2400)"


P3_SQL = f"""
WITH body AS (SELECT decision_id, any_value(body) AS body FROM decision_text WHERE body IS NOT NULL GROUP BY 1),
piece AS (SELECT DISTINCT decision_id, ord, char_start AS s, char_end AS e FROM decision_chunk),
p AS (SELECT *, max(ord) OVER (PARTITION BY decision_id) AS top, lag(e) OVER w AS before_end, lag(ord) OVER w AS before_ord FROM piece WINDOW w AS (PARTITION BY decision_id ORDER BY ord))
SELECT DISTINCT decision_id, ord FROM p JOIN body USING (decision_id)
WHERE e - s > 2400 OR s >= e OR e > length(body) OR {_inside("s")} OR {_inside("e")}
OR (ord = 0 AND regexp_matches(substr(body, 1, s), '{_W}')) OR (ord = top AND regexp_matches(substr(body, e + 1), '{_W}'))
OR (ord > 0 AND before_ord = ord - 1 AND NOT before_end - s BETWEEN 80 AND 240)
"""


@query("p3_found", P3_SQL)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.invalid_pieces(table(spark, d, "decision_text"), "decision_id", "body", table(spark, d, "decision_chunk"), "decision_id").withColumnRenamed("id", "decision_id")


@query("p3_pieces")
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "decision_text"), "decision_id", "body").withColumnRenamed("id", "decision_id")


@query("p3_cover", rf"SELECT decision_id, TRUE AS covered, TRUE AS bounded, TRUE AS overlapping FROM (SELECT decision_id, any_value(body) AS body FROM decision_text WHERE decision_id IS NOT NULL AND body IS NOT NULL GROUP BY 1) WHERE regexp_matches(body, '{_W}')")
def p3_cover(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "decision_text")
    return splitting.cover(texts, "decision_id", "body", splitting.pieces(texts, "decision_id", "body")).withColumnRenamed("id", "decision_id")


@query(
    "p3_long",
    "SELECT decision_id, length(body) > 2400 AS parted FROM (SELECT decision_id, any_value(trim(body, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) AS body FROM decision_text WHERE decision_id IS NOT NULL AND body IS NOT NULL GROUP BY 1) WHERE body <> ''",
)
def p3_long(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.pieces(table(spark, d, "decision_text"), "decision_id", "body").groupBy("id").agg(F.count("*").alias("n"))
    return cut.select(F.col("id").alias("decision_id"), (F.col("n") > 1).alias("parted"))


P6_SQL = r"""
WITH body AS (SELECT decision_id, any_value(body) AS body FROM decision_text WHERE body IS NOT NULL GROUP BY 1),
word AS (SELECT decision_id, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS w FROM body),
gram AS (SELECT decision_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM word WHERE len(w) >= 3),
n AS (SELECT decision_id, count(*) AS n FROM gram GROUP BY 1),
met AS (SELECT a.decision_id AS id_a, b.decision_id AS id_b, count(*) AS met FROM gram a JOIN gram b ON a.g = b.g AND a.decision_id < b.decision_id GROUP BY 1, 2)
SELECT id_a, id_b FROM met JOIN n AS x ON x.decision_id = id_a JOIN n AS y ON y.decision_id = id_b WHERE met >= 0.75 * (x.n + y.n - met)
"""


@query("p6_found", P6_SQL)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_pairs(table(spark, d, "decision_text"), "decision_id", "body", 3, 0.75)


@query("p6_copies", "WITH t AS (SELECT decision_id, min(sha256(body)) AS h FROM decision_text WHERE decision_id IS NOT NULL AND body IS NOT NULL GROUP BY 1) SELECT decision_id, min(decision_id) OVER (PARTITION BY h) AS copy_of, count(*) OVER (PARTITION BY h) AS keys FROM t")
def p6_copies(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.copies(table(spark, d, "decision_text"), "decision_id", "body").withColumnRenamed("id", "decision_id")


P6_GROUPS_SQL = P6_SQL.replace("SELECT id_a, id_b FROM met", ", pair AS (SELECT id_a, id_b FROM met").replace("WITH body", "WITH RECURSIVE body") + r"""),
class AS (SELECT decision_id AS id, md5(string_agg(g, '|' ORDER BY g)) AS class FROM gram GROUP BY 1),
edge AS (SELECT id_a AS a, id_b AS b FROM pair UNION SELECT id_b, id_a FROM pair),
reach(id, other) AS (SELECT DISTINCT decision_id, decision_id FROM decision_text WHERE decision_id IS NOT NULL UNION SELECT id, b FROM reach JOIN edge ON a = other),
own AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id),
link AS (SELECT a AS id, count(DISTINCT y.class) AS links FROM edge JOIN class AS x ON x.id = a JOIN class AS y ON y.id = b WHERE x.class <> y.class GROUP BY a)
SELECT id AS decision_id, group_id, coalesce(links, 0) AS links, count(*) OVER (PARTITION BY group_id) AS members FROM own LEFT JOIN link USING (id)
"""


@query("p6_groups", P6_GROUPS_SQL)
def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(table(spark, d, "decision_text"), "decision_id", "body", 3, 0.75).withColumnRenamed("id", "decision_id")


def _decoding(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The wrongly decoded bodies, and the wrongly decoded texts of final documents by place."""
    bodies = table(spark, d, "decision_text").select("decision_id", "body")
    languages = encodings.train(table(spark, d, "documents"), "lang", "text", "cs", bodies, "body")
    found = encodings.wrongly_decoded(bodies, ["decision_id"], "body", languages)
    document = table(spark, d, "justice_finaldoc")
    parts = []
    for place in ("header", "verdict", "justification"):
        blocks = document.select("uuid", F.posexplode(place).alias("block_no", "block"))
        parts.append(blocks.select(F.lit(place).alias("place"), "uuid", "block_no", F.posexplode("block.texts").alias("text_no", "entry")).select("place", "uuid", "block_no", "text_no", F.col("entry.text").alias("text")))
    entries = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return found, encodings.wrongly_decoded(entries, ["place", "uuid", "block_no", "text_no"], "text", languages)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """The wrongly decoded texts of both tables by (place, record_key, block_no, text_no)."""
    bodies, entries = _decoding(spark, d)
    one = bodies.select(F.lit("body").alias("place"), F.col("decision_id").cast("string").alias("record_key"), F.lit(0).alias("block_no"), F.lit(0).alias("text_no"), "restored", "lost_lines", "chains")
    return one.unionByName(entries.withColumnRenamed("uuid", "record_key")).where("record_key is not null")


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).select("place", "record_key", "block_no", "text_no").distinct()


@query("p5_restored")
def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    keys = ["place", "record_key", "block_no", "text_no"]
    row = F.struct("restored", "lost_lines", "chains")
    return _placed(spark, d).groupBy(*keys).agg(F.max(row).alias("row")).select(*keys, "row.*")


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "char_start", "char_end")


@query("p9_units")
def p9_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"), "doc_id", "text")


@query("p9_cover", rf"SELECT doc_id, TRUE AS apart, TRUE AS whole FROM documents WHERE regexp_matches(text, '{_W}')")
def p9_cover(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents")
    return sentences.cover(sentences.sentence_units(texts, "doc_id", "text"), texts, "doc_id", "text")


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "container_kind"))


@query("p7_found", "SELECT container, doc_id FROM documents JOIN container_kind ON strlen(text) + 1 > capacity")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversized(_filled(spark, d)).withColumnRenamed("doc", "doc_id")


@query("p7_windows")
def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).withColumnRenamed("doc", "doc_id")


@query("p7_report")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(_filled(spark, d))


@query(
    "p7_cover",
    "WITH s AS (SELECT DISTINCT container, capacity, doc_id, strlen(text) + 1 AS size FROM documents, container_kind WHERE text IS NOT NULL) SELECT container, count(DISTINCT doc_id) AS docs, CAST(sum(size) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS overfull, count(*) FILTER (size > capacity) AS parted, TRUE AS tight FROM s GROUP BY container",
)
def p7_cover(spark: SparkSession, d: str) -> DataFrame:
    return packing.cover(_filled(spark, d), table(spark, d, "container_kind"))


P8_SIZES = """
WITH own AS (
  SELECT m.source, m.target_share, m.max_repeats, coalesce(sum(strlen(d.text) + 1) FILTER (WHERE d.text IS NOT NULL), 0) AS own
  FROM mix_target m LEFT JOIN documents d ON lower(trim(d.source)) = m.source GROUP BY ALL)
"""


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = mixing.wanted(table(spark, d, "mix_target"))
    return targets, mixing.sized(table(spark, d, "documents"), "doc_id", "text", "source", targets)


@query("p8_found", P8_SIZES + "SELECT source FROM own WHERE target_share * (SELECT sum(own) FROM own) > max_repeats * own")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    targets, documents = _sources(spark, d)
    return mixing.solve(mixing.counted(documents), targets).where("not reachable").select("source")


@query("p8_selection")
def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    targets, documents = _sources(spark, d)
    return mixing.mix(documents, targets)[0].withColumnRenamed("doc", "doc_id")


@query("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets, documents = _sources(spark, d)
    return mixing.mix(documents, targets)[1]


@query("p8_kept", P8_SIZES + "SELECT source, target_share * (SELECT sum(own) FROM own) <= max_repeats * own AS reachable, TRUE AS kept FROM own")
def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    targets, documents = _sources(spark, d)
    return mixing.kept(mixing.mix(documents, targets)[1], 0.05)


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(table(spark, d, "files_eval"), "key", "text", "meta.title")


@query("p4_text")
def p4_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "files_eval"), "key", "text", "meta.title")
