"""Queries of ranked search over the documents and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.functions.text import snippet
from paragraf.operators import postings, search
from paragraf.plans.catalogue import query, table
from paragraf.session import there

TERMS = ["soud", "smlouva", "žaloba"]
WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}][\p{L}\p{Nd}\p{M}]*')"


def _bm25_sql(terms: list[str], where: str = "TRUE", extra: str = "", name: str = "hit") -> str:
    """Common table expressions up to `name`(doc_id, extra, matched, score)."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(terms))
    hit = " + ".join(f"CAST(t{i} > 0 AS INTEGER)" for i in range(len(terms)))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    return f"""{name}_w AS (SELECT doc_id{extra}, {where} AS kept, {WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
{name}_t AS (SELECT doc_id{extra}, kept, len(w) AS dl, {tf} FROM {name}_w),
{name}_g AS (SELECT count(*) AS n, avg(dl) AS avgdl, max({hit}) FILTER (kept) AS most, {df} FROM {name}_t),
{name} AS (SELECT doc_id{extra}, {hit} AS matched, round({score}, 6) AS score FROM {name}_t, {name}_g WHERE kept AND {hit} >= CASE WHEN most = {len(terms)} THEN {len(terms)} ELSE 1 END)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_OPEN: dict[tuple[str, str, str], postings.Index] = {}


def opened(spark: SparkSession, d: str, name: str = "documents") -> postings.Index:
    """The index of a table's texts, built at a session's first search and read by all later ones."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _OPEN or not there(spark, _OPEN[at].path):
        if name == "documents":
            _OPEN[at] = postings.build(_documents(spark, d), "doc_id", "text", ["lang", "source", "doc_kind", "n_chars"])
        else:
            bodies = table(spark, d, "decision_text").where("body is not null").dropDuplicates(["decision_id"])
            _OPEN[at] = postings.build(bodies, "decision_id", "body", ["source"])
    return _OPEN[at]


@query("R1_bm25_and_or", f"WITH {_bm25_sql(TERMS)} SELECT doc_id, matched, score FROM hit ORDER BY score DESC, doc_id LIMIT 20")
def bm25_and_or(spark: SparkSession, d: str) -> DataFrame:
    return search.top(postings.bm25(opened(spark, d), TERMS), [F.desc("score"), F.asc("doc_id")], 20)


@query("R1_bm25_ladder_or", f"WITH {_bm25_sql(['soud', 'contract', 'gericht'])} SELECT doc_id, matched, score FROM hit ORDER BY score DESC, doc_id LIMIT 20")
def bm25_ladder(spark: SparkSession, d: str) -> DataFrame:
    return search.top(postings.bm25(opened(spark, d), ["soud", "contract", "gericht"]), [F.desc("score"), F.asc("doc_id")], 20)


FILTER_SQL = "lower(lang) = 'cs' AND n_chars BETWEEN 500 AND 5000"


@query("R1_bm25_filtered", f"WITH {_bm25_sql(TERMS, FILTER_SQL)} SELECT doc_id, matched, score FROM hit ORDER BY score DESC, doc_id LIMIT 20")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    kept = (F.lower("lang") == "cs") & F.col("n_chars").between(500, 5000)
    return search.top(postings.bm25(opened(spark, d), TERMS, where=kept), [F.desc("score"), F.asc("doc_id")], 20)


@query(
    "R6_prior_rerank",
    f"WITH {_bm25_sql(['soud'], extra=', doc_kind')}, pool AS (SELECT * FROM hit ORDER BY score DESC, doc_id LIMIT 200) SELECT doc_id, doc_kind, round(score * CASE doc_kind WHEN 'rozsudek' THEN 1.5 WHEN 'usneseni' THEN 1.3 ELSE 1.0 END, 6) AS score FROM pool ORDER BY score DESC, doc_id LIMIT 20",
)
def prior_rerank(spark: SparkSession, d: str) -> DataFrame:
    pool = search.top(postings.bm25(opened(spark, d), ["soud"], ["doc_kind"]), [F.desc("score"), F.asc("doc_id")], 200)
    prior = F.when(F.col("doc_kind") == "rozsudek", 1.5).when(F.col("doc_kind") == "usneseni", 1.3).otherwise(1.0)
    return search.top(pool.select("doc_id", "doc_kind", F.round(F.col("score") * prior, 6).alias("score")), [F.desc("score"), F.asc("doc_id")], 20)


@query(
    "T7_lanes",
    f"WITH {_bm25_sql(['soud'], 'source IS NOT NULL', ', source')} SELECT source, doc_id, score FROM hit QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 3",
)
def lanes(spark: SparkSession, d: str) -> DataFrame:
    hits = postings.bm25(opened(spark, d), ["soud"], ["source"], where=F.col("source").isNotNull())
    return search.per_group(hits, ["source"], [F.desc("score"), F.asc("doc_id")], 3).select("source", "doc_id", "score")


@query(
    "R13_rrf",
    f"""WITH {_bm25_sql(TERMS, name="h_and")}, {_bm25_sql(["smlouva"], name="h_or")},
c_and AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h_and QUALIFY rank <= 60),
c_or AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h_or QUALIFY rank <= 60),
c_idn AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM (SELECT doc_id, (length(text) - length(replace(text, 'Listiny', ''))) / 7 AS n FROM documents WHERE text LIKE '%Listiny%') QUALIFY rank <= 60),
part AS (SELECT doc_id, 1.0 / (60 + rank) AS p FROM c_and UNION ALL SELECT doc_id, 0.5 / (60 + rank) FROM c_or UNION ALL SELECT doc_id, 1.5 / (60 + rank) FROM c_idn)
SELECT doc_id, round(sum(CAST(p AS DOUBLE)), 9) AS score, count(*) AS channels FROM part GROUP BY doc_id""",
)
def rrf(spark: SparkSession, d: str) -> DataFrame:
    rows, by = _documents(spark, d), [F.desc("score"), F.asc("doc_id")]
    every = search.ranked(search.top(postings.bm25(opened(spark, d), TERMS), by, 60), by)
    some = search.ranked(search.top(postings.bm25(opened(spark, d), ["smlouva"]), by, 60), by)
    key = rows.where(F.col("text").contains("Listiny")).select("doc_id", F.expr("(length(text) - length(replace(text, 'Listiny', ''))) / 7").alias("score"))
    return search.fuse({"and": every, "or": some, "idn": search.ranked(search.top(key, by, 60), by)}, "doc_id")


@query(
    "U5_interleave",
    f"""WITH {_bm25_sql(["smlouva"], name="a")}, {_bm25_sql(["žaloba"], name="b")},
l AS (SELECT doc_id, 1 AS variant, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a QUALIFY rank <= 40 UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 40),
f AS (SELECT doc_id, variant, rank FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank, variant) = 1)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, variant, CAST(row_number() OVER (ORDER BY rank, variant) AS INTEGER) AS position FROM f""",
)
def interleave(spark: SparkSession, d: str) -> DataFrame:
    rows, by = _documents(spark, d), [F.desc("score"), F.asc("doc_id")]
    lists = None
    for variant, term in enumerate(["smlouva", "žaloba"], 1):
        part = search.ranked(search.top(postings.bm25(opened(spark, d), [term]), by, 40), by).select("doc_id", F.lit(variant).alias("variant"), "rank")
        lists = part if lists is None else lists.unionByName(part)
    return search.interleave(lists, "variant", "rank", "doc_id")


@query(
    "R4_ident_channel",
    "SELECT decision_id, ord, CAST(len(list_intersect(ident_keys, ['par:160', 'par:1741', 'par:2246', 'par:2828'])) AS INTEGER) AS keys FROM (SELECT DISTINCT decision_id, ord, ident_keys FROM decision_chunk) WHERE list_has_any(ident_keys, ['par:160', 'par:1741', 'par:2246', 'par:2828'])",
)
def ident_channel(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in ("par:160", "par:1741", "par:2246", "par:2828")])
    chunks = table(spark, d, "decision_chunk").select("decision_id", "ord", "ident_keys").where(F.arrays_overlap("ident_keys", keys)).distinct()
    return chunks.select("decision_id", "ord", F.size(F.array_intersect("ident_keys", keys)).alias("keys"))


LINES_SQL = "line AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), scored AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST((length(line) - length(replace(line, 'soud', ''))) / 4 AS INTEGER) AS score FROM line WHERE line LIKE '%soud%')"


def _scored_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line")).where(F.col("line").contains("soud"))
    return rows.select("doc_id", "ord", F.expr("cast((length(line) - length(replace(line, 'soud', ''))) / 4 as int)").alias("score"))


@query("W1_per_doc_cap", f"WITH {LINES_SQL}, n AS (SELECT doc_id, count(*) AS total FROM scored GROUP BY doc_id) SELECT doc_id, ord, score, total - least(total, 3) AS more FROM scored JOIN n USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) <= 3")
def per_doc_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored_lines(spark, d)
    best = search.per_group(rows, ["doc_id"], [F.desc("score"), F.asc("ord")], 3)
    total = rows.groupBy("doc_id").agg(F.count("*").alias("total"))
    return best.join(total, "doc_id").select("doc_id", "ord", "score", (F.col("total") - F.least("total", F.lit(3))).alias("more"))


@query("W5_best_chunk", f"WITH {LINES_SQL} SELECT DISTINCT ON (doc_id) doc_id, ord, score FROM scored ORDER BY doc_id, score DESC, ord")
def best_chunk(spark: SparkSession, d: str) -> DataFrame:
    best = _scored_lines(spark, d).groupBy("doc_id").agg(F.max_by(F.struct("ord", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("doc_id", "b.*")


@query(
    "A15_eval_metrics",
    f"""WITH {_bm25_sql(['smlouva'], extra=", doc_kind")}, r AS (SELECT doc_kind, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM hit QUALIFY rank <= 50)
SELECT count(*) FILTER (doc_kind = 'rozsudek') AS relevant, round(1.0 / min(rank) FILTER (doc_kind = 'rozsudek'), 6) AS mrr, round(count(*) FILTER (doc_kind = 'rozsudek' AND rank <= 10) / 10.0, 6) AS precision_10 FROM r""",
)
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    by = [F.desc("score"), F.asc("doc_id")]
    hits = search.ranked(search.top(postings.bm25(opened(spark, d), ["smlouva"], ["doc_kind"]), by, 50), by)
    good = F.col("doc_kind") == "rozsudek"
    return hits.agg(F.count_if(good).alias("relevant"), F.round(1.0 / F.min(F.when(good, F.col("rank"))), 6).alias("mrr"), F.round(F.count_if(good & (F.col("rank") <= 10)) / 10.0, 6).alias("precision_10"))


@query(
    "PR10_snippet",
    """WITH h AS (SELECT doc_id, text, substr(text, 1, 400) AS h, 400 - length(string_split(reverse(substr(text, 1, 400)), ' ')[1]) - 1 AS cut FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE rtrim(CASE WHEN contains(h, ' ') AND cut >= 240 THEN substr(h, 1, cut) ELSE h END, ' ') || '…' END AS snippet FROM h""",
)
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where("text is not null").select("doc_id", snippet(F.col("text")).alias("snippet"))
