"""Queries of identifiers and statute references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.functions import identifiers as ids
from paragraf.operators import provisions
from paragraf.plans.catalogue import query, table
from paragraf.plans.retrieval import BODY, bodies


def _re(pattern: str) -> str:
    """A pattern in the other engine's words."""
    return pattern.replace("(?iu)", "(?i)").replace("\\u00a0", "\\x{A0}").replace("'", "''")


_YEAR = "CASE WHEN length({0}) = 2 THEN CAST(CAST({0} AS INTEGER) + CASE WHEN CAST({0} AS INTEGER) <= 40 THEN 2000 ELSE 1900 END AS VARCHAR) ELSE {0} END"


def _all(column: str, pattern: str, n: int) -> str:
    return ", ".join(f"unnest(regexp_extract_all({column}, '{_re(pattern)}', {i})) AS g{i}" for i in range(1, n + 1))


CASES = f"refs AS (SELECT decision_id, {_all('body', ids.CASE, 4)} FROM body), cased AS (SELECT decision_id, 'sz:' || lower(g1) || ' ' || lower(g2) || ' ' || regexp_replace(g3, '^0+([0-9])', '\\1') || '/' || {_YEAR.format('g4')} AS ident FROM refs)"
IDENTS = f"""{BODY}, {CASES},
found AS (SELECT decision_id, 'case' AS kind, ident FROM cased
UNION ALL SELECT decision_id, 'ecli', lower('ecli:' || g1 || ':' || g2 || ':' || g3 || ':' || rtrim(g4, '.')) FROM (SELECT decision_id, {_all('body', ids.ECLI, 4)} FROM body)
UNION ALL SELECT decision_id, 'act', 'zak:' || g1 || '/' || g2 FROM (SELECT decision_id, {_all('body', ids.ACT, 2)} FROM body)
UNION ALL SELECT decision_id, 'eu', 'eu:3' || CASE WHEN length(y) = 2 THEN '19' || y ELSE lpad(y, 4, '0') END || l || lpad(n, 4, '0') FROM (SELECT *, CASE WHEN f THEN g2 ELSE g3 END AS y, CASE WHEN f THEN g3 ELSE g2 END AS n, CASE lower(g1)[1:2] WHEN 'sm' THEN 'L' WHEN 'na' THEN 'R' ELSE 'D' END AS l FROM (SELECT *, length(g2) = 4 OR (length(g3) <> 4 AND lower(g1) LIKE 'sm%') AS f FROM (SELECT decision_id, {_all('body', ids.EU_ACT, 3)} FROM body))))"""


@query("X16_identifiers", f"WITH {IDENTS} SELECT decision_id, kind, ident, count(*) AS mentions FROM found GROUP BY ALL")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    return ids.keys(bodies(spark, d), "decision_id", "body").where("kind <> 'doi'")


OWN = "own AS (SELECT DISTINCT id, 'sz:' || lower(unnest(case_numbers)) AS ident FROM decision)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """(decision_id, ident, mentions, cited_id): cases that a body names, joined with the decisions that bear the number.

    Numbers that many texts name meet a short list of bearers, each number's bearers being few; the own number is no edge."""
    cited = ids.keys(bodies(spark, d), "decision_id", "body").where("kind = 'case'").select("decision_id", "ident", "mentions")
    own = table(spark, d, "decision").select(F.col("id").alias("cited_id"), F.explode("case_numbers").alias("n")).select("cited_id", F.concat(F.lit("sz:"), F.lower("n")).alias("ident")).distinct()
    named = own.select("ident").distinct()
    return cited.join(named, "ident", "left_semi").join(own, "ident").where("cited_id <> decision_id")


@query("J3_citation_edges", f"WITH {BODY}, {CASES}, {OWN}, m AS (SELECT decision_id, ident, count(*) AS mentions FROM cased GROUP BY ALL) SELECT decision_id AS citing_id, ident AS key, id AS cited_id, mentions FROM m JOIN own USING (ident) WHERE id <> decision_id")
def citation_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select(F.col("decision_id").alias("citing_id"), F.col("ident").alias("key"), "cited_id", "mentions")


@query("J4_cited_by", f"WITH {BODY}, {CASES}, {OWN}, m AS (SELECT decision_id, ident, count(*) AS mentions FROM cased GROUP BY ALL) SELECT id AS cited_id, count(DISTINCT decision_id) AS citing, CAST(sum(mentions) AS BIGINT) AS mentions FROM m JOIN own USING (ident) WHERE id <> decision_id GROUP BY id")
def cited_by(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("cited_id").agg(F.count_distinct("decision_id").alias("citing"), F.sum("mentions").alias("mentions"))


@query("R26_by_case", f"WITH {BODY}, {CASES} SELECT DISTINCT decision_id, ident FROM cased WHERE ident IN (SELECT ident FROM (SELECT ident, count(DISTINCT decision_id) AS n FROM cased GROUP BY 1 ORDER BY n DESC, ident LIMIT 5))")
def by_case(spark: SparkSession, d: str) -> DataFrame:
    cases = ids.keys(bodies(spark, d), "decision_id", "body").where("kind = 'case'").select("decision_id", "ident")
    most = cases.groupBy("ident").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ident").limit(5)
    return cases.join(F.broadcast(most.select("ident")), "ident", "left_semi")


@query("X37_case_parts", rf"WITH c AS (SELECT DISTINCT id, unnest(case_numbers) AS n FROM decision) SELECT id, n, regexp_extract(n, '^(\S+) (\p{{L}}+) (\d+)/(\d+)', 1) AS senate, regexp_extract(n, '^(\S+) (\p{{L}}+) (\d+)/(\d+)', 2) AS registry, try_cast(regexp_extract(n, '^(\S+) (\p{{L}}+) (\d+)/(\d+)', 3) AS INTEGER) AS number FROM c WHERE n IS NOT NULL")
def case_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision").select("id", F.explode("case_numbers").alias("n")).where("n is not null").distinct()
    part = lambda i: F.regexp_extract("n", r"^(\S+) (\p{L}+) (\d+)/(\d+)", i)
    return rows.select("id", "n", part(1).alias("senate"), part(2).alias("registry"), part(3).try_cast("int").alias("number"))


@query("PR2_court_of_key", f"WITH {BODY}, {CASES}, r AS (SELECT DISTINCT ident, string_split(ident, ' ')[2] AS reg FROM cased) SELECT ident, CASE WHEN reg = 'ús' THEN 'us' WHEN reg IN ('cdo', 'tdo', 'odo', 'nd', 'ncu', 'icdo') THEN 'ns' WHEN reg IN ('as', 'afs', 'azs', 'ads', 'ans', 'aos') THEN 'nss' END AS court, CASE WHEN regexp_matches(ident, '^sz:[ivx]+[.] ') THEN upper(substr(string_split(ident, ' ')[1], 4)) ELSE upper(substr(ident, 4, 1)) || substr(string_split(ident, ' ')[1], 5) END || ' ' || CASE WHEN reg = 'ús' THEN 'ÚS' ELSE upper(reg[1]) || reg[2:] END || ' ' || string_split(ident, ' ')[3] AS shown FROM r")
def court_of_key(spark: SparkSession, d: str) -> DataFrame:
    cases = ids.keys(bodies(spark, d), "decision_id", "body").where("kind = 'case'").select("ident").distinct()
    return cases.select("ident", ids.court_of_key(F.col("ident")).alias("court"), ids.displayed(F.col("ident")).alias("shown"))


@query("PR15_celex_of_case", "WITH n AS (SELECT DISTINCT user_id, event_id FROM events) SELECT event_id, '6' || CAST(1960 + event_id % 60 AS VARCHAR) || CASE WHEN user_id % 2 = 0 THEN 'C' ELSE 'T' END || 'J' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS celex FROM n")
def celex_of_case(spark: SparkSession, d: str) -> DataFrame:
    """Case numbers written with two digits of the year, as C-8/81; the pivot tells the century."""
    rows = table(spark, d, "events").select("user_id", "event_id").distinct()
    written = F.concat(F.when(F.col("user_id") % 2 == 0, "C-").otherwise("T-"), "user_id", F.lit("/"), F.lpad(((F.col("event_id") % 60 + 60) % 100).cast("string"), 2, "0"))
    return rows.select("event_id", ids.celex_of_case(written, 59).alias("celex"))


@query("X17_issn", rf"WITH p AS (SELECT DISTINCT record_id, unnest(regexp_extract_all(payload, '{_re(ids.ISSN)}', 1)) AS a, unnest(regexp_extract_all(payload, '{_re(ids.ISSN)}', 2)) AS b FROM upstream_record WHERE payload IS NOT NULL), s AS (SELECT *, a || upper(b) AS t FROM p), c AS (SELECT *, (11 - (" + " + ".join(f"CAST(t[{i}] AS INTEGER) * {9 - i}" for i in range(1, 8)) + ") % 11) % 11 AS k FROM s) SELECT DISTINCT record_id, a || '-' || b AS issn, t[8] = CASE WHEN k = 10 THEN 'X' ELSE CAST(k AS VARCHAR) END AS valid FROM c")
def issn(spark: SparkSession, d: str) -> DataFrame:
    groups = F.arrays_zip(*[F.regexp_extract_all(F.col("payload"), F.lit(ids.ISSN), i).alias(f"g{i}") for i in (1, 2)])
    rows = table(spark, d, "upstream_record").where("payload is not null").select("record_id", F.explode(groups).alias("g"))
    return rows.select("record_id", F.concat_ws("-", "g.g1", "g.g2").alias("issn"), ids.issn_valid(F.col("g.g1"), F.col("g.g2")).alias("valid")).distinct()


_SHORT_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in provisions.SHORT.items()) + "}"
_EXPAND = "list_transform(string_split(regexp_replace(replace({0}, ')', ''), ',[ \\x{{A0}}]?|[ \\x{{A0}}]a[ \\x{{A0}}]', ';', 'g'), ';'), lambda i: string_split(regexp_replace(i, '[ \\x{{A0}}]až[ \\x{{A0}}]|–', ';'), ';'))"
REFS = f"""{BODY}, g AS (SELECT decision_id, {_all('body', provisions.GRAMMAR, 6)}, unnest(range(len(regexp_extract_all(body, '{_re(provisions.GRAMMAR)}')))) AS n FROM body),
a AS (SELECT *, CASE WHEN g5 <> '' THEN 'zak:' || g5 WHEN g6 <> '' THEN ({_SHORT_SQL})[replace(g6, chr(160), ' ')] END AS own FROM g),
b AS (SELECT decision_id, n, last_value(own IGNORE NULLS) OVER (PARTITION BY decision_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS act, CASE WHEN g1 = 'čl.' THEN 'cl:' ELSE 'par:' END AS k,
unnest({_EXPAND.format('g2')}) AS s, CASE WHEN g3 <> '' THEN {_EXPAND.format('g3')} ELSE [[NULL]] END AS os, CASE WHEN g4 <> '' THEN {_EXPAND.format('g4')} ELSE [[NULL]] END AS ps FROM a),
c AS (SELECT decision_id, n, act, k, s, unnest(os) AS o, ps FROM b), d AS (SELECT decision_id, n, act, k, s, o, unnest(ps) AS p FROM c),
e AS (SELECT decision_id, n, act, k, unnest(CASE WHEN len(s) = 2 AND try_cast(s[1] AS INTEGER) <= try_cast(s[2] AS INTEGER) AND try_cast(s[2] AS INTEGER) - try_cast(s[1] AS INTEGER) < 30 THEN list_transform(range(CAST(s[1] AS INTEGER), CAST(s[2] AS INTEGER) + 1), lambda x: CAST(x AS VARCHAR)) ELSE s END) AS s, o, p FROM d),
f AS (SELECT decision_id, n, act, k, s, unnest(CASE WHEN len(o) = 2 AND try_cast(o[1] AS INTEGER) <= try_cast(o[2] AS INTEGER) THEN list_transform(range(CAST(o[1] AS INTEGER), CAST(o[2] AS INTEGER) + 1), lambda x: CAST(x AS VARCHAR)) ELSE o END) AS o, p FROM e),
ref AS (SELECT decision_id, CAST(n AS INTEGER) AS n, act, k || s || coalesce('/o' || o, '') || coalesce('/p' || unnest(CASE WHEN len(p) = 2 AND p[1] <= p[2] THEN list_transform(range(ascii(p[1]), ascii(p[2]) + 1), lambda x: chr(CAST(x AS INTEGER))) ELSE p END), '') AS provision FROM f)"""


def _references(spark: SparkSession, d: str) -> DataFrame:
    return provisions.references(bodies(spark, d), "decision_id", "body")


@query("X23_references", f"WITH {REFS} SELECT decision_id, n, act, provision FROM ref")
def references(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d)


_RECODED = "CASE" + "".join(f" WHEN g5 = '' AND own = '{new}' AND y < {since} THEN '{old}'" for new, (since, old) in provisions.RECODED.items()) + " ELSE own END"
REFS_BY_YEAR = REFS.replace("FROM a),", f"FROM (SELECT * REPLACE ({_RECODED} AS own) FROM a LEFT JOIN (SELECT id, max(year(decided_on)) AS y FROM decision GROUP BY id) ON id = decision_id)),", 1)


@query("X24_acts_by_year", f"WITH {REFS_BY_YEAR} SELECT act, count(*) AS mentions, count(DISTINCT decision_id) AS decisions FROM ref GROUP BY act")
def acts_by_year(spark: SparkSession, d: str) -> DataFrame:
    """References with the code in force in the year of the decision."""
    years = table(spark, d, "decision").groupBy(F.col("id").alias("decision_id")).agg(F.max(F.year("decided_on")).alias("y"))
    rows = provisions.references(bodies(spark, d).join(years, "decision_id", "left"), "decision_id", "body", "y")
    return rows.groupBy("act").agg(F.count("*").alias("mentions"), F.count_distinct("decision_id").alias("decisions"))


@query("F11_act_filter", f"WITH {REFS} SELECT DISTINCT decision_id FROM ref WHERE act = 'zak:99/1963' OR decision_id IN (SELECT decision_id FROM ref WHERE provision LIKE 'par:24%')")
def act_filter(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).where((F.col("act") == "zak:99/1963") | F.startswith("provision", F.lit("par:24"))).select("decision_id").distinct()


@query("G8_section_ranges", f"WITH {REFS} SELECT act, min(CAST(regexp_extract(provision, '^par:([0-9]+)', 1) AS INTEGER)) AS low, max(CAST(regexp_extract(provision, '^par:([0-9]+)', 1) AS INTEGER)) AS high, count(DISTINCT decision_id) AS decisions FROM ref WHERE provision LIKE 'par:%' AND act IS NOT NULL GROUP BY act")
def section_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = _references(spark, d).where("provision like 'par:%' and act is not null")
    number = F.regexp_extract("provision", "^par:([0-9]+)", 1).cast("int")
    return rows.groupBy("act").agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count_distinct("decision_id").alias("decisions"))


@query("PR12_section_range", f"WITH {REFS}, n AS (SELECT decision_id, act, provision, CAST(regexp_extract(provision, '^par:([0-9]+)', 1) AS INTEGER) AS n FROM ref WHERE provision LIKE 'par:%' AND act IS NOT NULL) SELECT decision_id, act, arg_min(provision, (n, provision)) AS low, arg_max(provision, (n, provision)) AS high FROM n GROUP BY ALL")
def section_range(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last provision of an act that a text refers to, by number."""
    number = F.struct(F.regexp_extract("provision", "^par:([0-9]+)", 1).cast("int"), F.col("provision"))
    rows = _references(spark, d).where("provision like 'par:%' and act is not null")
    return rows.groupBy("decision_id", "act").agg(F.min_by("provision", number).alias("low"), F.max_by("provision", number).alias("high"))


@query("R30_answers_by_act", f"WITH {REFS} SELECT act, min(decision_id) AS first_decision, count(*) AS n FROM ref WHERE provision LIKE 'par:24%' AND act IS NOT NULL GROUP BY act")
def answers_by_act(spark: SparkSession, d: str) -> DataFrame:
    rows = _references(spark, d).where(F.startswith("provision", F.lit("par:24")) & F.col("act").isNotNull())
    return rows.groupBy("act").agg(F.min("decision_id").alias("first_decision"), F.count("*").alias("n"))


@query("X25_act_lookup", f"WITH a AS (SELECT p_brand AS alias, p_partkey AS act, 1990 + p_size % 20 AS issued FROM part), ask AS (SELECT DISTINCT p_brand AS alias, 1995 + p_size % 5 AS y FROM part) SELECT ask.alias, y, coalesce((SELECT arg_max(act, (issued, act)) FROM a WHERE a.alias = ask.alias AND issued <= y), (SELECT arg_min(act, (issued, act)) FROM a WHERE a.alias = ask.alias)) AS act FROM ask")
def act_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    acts = part.select(F.col("p_brand").alias("alias"), F.col("p_partkey").alias("act"), (F.lit(1990) + F.col("p_size") % 20).alias("issued"))
    asked = part.select(F.col("p_brand").alias("alias"), (F.lit(1995) + F.col("p_size") % 5).alias("y")).distinct()
    return provisions.resolved(asked, "alias", acts, "y").select("alias", "y", "act")


@query("G1_neighbour_sections", "WITH k AS (SELECT DISTINCT CAST(regexp_extract(key, '^par:([0-9]+)$', 1) AS INTEGER) AS n FROM (SELECT unnest(ident_keys) AS key FROM decision_chunk) WHERE regexp_matches(key, '^par:[0-9]+$')), o AS (SELECT n, lag(n) OVER (ORDER BY n) AS below, lead(n) OVER (ORDER BY n) AS above FROM k) SELECT n, below, above FROM o WHERE n BETWEEN 1000 AND 1100")
def neighbour_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a range with their neighbours: what lies just below and above comes along, so that no window sees all."""
    from pyspark.sql import Window

    keys = table(spark, d, "decision_chunk").select(F.explode("ident_keys").alias("key")).where(F.col("key").rlike("^par:[0-9]+$")).select(F.regexp_extract("key", "^par:([0-9]+)$", 1).cast("int").alias("n")).distinct()
    near = keys.where("n < 1000").agg(F.max("n").alias("n")).unionByName(keys.where("n > 1100").agg(F.min("n").alias("n"))).unionByName(keys.where("n between 1000 and 1100")).where("n is not null")
    by = Window.partitionBy(F.lit(0)).orderBy("n")  # a hundred sections
    return near.select("n", F.lag("n").over(by).alias("below"), F.lead("n").over(by).alias("above")).where("n between 1000 and 1100")
