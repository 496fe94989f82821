"""Queries of statute references in the decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.operators import provisions
from paragraf.plans.catalogue import query, table

_REF = r"§[ \x{A0}]?(\d{1,4}[a-z]?)(?:[ \x{A0}]odst\.[ \x{A0}](\d{1,2}))?(?:[ \x{A0}]písm\.[ \x{A0}]([a-z])\))?"
_BODY = "body AS (SELECT decision_id, any_value(body) AS body FROM decision_text WHERE body IS NOT NULL GROUP BY 1)"
_KEYS = f"""{_BODY}, r AS (SELECT decision_id, unnest(regexp_extract_all(body, '{_REF}', 1)) AS a, unnest(regexp_extract_all(body, '{_REF}', 2)) AS b, unnest(regexp_extract_all(body, '{_REF}', 3)) AS c FROM body),
k AS (SELECT decision_id, 'par:' || a AS provision FROM r UNION ALL SELECT decision_id, 'par:' || a || '/o' || b FROM r WHERE b <> '' UNION ALL SELECT decision_id, 'par:' || a || CASE WHEN b <> '' THEN '/o' || b ELSE '' END || '/p' || c FROM r WHERE c <> '')"""


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision_text").where("body is not null").select("decision_id", "body").dropDuplicates(["decision_id"])


@query("A3_provision_counts", f"WITH {_KEYS} SELECT decision_id, provision, count(*) AS mentions FROM k GROUP BY ALL")
def provision_counts(spark: SparkSession, d: str) -> DataFrame:
    return provisions.provision_counts(_bodies(spark, d), "decision_id", "body")


@query("R25_leaf_provisions", f"WITH {_KEYS}, n AS (SELECT decision_id, provision, count(*) AS mentions FROM k GROUP BY ALL) SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n AS m WHERE m.decision_id = n.decision_id AND starts_with(m.provision, n.provision || '/'))")
def leaf_provisions(spark: SparkSession, d: str) -> DataFrame:
    rows = provisions.provision_counts(_bodies(spark, d), "decision_id", "body")
    parent = rows.select("decision_id", F.explode(F.array(F.regexp_extract("provision", r"^(.*)/[^/]*$", 1), F.regexp_extract("provision", r"^([^/]*)/.*$", 1))).alias("provision")).where("provision <> ''").distinct()
    return rows.join(parent, ["decision_id", "provision"], "left_anti")


@query("X21_act_counts", rf"WITH {_BODY} SELECT decision_id, 'zak:' || act AS act, count(*) AS mentions FROM (SELECT decision_id, unnest(regexp_extract_all(body, 'č\.[ \x{{A0}}](\d{{1,4}}/\d{{4}})[ \x{{A0}}]Sb\.', 1)) AS act FROM body) GROUP BY ALL")
def act_counts(spark: SparkSession, d: str) -> DataFrame:
    return provisions.act_counts(_bodies(spark, d), "decision_id", "body")


@query("R24_provision_search", f"WITH {_KEYS}, h AS (SELECT decision_id, count(*) AS mentions FROM k WHERE provision = (SELECT provision FROM k GROUP BY provision ORDER BY count(DISTINCT decision_id) DESC, provision LIMIT 1) GROUP BY 1), t AS (SELECT id, max(decided_on) AS decided_on FROM decision GROUP BY id) SELECT decision_id, mentions, decided_on FROM h LEFT JOIN t ON id = decision_id ORDER BY decided_on DESC NULLS LAST, decision_id LIMIT 30")
def provision_search(spark: SparkSession, d: str) -> DataFrame:
    rows = provisions.provision_counts(_bodies(spark, d), "decision_id", "body")
    most = rows.groupBy("provision").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "provision").limit(1)
    dates = table(spark, d, "decision").groupBy(F.col("id").alias("decision_id")).agg(F.max("decided_on").alias("decided_on"))
    hits = rows.join(most, "provision", "left_semi").join(dates, "decision_id", "left")
    return hits.select("decision_id", "mentions", "decided_on").orderBy(F.desc_nulls_last("decided_on"), "decision_id").limit(30)
