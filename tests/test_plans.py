"""The plans that matter at scale: filters reach the scan, top-k stays top-k, caps are limited before the shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__
from paragraf.operators import search
from paragraf.sources.requests import Request

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_request_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{DATA}/decision.parquet").where(Request(sources=("justice",), since="2015-01-01").predicate()).select("id")
    text = plan(df)
    assert "PushedFilters: [" in text and "GreaterThanOrEqual(decided_on" in text and "legal_sentence" not in text.split("ReadSchema")[-1]


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(__spark_entry__.queries()["R1_bm25_and_or"](spark, DATA))


def test_caps_are_limited_within_tasks(spark):
    rows = spark.read.parquet(f"{DATA}/decision_chunk.parquet")
    assert "WindowGroupLimit" in plan(search.per_group(rows, ["decision_id"], [F.desc("char_start")], 3))


def test_no_query_crosses_tables(spark):
    for name in ("J3_citation_edges", "J7_asof_view", "J9_offsets_in_chunks", "F16_leaf_keys", "p2_found"):
        text = plan(__spark_entry__.queries()[name](spark, DATA))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_jobs_write_tables(spark, tmp_path):
    from paragraf import jobs
    from paragraf.operators import postings

    for job in ("sections", "references", "index"):
        jobs.main([job, "--tables", DATA, "--out", str(tmp_path / job)])
    assert {r.kind for r in spark.read.parquet(str(tmp_path / "sections")).select("kind").distinct().collect()} >= {"zahlavi", "vyrok", "oduvodneni"}
    assert spark.read.parquet(str(tmp_path / "references")).count() > 0
    assert postings.bm25(postings.opened(spark, str(tmp_path / "index"), "decision_id"), ["soud"]).count() > 0


def test_a_cleared_index_is_built_again(spark):
    import shutil

    from paragraf.plans.search import opened

    first = opened(spark, DATA)
    assert opened(spark, DATA).path == first.path
    shutil.rmtree(first.path.removeprefix("file:"))
    assert opened(spark, DATA).path != first.path
    assert __spark_entry__.queries()["R1_bm25_filtered"](spark, DATA).count() > 0
