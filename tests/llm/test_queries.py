"""Queries of the operators over small tables of their own."""

from __future__ import annotations

import __spark_entry__
from tests.llm.test_texts import CZECH, garble


def tables(spark, folder, **frames):
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


DOCUMENTS = ([(i, "cs", f"{CZECH} Dne {i}. května 2010 vyložil Šárčin úřad ťukání ďáblů – č. j. {i} C 5/2010, ňadra óda Ó Ň Ď Ť Ů Ý É Á Í Ú „věc“ § 5.") for i in range(60)], "doc_id long, lang string, text string")
BLOCK = "array<struct<texts:array<struct<text:string>>>>"


def finaldoc(header=None, verdict=None, justification=None, uuid="u"):
    return (uuid, *([([(t,) for t in b],) for b in part] if part is not None else None for part in (header, verdict, justification)))


def test_restored_covers_final_documents(spark, tmp_path):
    bad = garble(CZECH, "cp1252", "utf-8")
    entries = [finaldoc([[CZECH], [CZECH, bad]], [], [[bad], None or []]), finaldoc([[CZECH], [CZECH, bad]], [], [[bad], []]), finaldoc(None, [["Rozhodnut� soudu"]], None, "v"), finaldoc([[bad]], uuid=None)]
    d = tables(
        spark, tmp_path, documents=DOCUMENTS, decision_text=([(1, CZECH + "\n" + bad), (1, CZECH + "\n" + bad), *((i, f"{CZECH} {i}") for i in range(2, 60))], "decision_id long, body string"),
        justice_finaldoc=(entries, f"uuid string, header {BLOCK}, verdict {BLOCK}, justification {BLOCK}"),
    )
    got = [tuple(r)[:6] for r in __spark_entry__.queries()["p5_restored"](spark, d).collect()]
    assert sorted(got) == [
        ("body", "1", 0, 0, CZECH + "\n" + CZECH, 0), ("header", "u", 1, 1, CZECH, 0), ("justification", "u", 0, 0, CZECH, 0), ("verdict", "v", 0, 0, "Rozhodnut� soudu", 1),
    ]
    assert {r[:4] for r in got} == {tuple(r) for r in __spark_entry__.queries()["p5_found"](spark, d).collect()}


def test_what_is_frequent_in_the_field_is_judged_too(spark, tmp_path):
    chains = [("cp1252", "utf-8"), ("cp1250", "utf-8"), ("cp1252", "cp1250"), ("cp1250", "cp852")]
    lead = "Obyčejný úvod. " * 500  # what comes after it counts as well
    notice = "© 2010 Všechna práva vyhrazena"
    for k, chain in enumerate(chains):
        bodies = [(i, f"{lead}\n{notice}\n{garble(CZECH, *chain) if i % 3 == 0 else CZECH}") for i in range(30)]
        d = tables(spark, tmp_path / str(k), documents=DOCUMENTS, decision_text=(bodies, "decision_id long, body string"), justice_finaldoc=([], f"uuid string, header {BLOCK}, verdict {BLOCK}, justification {BLOCK}"))
        got = {r.record_key: r.restored for r in __spark_entry__.queries()["p5_restored"](spark, d).collect()}
        assert got == {str(i): f"{lead}\n{notice}\n{CZECH}" for i in range(0, 30, 3)}, chain


def test_clean_keeps_bodies_without_a_court(spark, tmp_path):
    line = "společný dlouhý řádek pro všechny dokumenty"
    bodies = [(i, f"vlastní {i}\n{line}") for i in range(10)] + [(10, f"bez soudu\n{line}"), (11, line), (11, line), (12, None)]
    courts = [(i, "Soud A") for i in range(10)] + [(10, None)]
    d = tables(spark, tmp_path, decision_text=(bodies, "decision_id long, body string"), decision=(courts, "id long, court string"))
    got = sorted(tuple(r) for r in __spark_entry__.queries()["p1_clean"](spark, d).collect())
    assert got == [(i, f"vlastní {i}", 1) for i in range(10)] + [(10, f"bez soudu\n{line}", 0), (11, line, 0)]
