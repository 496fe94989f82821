"""Jobs from the shell: python -m paragraf.jobs JOB --tables FOLDER --out FOLDER writes one derived table as Parquet."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paragraf.functions import identifiers
from paragraf.operators import chunks, postings, provisions, structure
from paragraf.session import clear, local_session, prepare


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/decision_text.parquet").where("body is not null").dropDuplicates(["decision_id"])


#: What each job derives from the decisions' texts.
JOBS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "chunks": lambda b: chunks.chunks(b, "decision_id", "body"),
    "sections": lambda b: structure.sections(b, "decision_id", "body"),
    "references": lambda b: provisions.references(b, "decision_id", "body"),
    "identifiers": lambda b: identifiers.keys(b, "decision_id", "body"),
}


def run(spark: SparkSession, job: str, tables: str, out: str) -> None:
    """Write the job's table, or for `index` the tables of the search index; what was cut on the way is removed."""
    bodies = _bodies(prepare(spark), tables)
    if job == "index":
        postings.build(bodies, "decision_id", "body", ["source"], path=out)
    else:
        JOBS[job](bodies).write.mode("overwrite").parquet(out)
    clear(spark)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="paragraf.jobs")
    parser.add_argument("job", choices=sorted([*JOBS, "index"]))
    parser.add_argument("--tables", required=True)
    parser.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    active = SparkSession.getActiveSession()
    spark = active or local_session()
    try:
        run(spark, args.job, args.tables, args.out)
    finally:
        if active is None:
            spark.stop()


if __name__ == "__main__":
    main()
