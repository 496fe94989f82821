"""An inverted index of texts as tables: postings by bucket of their term, the terms' counts, and the documents' lengths.

A search reads the buckets of its terms only, and no text. The tables lie in the shared folder or where the caller says, so
they outlive the session that built them; a build is one pass over the texts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paragraf.functions.text import words
from paragraf.session import checkpoint_dir, kept

#: The usual constants of the ranking formula.
K1, B = 1.2, 0.75
#: Buckets of terms: a search of a few terms opens as many folders.
BUCKETS = 64
#: Words of the texts for each file of a bucket.
FILE_WORDS = 5_000_000
POSTINGS = "term string, doc long, dl int, tf int, bucket int"


@dataclass(frozen=True)
class Index:
    """postings(term, doc, tf, dl, bucket), terms(term, df, bucket), docs(doc, dl, kept columns); documents and mean length."""

    key: str
    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    size: int
    mean: float
    buckets: int
    path: str

    def frequencies(self, wanted: Iterable[str]) -> dict[str, int]:
        """In how many documents each of a search's few terms stands."""
        rows = _of(self.terms, list(wanted), self.buckets).select("term", "df").collect()
        return {r.term: r.df for r in rows}

    def like(self, prefix: str) -> DataFrame:
        """The terms that start with a prefix: a range of the small table of terms."""
        return self.terms.where(F.startswith("term", F.lit(prefix))).select("term", "df")

    def hits(self, wanted: list[str]) -> DataFrame:
        """The postings of the terms."""
        return _of(self.postings, wanted, self.buckets).select(F.col("doc").alias(self.key), "term", "tf", "dl")

    def counts(self, wanted: list[str]) -> DataFrame:
        """(key, matched, score): how many of the terms a document holds, and its BM25 score for them."""
        few = F.broadcast(_of(self.terms, wanted, self.buckets).select("term", "df"))  # a search has few terms
        idf = F.log(1 + (F.lit(self.size) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf = F.col("tf").cast("double")
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(self.mean or 1.0)))
        return self.hits(wanted).join(few, "term").groupBy(self.key).agg(F.count("*").cast("int").alias("matched"), F.sum(part).alias("score"))


def _of(table: DataFrame, wanted: list[str], buckets: int) -> DataFrame:
    # the buckets are numbers in the plan, so that folders are pruned before any is opened
    return table.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % buckets for t in wanted})) & F.col("term").isin(wanted))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def build(df: DataFrame, key: str, text: str, keep: list[str] | None = None, analyse: Callable[[Column], Column] = words, path: str | None = None, buckets: int = BUCKETS) -> Index:
    """Write the index of df's texts; null texts have none, empty ones have length 0. Keys must not repeat.

    keep names columns that go along with the documents, to filter and rank by. A term that many documents hold is spread
    over several files of its bucket."""
    spark = df.sparkSession
    if path is None:
        path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
        kept.append((spark, path))  # removed when the driver ends; one with a folder of its own stays
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("doc"), *(keep or []), F.explode(F.array(analyse(F.col(text)))).alias("w"))
    rows.select("doc", F.size("w").alias("dl"), *(keep or [])).write.mode("overwrite").parquet(f"{path}/docs")
    words = spark.read.parquet(f"{path}/docs").agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("n")).first().n
    files = int(words / (buckets * FILE_WORDS)) + 1  # of each bucket: a frequent term's rows lie in all of them
    held = rows.select("doc", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "doc", "dl").agg(F.count("*").cast("int").alias("tf"))
    held.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition(buckets * files, "bucket", F.pmod(F.xxhash64("doc"), F.lit(files))).sortWithinPartitions("bucket", "term", "doc").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    _read(spark, f"{path}/postings", POSTINGS).groupBy("bucket", "term").agg(F.count("*").alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    return opened(spark, path, key, buckets)


def opened(spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> Index:
    """The index that was written to a folder."""
    docs = spark.read.parquet(f"{path}/docs")
    size = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    postings, terms = (_read(spark, f"{path}/{name}", schema) for name, schema in (("postings", POSTINGS), ("terms", "term string, df long, bucket int")))
    return Index(key, postings, terms, docs.withColumnRenamed("doc", key), size.n, size.mean or 0.0, buckets, path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:  # no term at all: the folder holds no file
        return spark.createDataFrame([], schema)


def ladder(scored: DataFrame, terms: int) -> tuple[DataFrame, str | None]:
    """The rows that hold every term, or, if the whole result has none, all rows; and which it is: and, or, or None."""
    every = scored.where(F.col("matched") == terms)
    if not every.isEmpty():
        return every, "and"
    return scored, None if scored.isEmpty() else "or"


def bm25(index: Index, terms: list[str], keep: list[str] | None = None, within: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """(key, keep, matched, score) of the documents that hold every term, or, if none does, of those that hold any.

    Counts and lengths are those of the whole index. `where` filters by kept columns, `within` by keys, both before the
    choice between every and any."""
    terms = list(dict.fromkeys(terms))
    scored = index.counts(terms)
    if keep or where is not None:
        docs = index.docs if where is None else index.docs.where(where)
        scored = scored.join(docs.select(index.key, *(keep or [])), index.key)
    if within is not None:
        scored = scored.join(within.select(index.key).distinct(), index.key, "left_semi")
    rows, _ = ladder(scored, len(terms))
    return rows.select(index.key, *(keep or []), "matched", F.round("score", 6).alias("score"))


def phrase(index: Index, df: DataFrame, text: str, parts: list[str], analyse: Callable[[Column], Column] = words) -> DataFrame:
    """The keys whose text holds the words next to each other: only texts with all of them, told by the postings, are read."""
    every = index.counts(parts).where(F.col("matched") == len(set(parts))).select(index.key)
    line = F.concat(F.lit(" "), F.array_join(analyse(F.col(text)), " "), F.lit(" "))
    return df.join(every, index.key, "left_semi").where(line.contains(f" {' '.join(parts)} ")).select(index.key)
