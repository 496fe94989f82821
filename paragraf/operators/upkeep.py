"""Keeping derived tables: what changed, what is stale, what is due, and how a source stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def difference(old: DataFrame, new: DataFrame, by: list[str], tracked: list[str], kept: list[str] | None = None) -> DataFrame:
    """new over old, one row per key, with change: inserted, changed, unchanged or missing.

    A row is changed if a tracked column differs, nulls being equal to nulls. A kept column never loses a value to null.
    """
    rest = [c for c in old.columns if c not in by]
    a = old.select(*by, F.struct(*rest).alias("_old"))
    b = new.select(*by, F.struct(*rest).alias("_new"))
    both = a.join(b, by, "full_outer")
    same = F.struct(*[F.col(f"_old.{c}") for c in tracked]).eqNullSafe(F.struct(*[F.col(f"_new.{c}") for c in tracked]))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "missing").when(same, "unchanged").otherwise("changed")
    values = [F.when(F.col("_new").isNull(), F.col(f"_old.{c}")).otherwise(F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")) if c in (kept or []) else F.col(f"_new.{c}")).alias(c) for c in rest]
    return both.select(*by, *values, change.alias("change"))


def stale(rows: DataFrame, state: DataFrame, by: list[str], hash_column: str, version: int) -> DataFrame:
    """The rows whose derivation is missing, of another version, or of another text."""
    done = state.select(*by, F.col(hash_column).alias("_hash"), F.col("version").alias("_version"))
    return rows.join(done, by, "left").where(F.col("_version").isNull() | (F.col("_version") != version) | ~F.col("_hash").eqNullSafe(F.col(hash_column))).drop("_hash", "_version")


def next_try(at: Column, attempts: Column) -> Column:
    """An hour after the first failure, twice as long after each further one, a week at most."""
    return at + F.make_dt_interval(F.lit(0), F.least(F.lit(168), F.pow(F.lit(2), F.least(attempts, F.lit(20))).cast("int")), F.lit(0), F.lit(0))


def replace_children(old: DataFrame, new: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """Children of other parents as they were, those of `parents` as they are now, none if there are none."""
    return old.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(new)


def add_counters(old: DataFrame, new: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Counters with new amounts added; nulls, NaN, infinite amounts and those that aren't above 0 are ignored."""
    good = F.col(amount).isNotNull() & ~F.isnan(amount) & (F.col(amount) > 0) & (F.col(amount) < float("inf"))
    rows = old.select(*by, amount).unionByName(new.where(good).select(*by, amount))
    return rows.groupBy(*by).agg(F.sum(amount).alias(amount))


def refunded(old: DataFrame, back: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Counters less what is given back, never below 0; a counter that isn't there stays away."""
    less = back.groupBy(*by).agg(F.sum(amount).alias("_back"))
    return old.join(less, by, "left").withColumn(amount, F.greatest(F.lit(0), F.col(amount) - F.coalesce("_back", F.lit(0)))).drop("_back")


def grown(old: DataFrame, new: DataFrame, by: list[str], value: str, known: DataFrame, key: str) -> DataFrame:
    """The greater of the old and the new value of each key; rows of keys that `known` doesn't hold are dropped."""
    rows = old.select(*by, value).unionByName(new.select(*by, value)).groupBy(*by).agg(F.max(value).alias(value))
    return rows.join(known.select(key).distinct(), key, "left_semi")


def last_wins(loads: DataFrame, by: list[str], order: Column) -> DataFrame:
    """One row per key, that of the latest load."""
    rest = [c for c in loads.columns if c not in by]
    return loads.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def retained(df: DataFrame, at: str, now: Column, days: Column) -> DataFrame:
    """Rows younger than the days that their kind is kept for."""
    return df.where(F.col(at) > now - F.make_dt_interval(days))


def versioned(rows: DataFrame, edits: DataFrame, by: list[str], version: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts): edits that name the stored version are taken and raise it by one, the others are refused."""
    mine = edits.select(*by, F.col(version).alias("_v"), F.struct(*fields).alias("_e"))
    both = rows.join(mine, by, "left")
    taken = F.coalesce(F.col("_v") == F.col(version), F.lit(False))
    out = both.select(*by, *[F.when(taken, F.col(f"_e.{f}")).otherwise(F.col(f)).alias(f) for f in fields], (F.col(version) + taken.cast("int")).alias(version))
    return out, both.where(F.col("_v").isNotNull() & ~taken).select(*by, F.col(version).alias("stored"), F.col("_v").alias("asked"))


def without_blocked(df: DataFrame, digest: Column, blocked: DataFrame) -> DataFrame:
    """The rows whose content isn't blocked, whoever they belong to; nulls have no content to block."""
    return df.withColumn("_sha", digest).join(blocked.select(F.col(blocked.columns[0]).alias("_sha")).distinct(), "_sha", "left_anti").drop("_sha")


def scoped(df: DataFrame, by: str, *scopes: DataFrame) -> DataFrame:
    """The rows that lie within every scope. Scopes hold the keys that may be seen; an empty one shows nothing."""
    for scope in scopes:
        df = df.join(scope.select(by).distinct(), by, "left_semi")
    return df


def corrected(rows: DataFrame, truth: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """The rows of `rows` whose fields differ from the truth, nulls being equal to nulls, with the true values."""
    told = truth.select(*by, F.struct(*fields).alias("_t"))
    return rows.join(told, by).where(~F.struct(*fields).eqNullSafe(F.col("_t"))).select(*by, *[F.col(f"_t.{f}").alias(f) for f in fields])


def merged_keys(stored: Column, old: Column, new: Column) -> Column:
    """Stored keys without the old ones, then the new ones; each once."""
    return F.array_union(F.array_except(stored, old), new)
