"""Joins that SQL has no word for: the latest row before a moment, spans that contain a point, links of a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paragraf.session import cut


def asof(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str]) -> DataFrame:
    """left with `take` of the latest right row of the same key at or before it; null where there is none.

    Both sides become one stream for each key, so a row is compared with its neighbour only, never with all.
    """
    key = [F.col(c) for c in by]
    a = left.select(*left.columns, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_r_{c}") for c in take], F.lit(None).cast("boolean").alias("_there"))
    b = right.select(*[(F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c)) for c in left.columns], F.col(right_at).alias("_at"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_r_{c}") for c in take], F.lit(True).alias("_there"))
    upto = Window.partitionBy(*key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_there"), F.struct(*[F.col(f"_r_{c}").alias(c) for c in take])), ignorenulls=True).over(upto)
    return a.unionByName(b).withColumn("_seen", seen).where("_side = 1").select(*left.columns, *[F.col(f"_seen.{c}").alias(c) for c in take])


def within(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Each point with the spans [start, end) that hold it: equal keys and equal bins of `width` first, then the range."""
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end) - 1) / width))))
    return points.withColumn("_bin", F.floor(F.col(at) / width)).join(binned, [*by, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def having_any(df: DataFrame, keys: str, wanted: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The rows that carry one of the wanted keys, over the exploded keys, so that the join is by equality."""
    hits = df.select(*by, F.explode(keys).alias(key)).join(wanted.select(key).distinct(), key, "left_semi").select(*by).distinct()
    return df.join(hits, by, "left_semi")


def ancestors(links: DataFrame, child: str, parent: str, depth: int = 32) -> DataFrame:
    """(child, ancestor, distance) by joining one level at a time, to `depth` levels; a cycle ends there."""
    step = links.where(F.col(parent).isNotNull()).select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).distinct()
    up = step.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_next"))
    out, level = step.withColumn("distance", F.lit(1)), step
    for distance in range(2, depth + 1):
        level = cut(level.join(up, "ancestor").select("child", F.col("_next").alias("ancestor")).distinct())  # so no level is computed again
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("distance", F.lit(distance)))
    return out.groupBy("child", "ancestor").agg(F.min("distance").alias("distance"))


def latest(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """One row of each key, the greatest by order; partial results are combined before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def paths(links: DataFrame, child: str, parent: str, depth: int = 32) -> DataFrame:
    """(node, path, depth) from the nodes without a parent downwards, one level at a time; what hangs on a cycle has none."""
    edges = links.where(F.col(parent).isNotNull()).select(F.col(child).alias("_c"), F.col(parent).alias("_p")).distinct()
    level = links.where(F.col(parent).isNull()).select(F.col(child).alias("node"), F.col(child).alias("path"), F.lit(0).alias("depth")).distinct()
    out = level
    for _ in range(depth):
        level = cut(level.join(edges, F.col("node") == F.col("_p")).select(F.col("_c").alias("node"), F.concat_ws("/", "path", "_c").alias("path"), (F.col("depth") + 1).alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out
