"""Mixing sources to target shares of all tokens by entropy balancing.

Each document gets a rate, how often it is used on average, as close to 1 in relative entropy as the targets allow:
minimise the sum of r log r - r over documents, so that each source's tokens reach its target and no rate exceeds the
source's repeats. The dual has one variable for each source; its optimum tilts the rates exponentially by document size,
r = min(repeats, exp(v * size)). Newton steps on the dual need two sums for each source, which Spark takes over a table
of (source, size, documents), aggregated once. The rates are then rounded into whole copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from paragraf.llm.packing import size_in_tokens
from paragraf.session import cut

#: Newton steps at most, and the relative distance to the target at which a source is done.
STEPS, CLOSE = 60, 1e-9
#: Documents of one source whose rates are rounded together.
ROUNDED = 2_000
#: Sources to be mixed, a table of settings; more of them raise an error.
MOST_SOURCES = 100_000
#: So far may v * size run for the mean size: the bracket that the steps stay in.
FAR = 50.0


def source_key(c: Column) -> Column:
    """Trimmed and lower-cased; blank counts as null."""
    plain = F.lower(F.trim(F.regexp_replace(c, "^[ \\t\\n\\r\\u00a0]+|[ \\t\\n\\r\\u00a0]+$", "")))
    return F.when(plain != "", plain)


def sized(df: DataFrame, key: str, text: str, source: str, targets: DataFrame) -> DataFrame:
    """(doc, source, size) of the documents of the sources in targets; null texts have no size and take no part."""
    rows = df.select(F.col(key).cast("long").alias("doc"), source_key(F.col(source).cast("string")).alias("source"), size_in_tokens(F.col(text).cast("string")).alias("size")).where("doc is not null and source is not null and size is not null")
    return rows.join(targets.select("source"), "source", "left_semi")


def wanted(targets: DataFrame) -> DataFrame:
    """(source, share, repeats), one row per source; rows without a source, or with a negative share, are left out."""
    rows = targets.select(source_key(F.col("source").cast("string")).alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("repeats")).where("source is not null and share >= 0")
    return rows.groupBy("source").agg(F.max("share").alias("share"), F.max("repeats").alias("repeats"))


def solve(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, share, repeats, own, docs, goal, reachable, tilt, residual), one row for each source of targets.

    sizes(source, size, docs) counts the documents of each size. The first step evaluates the dual where it ends, at full
    tilt, where each rate is as high as it may be: a source whose tokens stay below its target even there has a dual
    without an optimum, and is not reachable. For the others Newton steps find the tilt per token, all sources in one job
    each, the sources' state being a small table joined to the sizes; the residual is the distance to the goal as a share
    of it. If one is still above CLOSE after STEPS steps, an error is raised.
    """
    spark = sizes.sparkSession
    size, docs = F.col("size").cast("double"), F.col("docs").cast("double")
    own = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("own"), F.sum("docs").alias("docs"))
    rows = targets.join(own, "source", "left").select("source", "share", "repeats", F.coalesce("own", F.lit(0)).cast("long").alias("own"), F.coalesce("docs", F.lit(0)).cast("long").alias("docs"))
    rows = rows.limit(MOST_SOURCES + 1).collect()  # a table of settings
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources to mix")
    total = sum(r.own for r in rows)
    state = {r.source: {"v": FAR, "lo": -FAR, "hi": FAR, "goal": r.share * total, "repeats": float(r.repeats), "mean": r.own / max(1, r.docs), "residual": None, "reachable": True, "done": False} for r in rows}
    for step in range(STEPS + 1):
        live = {k: x for k, x in state.items() if not x["done"]}
        if not live:
            break
        # the first step is taken at full tilt, where every rate is at its bound
        now = spark.createDataFrame([(k, x["v"] / x["mean"] if x["mean"] and step else math.inf, x["repeats"]) for k, x in live.items()], "source string, v double, top double")
        each = sizes.join(F.broadcast(now), "source")  # at most MOST_SOURCES rows
        rate = F.when(F.col("v") == math.inf, F.col("top")).otherwise(F.least("top", F.exp(F.least(F.lit(700.0), F.col("v") * size))))
        free = F.when(rate < F.col("top"), rate).otherwise(0.0)
        sums = {r.source: r for r in each.groupBy("source").agg(F.sum(docs * size * rate).alias("tokens"), F.sum(docs * size * size * free).alias("slope")).collect()}
        for k, x in live.items():
            tokens = sums[k].tokens if k in sums else 0.0
            gap = tokens - x["goal"]
            if step == 0:
                x["reachable"] = gap >= -CLOSE * x["goal"]
                x["done"] = not x["reachable"] or x["goal"] <= 0 or gap <= CLOSE * x["goal"]
                x["v"] = x["v"] if x["done"] else 0.0
                continue
            x["residual"] = abs(gap) / x["goal"]
            if x["residual"] <= CLOSE:
                x["done"] = True
                continue
            x["hi" if gap > 0 else "lo"] = x["v"]
            slope = sums[k].slope / x["mean"]
            newton = x["v"] - gap / slope if slope > 0 else math.inf
            x["v"] = newton if x["lo"] < newton < x["hi"] else (x["lo"] + x["hi"]) / 2  # a step that leaves the bracket halves it
    left = {k: x["residual"] for k, x in state.items() if not x["done"]}
    if left:
        raise ArithmeticError(f"no tilt found for {sorted(left.items())[:5]} after {STEPS} steps")
    out = [(r.source, float(r.share), int(r.repeats), r.own, r.docs, float(state[r.source]["goal"]), state[r.source]["reachable"], state[r.source]["v"] / state[r.source]["mean"] if state[r.source]["mean"] else 0.0, state[r.source]["residual"]) for r in rows]
    return spark.createDataFrame(out, "source string, share double, repeats int, own long, docs long, goal double, reachable boolean, tilt double, residual double")


def counted(documents: DataFrame) -> DataFrame:
    """(source, size, docs): how many documents of each size a source has."""
    return cut(documents.groupBy("source", "size").agg(F.count("*").alias("docs")))


def mix(documents: DataFrame, targets: DataFrame, budget: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): (doc, source, size, rate, copies) of all documents, and what each source reaches.

    The targets are shares of all tokens of all these sources, each document once. Copies never exceed the repeats. An
    unreachable source uses each of its documents as often as it may; one without documents has none.
    """
    documents = cut(documents)
    budget = solve(counted(documents), targets) if budget is None else budget
    settings = budget.select("source", F.col("repeats").cast("double").alias("most"), "tilt", "reachable", "goal", F.greatest(F.lit(1), F.ceil(F.col("docs") / ROUNDED)).alias("salts"))
    each = documents.join(F.broadcast(settings), "source")  # at most MOST_SOURCES rows
    rate = F.when(~F.col("reachable"), F.col("most")).when(F.col("goal") <= 0, F.lit(0.0)).otherwise(F.least("most", F.exp(F.least(F.lit(700.0), F.col("tilt") * F.col("size")))))
    # rates are summed by falling size within hashed groups of a source, and each document gets the whole numbers it passes
    each = each.withColumn("rate", rate.cast("double")).withColumn("salt", F.expr("pmod(xxhash64(doc), salts)"))
    upto = F.sum("rate").over(Window.partitionBy("source", "salt").orderBy(F.desc("size"), "doc").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("upto", upto + 0.5)
    copies = F.least(F.floor(F.col("upto") + 1e-9) - F.floor(F.col("upto") - F.col("rate") + 1e-9), F.col("most").cast("long"))
    selection = each.withColumn("copies", copies.cast("int")).select("doc", "source", "size", "rate", "copies")
    got = selection.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.sum("copies").alias("copies"))
    total = Window.partitionBy(F.lit(0))  # one row for each source
    tokens = F.coalesce("tokens", F.lit(0))
    shares = budget.join(got, "source", "left").select("source", "share", "repeats", "own", "goal", "reachable", "residual", tokens.alias("tokens"), F.coalesce("copies", F.lit(0)).alias("copies"), (tokens / F.greatest(F.lit(1), F.sum(tokens).over(total))).alias("reached"))
    return selection, shares


def kept(shares: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(source, reachable, kept): does each source's selection hold its target's tokens up to the tolerance, or, where it
    can't be reached, all it has as often as it may?"""
    wanted_tokens = F.when(F.col("reachable"), F.col("goal")).otherwise(F.col("own") * F.col("repeats"))
    return shares.select("source", "reachable", (F.abs(F.col("tokens") - wanted_tokens) <= tolerance * wanted_tokens).alias("kept"))
