"""Joins between catalog tables: attributes, existence flags, staleness, change detection, merges."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach(left: DataFrame, right: DataFrame, on: dict[str, str], columns: list[str]) -> DataFrame:
    """``left`` with columns of its match in ``right`` (unique by key), null without one."""
    keyed = right.select(*[F.col(r).alias(f"_on_{i}") for i, r in enumerate(on.values())], *columns)
    test = [left[x] == keyed[f"_on_{i}"] for i, x in enumerate(on)]
    return left.join(keyed, test, "left").drop(*[f"_on_{i}" for i in range(len(on))])


def flag(left: DataFrame, keys: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """``left`` with a flag that says whether its key occurs in ``keys``."""
    seen = keys.select(F.col(other).alias("_seen")).where("_seen is not null").distinct()
    return left.join(seen, left[key] == seen["_seen"], "left").withColumn(name, F.col("_seen").isNotNull()).drop("_seen")


def stale(source: DataFrame, derived: DataFrame, key: str, indexed: str, updated: str) -> DataFrame:
    """Rows of ``source`` without a derived row, or with an older one."""
    rows = derived.select(F.col(key).alias("_key"), F.col(updated).alias("_updated"))
    out = source.join(rows, source[key] == rows["_key"], "left").where(F.col("_updated").isNull() | (F.col("_updated") < F.col(indexed)))
    return out.drop("_key", "_updated")


def changes(current: DataFrame, stored: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, status): new, modified, unchanged, resurrected or vanished; ``stored`` may have ``deleted``."""
    old = stored if "deleted" in stored.columns else stored.withColumn("deleted", F.lit(False))
    a = current.select(F.col(key).alias("_a"), F.struct(*compare).alias("_now"))
    b = old.select(F.col(key).alias("_b"), F.struct(*compare).alias("_then"), F.coalesce("deleted", F.lit(False)).alias("_deleted"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    status = (
        F.when(F.col("_b").isNull(), "new")
        .when(F.col("_a").isNull(), F.when(F.col("_deleted"), "deleted").otherwise("vanished"))
        .when(F.col("_deleted"), "resurrected")
        .when(F.col("_now").eqNullSafe(F.col("_then")), "unchanged")
        .otherwise("modified")
    )
    return both.select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def top_per_key(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts groups before and after the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n)


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key with the largest order columns; a partial aggregate, no window."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("_row")).select(key, "_row.*")


def candidates_text(candidates: DataFrame, key: str, n: int = 3) -> DataFrame:
    """``source:id title (year) [score]`` of the best candidates of each key, joined by ``; ``."""
    top = top_per_key(candidates, key, n, F.desc("score"), F.asc("candidate_id"))
    year = F.when(F.col("year").isNotNull(), F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).otherwise("")
    text = F.concat(F.col("source"), F.lit(":"), F.col("candidate_id").cast("string"), F.lit(" "), F.coalesce("title", F.lit("")), year, F.format_string(" [%.2f]", F.bround(F.col("score").cast("double"), 2)))
    listed = top.select(key, F.struct("rn", text.alias("t")).alias("x")).groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return listed.select(key, F.array_join(F.transform("x", lambda x: x["t"]), "; ").alias("candidates"))


def in_order(ids: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Items of a requested list (id, position), in its order; ids without an item are left out."""
    return ids.join(items, key).orderBy("position")


def federated(hits: list[DataFrame]) -> DataFrame:
    """Hits (drive, path, score, snippet, source) of several searches merged: best score and its snippet, all sources."""
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    best = F.max_by("snippet", F.when(F.col("snippet") != "", F.struct("score", "source")))
    merged = every.groupBy("drive", "path").agg(F.max("score").alias("score"), best.alias("snippet"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return merged.orderBy(F.desc("score"), "drive", "path")
