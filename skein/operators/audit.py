"""Audit summaries, baselines and health rollups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_known_id, truthy_keys


def unresolved(profiles: DataFrame, ids: str) -> DataFrame:
    """Rows whose JSON has no known id."""
    return profiles.agg(F.count_if(~has_known_id(F.col(ids))).alias("unresolved"))


def quality_flags(quality: DataFrame, reasons: str, score: str) -> DataFrame:
    """Rows with a truthy reason, or, where there is none to read, a score under 70."""
    keys = truthy_keys(F.col(reasons))
    return quality.agg(F.count_if((F.size(keys) > 0) | (F.col(reasons).isNull() & (F.col(score) < 70))).alias("flagged"))


def compare_counters(base: DataFrame, current: DataFrame, counters: list[str]) -> DataFrame:
    """(counter, added, removed) between two one-row summaries, never negative."""
    pairs = base.select(*[F.col(c).alias(f"b_{c}") for c in counters]).crossJoin(current.select(*counters))  # one row each
    rows = F.array(*[F.struct(F.lit(c).alias("counter"), F.greatest(F.lit(0), F.col(c) - F.col(f"b_{c}")).alias("added"), F.greatest(F.lit(0), F.col(f"b_{c}") - F.col(c)).alias("removed")) for c in counters])
    return pairs.select(F.explode(rows).alias("r")).select("r.*")


def changed_digests(base: DataFrame, current: DataFrame) -> DataFrame:
    """Names whose digest differs or that one side lacks."""
    b, c = base.select("name", F.col("digest").alias("old")), current.select("name", F.col("digest").alias("new"))
    return b.join(c, "name", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("name")


def severity_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("severity").agg(F.count("*").alias("n"))


def provider_health(log: DataFrame, n: int = 50) -> DataFrame:
    """From the newest ``n`` entries: each provider's latest message and its number of warnings and errors."""
    newest = log.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    return newest.groupBy("provider").agg(F.max_by("message", F.struct("ts", "id")).alias("latest"), F.count_if(F.lower("level").isin("warn", "warning", "error")).alias("problems"))


def series_latest(metrics: DataFrame, n: int = 500) -> DataFrame:
    """From the newest ``n`` samples: count and latest value of each series."""
    newest = metrics.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    return newest.groupBy("series").agg(F.count("*").alias("n"), F.max_by("value", F.struct("ts", "id")).alias("latest"))


def slow_entries(log: DataFrame, n: int, least_ms: float, *order: str) -> DataFrame:
    """Of the newest ``n`` entries those that took longer than ``least_ms``, newest first."""
    newest = [F.desc(c) for c in order]
    return log.orderBy(*newest).limit(n).where(F.col("duration_ms") > least_ms).orderBy(*newest)


def stale_ratio(entries: DataFrame, by: str, stale: Column, least: float = 0.4) -> DataFrame:
    """Groups whose share of stale entries reaches ``least``."""
    return entries.groupBy(by).agg((F.count_if(stale) / F.count("*")).alias("ratio")).where(F.col("ratio") >= least)
