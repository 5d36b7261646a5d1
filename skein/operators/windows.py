"""Running totals, budgets, retention and event coalescing."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import in_ranges


def running_before(df: DataFrame, value: str, *order: Column, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows ahead of each, in its group.

    Without groups the rows are written in ranges of their order; sums go over the ranges first and then within each.
    """
    if not by:
        return _over_ranges(df, value, list(order))
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def _over_ranges(df: DataFrame, value: str, order: list[Column]) -> DataFrame:
    rows = in_ranges(df, *order)
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = rows.groupBy("_range").agg(F.sum(value).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(sums), "_range")
    return out.withColumn("before", F.col("_ahead") + F.col("_inside")).select(*df.columns, "before")


def numbered(df: DataFrame, name: str, *order: Column | str, first: int = 0) -> DataFrame:
    """``df`` with gapless numbers from ``first`` in its order, which must tell all rows apart; no task sorts more than a range."""
    rows = in_ranges(df, *order)
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    out = rows.withColumn("_inside", inside).join(F.broadcast(counts), "_range")
    return out.withColumn(name, F.col("_ahead") + F.col("_inside") + first).select(*df.columns, name)


def fill_budget(df: DataFrame, value: str, budget: float, *order: Column, by: list[str] | None = None) -> DataFrame:
    """Rows in order until the total ahead of a row reaches the budget; the first row always stays."""
    return running_before(df, value, *order, by=by).where(F.col("before") < budget)


def within_budget(df: DataFrame, value: str, budget: float, *order: Column, by: list[str] | None = None) -> DataFrame:
    """Rows in order while their total, themselves included, stays within the budget."""
    return running_before(df, value, *order, by=by).where(F.col("before") + F.coalesce(value, F.lit(0)) <= budget)


def weighted_order(seed: int, key: Column, weight: Column) -> Column:
    """A-Res sampling key u**(1/w) with a seeded u from the row's key; the largest keys are the sample."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.pow(u, 1 / F.least(F.lit(1.0), F.greatest(F.lit(0.05), weight)))


def retention(backups: DataFrame, keep_last: int, days: int, weeks: int) -> DataFrame:
    """(backup_id, reasons): the newest ones, the newest of each of the last days, and of each of the last ISO weeks."""
    newest = [F.desc("created"), F.desc("backup_id")]
    rows = backups.select("backup_id", "created")
    parts = [rows.orderBy(*newest).limit(keep_last).select("backup_id", F.lit(0).alias("k"), F.lit("last").alias("reason"))]
    for k, (name, of, most) in enumerate((("daily", F.to_date("created"), days), ("weekly", F.date_trunc("week", "created"), weeks)), 1):
        first = rows.groupBy(of.alias("of")).agg(F.max(F.struct("created", "backup_id")).alias("row")).orderBy(F.desc("of")).limit(most)
        parts.append(first.select("row.backup_id", F.lit(k).alias("k"), F.lit(name).alias("reason")))
    every = parts[0].union(parts[1]).union(parts[2])
    listed = every.groupBy("backup_id").agg(F.array_sort(F.collect_list(F.struct("k", "reason"))).alias("r"))
    return listed.select("backup_id", F.array_join(F.transform("r", lambda x: x["reason"]), ",").alias("reasons"))


def over_cap(items: DataFrame, size: str, cap: float, *order: Column) -> DataFrame:
    """Rows to drop, in order, until the rest fits the cap."""
    total = items.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"))
    return running_before(items, size, *order).crossJoin(F.broadcast(total)).where(F.col("before") < F.col("_total") - cap).drop("_total", "before")  # one row


def coalesce_events(events: DataFrame, key: str, seq: str, most: int = 50) -> DataFrame:
    """For a batch of over ``most`` rows the last row of each key, placed where the key was first seen."""
    if events.limit(most + 1).count() <= most:
        return events.withColumn("at", F.col(seq))
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.col(seq)).alias("_row"), F.min(seq).alias("at")).select(key, "_row.*", "at")
