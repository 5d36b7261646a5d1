"""Buckets, percentiles, histograms, calibration and digests."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

SKETCH, FEW_TARGETS = 10_000, 100_000


def confidence_buckets(df: DataFrame, c: Column, low: float = 0.50, high: float = 0.80) -> DataFrame:
    """Counts of high, medium and low; rows without a value only in the total. One pass."""
    return df.agg(F.count_if(c >= high).alias("high"), F.count_if((c >= low) & (c < high)).alias("medium"), F.count_if(c < low).alias("low"), F.count("*").alias("total"))


def at_ranks(df: DataFrame, by: str, value: str, ranks: dict[str, tuple[float, Column]], sketch: int = SKETCH) -> DataFrame:
    """(by, n, name...): the exact values at ranks (from 0) of each group's sorted values; a group may hold any share of all rows.

    ``ranks`` maps names to (share, rank): about where in a group of ``n`` rows it lies, and the rank as a column over n. A sketch of ``sketch``
    values for each group gives the range that must hold a rank; the rows below it are counted and only those within it are put in order,
    each distinct value once. No rank is taken on trust: where a range turns out not to hold its rank, it is looked for among all values.
    Null values don't count; a null group is a group.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(F.col(by).alias("by")).alias("g"), F.col(value).alias("value"))
    points = sorted({min(1.0, max(0.0, share + d / sketch)) for share, _ in ranks.values() for d in (-2, 2)})
    at = lambda share, d: F.col("q")[points.index(min(1.0, max(0.0, share + d / sketch)))]
    stats = written(rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("value", points, sketch).alias("q")), "ranks")
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), rank.cast("long").alias("rank"), at(share, -2).alias("low"), at(share, 2).alias("high")) for k, (share, rank) in enumerate(ranks.values())]))
    targets = written(stats.select("g", "n", asked.alias("t")).select("g", "n", "t.*"), "ranks")
    found = written(_found(rows, targets), "ranks")
    missed = written(targets.join(found, ["g", "k"], "left_anti"), "ranks")
    if not missed.isEmpty():
        none = F.lit(None).cast(rows.schema["value"].dataType)
        found = found.unionByName(_found(rows, missed.withColumns({"low": none, "high": none})))
    named = found.groupBy("g").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(name) for k, name in enumerate(ranks)])
    return stats.join(named, "g").select(F.col("g.by").alias(by), "n", *ranks)


def _found(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(g, k, value) of the targets (g, k, rank, low, high) whose rank lies within their range; a null bound is none."""
    plain = targets.select("g", "k", "rank", "low", "high")
    if targets.count() <= FEW_TARGETS:
        asked = rows.join(F.broadcast(plain), "g")
    else:
        # groups with over a thousandth of the rows, of which there are a thousand at most, are broadcast; others meet by their key
        limit = targets.where("k = 0").agg(F.sum("n").alias("n")).first().n // 1000
        large = F.broadcast(plain.join(targets.where(F.col("n") > limit).select("g", "k"), ["g", "k"], "left_semi"))
        rest = rows.join(F.broadcast(large.select("g").distinct()), "g", "left_anti")
        asked = rows.join(large, "g").unionByName(rest.join(plain, "g"))
    under, over = F.coalesce(F.col("value") < F.col("low"), F.lit(False)), F.coalesce(F.col("value") > F.col("high"), F.lit(False))
    below = asked.groupBy("g", "k").agg(F.count_if(under).alias("below"))
    each = asked.where(~under & ~over).groupBy("g", "k", "value", "rank").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g", "k").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = each.withColumn("upto", upto).join(below, ["g", "k"])
    first = F.col("below") + F.col("upto") - F.col("c")
    return ranked.where((F.col("rank") >= first) & (F.col("rank") < F.col("below") + F.col("upto"))).select("g", "k", "value")


def percentiles(df: DataFrame, by: str, value: str, points: list[float]) -> DataFrame:
    """Linearly interpolated percentiles by group, as columns p<percent>; null for a group without values."""
    n = F.col("n") - 1
    ranks = {f"{end}{k}": (p, F.floor(n * p) if end == "low" else F.ceil(n * p)) for k, p in enumerate(points) for end in ("low", "high")}
    found = at_ranks(df, by, value, ranks).withColumnRenamed(by, "_by")
    out = []
    for k, p in enumerate(points):
        place, low, high = n * F.lit(p), F.col(f"low{k}").cast("double"), F.col(f"high{k}").cast("double")
        mixed = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        out.append(F.when(F.floor(place) == F.ceil(place), low).otherwise(mixed).alias(f"p{round(p * 100)}"))
    groups = df.select(by).distinct()
    return groups.join(found, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, *out)


def ceil_rank_percentile(df: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """The value at index ceil(p (n - 1)) of each group's sorted values; groups without values are left out."""
    return at_ranks(df, by, value, {"value": (p, F.ceil(F.lit(p) * (F.col("n") - 1)))}).select(by, "value")


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Rows by the first bound that is not below the value; ``inf`` beyond the last. Empty buckets are left out."""
    label = F.lit("inf")
    for b in reversed(bounds):
        label = F.when(F.col(value) <= b, F.lit(f"{b:g}")).otherwise(label)
    return df.where(F.col(value).isNotNull()).groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Count, accuracy and mean confidence in equal bins of [0, 1], the last one closed; empty bins are zero."""
    got = df.select(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin"), p, y).groupBy("bin").agg(F.count("*").alias("n"), F.avg(y).alias("accuracy"), F.avg(p).alias("confidence"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(got, "bin", "left").na.fill(0)


def calibration_error(bins: DataFrame) -> DataFrame:
    total = F.sum("n")
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / total).alias("ece"))


def ordered_digest(df: DataFrame, key: str, chunk_prefix: int = 2) -> DataFrame:
    """MD5 of the sorted keys of each common prefix; ``digests`` has those of whole lists, whose tasks don't depend on prefixes."""
    chunks = df.where(F.col(key).isNotNull()).groupBy(F.substring(key, 1, chunk_prefix).alias("chunk")).agg(F.md5(F.array_join(F.array_sort(F.collect_list(key)), "").cast("binary")).alias("digest"))
    return chunks.orderBy("chunk")


def rate_by_minute(calls: DataFrame, bucket: str, ts: str, most: int) -> DataFrame:
    """Calls by bucket and minute, and whether they exceed the allowance."""
    return calls.groupBy(bucket, F.date_trunc("minute", ts).alias("minute")).agg(F.count("*").alias("calls")).withColumn("over", F.col("calls") > most)


def tool_metrics(calls: DataFrame) -> DataFrame:
    """Totals, failures, successes and the 95th percentile of each tool."""
    return calls.groupBy("tool").agg(F.count("*").alias("total"), F.count_if("failed").alias("failed"), F.percentile("ms", F.lit(0.95)).alias("p95")).withColumn("success", F.greatest(F.lit(0), F.col("total") - F.col("failed")))


def blob_totals(df: DataFrame, value: str) -> DataFrame:
    """Rows, bytes and the mean length in characters, ties to even."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).cast("long").alias("bytes"), F.bround(F.avg(F.length(value)), 0).cast("long").alias("mean_size"))


def mean_dimension(df: DataFrame, vec: str) -> DataFrame:
    return df.agg(F.coalesce(F.bround(F.avg(F.size(vec)), 0), F.lit(0)).cast("long").alias("dimension"))
