"""Event streams: coalesced batches into a keyed table, counts by window, sessions, lag percentiles."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream of files, with a zoned time; back-pressure instead of dropped readers."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/[e]vents.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows and sum of values by window and type; rows later than ``late`` are left out by the watermark."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def lag_percentiles(events: DataFrame, size: str = "120 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Median and 95th percentile of lag_ms in sliding windows."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w")).agg(F.percentile_approx("lag_ms", [0.5, 0.95], 10_000).alias("p"))
    return out.select(F.col("w.end").alias("at"), F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def last_by_key(batch: DataFrame, key: str, seq: str) -> DataFrame:
    """The last event of each key of a batch."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), F.col(seq)).alias("_row")).select(key, "_row.*")


def into_versions(events: DataFrame, key: str, seq: str, table: str, checkpoint: str) -> StreamingQuery:
    """Each batch's last events by key, as one folder for each batch: a batch that runs again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        last_by_key(batch, key, seq).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(rows: DataFrame, checkpoint: str, table: str) -> DataFrame:
    """Runs a stream over what is available; every batch that it gives out is a folder of its own. Returns all that ``table`` holds."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(table).select(*rows.columns)


def finished(rows: DataFrame, checkpoint: str, table: str, mode: str = "complete", put: Callable | None = None) -> DataFrame:
    """Runs a stream over what is available and returns its last result, written to ``table``."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    query = rows.writeStream.outputMode(mode).foreachBatch(put or save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.parquet(table)
