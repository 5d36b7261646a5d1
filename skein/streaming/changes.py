"""Change capture: a log with gapless sequence numbers, a queue of pending vectors, replay and live reading.

A log is a folder of batches. Batch k is written as one folder of its own, so a batch that runs again replaces itself, and beside
it stands the last number given so far; the numbers of batch k follow those of batch k - 1 without a gap. Numbers are given by ranges of
a batch's order, so no task holds a batch. A reader asks for what lies after a number it knows: that is the replay; the
same folder read as a stream goes on from there.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import numbered

# The columns of a row that its payload shows, the rule for full batches.
PAYLOAD = ("updated_utc", "id", "item_id", "path", "drive", "folder_path", "series_id", "season_id", "episode_path", "kind", "score", "title", "bytes_sampled", "lines_sampled")
IDENTITY = ("path", "item_id", "id", "doc_id", "series_id")
BATCH, MOST = 128, 50
CHANGE = "kind string, doc_id string, vector_kind string, payload_json string"
LOG = f"{CHANGE}, seq long"


def captured(before: DataFrame | None, after: DataFrame, key: str, table: str, kind: str, vector_kind: str | None = None) -> DataFrame:
    """(kind, doc_id, vector_kind, payload_json) of the rows of ``after`` that ``before`` lacks or has with other values.

    doc_id is ``table:key``; the payload names the table and those columns of ``PAYLOAD`` that the table has; nulls stay out. A null key is
    a key like any other. No ``before``: all rows are new.
    """
    rows = after.select(F.struct(*after.columns).alias("_now"), F.col(key).alias("_key"))
    if before is not None:
        then = before.select(F.struct(*after.columns).alias("_then"), F.col(key).alias("_old"), F.lit(True).alias("_had"))
        rows = rows.join(then, F.col("_key").eqNullSafe(F.col("_old")), "left").where(F.col("_had").isNull() | ~F.col("_now").eqNullSafe(F.col("_then")))
    shown = [F.lit(table).alias("table"), *[F.col(f"_now.{c}").alias(c) for c in PAYLOAD if c in after.columns]]
    doc_id = F.concat(F.lit(f"{table}:"), F.coalesce(F.col("_key").cast("string"), F.lit("")))
    return rows.select(F.lit(kind).alias("kind"), doc_id.alias("doc_id"), F.lit(vector_kind or table).alias("vector_kind"), F.to_json(F.struct(*shown)).alias("payload_json"))


class ChangeLog:
    """A log and its queue in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def append(self, changes: DataFrame, batch: int, *order: Column | str) -> None:
        """Writes batch ``batch``, which follows ``batch`` - 1; written again, it replaces itself. No change: an empty batch."""
        last = 0
        if batch:
            last = self.spark.read.parquet(f"{self.folder}/heads/batch={batch - 1}").first().last
        rows = numbered(changes, "seq", *(order or ("doc_id", "payload_json")), first=last + 1)
        rows.write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")
        mine = self.spark.read.schema(LOG).parquet(f"{self.folder}/log/batch={batch}")
        mine.groupBy("doc_id").agg(F.max_by("vector_kind", "seq").alias("kind"), F.max("seq").alias("seq")).write.mode("overwrite").parquet(f"{self.folder}/queue/batch={batch}")
        mine.agg(F.coalesce(F.max("seq"), F.lit(last)).alias("last")).write.mode("overwrite").parquet(f"{self.folder}/heads/batch={batch}")

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Appends each micro-batch of a stream of changes."""
        put = lambda batch, number: self.append(batch, number)
        return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def last(self) -> int:
        """The last number given, 0 at the start."""
        found = self.spark.read.schema("last long, batch int").parquet(f"{self.folder}/heads").agg(F.max("last").alias("last")).first()
        return found.last or 0

    def after(self, seq: int, upto: int | None = None) -> DataFrame:
        """The changes after a number, and up to one: a replay. Row groups of other numbers are skipped by their statistics."""
        rows = self.spark.read.schema(LOG).parquet(f"{self.folder}/log").where(F.col("seq") > seq)
        return (rows if upto is None else rows.where(F.col("seq") <= upto)).drop("batch")

    def live(self, seq: int) -> DataFrame:
        """The changes after a number, as a stream that goes on with every batch."""
        return self.spark.readStream.schema(LOG).parquet(f"{self.folder}/log").where(F.col("seq") > seq).drop("batch")

    def pending(self) -> DataFrame:
        """(doc_id, kind, seq): rows whose vector is due, once each with the last change."""
        queue = self.spark.read.schema("doc_id string, kind string, seq long").parquet(f"{self.folder}/queue")
        due = queue.groupBy("doc_id").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))
        try:
            taken = self.spark.read.schema("doc_id string, seq long").parquet(f"{self.folder}/taken")
        except Exception as gone:
            if "PATH_NOT_FOUND" not in str(gone):
                raise
            return due
        done = taken.groupBy("doc_id").agg(F.max("seq").alias("_done"))
        return due.join(done, "doc_id", "left").where(F.col("_done").isNull() | (F.col("_done") < F.col("seq"))).drop("_done")

    def take(self, limit: int, number: int) -> DataFrame:
        """Dequeues up to ``limit`` rows, the oldest changes first; a row that changes later is due again. ``number`` names the dequeue."""
        self.pending().orderBy("seq").limit(limit).write.mode("overwrite").parquet(f"{self.folder}/taken/take={number}")
        return self.spark.read.schema("doc_id string, kind string, seq long").parquet(f"{self.folder}/taken/take={number}")


def coalesced(log: DataFrame, batch: int = BATCH, most: int = MOST) -> DataFrame:
    """(batch, place, seq, kind, doc_id, payload_json): what a reader is told of each ``batch`` numbers.

    A batch of over ``most`` changes shows only the last of each kind and identity, where it was first seen; the identity is the first of ``IDENTITY``
    that the payload has, or the change itself. As numbers have no gaps, a batch has ``batch`` rows at most.
    """
    identity = F.coalesce(*[F.nullif(F.get_json_object("payload_json", f"$.{c}"), F.lit("")) for c in IDENTITY], F.concat(F.lit("#"), F.col("seq").cast("string")))
    rows = log.withColumn("batch", F.expr(f"(seq - 1) div {batch}")).withColumn("_id", identity)
    w = Window.partitionBy("batch")
    rows = rows.withColumn("_full", F.count("*").over(w) > most)
    rows = rows.withColumn("_same", F.when(F.col("_full"), F.concat_ws(":", "kind", "_id")).otherwise(F.col("seq").cast("string")))
    same = Window.partitionBy("batch", "_same")
    rows = rows.withColumns({"_first": F.min("seq").over(same), "_last": F.max("seq").over(same)}).where(F.col("seq") == F.col("_last"))
    return rows.select("batch", F.row_number().over(w.orderBy("_first")).alias("place"), "seq", "kind", "doc_id", "payload_json")
