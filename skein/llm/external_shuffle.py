"""Two-pass external shuffle of documents into shards whose row counts differ by one at most.

Pass 1 scatters rows uniformly into memory-sized buckets by a seeded hash of id and text. Pass 2 puts
each bucket into a fixed order, shuffles it with Fisher-Yates under a seed of its own, and the row's
place in the concatenation of all buckets is its place in the global permutation. Shards are
consecutive stretches of that permutation: law ``rows``. Assignments depend only on the rows and
the seed, never on how tasks were scheduled, so a stage that runs again gives the same ones.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_position, fresh, partitions, told_apart

SHARDS, SEED = 24, 7
BUCKET_BYTES = 32 << 20
BROADCAST_ROWS, TASK_BUCKETS = 1_000_000, 4


def fisher_yates(n: int, seed: tuple[int, int]) -> np.ndarray:
    """A permutation of range(n)."""
    order = list(range(n))
    draws = np.random.default_rng(seed).integers(0, np.arange(n, 0, -1)) if n else []
    for k, j in zip(range(n - 1, 0, -1), np.asarray(draws).tolist()):
        order[k], order[j] = order[j], order[k]
    return np.array(order, np.int64)


@by_position
def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` with ``place``: their place in a global random permutation, from 0 without gaps.

    Names that clash with columns of ``docs`` get underscores appended. A null or empty text is a row like any other, and
    repeated rows are rows of their own, spread like any others (wholly equal ones are interchangeable). Empty table: no rows.
    """
    spark = docs.sparkSession
    bucket, index, place, before, a, b = fresh(docs.columns, "bucket", "index", "place", "before", "a", "b")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n
    n_buckets = max(4 * partitions(spark), -(-total // bucket_bytes))
    scattered = told_apart(docs, seed, a, b).withColumn(bucket, F.pmod(a, F.lit(n_buckets)))
    offsets = scattered.groupBy(bucket).agg(F.count("*").alias("rows"))
    offsets = offsets.select(F.col(bucket), F.coalesce(F.sum("rows").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    bucket_at = scattered.columns.index(bucket)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one bucket at a time is held."""
        held: list[pa.RecordBatch] = []

        def release() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            number = rows.column(bucket_at)[0].as_py()
            out = rows.append_column(index, pa.array(np.argsort(fisher_yates(rows.num_rows, (seed, number)))))
            yield from out.to_batches(max_chunksize=2000)

        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(bucket_at).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and held[-1].column(bucket_at)[0].as_py() != number[a]:
                    yield from release()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from release()

    # a task has a few buckets, however large the table is
    tasks = max(partitions(spark), n_buckets // TASK_BUCKETS)
    ordered = scattered.repartition(tasks, bucket).sortWithinPartitions(bucket, a, b)
    filled = ordered.mapInArrow(fill, T.StructType([*scattered.schema.fields, T.StructField(index, T.LongType())]))
    if n_buckets <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return filled.join(offsets, bucket).withColumn(place, F.col(before) + F.col(index)).drop(bucket, index, before, a, b)


@by_position
def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (from 0 without gaps in each shard).

    The first (rows modulo shards) shards hold one row more than the others.
    """
    place, shard_, slot = fresh(docs.columns, "place", "shard", "slot")
    n = docs.select("doc_id").count()
    small, larger = divmod(n, shards)
    edge, at = larger * (small + 1), F.col(place)
    number = F.when(at < edge, F.expr(f"`{place}` div {small + 1}")).otherwise(F.expr(f"{larger} + (`{place}` - {edge}) div {max(1, small)}"))
    out = shuffled(docs, seed, bucket_bytes).withColumn(shard_, number.cast("int"))
    first = F.col(shard_).cast("long") * small + F.least(F.col(shard_).cast("long"), F.lit(larger))
    return out.withColumn(slot, at - first).drop(place)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes the shuffled rows as Parquet, one folder for each shard, rows in slot order within a file."""
    out = shard(docs, shards, seed)
    shard_, slot = out.columns[-2:]
    out.repartition(shards, shard_).sortWithinPartitions(shard_, slot).write.partitionBy(shard_).parquet(path)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, from the shards' rows."""
    rows = shard(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
