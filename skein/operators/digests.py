"""Order-sensitive digests of key lists: the plain MD5 of all sorted keys, and a tree over stable ranges whose leaves tell where lists differ.

A range begins at a key whose hash is a multiple of ``fanout``, and goes to the next such key: ranges follow the keys themselves,
so a key that comes, goes or changes touches its own range and the path above it. A node of level l begins at a key whose hash is a
multiple of fanout^(l+1). A node's digest is the MD5 of its children's in order, a leaf's that of its keys' with their counts.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import in_ranges

FANOUT, RUN_KEYS = 1024, 1000
HASH_DIGITS = 15


def _hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def _begins(rows: DataFrame, order: str, every: int) -> DataFrame:
    """``rows`` with ``start``: the last key at or before ``order`` that begins a node, the empty one before the first.

    Rows are dealt by ranges; a range that no node begins in takes over what the ranges ahead of it end with.
    """
    ranged = in_ranges(rows, order)
    mark = F.when((F.col(order) == "") | (_hash(F.col(order)) % every == 0), F.col(order))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    last = ranged.groupBy("_range").agg(F.max(mark).alias("_last")).select("_range", F.max("_last").over(ahead).alias("_carried"))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("_own", F.last(mark, ignorenulls=True).over(inside)).join(F.broadcast(last), "_range")
    return out.withColumn("start", F.coalesce("_own", "_carried", F.lit(""))).drop("_range", "_own", "_carried")


def _folded(order: str, digest: Column) -> Column:
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), digest.alias("d"))))
    return F.md5(F.array_join(F.transform(listed, lambda x: x["d"]), "").cast("binary")).alias("digest")


def leaves(df: DataFrame, key: str, fanout: int = FANOUT) -> DataFrame:
    """(start, digest, keys): the leaf ranges of a list of keys, by the key that begins them; nulls stay out, a repeated key counts.

    A range has ``fanout`` distinct keys on average, whatever the list's length and however its keys are distributed.
    """
    keys = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))
    each = F.concat(F.md5(F.col("key").cast("binary")), F.col("n").cast("string"))
    return _begins(keys, "key", fanout).groupBy("start").agg(_folded("key", each), F.sum("n").alias("keys"))


def tree(df: DataFrame, key: str, fanout: int = FANOUT, levels: int | None = None) -> DataFrame:
    """One row (digest, keys): the root of a list of keys.

    ``levels`` nodes lie one above the other below the root; by default as many as it takes until a level has ``fanout`` nodes or fewer.
    Lists are equal if and only if (but for MD5) their roots of equal levels are. An empty list has the digest of nothing.
    """
    nodes, level = leaves(df, key, fanout), 1
    while level <= levels if levels is not None else nodes.count() > fanout:
        level += 1
        above = _begins(nodes.withColumnRenamed("start", "begin"), "begin", fanout**level)
        nodes = above.groupBy("start").agg(_folded("begin", F.col("digest")), F.sum("keys").alias("keys"))
    return nodes.agg(_folded("start", F.col("digest")), F.coalesce(F.sum("keys"), F.lit(0)).alias("keys"))


def changed_ranges(base: DataFrame, current: DataFrame) -> DataFrame:
    """(start, status) of the ranges whose digests differ, from the ``leaves`` of both: changed, added or removed.

    A range that splits shows as changed and added, one that joins its neighbour as changed and removed.
    """
    b, c = base.select("start", F.col("digest").alias("old")), current.select("start", F.col("digest").alias("new"))
    both = b.join(c, "start", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("start", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("status"))


def sorted_md5(df: DataFrame, key: str) -> DataFrame:
    """One row (digest): the MD5 of all keys in order, one after the other; nulls stay out.

    Keys are sorted and joined by ranges, ``RUN_KEYS`` to a row. MD5 is sequential by its definition, so one task reads these
    rows in order, a batch at a time, and holds no more than one.
    """
    ranged = in_ranges(df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")), "key")
    run = F.expr(f"(row_number() OVER (PARTITION BY _range ORDER BY key) - 1) div {RUN_KEYS}")
    runs = ranged.withColumn("run", run).groupBy("_range", "run").agg(F.array_join(F.sort_array(F.collect_list("key")), "").alias("keys"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5()
        for batch in batches:
            for keys in batch.column(0).to_pylist():
                md5.update(keys.encode())
        yield pa.RecordBatch.from_pydict({"digest": [md5.hexdigest()]})

    found = runs.repartition(1).sortWithinPartitions("_range", "run").select("keys").mapInArrow(fold, "digest string")
    return found.agg(F.coalesce(F.max("digest"), F.lit(hashlib.md5().hexdigest())).alias("digest"))
