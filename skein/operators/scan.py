"""A resumable scan: a listing against the stored files, chunk by chunk, contents read for new and changed files only.

The plan, the status of every path, is written first. Its paths are numbered in order of their keys and dealt into chunks; a chunk's
results are one folder, and its mark, written after it, is the high-water mark. A scan that is cut goes on behind the last
mark with the plan that it began, and ends with the same table as one that wasn't cut.
"""

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .windows import numbered

# Characters of a path that is too long unless prefixed, rows of a chunk.
LONGEST_PATH, CHUNK_ROWS = 260, 1_000_000
READ = ("new", "changed", "restored")
MARK = "chunk int, rows long, high string"


def path_key(path: Column, casefold: bool = False) -> Column:
    """What tells paths apart: Unicode NFC, and case-folded where the file system ignores case."""

    @F.arrow_udf("string")
    def key(column: pa.Array) -> pa.Array:
        normal = (None if x is None else unicodedata.normalize("NFC", x) for x in column.to_pylist())
        return pa.array([x.casefold() if casefold and x is not None else x for x in normal], pa.string())

    return key(path)


def admitted(listing: DataFrame, ignore: list[str] | None = None, skip_hidden: bool = True, longest: int | None = LONGEST_PATH) -> DataFrame:
    """``listing`` with ``skipped``: null, ``ignored`` (a hidden part of the path or a fitting pattern) or ``too long``."""
    parts = F.filter(F.split(paths.slashes(F.col("path")), "/"), lambda s: (s != "") & (s != ".") & (s != ".."))
    hide = F.exists(parts, lambda s: s.startswith(".")) if skip_hidden else F.lit(False)
    fits = paths.glob_match(F.col("path"), ignore) if ignore else F.lit(False)
    long = F.length("path") >= longest if longest else F.lit(False)
    return listing.withColumn("skipped", F.when(hide | fits, "ignored").when(long, "too long"))


def totals(listed: DataFrame, av: Column) -> DataFrame:
    """One row: files and bytes seen, audio and video files, folders, and what was skipped, of an ``admitted`` listing."""
    seen = F.col("skipped").isNull()
    folder = F.when(seen, paths.parent_folder(F.col("path")))
    return listed.agg(
        F.count_if(seen).alias("files_seen"),
        F.coalesce(F.sum(F.when(seen, F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes_seen"),
        F.count_if(seen & av).alias("av_total"),
        F.count_distinct(folder).alias("dirs_seen"),
        F.count_if(F.col("skipped") == "ignored").alias("skipped_ignored"),
        F.count_if(F.col("skipped") == "too long").alias("skipped_toolong"),
    )


def planned(files: DataFrame, listing: DataFrame, casefold: bool = False, full: bool = False) -> DataFrame:
    """(key, path, size_bytes, mtime_utc, status, file): every path of either side once.

    status is new, changed (other size or time, or ``full``), unchanged, restored (was deleted), deleted (no longer listed) or gone (was deleted
    before and still is); file is the stored row. Of listed paths with one key the greatest counts, of stored rows the least id.
    """
    a = listing.where("path is not null").select(path_key(F.col("path"), casefold).alias("key"), F.struct("path", "size_bytes", "mtime_utc").alias("now"))
    a = a.groupBy("key").agg(F.max("now").alias("now"))
    b = files.select(path_key(F.col("path"), casefold).alias("key"), F.struct(*files.columns).alias("file"))
    b = b.groupBy("key").agg(F.min_by("file", F.col("file.id")).alias("file"))
    same = F.col("now.size_bytes").eqNullSafe(F.col("file.size_bytes")) & F.col("now.mtime_utc").eqNullSafe(F.col("file.mtime_utc"))
    was_deleted = F.coalesce(F.col("file.deleted"), F.lit(False))
    status = (
        F.when(F.col("file").isNull(), "new")
        .when(F.col("now").isNull(), F.when(was_deleted, "gone").otherwise("deleted"))
        .when(was_deleted, "restored")
        .when(F.lit(full) | ~same, "changed")
        .otherwise("unchanged")
    )
    return a.join(b, "key", "full_outer").select("key", "now.*", status.alias("status"), "file")


class Scan:
    """A scan that keeps its plan, chunks and marks in a folder. ``contents`` reads: (key, path, ...) to (key, hash)."""

    def __init__(self, spark: SparkSession, folder: str, contents: Callable[[DataFrame], DataFrame], chunk_rows: int = CHUNK_ROWS, casefold: bool = False):
        self.spark, self.folder, self.contents, self.chunk_rows, self.casefold = spark, folder, contents, chunk_rows, casefold

    def _written(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}/_SUCCESS")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def run(self, files: DataFrame, listing: DataFrame, now: Column, stop_after: int | None = None) -> DataFrame | None:
        """The files table after the scan, or None if it was cut after ``stop_after`` chunks of this run.

        Rows of ``files`` (id, path, size_bytes, mtime_utc, hash, deleted, deleted_ts and others) keep their id and path; new ones get the next ids.
        A file whose content can't be read has a null hash. The plan of a scan that was cut stays in force.
        """
        plan = planned(files, listing, self.casefold)
        if not self._written("plan"):
            todo = numbered(plan.where(F.col("status").isin(*READ)), "number", "key")
            todo = todo.withColumn("chunk", F.expr(f"cast(number div {self.chunk_rows} as int)"))
            rest = plan.where(~F.col("status").isin(*READ)).select("*", F.lit(None).cast("long").alias("number"), F.lit(-1).alias("chunk"))
            todo.unionByName(rest).write.mode("overwrite").partitionBy("chunk").parquet(f"{self.folder}/plan")
        plan = self.spark.read.schema(plan.select("*", F.lit(0).cast("long").alias("number"), F.lit(0).alias("chunk")).schema).parquet(f"{self.folder}/plan")
        last = plan.agg(F.max("chunk").alias("n")).first().n
        done = 0
        for k in range((-1 if last is None else last) + 1):
            if self._written(f"marks/chunk={k}"):
                continue
            if done == stop_after:
                return None
            todo = plan.where(F.col("chunk") == k)
            todo.select("key").join(self.contents(todo.select("key", "path", "size_bytes")), "key", "left").write.mode("overwrite").parquet(f"{self.folder}/hashes/chunk={k}")
            todo.agg(F.lit(k).alias("chunk"), F.count("*").alias("rows"), F.max("key").alias("high")).write.mode("overwrite").parquet(f"{self.folder}/marks/chunk={k}")
            done += 1
        return self.result(files, plan, now)

    def result(self, files: DataFrame, plan: DataFrame, now: Column) -> DataFrame:
        if plan.where(F.col("chunk") >= 0).isEmpty():
            hashes = plan.where("false").select("key", F.lit("").alias("_hash"))
        else:
            hashes = self.spark.read.schema("key string, hash string").parquet(f"{self.folder}/hashes").select("key", F.col("hash").alias("_hash"))
        first = (files.agg(F.max("id").alias("n")).first().n or 0) + 1
        fresh = numbered(plan.where("status = 'new'").select("key"), "_new", "key", first=first)
        rows = plan.join(hashes, "key", "left").join(fresh, "key", "left")
        read = F.col("status").isin(*READ)
        gone = F.col("status") == "deleted"
        values = {c: F.col(f"file.{c}") for c in files.columns} | {
            "id": F.coalesce(F.col("file.id"), F.col("_new")),
            "path": F.coalesce(F.col("file.path"), F.col("path")),
            "size_bytes": F.when(read, F.col("size_bytes")).otherwise(F.col("file.size_bytes")),
            "mtime_utc": F.when(read, F.col("mtime_utc")).otherwise(F.col("file.mtime_utc")),
            "hash": F.when(read, F.col("_hash")).otherwise(F.col("file.hash")),
            "deleted": F.col("status").isin("deleted", "gone"),
            "deleted_ts": F.when(gone, now).when(F.col("status") == "gone", F.col("file.deleted_ts")),
        }
        return rows.select(*[values[c].alias(c) for c in files.columns], "status")
