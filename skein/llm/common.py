"""What the operators of this subpackage share: table access, shared folders, column checks."""

import functools
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset and the master local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that no later plan reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str, modulus: int, remainder: int):
    """Column: crc32 of the id as text falls on the held-out remainder (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def process_cache() -> dict:
    """A dict that lives as long as the Python worker, across the tasks that it runs."""
    return sys.modules.setdefault("_skein_process_cache", types.ModuleType("_skein_process_cache")).__dict__


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names for added columns that clash with none of ``columns``, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: The columns of documents that operators read by name.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def by_position(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator`` for tables with any column names: those that it doesn't read (dotted, quoted, alike but for case) are
    renamed by position before and back after; the columns that it adds come last and get underscores where they clash."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        first = {c: docs.columns.index(c) for c in READ if c in docs.columns}
        out = operator(docs.toDF(*[c if first.get(c) == k else f"_c{k}" for k, c in enumerate(docs.columns)]), *args, **options)
        return out.toDF(*docs.columns, *fresh(docs.columns, *out.columns[len(docs.columns) :]))

    return run


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written table, marked for broadcast if it has ``rows`` rows of numbers at most."""
    return F.broadcast(df) if df.count() <= rows else df


def meet(rows: DataFrame, table: DataFrame, on: str | list[str], heavy, merge: bool = False) -> DataFrame:
    """Inner join of ``rows`` with a written ``table`` unique by ``on``; the rows of ``table`` that ``heavy`` (a column) marks are broadcast.

    Mark those that over a thousandth of all rows meet: there are a thousand at most, and no task gets all rows of such a key.
    With ``merge`` the others are never broadcast, however small their files.
    """
    keys, heavy = [on] if isinstance(on, str) else on, F.col(heavy) if isinstance(heavy, str) else heavy
    light = table.where(~heavy).hint("merge") if merge else table.where(~heavy)
    few = F.broadcast(table.where(heavy))
    rest = rows.join(F.broadcast(table.where(heavy).select(*keys)), keys, "left_anti").join(light, keys)
    return rows.join(few, keys).unionByName(rest)


def told_apart(docs: DataFrame, seed: int, first: str, second: str) -> DataFrame:
    """``docs`` with two 64-bit hashes of id and text by which every row differs, wholly equal ones too.

    Rows that occur once depend on nothing else. Equal rows are numbered, by input partition first, so that no task
    holds a group of them, and their number is hashed as well; they are written, so that the numbers stay. Which of them has
    which number doesn't matter, as they are equal in id and text.
    """
    rows = docs.withColumn(first, F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn(second, F.xxhash64(F.lit(seed + 1), "text", "doc_id"))
    twice = written(rows.groupBy(first, second).agg(F.count("*").alias("n")).where("n > 1").select(first, second), "equal-rows")
    if twice.isEmpty():
        return rows
    twice = small(twice)
    part, before, nth = fresh(rows.columns, "part", "before", "nth")
    again = written(rows.join(twice, [first, second], "left_semi").withColumn(part, F.spark_partition_id()), "equal-rows")
    sofar = Window.partitionBy(first, second).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = again.groupBy(first, second, part).agg(F.count("*").alias("n"))
    counts = counts.select(first, second, part, F.coalesce(F.sum("n").over(sofar), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(first, second, part).orderBy(F.lit(0)))
    again = again.withColumn(nth, inside - 1).join(counts, [first, second, part]).withColumn(nth, F.col(nth) + F.col(before))
    for k, name in enumerate((first, second)):
        again = again.withColumn(name, F.when(F.col(nth) > 0, F.xxhash64(F.lit(seed + 2 + k), name, nth)).otherwise(F.col(name)))
    return rows.join(twice, [first, second], "left_anti").select(*rows.columns).unionByName(again.select(*rows.columns))
