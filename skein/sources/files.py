"""Files read by byte ranges: content digests that don't depend on how a file was cut, head and tail signatures.

A range's part of the digest is the sum of (byte + 1) * BASE^(place in the file) modulo four primes, so a file's digest is
the sum of its ranges' parts, in any order and of any size: a large file is many small tasks and one partial aggregate.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525, 22695477, 214013)
PIECE, RANGE_BYTES, BLOCK = 1 << 20, 64 << 20, 1 << 16
PARTS = "part0 long, part1 long, part2 long, part3 long"
WORD_BITS = 64


def part(content: bytes, offset: int, tables: list[np.ndarray]) -> list[int]:
    """The digest's part of the bytes at ``offset``; ``tables``: powers for one piece."""
    out = [0] * len(PRIMES)
    for at in range(0, len(content), PIECE):
        b = np.frombuffer(content, np.uint8, min(PIECE, len(content) - at), at).astype(np.int64) + 1
        for k, (p, base) in enumerate(zip(PRIMES, BASES)):
            out[k] = (out[k] + int(b @ tables[k][: len(b)]) % p * pow(base, offset + at, p)) % p
    return out


def powers(n: int = PIECE) -> list[np.ndarray]:
    """For each prime the first powers of its base."""
    out = []
    for p, base in zip(PRIMES, BASES):
        t = np.ones(1, np.int64)
        while len(t) < n:
            t = np.concatenate([t, t * pow(base, len(t), p) % p])
        out.append(t[:n])
    return out


def content_parts(content: Column, offset: Column) -> Column:
    """The parts of a binary column that begins at ``offset`` in its file, as an array; null for null."""

    @F.arrow_udf("array<long>")
    def parts(contents: pa.Array, offsets: pa.Array) -> pa.Array:
        rows = contents.to_pylist()
        tables = powers(min(PIECE, max((len(c) for c in rows if c is not None), default=1) or 1))
        return pa.array([None if c is None else part(c, o, tables) for c, o in zip(rows, offsets.to_pylist())], pa.list_(pa.int64()))

    return parts(content, offset)


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, size, offset, length): the ranges of (path, size); an empty file has one of no bytes."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long"))
    return files.select("path", "size", F.explode(starts).alias("offset")).withColumn("length", F.least(F.lit(range_bytes), F.col("size") - F.col("offset")))


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def file_digests(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, size, digest, error) of (path, size), each file read by ranges; a file that can't be read, or is shorter than its size,
    has no digest and an error. A repeated path counts once; a null path is left out. The digest doesn't depend on ``range_bytes``."""
    rows = ranges(files.where("path is not null").groupBy("path").agg(F.max("size").alias("size")), range_bytes)
    result = f"path string, size long, {PARTS}, error string"
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = powers(min(PIECE, range_bytes))
        for batch in batches:
            out = []
            for path, size, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                sums, error = [0] * len(PRIMES), None
                try:
                    with _opened(path) as f:
                        f.seek(offset)
                        done = 0
                        while done < length:
                            content = f.read(min(PIECE, length - done))
                            if not content:
                                raise OSError(f"ends at byte {offset + done}")
                            sums = [(a + b) % p for a, b, p in zip(sums, part(content, offset + done, tables), PRIMES)]
                            done += len(content)
                except OSError as failed:
                    error = str(failed)
                out.append((path, size, *sums, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=[x.split()[0] for x in result.split(", ")])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return combined(rows.repartition(n, "path", "offset").mapInArrow(read, result))


def combined(parts: DataFrame) -> DataFrame:
    """(path, size, digest, error) of the ranges' parts (path, size, part0 ... part3, error)."""
    sums = parts.groupBy("path", "size").agg(*[F.sum(f"part{k}").alias(f"part{k}") for k in range(len(PRIMES))], F.min("error").alias("error"))
    text = F.format_string("%08x" * len(PRIMES), *[F.col(f"part{k}") % p for k, p in enumerate(PRIMES)])
    return sums.select("path", "size", F.when(F.col("error").isNull(), text).alias("digest"), "error")


def content_digests(rows: DataFrame, key: str, content: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, size, digest) of contents held in a table, cut into ranges as files are; a null content has no row."""
    held = rows.where(F.col(content).isNotNull()).select(F.col(key).alias("path"), F.col(content).cast("binary").alias("_c"))
    cut = held.select("path", F.octet_length("_c").cast("long").alias("size"), "_c").withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long"))))
    parts = cut.withColumn("_p", content_parts(F.substr("_c", (F.col("offset") + 1).cast("int"), F.lit(range_bytes)), F.col("offset")))
    return combined(parts.select("path", "size", *[F.get("_p", F.lit(k)).alias(f"part{k}") for k in range(len(PRIMES))], F.lit(None).cast("string").alias("error"))).drop("error")


def head_tail_signatures(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, size, signature) of (path, size): size plus the 64-bit little-endian words of the first and last ``block`` bytes, modulo 2^64,
    as 16 hex digits. A shorter file is its own head and tail; one that can't be read has no signature. Two blocks are read, no more."""
    kinds = [pa.string(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with _opened(path) as f:
                        head = f.read(min(block, size))
                        if size > block:
                            f.seek(size - block)
                        out.append((path, size, f"{(size + word_sum(head) + word_sum(f.read(block) if size > block else head)) % 2**WORD_BITS:016x}"))
                except OSError:
                    out.append((path, size, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["path", "size", "signature"])

    rows = files.where("path is not null").select("path", F.col("size").cast("long").alias("size"))
    return rows.mapInArrow(read, T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("signature", T.StringType())]))


def word_sum(data: bytes) -> int:
    """Sum of little-endian 64-bit words, the last one padded with zeros, modulo 2^64."""
    return int(np.frombuffer(data + b"\0" * (-len(data) % 8), "<u8").sum(dtype=np.uint64))
