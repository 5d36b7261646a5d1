"""A stored positional index over texts: segments of postings, replaced by path; terms, phrases and prefixes with BM25 and exact counts.

A write is a segment: its documents with their lengths, and its postings (term, path, places), laid out by buckets of terms
so that a look-up reads the buckets of its terms alone. The newest segment that names a path holds it; older rows of that path no longer
count, and a document whose text is null is gone. ``merged`` writes one segment of all live rows.

Postings, which shuffled would take several times the room of the texts, are sorted and written by the task that reads their documents. A
folder for each part of the tasks keeps them beside these documents, so that a merge goes part by part.
"""

import math
import operator
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stems
from ..sources.shared import written
from .search import B, K1, LEAST_IDF

BUCKETS, PARTS, BROADCAST_ROWS = 64, 16, 200_000
TEXTS = 256  # whose postings Python holds at a time
POSTINGS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType()))]))
SEGMENT = "path string, term string, places array<int>, segment int, part int, bucket int"
DOCUMENT = "path string, length int, part int, segment int"


def placed_terms(text):
    """Column: the terms of a text, each with its places from 0 in order; a null or empty text has none. A few texts of a batch are read at a time."""

    @F.arrow_udf(POSTINGS)
    def split(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = lru_cache(maxsize=1 << 17)(stems.stem)
        for column in columns:
            for first in range(0, len(column), TEXTS):
                yield _postings(column.slice(first, TEXTS).to_pylist(), known)

    return split(text)


def _postings(texts: list[str | None], known: Callable[[str], str]) -> pa.Array:
    ends, names, place_ends, places = [0], [], [0], []
    for value in texts:
        at = defaultdict(list)
        for k, word in enumerate(stems.WORD.findall(stems.folded(value or ""))):
            at[known(word)].append(k)
        for term, found in at.items():
            names.append(term)
            places += found
            place_ends.append(len(places))
        ends.append(len(names))
    lists = pa.ListArray.from_arrays(pa.array(place_ends, pa.int32()), pa.array(places, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), lists], ["term", "places"]))


class TextIndex:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def write(self, docs: DataFrame, segment: int, path: str = "path", text: str = "text") -> None:
        """Documents as segment ``segment``: they take the place of all earlier ones of their paths. Written again, a segment replaces itself.

        A path twice in one segment keeps the row of the least text. A null path is left out; a null text removes its path.
        """
        one = docs.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("text"))
        cores = self.spark.sparkContext.defaultParallelism
        if not one.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            one = one.groupBy("path").agg(F.min("text").alias("text"))
        elif one.select(F.spark_partition_id()).distinct().count() < cores:
            one = one.repartition(cores, "path")
        rows = one.select("path", "text", (F.spark_partition_id() % PARTS).alias("part")).select("path", "part", F.col("text").isNull().alias("_gone"), placed_terms(F.col("text")).alias("_t"))
        # a document's length goes along as places without a term, in a bucket of its own
        length = F.when(~F.col("_gone"), F.aggregate("_t", F.lit(0), lambda n, x: n + F.size(x["places"])))
        all_terms = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), F.array(length).alias("places"))), "_t")
        each = rows.select("path", "part", F.explode(all_terms).alias("t")).select("path", "t.term", "t.places", "part")
        self._lay(each.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(self._bucket(F.col("term")))), segment, "overwrite")
        # the documents come last: until then the postings belong to no live document
        held = self.spark.read.schema(SEGMENT.replace(" segment int,", "")).parquet(f"{self.folder}/postings/segment={segment}").where("bucket = -1")
        held.select("path", F.col("places")[0].alias("length"), "part").coalesce(cores).write.mode("overwrite").parquet(f"{self.folder}/documents/segment={segment}")

    def _lay(self, rows: DataFrame, segment: int, mode: str) -> None:
        laid = rows.select("path", "term", "places", "part", "bucket").sortWithinPartitions("part", "bucket", "term", "path")
        laid.write.mode(mode).partitionBy("part", "bucket").parquet(f"{self.folder}/postings/segment={segment}")

    def _bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def documents(self) -> DataFrame:
        """(path, segment, length, part) of the live documents."""
        rows = self.spark.read.schema(DOCUMENT).parquet(f"{self.folder}/documents")
        newest = rows.groupBy("path").agg(F.max(F.struct("segment", "length", "part")).alias("d"))
        return newest.select("path", "d.segment", "d.length", "d.part").where("length is not null")

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.drop("part").join(self.documents(), ["path", "segment"])

    def postings(self) -> DataFrame:
        """The postings of all segments, their files listed now."""
        return self.spark.read.schema(SEGMENT).parquet(f"{self.folder}/postings")

    def phrase(self, words: list[str], prefix: bool = False, listed: DataFrame | None = None) -> DataFrame:
        """(path, length, hits): live documents that hold the terms one after the other, and how often.

        With ``prefix`` the one word is a beginning, which isn't stemmed. No word: no row. ``listed``: postings that were listed before.
        """
        postings = self.postings() if listed is None else listed
        if prefix:
            found = self._live(postings.where(F.col("term").startswith(words[0])))
            return found.groupBy("path", "length").agg(F.sum(F.size("places")).alias("hits"))
        if not words:
            return self.documents().where("false").select("path", "length", F.lit(0).cast("long").alias("hits"))
        wanted = sorted(set(words))
        buckets = self.spark.createDataFrame([(w,) for w in wanted], "term string").select(self._bucket(F.col("term")).alias("b")).distinct().collect()
        found = self._live(postings.where(F.col("bucket").isin(*[b.b for b in buckets]) & F.col("term").isin(*wanted)))
        if len(words) == 1:
            return found.select("path", "length", F.size("places").cast("long").alias("hits"))
        # one row for each path, with as many lists of places as the phrase has terms
        held = found.groupBy("path", "length").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at")).where(F.size("at") == len(wanted))
        begins = F.col("at")[words[0]]
        for k, word in enumerate(words[1:], 1):
            begins = F.array_intersect(begins, F.transform(F.col("at")[word], partial(operator.add, -k)))
        return held.select("path", "length", F.size(begins).cast("long").alias("hits")).where("hits > 0")

    def search(self, *phrases: str) -> DataFrame:
        """(path, score) of live documents that hold every phrase, by BM25; larger is better.

        A phrase is a text of one or more words, put through ``terms``; one that ends in ``*`` is a word's beginning. Statistics cover
        all live documents. A phrase without words holds nowhere. What the phrases hit is written, as it is read more than once.
        """
        stats = self.documents().agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length"))
        parts, listed = [], self.postings()
        for k, phrase in enumerate(phrases):
            prefix = phrase.endswith("*")
            words = [stems.folded(phrase[:-1].strip())] if prefix else stems.terms(phrase)
            parts.append(self.phrase(words, prefix, listed).withColumn("phrase", F.lit(k)))
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        hits = written(hits, "hits")
        df = hits.groupBy("phrase").agg(F.count("*").alias("df"))  # a row for each phrase
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        weight = idf * F.col("hits") * (K1 + 1) / (F.col("hits") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
        scored = hits.join(F.broadcast(df), "phrase").crossJoin(F.broadcast(stats)).groupBy("path").agg(F.sum(weight).alias("score"), F.count("*").alias("held"))  # one row of statistics
        return scored.where(F.col("held") == len(phrases)).select("path", "score")

    def page(self, table: DataFrame, *phrases: str, limit: int = 100, offset: int = 0, digits: int | None = None) -> DataFrame:
        """Rows of ``table`` by path for the best hits, ties by path, with their score and the exact ``total`` of all hits.

        With ``digits`` scores are rounded before they are compared, so that those which read alike are ties.
        """
        hits = self.search(*phrases).join(table.select("path"), "path", "left_semi")
        if digits is not None:
            hits = hits.withColumn("score", F.round("score", digits))
        hits = written(hits, "scores")
        total = hits.agg(F.count("*").alias("total"))
        best = hits.orderBy(F.desc("score"), "path").limit(offset + limit).orderBy(F.desc("score"), "path").offset(offset)
        return table.join(F.broadcast(best), "path").crossJoin(F.broadcast(total)).orderBy(F.desc("score"), "path")  # at most a page; one row

    def merged(self, segment: int, *older: int) -> None:
        """Writes the live rows of the segments ``older`` as one segment, which must be the newest; the old ones may be removed then.

        Parts are taken together as long as a broadcast holds their documents; one with more documents is read for each share of them.
        """
        staged = f"{self.folder}/documents.merged/segment={segment}"
        self.documents().where(F.col("segment").isin(*older)).write.mode("overwrite").parquet(staged)
        docs = self.spark.read.schema("path string, segment int, length int, part int").parquet(staged)
        postings, mode = self.postings().where(F.col("segment").isin(*older) & F.col("term").isNotNull()), "overwrite"
        for parts, share, shares in _shares({r.part: r["count"] for r in docs.groupBy("part").count().collect()}):
            live = docs.where(F.col("part").isin(*parts) & (F.pmod(F.xxhash64("path"), F.lit(shares)) == share)).select("path", "segment")
            self._lay(postings.where(F.col("part").isin(*parts)).join(F.broadcast(live), ["path", "segment"], "left_semi"), segment, mode)
            mode = "append"
        # the documents come last: until then the new postings belong to no live document
        docs.select("path", "length", "part").write.mode("overwrite").parquet(f"{self.folder}/documents/segment={segment}")


def _shares(counts: dict[int, int]) -> list[tuple[list[int], int, int]]:
    """(parts, share, shares) of each step of a merge, with ``BROADCAST_ROWS`` documents or so at most."""
    steps, held = [], BROADCAST_ROWS
    for part, n in sorted(counts.items()):
        if n > BROADCAST_ROWS:
            shares = math.ceil(n / BROADCAST_ROWS)
            steps += [([part], k, shares) for k in range(shares)]
            held = BROADCAST_ROWS
        elif held + n > BROADCAST_ROWS:
            steps.append(([part], 0, 1))
            held = n
        else:
            steps[-1][0].append(part)
            held += n
    return steps
