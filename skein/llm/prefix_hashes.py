"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for each place k, the sum of (code point + 1) * BASE^(place + 1) over the places before
k, modulo the prime 2^61 - 1. The difference of two entries is the hash of the span between them, up to a power of
BASE, so any two spans of any two texts are compared in constant time, and the longest common extension of two
places is found by binary search over its length.

The fingerprint of a text is its length, the hash of all of it and the ``KEEP`` least hashes among its spans of
``WINDOW`` code points (40 bits of each; a shorter text is one span). Two fingerprints estimate the Dice
likeness of the texts' sets of spans; it is exact where both hold fewer spans than are kept.

Hashes are 61 bits wide and not cryptographic: equal spans are always called equal, and different ones of n code
points with a probability of about n / 2^61.
"""

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, process_cache, told_apart

PRIME, BASE = (1 << 61) - 1, 1_318_699_207_459_276_317
WINDOW, KEEP, DROP_BITS, DIGITS = 12, 128, 21, 10
BLOCK, SEED, TASK_BUCKETS = 1 << 14, 29, 4
LOW31, LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
B30, B31, B61, ONE = np.uint64(30), np.uint64(31), np.uint64(61), np.uint64(1)
P = np.uint64(PRIME)


def reduced(s: np.ndarray) -> np.ndarray:
    """Values below 2^64 modulo the prime."""
    s = (s & P) + (s >> B61)
    return np.where(s >= P, s - P, s)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo the prime, from halves of 31 bits."""
    au, ad, bu, bd = a >> B31, a & LOW31, b >> B31, b & LOW31
    mid = ad * bu + au * bd
    return reduced(((au * bu) << ONE) + (mid >> B30) + ((mid & LOW30) << B31) + ad * bd)


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^1, BASE^2, ... and BASE^0, BASE^-1, ... for one block and the window behind it; made once for each process."""
    cache = process_cache()
    if "prefix powers" not in cache:
        tables = []
        for first, step in ((BASE, BASE), (1, pow(BASE, -1, PRIME))):
            t = np.array([first], np.uint64)
            while len(t) < BLOCK + WINDOW:
                t = np.concatenate([t, times(t, np.uint64(pow(step, len(t), PRIME)))])
            tables.append(t)
        cache["prefix powers"] = tuple(tables)
    return cache["prefix powers"]


class Prefixes:
    """The prefix array of a text (8 bytes a code point), with its fingerprint."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.n = n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        up, down = powers()
        least = np.empty(0, np.uint64)
        for start in range(0, n, BLOCK):
            c = codes[start : start + BLOCK + WINDOW - 1].astype(np.uint64) + ONE
            power = up[: len(c)]
            mid = c * (power >> B31)
            terms = reduced((mid >> B30) + ((mid & LOW30) << B31) + c * (power & LOW31))
            local = np.zeros(len(c) + 1, np.uint64)
            high = np.cumsum(terms >> B31)
            local[1:] = reduced((high >> B30) + ((high & LOW30) << B31) + np.cumsum(terms & LOW31))
            own = min(BLOCK, n - start)
            shifted = times(local[1 : own + 1], np.uint64(pow(BASE, start, PRIME))) if start else local[1 : own + 1]
            self.sums[start + 1 : start + own + 1] = reduced(shifted + self.sums[start])
            if n < WINDOW:
                spans = local[n:]
            else:
                ends, begins = local[WINDOW:], local[: max(0, len(local) - WINDOW)]
                spans = times(reduced(ends + (P - begins)), down[: len(begins)])
            spans = spans >> np.uint64(DROP_BITS)
            if len(least) == KEEP:
                spans = spans[spans < least[-1]]
            if len(spans):
                least = np.unique(np.concatenate([least, spans]))[:KEEP]
        drawn = least.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()
        self.fingerprint = f"{n:x}-{int(self.sums[n]):016x}-{drawn}"

    def span(self, start: int, length: int) -> int:
        """The hash of a span, as if it stood at the start of its text."""
        return (int(self.sums[start + length]) - int(self.sums[start])) * pow(BASE, -start, PRIME) % PRIME

    def same(self, start: int, other: "Prefixes", there: int, length: int) -> bool:
        """Whether the spans of ``length`` code points at ``start`` here and at ``there`` in ``other`` are equal."""
        return self._equal(start, other, there, length, pow(BASE, there - start, PRIME))

    def _equal(self, a: int, other: "Prefixes", b: int, length: int, shift: int) -> bool:
        here = int(self.sums[a + length]) - int(self.sums[a])
        return (here * shift - int(other.sums[b + length]) + int(other.sums[b])) % PRIME == 0

    def forward(self, start: int, other: "Prefixes", there: int) -> int:
        """Length of the longest equal spans that begin at the two places."""
        shift = pow(BASE, there - start, PRIME)
        low, high = 0, min(self.n - start, other.n - there)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self._equal(start, other, there, mid, shift) else (low, mid - 1)
        return low

    def backward(self, end: int, other: "Prefixes", there: int) -> int:
        """Length of the longest equal spans that end before the two places."""
        shift = pow(BASE, there - end, PRIME)
        low, high = 0, min(end, there)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self._equal(end - mid, other, there - mid, mid, shift) else (low, mid - 1)
        return low


def likeness(a: str, b: str) -> float:
    """Estimated Dice likeness (0 to 1) of the span sets behind two fingerprints; 1 if both texts are empty."""
    x, y = ({f[k : k + DIGITS] for k in range(0, len(f), DIGITS)} for f in (a.rsplit("-", 1)[1], b.rsplit("-", 1)[1]))
    least = sorted(x | y)[:KEEP]
    both = sum(v in x and v in y for v in least)
    return 2 * both / (len(least) + both) if least else 1.0


def extensions(pairs: DataFrame) -> DataFrame:
    """``pairs`` (text_a, at_a, text_b, at_b: places from 0) with ``forward`` and ``backward``: the longest common extensions
    of the two places to either side. A null text is empty; a place outside its text counts as the nearest end, null as 0.

    Other columns are kept; names that clash with the two are replaced.
    """
    keep = [c for c in pairs.columns if c.lower() not in ("forward", "backward")]
    rows = pairs.select(*[F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(keep)])
    at = {c: keep.index(c) for c in ("text_a", "at_a", "text_b", "at_b")}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, i, b, j = (batch.column(at[c]).to_pylist() for c in ("text_a", "at_a", "text_b", "at_b"))
            ahead, behind = [], []
            for s, p, t, q in zip(a, i, b, j):
                s, t = Prefixes(s or ""), Prefixes(t or "")
                p, q = min(max(p or 0, 0), s.n), min(max(q or 0, 0), t.n)
                ahead.append(s.forward(p, t, q))
                behind.append(s.backward(p, t, q))
            columns = [*batch.columns, pa.array(ahead, pa.int64()), pa.array(behind, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "forward", "backward"])

    fields = [T.StructField("forward", T.LongType()), T.StructField("backward", T.LongType())]
    return rows.mapInArrow(find, T.StructType([*rows.schema.fields, *fields])).toDF(*keep, "forward", "backward")


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, text): ``docs`` in buckets of consecutive rows, each followed by the first row of the next bucket.

    The order is that of doc_id, null first; rows of equal doc_id follow a hash of their text, so that a run of
    equal ids spreads over buckets. After the last bucket comes the first. Only ids and hashes are read to find the buckets'
    edges, one for each bucket; texts are shuffled once. A partition holds whole buckets, sorted.
    """
    spark = docs.sparkSession
    n = TASK_BUCKETS * partitions(spark)
    rows = told_apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), SEED, "a", "b")
    order = [F.col("doc_id").asc_nulls_first(), F.col("a"), F.col("b")]
    ranges = rows.select("doc_id", "a", "b").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    edges = ranges.groupBy("part").agg(F.min(F.struct("doc_id", "a", "b")).alias("edge")).select("edge.*").collect()
    edges = sorted((e.doc_id is not None, e.doc_id or 0, e.a, e.b) for e in edges)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def buckets(doc_id: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for d, *hashes in zip(doc_id.to_pylist(), a.to_pylist(), b.to_pylist()):
            key = (d is not None, d or 0, *hashes)
            k = bisect_right(edges, key) - 1
            out.append([k, (k - 1) % len(edges)] if edges[k] == key else [k])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = rows.select("doc_id", "text", "a", "b", F.posexplode(buckets("doc_id", "a", "b")).alias("guest", "bucket"))
    return dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "guest", *order).select("bucket", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down, in code points) replaced by the first as many of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "n_chars")]
    + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    + [T.StructField(c, T.LongType()) for c in ("common_edited", "common_next")]
)


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document (see ``edited``, ``in_order``).

    common_edited and common_next are the lengths of the longest common beginnings, by binary search. A null
    text is empty; repeated rows are rows of their own; a single document is its own next; empty table: no rows. A task holds
    one batch of texts and the prefix arrays of three, however long they are.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for bucket, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                prefixes = Prefixes(text)
                if last and last[0] == bucket:
                    _, before, earlier, here = last
                    changed = edited(earlier, text)
                    there = Prefixes(changed)
                    sha = hashlib.sha256(changed.encode()).hexdigest()
                    near = likeness(here.fingerprint, there.fingerprint), likeness(here.fingerprint, prefixes.fingerprint)
                    common = here.forward(0, there, 0), here.forward(0, prefixes, 0)
                    out.append((before, here.n, sha, here.fingerprint, there.fingerprint, *near, *common))
                last = bucket, doc_id, text, prefixes
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=RESULT.names)

    return in_order(docs).mapInArrow(compare, RESULT)


TYPES = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2 + [pa.int64()] * 2

# The same sums over rows of code points: powers of BASE from two small tables, spans as sums over window frames.
SQL = f"""
WITH RECURSIVE small AS (
    SELECT 0 AS k, 1::HUGEINT AS up, 1::HUGEINT AS down
    UNION ALL SELECT k + 1, up * {BASE} % {PRIME}, down * {pow(BASE, -1, PRIME)} % {PRIME} FROM small WHERE k < 1023
), big AS (
    SELECT 0 AS k, 1::HUGEINT AS up, 1::HUGEINT AS down
    UNION ALL SELECT k + 1, up * {pow(BASE, 1024, PRIME)} % {PRIME}, down * {pow(BASE, -1024, PRIME)} % {PRIME} FROM big WHERE k < 1023
), power AS (
    SELECT big.k * 1024 + small.k AS k, big.up * small.up % {PRIME} * {BASE} % {PRIME} AS up, big.down * small.down % {PRIME} AS down
    FROM big, small WHERE big.k * 1024 <= (SELECT max(length(text)) * 2 FROM documents)
), ordered AS (
    SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS r, count(*) OVER () AS rows, doc_id, coalesce(text, '') AS text FROM documents
), texts AS (
    SELECT t.r, u.r AS next, t.doc_id, t.text, u.text AS following, length(t.text) AS n,
        t.text[: length(t.text) - length(t.text) // 4] || u.text[: length(t.text) // 4] AS edited
    FROM ordered t JOIN ordered u ON u.r = (t.r + 1) % t.rows
), forms AS (
    SELECT 2 * r AS f, text FROM texts UNION ALL SELECT 2 * r + 1, edited FROM texts
), codes AS (
    SELECT f, length(text) AS n, unnest(range(length(text))) AS k, unicode(unnest(string_split(text, ''))) + 1 AS code FROM forms WHERE text <> ''
), terms AS (
    SELECT f, n, k, code * up % {PRIME} AS term, down FROM codes JOIN power USING (k)
), spans AS (
    SELECT f, n, k, (sum(term) OVER (PARTITION BY f ORDER BY k ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) % {PRIME} * down % {PRIME} // {1 << DROP_BITS})::BIGINT AS span, term
    FROM terms
), sketches AS (
    SELECT f, list_sort(list_distinct(list(span) FILTER (k <= greatest(n - {WINDOW}, 0))))[:{KEEP}] AS least, (sum(term) % {PRIME})::BIGINT AS whole FROM spans GROUP BY f
), prints AS (
    SELECT f, coalesce(least, []::BIGINT[]) AS least,
        format('{{:x}}-{{:016x}}-', length(text), coalesce(whole, 0)) || coalesce(array_to_string(list_transform(least, lambda v: format('{{:0{DIGITS}x}}', v)), ''), '') AS fingerprint
    FROM forms LEFT JOIN sketches USING (f)
), near AS (
    SELECT t.*, a.fingerprint, b.fingerprint AS edited_fingerprint,
        list_sort(list_distinct(list_concat(a.least, b.least)))[:{KEEP}] AS u, list_sort(list_distinct(list_concat(a.least, c.least)))[:{KEEP}] AS v,
        a.least AS x, b.least AS y, c.least AS z, string_split(t.text, '') AS d, string_split(t.edited, '') AS e, string_split(t.following, '') AS g
    FROM texts t JOIN prints a ON a.f = 2 * t.r JOIN prints b ON b.f = 2 * t.r + 1 JOIN prints c ON c.f = 2 * t.next
), matched AS (
    SELECT *, len(list_intersect(list_intersect(u, x), y)) AS p, len(list_intersect(list_intersect(v, x), z)) AS q FROM near
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
    CASE WHEN len(u) = 0 THEN 1.0::DOUBLE ELSE 2 * p / (len(u) + p)::DOUBLE END AS near_edited,
    CASE WHEN len(v) = 0 THEN 1.0::DOUBLE ELSE 2 * q / (len(v) + q)::DOUBLE END AS near_next,
    coalesce(list_position(list_transform(range(1, least(n, length(edited)) + 1), lambda k: d[k] <> e[k]), true) - 1, least(n, length(edited)))::BIGINT AS common_edited,
    coalesce(list_position(list_transform(range(1, least(n, length(following)) + 1), lambda k: d[k] <> g[k]), true) - 1, least(n, length(following)))::BIGINT AS common_next
FROM matched
"""
