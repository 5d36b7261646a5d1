"""SimHash near-duplicate groups, found through Golay-code keys.

Fingerprint: words are runs of bytes other than ASCII white space, A-Z lower-cased; each three
consecutive words, repeats included, give one XXH64 (seed 42); a bit is set when it is set in more
than half of the hashes. Fewer than three words hash as one shingle, none gives zero.

Search: two fingerprints within three bits agree on at least one of four 16-bit segments (three
errors cannot touch four). Of the two 24-bit halves of the other 48 bits, one has at most one error.
Its 23 lower bits are decoded with the perfect (23,12) Golay code. A word's own key is the index of
its nearest codeword; its search keys are the indices of all codewords within distance three, and
within four if the nearest is three away (one index, or six). If two words differ in one bit at most,
the own key of either is among the search keys of the other. So
(segment, half, 16 exact bits, 12-bit codeword index) joins all linked pairs, and a popcount verifies.

Equal fingerprints are one node, so copies never multiply. What a key gathers is compared inside the
task and leaves as a spanning forest, never as all its pairs. Keys are counted before rows are shuffled by
them: a row of a key with more than ``block_rows`` rows gets four finer keys instead, each with 12 of the
48 bits in which its links may differ (three errors cannot touch four parts). Where a finer key still has too
many rows, it is divided into blocks, and pairs of blocks are compared by separate tasks.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_position, fresh, meet, partitions, small, utf8, written
from .components import connected_components

SEED, SHINGLE, MAX_BITS = 42, 3, 3
CHUNK, HOT_COPIES = 1 << 16, 100_000
# Fixed value: generator polynomial of the binary (23,12,7) Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY_POLYNOMIAL = 0b110001110101


def simhash(text: bytes) -> int:
    """The fingerprint of UTF-8 ``text`` as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    digest, n, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(doc_id, fp: the fingerprint's 64 bits as a long) for every row, and ``row`` if given; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(map(simhash, utf8(batch.column(0))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], [*batch.schema.names[1:], "fp"])

    rest = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *([row.alias("row")] if row is not None else []))
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields[1:], T.StructField("fp", T.LongType())]))


def _syndromes() -> np.ndarray:
    """Remainder by the generator of every single-bit word."""
    out = []
    for i in range(23):
        v = 1 << i
        for shift in range(11, -1, -1):
            if v >> (shift + 11) & 1:
                v ^= GOLAY_POLYNOMIAL << shift
        out.append(v)
    return np.array(out)


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the lower 12 and upper 11 bits, and for each syndrome up to six error patterns (-1: none)."""
    from itertools import combinations

    single = _syndromes()
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[(np.arange(1 << 12) >> i & 1) == 1] ^= single[i]
    for i in range(11):
        high[(np.arange(1 << 11) >> i & 1) == 1] ^= single[12 + i]
    errors = np.full((1 << 11, 6), -1, np.int64)
    weight = np.zeros(1 << 11, np.int64)
    for size in range(5):
        for at in combinations(range(23), size):
            syndrome = int(np.bitwise_xor.reduce(single[list(at)])) if at else 0
            pattern = sum(1 << i for i in at)
            if size < 4:
                errors[syndrome, 0], weight[syndrome] = pattern, size
            elif weight[syndrome] == 3:
                errors[syndrome, int((errors[syndrome] >= 0).sum())] = pattern
    return low, high, errors


def golay_keys(fp: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, own) rows of unsigned fingerprints; own marks the key of the nearest codeword."""
    low, high, errors = tables
    keys, rows, own = [], [], []
    for segment in range(4):
        shift = 16 * segment
        exact = (fp >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int64)
        upper = np.right_shift(fp >> np.uint64(shift), np.uint64(16))
        rest = (fp & np.uint64((1 << shift) - 1)) | (upper << np.uint64(shift))
        for half in range(2):
            word = (rest >> np.uint64(24 * half) & np.uint64(0x7FFFFF)).astype(np.int64)
            pattern = errors[low[word & 0xFFF] ^ high[word >> 12]]
            index = (word[:, None] ^ pattern) >> 11
            key = ((segment * 2 + half) << 28 | exact << 12)[:, None] | index
            i, j = np.nonzero(pattern >= 0)
            keys.append(key[i, j])
            rows.append(fp[i])
            own.append(j == 0)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(own)


def forest(own: np.ndarray, fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (node, root) of the links between ``own`` and all of the sorted distinct ``fps``."""
    label, at = np.arange(len(fps)), np.searchsorted(fps, own)
    step = max(1, (1 << 22) // max(1, len(fps)))
    for k in range(0, len(at), step):
        i, j = np.nonzero(np.bitwise_count(fps[at[k : k + step]][:, None] ^ fps[None, :]) <= max_bits)
        i = at[k + i]
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != (label := label[label])).any():
                pass
    child = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[child], fps[label[child]]


def _linked(keys: np.ndarray, fps: np.ndarray, own: np.ndarray, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal, sorted keys: short runs pair by pair, longer ones as a forest."""
    n = len(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, n])
    run = np.repeat(size, size)
    out_a, out_b = [], []
    for lag in range(1, small):
        i = np.flatnonzero((keys[lag:] == keys[:-lag]) & (run[lag:] <= small))
        if not len(i):
            break
        i = i[(own[i] | own[i + lag]) & (np.bitwise_count(fps[i] ^ fps[i + lag]) <= MAX_BITS)]
        out_a.append(fps[i])
        out_b.append(fps[i + lag])
    for s, m in zip(first[size > small].tolist(), size[size > small].tolist()):
        a, b = forest(fps[s : s + m][own[s : s + m]], np.unique(fps[s : s + m]))
        out_a.append(a)
        out_b.append(b)
    if not out_a:
        return fps[:0], fps[:0]
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def finer(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Four keys (columns) for each row of a key: the key with 12 of the bits outside its exact segment."""
    shift = (key >> 29).astype(np.uint64) * np.uint64(16)
    low = fp & ((np.uint64(1) << shift) - np.uint64(1))
    rest = low | (np.right_shift(np.right_shift(fp, shift), np.uint64(16)) << shift)
    parts = [rest >> np.uint64(12 * j) & np.uint64(0xFFF) | np.uint64(j << 12) for j in range(4)]
    mixed = (key.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ np.stack(parts, 1)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ mixed >> np.uint64(29)).view(np.int64)


KEYED = "key long, fp long, own boolean"


def _crowded(keyed: DataFrame, block_rows: int) -> DataFrame:
    return written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block_rows), "crowded")


def links(nodes: DataFrame, block_rows: int = 20_000) -> DataFrame:
    """(a, b: long) edges that connect all of the distinct ``nodes`` (fp) within three bits, directly or through others."""
    tables = golay_tables()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 4096):
                key, row, own = golay_keys(fp[at : at + 4096], tables)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row.view(np.int64)), pa.array(own)], ["key", "fp", "own"])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(finer(key, fp.view(np.uint64)).ravel()), pa.array(np.repeat(fp, 4)), pa.array(np.repeat(own, 4))], ["key", "fp", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the runs of a batch are compared at once, the last one waits for its rest."""

        def edges(run: list[tuple]) -> pa.RecordBatch:
            a, b = _linked(*(np.concatenate(x) for x in zip(*run)))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        rest: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            if rest and (last or rest[-1][0][-1] != key[0]):
                yield edges([*rest, (key[:last], fp[:last].view(np.uint64), own[:last])])
                rest = []
            elif last:
                yield edges([(key[:last], fp[:last].view(np.uint64), own[:last])])
            rest.append((key[last:], fp[last:].view(np.uint64), own[last:]))
        if rest:
            yield edges(rest)

    def compared(rows: DataFrame) -> DataFrame:
        sorted_rows = rows.select("key", "fp", "own").repartition(n, "key").sortWithinPartitions("key", "fp")
        return sorted_rows.mapInArrow(compare, "a long, b long")

    n = partitions(nodes.sparkSession)
    keyed = nodes.select("fp").mapInArrow(expand, KEYED)
    crowded = _crowded(keyed, block_rows)
    if crowded.isEmpty():
        return written(compared(keyed), "links")
    crowded = small(crowded.select("key"))
    fine = written(keyed.join(crowded, "key", "left_semi").select("key", "fp", "own").mapInArrow(refine, KEYED), "finer")
    dense = _crowded(fine, block_rows)
    out = compared(keyed.join(crowded, "key", "left_anti")).union(compared(fine.join(small(dense.select("key")), "key", "left_anti")))
    if not dense.isEmpty():
        blocks = small(dense.select("key", F.ceil(F.col("n") / F.lit(block_rows)).cast("long").alias("blocks")))
        rows = fine.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
        spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "own")

        def pair(batch: pa.Table) -> pa.Table:
            fps = np.unique(batch.column("fp").to_numpy().view(np.uint64))
            own = batch.column("fp").filter(batch.column("own")).to_numpy().view(np.uint64)
            a, b = forest(own, fps)
            return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

        out = out.union(spread.groupBy("key", "i", "j").applyInArrow(pair, "a long, b long"))
    return written(out, "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, itself included. Null texts, empty texts and
    texts of white space have fingerprint zero and link to each other. Repeated rows each give a row. A
    null doc_id never becomes a component_id unless its whole component has none. Empty table: no rows.
    Extra columns are not read.
    """
    return grouped(written(fingerprints(docs), "fingerprints")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(prints: DataFrame) -> DataFrame:
    """Written ``prints`` (doc_id, fp, ...) with component_id.

    Copies meet only as one node with a count; fingerprints of more than ``HOT_COPIES`` rows, of which there can be few,
    are broadcast so that no task gets all their rows.
    """
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "nodes")
    roots = connected_components(links(nodes))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    joined = written(joined.select("fp", "low", "copies", "root"), "roots")
    least = written(joined.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members")), "least")
    found = meet(joined, least, "root", F.col("members") > joined.count() // 1000)
    of = written(found.select("fp", "component_id", "copies"), "components")
    hot = of.where(F.col("copies") > HOT_COPIES).select("fp", "component_id")
    cool = of.where(F.col("copies") <= HOT_COPIES).select("fp", "component_id")
    if hot.isEmpty():
        return prints.join(cool, "fp")
    hot = small(hot)
    return prints.join(hot, "fp").unionByName(prints.join(hot, "fp", "left_anti").join(cool, "fp"))


@by_position
def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, of each near-duplicate group: the least doc_id, null last, then the least hash of the row.

    Rows are documents of their own, also where they share a doc_id or have none.
    """
    a, b, rank = fresh(docs.columns, "_a", "_b", "_rank")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))
    prints = written(fingerprints(docs, row), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("row").alias("low"))
    roots = connected_components(links(written(nodes, "nodes")))
    one = nodes.join(roots, nodes["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("low").alias("low"))
    kept = one.select(F.col("low.a").alias(a), F.col("low.b").alias(b))
    rows = docs.withColumn(a, F.xxhash64("doc_id", "text")).withColumn(b, F.xxhash64(F.lit(1), "text", "doc_id")).join(kept, [a, b], "left_semi")
    # wholly equal rows: one of them, cut before the shuffle
    order = Window.partitionBy(a, b).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
