"""Near-duplicate pairs of fingerprints, their consensus, and duplicates by content."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import bound
from ..functions.vectors import hamming, positional_distance

PART_BITS, SHIFTS, FEW_WORDS = 16, tuple(np.uint64(k) for k in (0, 16, 32, 48)), 100_000
TILE = 64, 2048  # words on either side that are compared at once, few enough for a core's cache
VIDEO_SHARE, AUDIO_SHARE, LEAST_SIMILARITY, MOST_DISTANCE = 0.7, 0.3, 0.75, 0.15


def banded(prints: DataFrame, key: str, bits: str, most: int, width: int = 64) -> DataFrame:
    """(key_a, key_b, distance) of all pairs within ``most`` bits.

    The fingerprint is cut into most + 1 bands; a pair within ``most`` bits agrees on one of them, so joining on
    (band, value) finds all of them and verifies each once, at the first band on which it agrees.
    """
    n = most + 1
    cuts = [k * width // n for k in range(n + 1)]
    bands = F.array(*[F.call_function("shiftrightunsigned", F.col(bits), F.lit(a)).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(cuts, cuts[1:])])
    rows = prints.select(F.col(key).alias("key"), F.col(bits).alias("bits"), bands.alias("bands"))
    spread = rows.select("key", "bits", "bands", F.posexplode("bands").alias("band", "value"))
    a, b = spread.alias("a"), spread.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.key") < F.col("b.key")))
    first = F.array_position(F.zip_with("a.bands", "b.bands", lambda x, y: x == y), True) - 1
    distance = hamming(F.col("a.bits"), F.col("b.bits"))
    return pairs.where((first == F.col("a.band")) & (distance <= most)).select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"), distance.alias("distance"))


def classes(prints: DataFrame, key: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """Rows with equal ``by`` as one: (representatives: key, by...) and (key_a, key_b), a representative and each further key.

    The representative is the least key; rows with a null in ``by`` or the key are in no class.
    """
    rows = prints.select(F.col(key).alias("key"), *by).dropna().distinct()
    first = rows.groupBy(*by).agg(F.min("key").alias("key")).select("key", *by)
    copies = rows.join(first.withColumnRenamed("key", "key_a"), list(by)).where(F.col("key") != F.col("key_a"))
    return first, copies.select("key_a", F.col("key").alias("key_b"))


def within_bits(prints: DataFrame, key: str, bits: str, most: int, block_rows: int = 300_000, least_blocks: int = 6) -> DataFrame:
    """(key_a, key_b, distance) of all pairs within ``most`` bits, for thresholds so wide that no band is selective.

    At 16 of 64 bits the 17 bands have three or four bits each, and a banded join makes more candidates than there are
    pairs. Here the fingerprints are dealt by a hash into blocks of about ``block_rows``, and each pair of blocks is one
    group that compares its words (``near``): what is shuffled grows with rows x blocks, no candidate is a row,
    and a task holds two blocks. Call it on the representatives of ``classes``, so that copies are compared once;
    rows with a null are left out.
    """
    rows = prints.select(F.col(key).alias("key"), F.col(bits).alias("bits")).dropna()
    blocks = max(least_blocks, -(-rows.count() // block_rows))
    own = F.pmod(F.xxhash64("bits", "key"), F.lit(blocks)).cast("int")
    spread = rows.select("key", "bits", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = spread.select("key", "bits", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    kind = T.StructType([T.StructField("key_a", rows.schema["key"].dataType), T.StructField("key_b", rows.schema["key"].dataType), T.StructField("distance", T.IntegerType())])
    out = _arrow(kind)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        keys, own, i, j = group["key"].combine_chunks(), *(group[c].to_numpy() for c in ("own", "i", "j"))
        words = group["bits"].to_numpy().view(np.uint64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for a, b, apart in near(words[left], words[right], most):
            a, b = left[a], right[b]
            once = (i[0] != j[0]) | (a < b)
            found = pa.table([keys.take(pa.array(a[once])), keys.take(pa.array(b[once])), pa.array(apart[once].astype(np.int32))], schema=out)
            yield from found.to_batches()

    found = dealt.groupBy("i", "j").applyInArrow(compare, kind)
    return found.where("key_a <> key_b").select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "distance")


def near(left: np.ndarray, right: np.ndarray, most: int, few: int = FEW_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``left``, in ``right``, distance) of all pairs of 64-bit words within ``most`` bits, each once, some at a time.

    Words are cut into four parts of 16 bits with a radius each, the radii adding up to ``most`` - 3: a pair beyond all four would differ in
    more than ``most`` bits. For each part ``right`` is laid out by the part's value, and a value of ``left`` is compared with the values
    within its radius alone (at 16 bits: radii 4, 3, 3, 3, 7 % of all pairs); a pair counts at the first part that finds it. Up to ``few`` words
    on a side, and where the radii reach most values, all words are compared.
    """
    spare = most - len(SHIFTS) + 1
    radii = [spare // len(SHIFTS) + (k < spare % len(SHIFTS)) for k in range(len(SHIFTS))]
    values = np.arange(1 << PART_BITS, dtype=np.int64)
    balls = [values[np.bitwise_count(values) <= r] if r >= 0 else values[:0] for r in radii]
    if min(len(left), len(right)) <= few or sum(map(len, balls)) > len(values):
        for at in range(0, len(left), TILE[0]):
            for by in range(0, len(right), TILE[1]):
                apart = np.bitwise_count(left[at : at + TILE[0], None] ^ right[None, by : by + TILE[1]])
                hits = np.flatnonzero(apart <= most)
                if len(hits):
                    a, b = np.divmod(hits, apart.shape[1])
                    yield at + a, by + b, apart[a, b]
        return
    part = lambda words, shift: ((words >> shift) & np.uint64(len(values) - 1)).astype(np.int64)
    for k, (shift, ball) in enumerate(zip(SHIFTS, balls)):
        mine, theirs = part(left, shift), part(right, shift)
        order, laid = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
        first, words = np.r_[0, np.cumsum(np.bincount(theirs, minlength=len(values)))], right[laid]
        distinct, begins = np.unique(mine[order], return_index=True)
        for value, group in zip(distinct.tolist(), np.split(order, begins[1:])):
            reached = ball ^ value
            n = first[reached + 1] - first[reached]
            reached, n = reached[n > 0], n[n > 0]
            at = np.repeat(first[reached] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            apart = np.bitwise_count(left[group][:, None] ^ words[at][None, :])
            a, b = np.nonzero(apart <= most)
            if len(a):
                x = left[group[a]] ^ words[at[b]]
                fresh = np.ones(len(a), bool)
                for earlier, radius in zip(SHIFTS[:k], radii):
                    fresh &= np.bitwise_count(part(x, earlier)) > radius
                yield group[a][fresh], laid[at[b]][fresh], apart[a, b][fresh]


def _arrow(kind: T.StructType) -> pa.Schema:
    names = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return pa.schema([pa.field(f.name, names[f.dataType.simpleString()]) for f in kind.fields])


def still_within(found: DataFrame, prints: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """Those of the pairs ``found`` whose fingerprints are within ``most`` bits: (key_a, key_b, distance)."""
    of = lambda n: prints.select(F.col(key).alias(f"key_{n}"), F.col(bits).alias(f"bits_{n}"))
    both = found.select("key_a", "key_b").join(of("a"), "key_a").join(of("b"), "key_b")
    return both.select("key_a", "key_b", hamming(F.col("bits_a"), F.col("bits_b")).alias("distance")).where(F.col("distance") <= most)


def positional(prints: DataFrame, key: str, codes: str, most: float = MOST_DISTANCE) -> DataFrame:
    """(key_a, key_b, score) of all pairs of codes that differ in at most a share ``most`` of their positions, over the shorter length.

    Codes of one length n may differ in e = floor(most n) positions; of e // 2 + 1 stretches such a pair differs in one position at most on
    one, so the two agree on it but for a place left out, and every place left out is a key. Codes of different lengths do the same by stretches
    of floor(1 / most) positions counted from the start, which holds for any shorter length; where the shorter is less than a stretch, the
    beginnings are equal. Of rows with a key in common only those leave the join whose ``_marks`` may be near enough, so that what is shuffled
    grows with the rows and the pairs found; these are compared once, in full. Empty codes and nulls are in no pair. Call
    it on the representatives of ``classes``, so that copies are compared once.
    """
    n = F.size(codes)
    # a small file of many rows would be one task's
    rows = prints.where(F.col(key).isNotNull() & (n > 0)).repartition(F.col(key)).select(F.col(key).alias("key"), F.col(codes).alias("codes"), n.alias("n"), _marks(prints.schema[codes].dataType.elementType, F.col(codes)).alias("marks"))
    errors = F.floor(F.lit(most) * F.col("n") + 1e-9).cast("int")
    stretches = F.expr("errors div 2").cast("int") + 1
    own = lambda p: F.floor(((p + 1) * F.col("stretches") - 1) / F.col("n")).cast("int")
    edge = lambda k: F.floor(k * F.col("n") / F.col("stretches")).cast("int")
    equal = rows.withColumn("errors", errors).withColumn("stretches", stretches)
    places = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda p: _without(p, own(p), edge(own(p)), edge(own(p) + 1), F.col("n")))
    whole = F.array(F.xxhash64("n", "codes"))
    found = _candidates(equal.select("key", "n", "marks", F.when(F.col("errors") > 0, places).otherwise(whole).alias("keys")), (F.col("a.n") == F.col("b.n")) & _may_fit(most))
    lengths = rows.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    if lengths.least != lengths.most:
        size = max(1, int(1 / max(most, 1 / 64) + 1e-9))
        upto = F.expr(f"n div {size}").cast("int") * size
        places = F.transform(F.sequence(F.lit(0), upto - 1), lambda p: _without(p, F.floor(p / size).cast("int"), (F.floor(p / size) * size).cast("int"), ((F.floor(p / size) + 1) * size).cast("int"), F.lit(-1)))
        none = F.array().cast("array<bigint>")
        long = rows.select("key", "n", "marks", F.when(F.col("n") >= size, places).otherwise(none).alias("keys"))
        both = F.least("a.n", "b.n")
        apart = F.col("a.n") != F.col("b.n")
        found = found.unionByName(_candidates(long, apart & (both >= size) & _may_fit(most)))
        begins = F.transform(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(size - 1))), lambda k: F.xxhash64(k, F.slice("codes", F.lit(1), k)))
        if lengths.least < size:
            found = found.unionByName(_candidates(rows.select("key", "n", "marks", begins.alias("keys")), apart & (both < size) & (F.col("a.place") + 1 == both)))
    of = lambda x: rows.select(F.col("key").alias(f"key_{x}"), F.col("codes").alias(f"codes_{x}"))
    scored = found.join(of("a"), "key_a").join(of("b"), "key_b").select("key_a", "key_b", positional_distance(F.col("codes_a"), F.col("codes_b")).alias("d"))
    return scored.where(F.col("d") <= most + 1e-12).select("key_a", "key_b", (1 - F.col("d")).alias("score"))


def _without(place: Column, stretch: Column, begin: Column, end: Column, seed: Column) -> Column:
    """The key of a stretch of ``codes`` with one place left out."""
    return F.xxhash64(seed, stretch, place, F.slice("codes", begin + 1, place - begin), F.slice("codes", place + 2, end - place - 1))


def _marks(kind: T.DataType, codes: Column) -> Column:
    """Two bits of each of the first 64 codes, as a struct of two words: where the bits differ, so do the codes."""
    whole = isinstance(kind, T.IntegralType)
    bits = F.transform(F.slice(codes, 1, 64), lambda x: F.coalesce((x.cast("long") if whole else F.xxhash64(x)).bitwiseAND(F.lit(3).cast("long")), F.lit(0).cast("long")))
    word = lambda x, at: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: F.shiftleft(s, 1).bitwiseOR(F.shiftright(v, at).bitwiseAND(F.lit(1).cast("long"))))
    # the first code is the highest bit, however many there are
    up = lambda x, at: F.call_function("shiftleft", word(x, at), 64 - F.size(x))
    return bound(bits, lambda x: F.struct(up(x, 0).alias("low"), up(x, 1).alias("high")))


def _may_fit(most: float) -> Column:
    """False only for rows a and b whose codes differ, by their marks alone, in more than a share ``most`` of the shorter length."""
    n = F.least("a.n", "b.n")
    apart = F.col("a.marks.low").bitwiseXOR(F.col("b.marks.low")).bitwiseOR(F.col("a.marks.high").bitwiseXOR(F.col("b.marks.high")))
    shared = F.call_function("shiftrightunsigned", apart, F.greatest(F.lit(0), 64 - n))
    return F.bit_count(shared) <= F.floor(F.lit(most) * n + 1e-9)


def _candidates(rows: DataFrame, fit: Column) -> DataFrame:
    """(key_a, key_b), once each, of the rows (key, n, marks, keys) that ``fit`` and have a key in common at its place."""
    spread = rows.select("key", "n", "marks", F.posexplode("keys").alias("place", "value"))
    a, b = spread.alias("a"), spread.alias("b")
    # merged, as a broadcast of one side leaves all comparisons to the few tasks that read the other
    pairs = a.join(b.hint("merge"), (F.col("a.place") == F.col("b.place")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.key") < F.col("b.key")) & fit)
    return pairs.select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b")).distinct()


def consensus(video: DataFrame, audio: DataFrame, video_of_audio: DataFrame | None = None) -> DataFrame:
    """Scores of both kinds of pairs and, where both match, their weighted mean as a third.

    ``video_of_audio`` has the video scores of the audio pairs (``still_within``), where ``video`` itself keeps copies
    as links to a representative.
    """
    v, a = (x.select("key_a", "key_b", F.col("score").alias(n)) for x, n in ((video if video_of_audio is None else video_of_audio, "v"), (audio, "a")))
    both = v.join(a, ["key_a", "key_b"]).select("key_a", "key_b", (VIDEO_SHARE * F.col("v") + AUDIO_SHARE * F.col("a")).alias("score"), F.lit("consensus").alias("reason"))
    tagged = [x.select("key_a", "key_b", "score", F.lit(r).alias("reason")) for x, r in ((video, "video"), (audio, "audio"))]
    return tagged[0].unionByName(tagged[1]).unionByName(both)


def same_content(files: DataFrame, key: str, content: str) -> DataFrame:
    """Each file with the first file of its content and the number of copies; no pairs are made."""
    digest = files.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    groups = digest.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    return digest.join(groups, "digest").select(key, "first", "copies")
