"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, ... and share 150 % of all words; a
target stops at twice its source's words and the excess is shared again by weight.

Blocks: the documents of a source stand in a seeded random order, once and then once more, and this stream is
cut into blocks of about ``block_words`` words; a document belongs to the block where it starts. A
source's blocks are put into a seeded random permutation and taken in its order until the target is met;
the last block is cut, so a source takes its target to the word and one document at most is cut.

Tree: the root holds the exact number of blocks that every source takes. Each node gives its left child half
of its output shards (rounded down) and the same share of blocks, how many from each source being drawn
from the multivariate hypergeometric distribution, until a leaf is one shard. The permutation is
dealt to the shards in stretches of these quotas, so draws are disjoint; rows within a shard are shuffled by
a seeded hash. Sources are split by chunks: first the chunks' totals, then the sources within each chunk
under them, which is the same distribution.

No task holds a source or a shard: running sums go over parts by hash first and then within a part.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_position, fresh, partitions, told_apart, written

# Fixed values of the mix: weights, share of all words, most repeats.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
SEED, OUTPUTS, BLOCK_WORDS = 11, 24, 4096
BROADCAST_BYTES, CHUNK_SOURCES, PART_ROWS, RUN_PARTS = 8 << 20, 10_000, 20_000, 64
# numpy draws exactly from up to so many blocks; beyond, the normal limit of the distribution stands in for it.
EXACT_BLOCKS = 10**9


def split(quotas: np.ndarray, outputs: int, seed: int, totals: np.ndarray | None = None) -> np.ndarray:
    """Blocks of each source (rows) for each output shard (columns); row sums are ``quotas``, column sums ``totals`` if given."""
    out = np.zeros((len(quotas), outputs), np.int64)
    todo = [(0, outputs, quotas.astype(np.int64))]
    while todo:
        first, n, have = todo.pop()
        if n == 1:
            out[:, first] = have
            continue
        left, total = n // 2, int(have.sum())
        rng = np.random.default_rng((seed, first, n))
        if totals is None:
            to_left = total * left // n
            # a total that n does not divide: the odd blocks fall left as often as its share of the shards
            to_left += int(rng.random() < total * left / n - to_left)
        else:
            to_left = int(totals[first : first + left].sum())
        got = drawn(have, to_left, rng)
        todo += [(first, left, got), (first + left, n - left, have - got)]
    return out


def drawn(have: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` blocks, drawn from all without replacement, come from each source."""
    total = int(have.sum())
    if total < EXACT_BLOCKS:
        return rng.multivariate_hypergeometric(have, n, method="marginals") if total else have
    out = np.zeros_like(have)
    for k, good in enumerate(have.tolist()):
        bad = total - good
        if total < EXACT_BLOCKS:
            out[k] = rng.hypergeometric(good, bad, n) if n else 0
        else:
            mean = n * (good / total)
            spread = np.sqrt(mean * (bad / total) * ((total - n) / max(1, total - 1)))
            out[k] = min(max(round(rng.normal(mean, spread)), n - bad, 0), good, n)
        n, total = n - int(out[k]), bad
    return out


def targeted(sources: DataFrame) -> DataFrame:
    """(key, source_size) with ``target``: the words to take from each source; the order is that of the keys, null last.

    Places are counted over range partitions, and each round of refilling is one sum over all sources.
    """
    n = partitions(sources.sparkSession)
    order = [F.col("key") == "", "key"]
    ranged = written(sources.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double")
    rows = written(ranged.join(F.broadcast(before), "part").select("key", "source_size", weight.alias("weight"), (F.col("source_size") * float(REPEATS)).alias("most")), "mix-sources")
    words = SHARE * float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n)
    level, full = 0.0, -1
    while True:
        over = F.col("most") < level * F.col("weight")
        r = rows.agg(*[F.coalesce(F.sum(F.when(c, v)), F.lit(0.0)).alias(a) for c, v, a in ((over, F.col("most"), "most"), (~over, F.col("weight"), "weight"), (over, F.lit(1.0), "full"))]).first()
        if not r.weight or int(r.full) == full:
            break
        level, full = (words - r.most) / r.weight, int(r.full)
    return rows.select("key", "source_size", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def running(parts: DataFrame, keys: list[str], **values: str) -> DataFrame:
    """``parts`` (keys, part, ...) with the sum of each value over a group's parts before this one, by the given names.

    Sums go over runs of ``RUN_PARTS`` parts first and then within a run, so no task has all parts of a source.
    """
    runs = parts.withColumn("run", F.floor(F.col("part") / RUN_PARTS))
    ahead = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.groupBy(*keys, "run").agg(*[F.sum(v).alias(name) for name, v in values.items()])
    sums = sums.select(*keys, "run", *[F.coalesce(F.sum(name).over(ahead), F.lit(0)).alias(f"_{name}") for name in values])
    out = runs.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(name) for name, v in values.items()]).join(sums, [*keys, "run"])
    return out.select(*parts.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in values])


def stretches(blocks: DataFrame, outputs: int, seed: int) -> DataFrame:
    """(key, ends): where each shard's stretch of a source's permuted blocks ends, from (key, blocks)."""
    n = -(-blocks.count() // CHUNK_SOURCES)
    chunked = blocks.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(max(1, n))))

    def of_chunks(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        shares = split(t["blocks"].to_numpy(), outputs, seed)
        return pa.table({"chunk": t["chunk"], "totals": pa.array(shares.tolist(), pa.list_(pa.int64()))})

    def of_sources(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        shares = split(t["blocks"].to_numpy(), outputs, seed + 1 + t["chunk"][0].as_py(), np.array(t["totals"][0].as_py()))
        return pa.table({"key": t["key"], "ends": pa.array(np.cumsum(shares, axis=1).tolist(), pa.list_(pa.int64()))})

    # one row for each chunk of ten thousand sources
    totals = chunked.groupBy("chunk").agg(F.sum("blocks").alias("blocks")).withColumn("every", F.lit(0)).groupBy("every").applyInArrow(of_chunks, "chunk long, totals array<long>")
    return chunked.join(totals, "chunk").groupBy("chunk").applyInArrow(of_sources, "key string, ends array<long>")


def _with_sources(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with _a, _b (hashes by which rows differ), _key and _size."""
    return told_apart(docs, seed, "_a", "_b").select(
        "*",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
    )


def plan(rows: DataFrame, outputs: int, seed: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """(rows with source_size and target, draws) for written rows (a, b, key, size).

    Draws: a, b, size, epoch, words, shard, block (its place among the source's taken blocks).
    """
    n = max(partitions(rows.sparkSession), rows.count() // PART_ROWS)
    rows = rows.withColumn("part", F.pmod("a", F.lit(n)))
    sums = written(rows.groupBy("key", "part").agg(F.sum("size").alias("words")), "mix-sums")
    sources = targeted(sums.groupBy("key").agg(F.sum("words").alias("source_size")))
    starts = written(running(sums, ["key"], before="words").drop("words").join(sources, "key"), "mix-starts")
    rows = rows.join(starts, ["key", "part"])
    # the stream: every document with words, once for each epoch, and its block
    inside = Window.partitionBy("key", "part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("epoch") * F.col("source_size")
    want = F.least(F.rint("target").cast("long"), REPEATS * F.col("source_size")).alias("want")
    first = rows.where("size > 0").withColumn("epoch", F.lit(0)).withColumn("start", start)
    epochs = F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("epoch")
    stream = first.select("a", "b", "key", "size", want, epochs, F.col("start").alias("at"), "source_size")
    stream = stream.select("a", "b", "key", "size", "want", "epoch", (F.col("at") + F.col("epoch") * F.col("source_size")).alias("start"))
    stream = written(stream.withColumn("block", F.expr(f"start div {block_words}")), "mix-stream")
    # blocks in a random order, cut where the target is met
    order = F.xxhash64(F.lit(seed), "key", "block")
    blocks = stream.groupBy("key", "block").agg(F.sum("size").alias("words"), F.min("start").alias("first"), F.first("want").alias("want"))
    blocks = written(blocks.withColumn("order", order).withColumn("part", F.shiftright("order", 48)), "mix-blocks")
    parts = blocks.groupBy("key", "part").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    parts = running(parts, ["key"], words_before="words", n_before="n").drop("words", "n")
    within = Window.partitionBy("key", "part").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    sofar = F.col("words_before") + F.coalesce(F.sum("words").over(within), F.lit(0))
    place = F.col("n_before") + F.coalesce(F.count("block").over(within), F.lit(0))
    dealt = blocks.join(parts, ["key", "part"]).select("key", "part", F.col("block").alias("number"), "first", "want", sofar.alias("sofar"), place.alias("place"))
    dealt = written(dealt.where("sofar < want"), "mix-dealt")
    # the tree over the blocks that each source takes
    ends = written(stretches(dealt.groupBy("key").agg(F.count("*").alias("blocks")), outputs, seed), "mix-ends")
    if ends.count() * (outputs * 8 + 100) <= BROADCAST_BYTES:
        dealt = dealt.join(F.broadcast(ends), "key")
    else:
        dealt = dealt.join(dealt.select("key", "part").distinct().join(ends, "key"), ["key", "part"])
    shard = F.size(F.filter("ends", lambda end: end <= F.col("place")))
    dealt = dealt.select("key", F.col("number").alias("block"), "place", (F.col("want") - F.col("sofar")).alias("left"), F.col("first"), shard.alias("shard"))
    words = F.least(F.col("size"), F.col("left") - (F.col("start") - F.col("first"))).alias("words")
    draws = stream.join(dealt, ["key", "block"]).select("a", "b", "size", "epoch", words, "shard", F.col("place").alias("block")).where("words > 0")
    return rows.drop("part", "before"), draws


def taken(docs: DataFrame, outputs: int = OUTPUTS, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken and draws (epoch, words, shard, block) of every row of ``docs``.

    A null or empty text has size 0 and is never taken; a null source is a source of its own, the last;
    repeated rows are taken each for itself. No words at all: all targets are 0. Empty table: no rows.
    """
    rows = _with_sources(docs.select("doc_id", "source", "text"), seed)
    rows = written(rows.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"_{c}").alias(c) for c in ("a", "b", "key", "size")]), "mix-sizes")
    rows, draws = plan(rows, outputs, seed, block_words)
    each = draws.groupBy("a", "b").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("epoch", "words", "shard", "block"))).alias("draws"))
    out = rows.join(each, ["a", "b"], "left")
    none = F.array().cast("array<struct<epoch:int,words:bigint,shard:int,block:bigint>>")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("draws", none).alias("draws"))


def digests(docs: DataFrame) -> DataFrame:
    """``taken`` with its draws as a text: epoch, shard and block of each, joined by commas."""
    parts = F.transform("draws", lambda d: F.concat_ws("/", d["epoch"].cast("string"), d["shard"].cast("string"), d["block"].cast("string")))
    return taken(docs).withColumn("draws", F.array_join(parts, ","))


def slots(draws: DataFrame, seed: int) -> DataFrame:
    """``draws`` with ``slot``: a seeded shuffle of each shard's rows, from 0 without gaps."""
    mixed = written(draws.withColumn("order", F.xxhash64(F.lit(seed), "a", "b", "epoch")).withColumn("part", F.shiftright("order", 52)), "mix-draws")
    counts = running(mixed.groupBy("shard", "part").agg(F.count("*").alias("n")), ["shard"], n_before="n").drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("order", "a", "b", "epoch")) - 1
    return mixed.withColumn("slot", inside).join(F.broadcast(counts), ["shard", "part"]).withColumn("slot", F.col("n_before") + F.col("slot")).drop("order", "part", "n_before")


@by_position
def mix(docs: DataFrame, outputs: int = OUTPUTS, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows that the mix takes, once for each draw, with ``shard`` and ``slot`` (a local shuffle, from 0).

    A document that the target cuts keeps its first words, joined by single spaces; n_chars, if there, follows the text.
    Other cases as in ``taken``; names that clash get underscores appended.
    """
    shard, slot = fresh(docs.columns, "shard", "slot")
    rows = _with_sources(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", "text"), seed)
    sizes = written(rows.select(*[F.col(f"_{c}").alias(c) for c in ("a", "b", "key", "size")]), "mix-sizes")
    draws = slots(plan(sizes, outputs, seed, block_words)[1], seed)
    out = rows.select("_row", "text", F.col("_a").alias("a"), F.col("_b").alias("b")).join(draws, ["a", "b"])
    cut = F.col("words") < F.col("size")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    columns = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(cut, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(columns["n_chars"])
    return out.select(*(v.alias(k) for k, v in columns.items()), F.col("shard").alias(shard), F.col("slot").alias(slot))
