"""Prefix trie of conversations with sums rolled up to all ancestors by pointer jumping.

Every distinct beginning of a conversation is a node, keyed by a digest of 128 bits: the exclusive or of the hashes
of (place, role, text) of its turns, so a node's digest and its parent's differ by one turn's hash, and a conversation's
digests are running sums. The root, the empty beginning, has digest zero.

A node's own counts go up in doubling rounds. In round i a node points to its ancestor 2^i levels above and holds the sums
over its subtree to a depth below 2^i; it adds what the nodes that point to it hold, and takes its pointer's pointer.
Rounds end when all pointers have passed the top, after the logarithm of the longest conversation; the root is the sum of all.

Texts are read once and never shuffled. Conversations may have any number of turns: rows are dealt by ranges of
(conversation, turn) and running sums go over a conversation's parts first, so no task holds a conversation. A
node that many point to, or that has many children, is broadcast in the joins on it: with the limit at a thousandth
of the rows there are a thousand at most.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, written

# Fixed values of the rebuilt conversations: who lends to whom, and how many turns at most.
FAMILY, SHARED = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
SEED, HEAVY_SHARE, PART_ENDS = 31, 1000, 100_000
KEY = ["d1", "d2"]


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, pos, t1, t2, words, len): each turn's place from 0 in its conversation, as hashes; written.

    Turns are ordered by ``turn``, null first; equal turns by the hashes of role and text. A null role or text is
    empty. Rows without conv_id belong to no conversation and are left out. A repeated row is a turn of its own.
    """
    n = partitions(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(SEED), role, text).alias("t1"),
        F.xxhash64(F.lit(SEED + 1), text, role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    ranged = written(turns.repartitionByRange(n, "conv_id", *order, "row").withColumn("part", F.spark_partition_id()), "trie-turns")
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("conv_id", "part", before.alias("before"), F.sum("n").over(whole).alias("len"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1
    rows = ranged.withColumn("inside", inside).join(counts, ["conv_id", "part"])
    rows = written(rows.select("conv_id", "part", (F.col("before") + F.col("inside")).alias("pos"), "t1", "t2", "words", "len"), "trie-placed")
    discard(ranged)
    return rows


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, total): the conversations of placed rows and their numbers of turns."""
    return rows.groupBy("conv_id").agg(F.max("len").alias("total"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations) in which a conversation's first h turns come from the first of its family; both written.

    h is crc32(conv_id as text) modulo 4, the first of the family conv_id - conv_id % 20 (% as in SQL, towards zero). A family
    without its first one lends nothing, one with fewer turns lends all; a conversation keeps its own turns after its first h.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    own = conversations_of(rows).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    lenders = own.where("conv_id = base").select("base", F.col("total").alias("base_len"))
    m = F.least(F.col("h"), F.coalesce("base_len", F.lit(0)))
    convs = own.join(lenders, "base", "left").select("conv_id", "base", "h", m.alias("m"), (m + F.greatest(F.lit(0), F.col("total") - F.col("h"))).alias("total"))
    convs = written(convs, "trie-conversations")
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")).join(convs, "conv_id").select("conv_id", "part", "h", "m", "total")
    kept = rows.join(parts, ["conv_id", "part"]).where("pos >= h")
    kept = kept.select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "t1", "t2", "words", F.col("total").alias("len"))
    lent = rows.where(f"pos < {SHARED - 1} and conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), "pos", "t1", "t2", "words").join(convs, "base").where("pos < h")
    lent = lent.select("conv_id", F.lit(-1).alias("part"), "pos", "t1", "t2", "words", F.col("total").alias("len"))
    return written(kept.unionByName(lent), "trie-rebuilt"), convs.select("conv_id", "total")


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, last, d1, d2, p1, p2, words): the node that each turn ends at and its parent, from placed rows; written."""
    mark = [F.xxhash64(F.lit(SEED + 2 + k), "pos", "t1", "t2").alias(f"x{k}") for k in (1, 2)]
    rows = rows.select("conv_id", "part", "pos", "words", "len", *mark)
    sums = rows.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(x).over(ahead), F.lit(0)).alias(f"before_{x}") for x in ("x1", "x2")])
    inside = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"inside_{x}": F.bit_xor(x).over(inside) for x in ("x1", "x2")}).join(sums, ["conv_id", "part"])
    d1, d2 = (F.col(f"before_{x}").bitwiseXOR(F.col(f"inside_{x}")) for x in ("x1", "x2"))
    depth = F.col("pos") + 1
    out = rows.select("conv_id", depth.alias("depth"), (depth == F.col("len")).alias("last"), d1.alias("d1"), d2.alias("d2"), d1.bitwiseXOR(F.col("x1")).alias("p1"), d2.bitwiseXOR(F.col("x2")).alias("p2"), "words")
    return written(out, "trie-paths")


def looked_up(rows: DataFrame, pointer: list[str], table: DataFrame, heavy: Column) -> DataFrame:
    """``rows`` left-joined with ``table`` (d1, d2, ...) on a pointer that may be null; heavy rows of ``table`` are broadcast.

    Rows with a heavy pointer or none are not shuffled, so no task gets all that point to one node.
    """
    names = [c for c in table.columns if c not in KEY]
    few = F.broadcast(table.where(heavy).select(*[F.col(k).alias(f"_{k}") for k in KEY], *names, F.lit(True).alias("_hit")))
    first = rows.join(few, (rows[pointer[0]] == few["_d1"]) & (rows[pointer[1]] == few["_d2"]), "left").drop("_d1", "_d2")
    done = first.where(f"_hit or {pointer[0]} is null").drop("_hit")
    rest = table.where(~heavy).select(*[F.col(k).alias(p) for k, p in zip(KEY, pointer)], *names)
    return done.unionByName(first.where(f"_hit is null and {pointer[0]} is not null").select(*rows.columns).join(rest, pointer, "left").select(*done.columns))


def rolled_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` (d1, d2, q1, q2, values) with each value summed over the node's subtree; q1, q2: the parent, null at the top.

    Each round is written to the shared folder and the one before is removed. No node: no rows.
    """
    state = written(nodes, "trie-round")
    limit = state.count() // HEAVY_SHARE
    while True:
        followers = F.count("*").alias("followers")
        sums = state.where("q1 is not null").groupBy("q1", "q2").agg(followers, *[F.sum(v).alias(f"add_{v}") for v in values])
        sums = sums.withColumnsRenamed({"q1": "d1", "q2": "d2"})
        above = written(state.select(*KEY, "q1", "q2").join(sums, KEY), "trie-above")
        if above.isEmpty():
            discard(above)
            return state
        added = state.join(above.drop("q1", "q2", "followers"), KEY, "left")
        added = added.select(*KEY, "q1", "q2", *[(F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values])
        further = above.select(*KEY, F.col("q1").alias("n1"), F.col("q2").alias("n2"), "followers")
        moved = looked_up(added, ["q1", "q2"], further, F.col("followers") > limit)
        following = written(moved.select(*KEY, F.col("n1").alias("q1"), F.col("n2").alias("q2"), *values), "trie-round")
        discard(state, above)
        state = following


def digests_of_ids(ends: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) from (d1, d2, conv_id): SHA-256 of each node's ids, ascending, joined by commas.

    Ids are joined by ranges of conv_id, ``PART_ENDS`` at most on average; the hash is sequential by its definition, so one task
    reads a node's texts of ids in order, one batch at a time, and never holds them all.
    """
    n = max(partitions(ends.sparkSession), ends.count() // PART_ENDS)
    ranged = ends.repartitionByRange(n, "conv_id").withColumn("part", F.spark_partition_id())
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ranged.groupBy(*KEY, "part").agg(ids.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for d1, d2, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (d1, d2) == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (d1, d2), hashlib.sha256(ids.encode())
            if out:
                yield row(out)
        if node:
            yield row([(*node, sha.hexdigest())])

    def row(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "ends_sha256"])

    ordered = pieces.repartition(partitions(ends.sparkSession), *KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids")
    return ordered.mapInArrow(hashed, "d1 long, d2 long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of placed rows; ``convs`` (conv_id, total) also names conversations without turns.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens (over the subtree),
    ends_sha256 (of the conversations that end at the node). No conversations: no rows, not even the root.
    """
    path = paths(rows)
    each = [F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2")]
    found = written(path.groupBy(*KEY).agg(*each), "trie-found")
    children = found.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    nodes = found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    top = F.col("depth") == 1
    up = [F.when(~top, F.col(p)).alias(q) for p, q in (("p1", "q1"), ("p2", "q2"))]
    own = [(F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")]
    nodes = written(nodes.select(*KEY, *up, "conv_id", "depth", "n_convs", "n_children", *own), "trie-nodes")
    discard(found)
    sums = rolled_up(nodes.select(*KEY, "q1", "q2", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"]).drop("q1", "q2")
    # the root: one row
    totals = nodes.agg(F.count_if(top).alias("n_children"), F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").crossJoin(F.broadcast(totals))
    zero = [F.lit(0).cast("long").alias(k) for k in KEY]
    least = root.select(F.col("conv_id").alias("root_conv_id"))
    parents = nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id"), "n_children").withColumnRenamed("n_children", "followers")
    limit = nodes.count() // HEAVY_SHARE
    below = looked_up(nodes.drop("n_leaves", "saved_tokens"), ["q1", "q2"], parents, F.col("followers") > limit).crossJoin(F.broadcast(least))
    below = below.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "root_conv_id")).join(sums, KEY)
    columns = [*KEY, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    root = root.select(*zero, "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    ends = path.where("last").select(*KEY, "conv_id").unionByName(convs.where("total = 0").select(*zero, "conv_id"))
    out = below.select(*columns).unionByName(root).join(digests_of_ids(ends), KEY, "left")
    return out.select(*columns[2:], F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` as they are; cases as in ``placed`` and ``trie``."""
    rows = placed(conversations)
    return trie(rows, conversations_of(rows))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations that ``rebuilt`` makes."""
    rows, convs = rebuilt(placed(conversations))
    return trie(rows, convs)


# Nodes are the lists of turns themselves; crc32 is folded bit by bit.
SQL = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS k
    FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
    SELECT conv_id, count(*) AS len, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT) AS bytes FROM turns GROUP BY conv_id
), hashed AS (
    SELECT conv_id, len, list_reduce(bytes, lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384)), 4294967295::BIGINT) AS crc FROM bits
), convs AS (
    SELECT c.conv_id, xor(c.crc, 4294967295) % {SHARED} AS h, c.conv_id - c.conv_id % {FAMILY} AS base, coalesce(b.len, 0) AS base_len
    FROM hashed c LEFT JOIN hashed b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}
), rows AS (
    SELECT c.conv_id, t.k AS pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.k < c.h
    UNION ALL SELECT c.conv_id, t.k - c.h + least(c.h, c.base_len), role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k >= c.h
), path AS (
    SELECT conv_id, pos + 1 AS depth, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::VARCHAR AS node,
        len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, count(*) OVER (PARTITION BY conv_id) AS total
    FROM rows
    UNION ALL SELECT conv_id, 0, '', 0, (SELECT count(*) FROM rows r WHERE r.conv_id = c.conv_id) FROM convs c
), nodes AS (
    SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256
    FROM path GROUP BY depth, node
), parents AS (
    SELECT DISTINCT c.depth, c.node, p.node AS parent FROM path c JOIN path p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1
), children AS (
    SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM parents GROUP BY ALL
), own AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, node)
), below AS (
    SELECT DISTINCT a.depth, a.node, d.depth AS depth_below, d.node AS node_below FROM path a JOIN path d ON d.conv_id = a.conv_id AND d.depth >= a.depth
), sums AS (
    SELECT b.depth, b.node, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.words)::BIGINT AS saved_tokens
    FROM below b JOIN own o ON o.depth = b.depth_below AND o.node = b.node_below GROUP BY b.depth, b.node
)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM own o JOIN sums s USING (depth, node) LEFT JOIN parents e USING (depth, node) LEFT JOIN own p ON p.depth = o.depth - 1 AND p.node = e.parent
"""
