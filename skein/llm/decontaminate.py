"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of bytes other than ASCII white space, lower-cased, without ASCII punctuation. Seeds are the
``SEED_WORDS``-grams of test items. One pass over the corpus finds the seeds of each document and aligns the words around each
shared diagonal with the item: match +2, mismatch -1, gap -1, local. The similarity of a pair is the
share of the item's words that its best alignment matches.

Rare seeds, those at ``RARE`` places of the items at most, come first: each leads to few places. Frequent ones are looked up only
for stretches of a document that no rare seed has led to. None is left out, as an edited copy may keep no rare one, so what is
found doesn't depend on ``RARE``.

Items are a test set; ``ITEM_BYTES`` of them are held at a time, once in each Python process. A larger set is divided by hash and
the corpus is passed over once for each part. Alignments are made for so many pairs at a time as ``CELLS`` allow, so a long item
costs time (its words times the window's, about 1.6 times its words squared), not memory.
"""

import itertools
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, process_cache
from .token_repair import pieces

SEED_WORDS, SIMILARITY, RARE, CELLS = 3, 0.8, 4, 1 << 21
ITEM_BYTES, PIECE_BYTES = 16 << 20, 1 << 20
BLOCK = 1 << 20
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
UNIT = 1 << 20


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(None, PUNCTUATION).split()


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive ids."""
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        h = (h ^ ids[k : k + len(h)].astype(np.uint64)) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


class Items:
    """Test items by their words' numbers, and the seeds that lead to them."""

    def __init__(self, ids: list, texts: list[str | None], n: int = SEED_WORDS, similarity: float = SIMILARITY):
        self.n, self.similarity, self.number, kept = n, similarity, {}, []
        for item_id, text in zip(ids, texts):
            w = words(text)
            if len(w) >= n:
                kept.append((item_id, np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], np.int32)))
        self.ids, self.words = [x[0] for x in kept], [x[1] for x in kept]
        hashes = [grams(w, n) for w in self.words]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(kept)), [len(h) for h in hashes])
        at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.seeds, first = np.unique(flat[order], return_index=True)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.slack = np.maximum(8, self.length // 4)
        self.step = self.slack // 2
        self.room = 1 << np.ceil(np.log2(4 * self.length)).astype(np.int64)
        self.base = np.r_[0, np.cumsum(self.room)[:-1]].astype(np.int64)[: len(kept)]
        self.holds = np.zeros(int(self.room.sum()), bool)
        if kept:
            self.holds[self.place(np.repeat(np.arange(len(kept)), self.length), np.concatenate(self.words))] = True
        self.item, self.at, self.first = item[order], at[order], np.r_[first, len(flat)].astype(np.int64)

    def numbers(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.number.get, w := words(text), itertools.repeat(0)), np.int32, len(w))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, seed) of the seeds in a document."""
        known = ids > 0
        full = known[: max(0, len(ids) - self.n + 1)].copy()
        for k in range(1, self.n):
            full &= known[k : k + len(full)]
        at = np.flatnonzero(full)
        if not len(at) or not len(self.seeds):
            return at[:0], at[:0]
        h = np.zeros(len(at), np.uint64)
        for k in range(self.n):
            h = (h ^ ids[at + k].astype(np.uint64)) * MULTIPLIER
            h ^= h >> np.uint64(29)
        s = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
        found = self.seeds[s] == h
        return at[found], s[found]

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, end) of the windows of a document that seeds suggest and that hold enough of the item's words.

        Diagonals are divided into stretches of the item's ``step`` + 1, each a window with ``slack`` on both sides, so
        every diagonal has its whole slack whatever its neighbours are.
        """
        at, seed = self.hits(ids)
        if not len(at):
            return []
        size = self.first[seed + 1] - self.first[seed]
        found = np.zeros(0, np.int64)
        span = 2 * (len(ids) + int(self.length.max())) + 1
        for some in (size <= RARE, size > RARE):
            # as many (hit, place in an item) pairs at a time as BLOCK, or as one hit has
            hit = np.flatnonzero(some)
            for part in np.split(hit, np.flatnonzero(np.diff(np.cumsum(size[hit]) // BLOCK)) + 1):
                n = size[part]
                k = np.repeat(self.first[seed[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                item, diagonal = self.item[k], np.repeat(at[part], n) - self.at[k]
                stretch = item * span + diagonal // (self.step[item] + 1) + span // 2
                found = np.union1d(found, stretch[~np.isin(stretch, found)])
        return self.enough(ids, np.stack([found // span, found % span - span // 2], 1))

    def enough(self, ids: np.ndarray, stretches: np.ndarray) -> list[tuple[int, int, int]]:
        """The windows in which at least ``similarity`` of the item's words can match: a bound, no copy is lost by it."""
        item, first = stretches[:, 0], stretches[:, 1] * (self.step[stretches[:, 0]] + 1)
        from_ = np.maximum(0, first - self.slack[item])
        end = np.minimum(len(ids), first + self.step[item] + self.length[item] + self.slack[item])
        out = []
        for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(np.cumsum(end - from_) // BLOCK)) + 1):
            n = end[part] - from_[part]
            edge = np.r_[0, np.cumsum(n)[:-1]]
            word, of = ids[np.repeat(from_[part] - edge, n) + np.arange(n.sum())], np.repeat(item[part], n)
            held = np.add.reduceat((word > 0) & self.holds[self.place(of, word)], edge, dtype=np.int64)
            part = part[held >= self.similarity * self.length[item[part]] - 1e-6]
            out += zip(item[part].tolist(), from_[part].tolist(), end[part].tolist())
        return out

    def place(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The bit of ``holds`` that a word has in an item's range; some words share one."""
        return self.base[item] + (word & (self.room[item] - 1))


def align(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of the best local alignment of each row of ``items`` with its row of ``windows``, and the last column it uses.

    Cells hold the score times 2**20 plus the matches so far, so of equal scores the one with more matches wins.
    """
    b, w = windows.shape
    h, rise = np.zeros((b, w + 1), np.int64), np.arange(w + 1, dtype=np.int64) * UNIT
    best, end = np.zeros(b, np.int64), np.zeros(b, np.int64)
    for i in range(items.shape[1]):
        step = np.where(windows == items[:, i : i + 1], 2 * UNIT + 1, -UNIT)
        x = np.zeros_like(h)
        np.maximum(h[:, :-1] + step, h[:, 1:] - UNIT, out=x[:, 1:])
        np.maximum(x, 0, out=x)
        h = np.maximum.accumulate(x + rise, axis=1) - rise
        top = h.argmax(axis=1)
        value = h[np.arange(b), top]
        better = value > best
        best[better], end[better] = value[better], top[better] - 1
    return best % UNIT, end


def batches_of(todo: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
    """Windows (document, item, first word, end), 256 at most at a time and ``CELLS`` of them together, or one."""
    held, widest = [], 0
    for x in todo:
        widest = max(widest, x[3] - x[2])
        if held and (len(held) == 256 or (len(held) + 1) * widest > CELLS):
            yield held
            held, widest = [], x[3] - x[2]
        held.append(x)
    if held:
        yield held


def scored(index: Items, docs: list[np.ndarray]) -> list[tuple[int, int, float, int, int]]:
    """(document, item, similarity, first word, last word) of the pairs that reach the index's similarity, the best for each pair."""
    todo = [(d, *x) for d, ids in enumerate(docs) for x in index.candidates(ids)]
    todo.sort(key=lambda x: index.length[x[1]])
    out: dict[tuple[int, int], tuple] = {}
    for part in batches_of(todo):
        items = np.full((len(part), index.length[part[-1][1]]), -1, np.int32)
        windows = np.full((len(part), max(end - from_ for _, _, from_, end in part)), -2, np.int32)
        for k, (d, item, from_, end) in enumerate(part):
            items[k, : index.length[item]] = index.words[item]
            windows[k, : end - from_] = docs[d][from_:end]
        matches, last = align(items, windows)
        for k, (d, item, from_, _) in enumerate(part):
            alike = float(matches[k]) / len(index.words[item])
            if alike >= index.similarity and alike > out.get((d, item), (0.0,))[0]:
                _, back = align(items[k : k + 1, : index.length[item]][:, ::-1], windows[k : k + 1, : last[k] + 1][:, ::-1])
                out[d, item] = (alike, from_ + int(last[k] - back[0]), from_ + int(last[k]))
    return [(d, item, *x) for (d, item), x in sorted(out.items())]


def _parts(items: DataFrame, item_bytes: int, similarity: float) -> Iterator[Callable[[], Items]]:
    """For each part of the items a function that gives its index, which a Python process makes once."""
    spark = items.sparkSession
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = max(1, -(-total // item_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").collect()
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        yield partial(_held, uuid.uuid4().hex, sent, similarity)


def _held(name: str, sent: Broadcast, similarity: float) -> Items:
    cache = process_cache()
    if cache.get("items", ("",))[0] != name:
        cache["items"] = name, Items(*sent.value, similarity=similarity)
    return cache["items"][1]


PAIRS = "doc_id long, item_id long, similarity double, first_word long, last_word long"


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, last_word): documents that hold a copy of an item, edited or not.

    One row for each row of ``docs`` and each row of ``items`` it leaks, with the words of the best alignment.
    Null and empty texts on either side leak nothing; an item of fewer than ``SEED_WORDS`` words is too
    short to tell and never leaks. Null ids stay null. Empty tables: no rows. Extra columns are not read.
    """
    found = None
    for index in _parts(items, item_bytes, similarity):

        def run(batches: Iterator[pa.RecordBatch], held: Callable[[], Items] = index) -> Iterator[pa.RecordBatch]:
            names = [c.split()[0] for c in PAIRS.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            index = held()
            for batch in (piece for b in batches for piece in pieces(b, 1, PIECE_BYTES)):
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], index.ids[item], *x) for d, item, *x in scored(index, [index.numbers(t) for t in batch.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PAIRS)
        found = part if found is None else found.union(part)
    return found


@by_position
def decontaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item. Rows without a text stay."""
    at = docs.columns.index("text")
    clean = docs
    for index in _parts(items, item_bytes, similarity):

        def run(batches: Iterator[pa.RecordBatch], held: Callable[[], Items] = index) -> Iterator[pa.RecordBatch]:
            index = held()
            for batch in (piece for b in batches for piece in pieces(b, at, PIECE_BYTES)):
                leaked = {x[0] for x in scored(index, [index.numbers(t) for t in batch.column(at).to_pylist()])}
                yield batch.filter(pa.array([k not in leaked for k in range(batch.num_rows)], pa.bool_()))

        clean = clean.mapInArrow(run, docs.schema)
    return clean
