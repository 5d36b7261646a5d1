"""Token ids of whole documents in Re-Pair compressed shards that can be read at any position.

Documents are ordered by doc_id over range partitions; each partition is a run of shards of about
``shard_ids`` ids that never split a document. Within a shard the frequent pairs of neighbouring ids
are replaced by nonterminals, round after round, until no pair occurs ``min_count`` times. A shard
stores its rules, the length that every rule expands to, and the remaining sequence, so that a
position is found from cumulated lengths and only the symbols that cover it are expanded.

The file is Parquet whose rows are shards, so Spark's commit protocol covers lost executors and the
small columns (partition, number of ids) are read without the large ones.
"""

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, process_cache, written

END = 0
MAGIC = b"RPG2"
BROADCAST_ROWS = 100_000
# Least occurrences of a pair that becomes a rule: its two symbols and length take the room of four symbols.
MIN_COUNT, LEAST_ROOM = 8, 8192
CACHED_WORDS, PIECE_BYTES = 1_200_000, 8 << 20
# Two neighbouring white space characters, or one at the start, whichever the tokenizer's pattern may count as such.
BLANK = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ADJACENT = BLANK + r"{2}|\A" + BLANK
# Marks that the tokenizer's pattern keeps in one piece; an apostrophe may begin a contraction.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """The tokenizer's ids of whole texts, put together from its ids of their words.

    The byte-level pattern always cuts before a single space or line feed that stands alone, so ids of
    " word" and "\\nword" don't depend on what is around them. Words are told apart in Arrow and each distinct
    one is encoded once: letters as ready-made pieces in one batch, the marks after them apart, any other
    word by the whole pattern. Texts with neighbouring white space or a special token in them go through the
    tokenizer whole, and so does every text if the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = max(self.tokenizer.get_vocab().values(), default=0) + 1
        split, model = plan.get("pre_tokenizer") or {}, plan["model"]
        self.by_words = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and plan.get("normalizer") is None and model["type"] == "BPE"
        special = sorted((x["content"] for x in plan.get("added_tokens") or []), key=len, reverse=True)
        self.whole = "|".join([ADJACENT, *map(re.escape, special)])
        if self.by_words:
            # pieces come cut already, and as each is seen once the model needs no cache of its own
            plan["pre_tokenizer"]["use_regex"] = False
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.pop("merges")]
            plan["model"] = {**model, "merges": [], "vocab": {}}
            self.pieces = Tokenizer.from_str(json.dumps({**plan, "added_tokens": []}))
            self.pieces.model = models.BPE(model["vocab"], merges, cache_capacity=0)
            self.begins = np.zeros(self.vocabulary, bool)
            self.begins[[k for x, k in model["vocab"].items() if x[0] == "Ġ"]] = True
            self._forget(np.zeros(0, np.int64))

    def _forget(self, kept: np.ndarray) -> None:
        """Keeps only the known words ``kept``."""
        if not len(kept):
            self.words, self.entry, self.tails = pa.array([], pa.large_string()), np.zeros(0, np.int64), {}
            self.first, self.length, self.used = (np.zeros(1 << 16, np.int64) for _ in range(3))
            self.flat, self.size, self.end = np.zeros(1 << 18, np.uint32), 0, 0
            return
        words, entry = self.words.take(pa.array(kept)), self.entry[kept]
        ids, length, used = _gather(self.flat, self.first[entry], self.length[entry]), self.length[entry], self.used[entry]
        self._forget(kept[:0])
        self.words, self.entry = words, self._add(ids, length)
        self.used[: self.size] = used

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of new entries that stand one after the other in ``ids``."""
        size, end = self.size + len(lengths), self.end + len(ids)
        if size > len(self.first):
            self.first, self.length, self.used = (np.resize(x, 2 * size) for x in (self.first, self.length, self.used))
        if end > len(self.flat):
            self.flat = np.resize(self.flat, 2 * end)
        new = np.arange(self.size, size)
        self.length[new], self.used[new] = lengths, 0
        self.first[new] = self.end + np.cumsum(lengths) - lengths
        self.flat[self.end : end] = ids
        self.size, self.end = size, end
        return new

    def _encoded(self, texts: list[str]) -> np.ndarray:
        """Numbers of new entries for texts that go through the tokenizer as they are."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return self._add(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)

    def _lettered(self, words: list[str]) -> np.ndarray:
        """Numbers of new entries for words of letters, each after a space."""
        batch = [[" " + w for w in part] for part in itertools.batched(words, 1000)]
        ids = [np.array(x.ids, np.uint32) for x in self.pieces.encode_batch_fast(batch, is_pretokenized=True, add_special_tokens=False)]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        first = np.flatnonzero(self.begins[flat])
        return self._add(flat, np.diff(np.r_[first, len(flat)]))

    def _find(self, words: pa.Array) -> np.ndarray:
        """The entries of words, -1 for unknown ones."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        return np.where(at < 0, -1, self.entry[at] if len(self.entry) else -1)

    def _know(self, words: pa.Array, entries: np.ndarray) -> None:
        self.words, self.entry = pa.concat_arrays([self.words, words]), np.r_[self.entry, entries]

    def learn(self, words: pa.Array, core: pa.Array, of_core: np.ndarray) -> np.ndarray:
        """Entries for distinct words that are not known; ``core``: without the marks behind them, ``of_core``: their entries, -1 for unknown ones."""
        lettered = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False)
        marked = lettered & (pc.binary_length(words).to_numpy() > pc.binary_length(core).to_numpy())
        coded = core.filter(pa.array(lettered)).dictionary_encode()
        at, out = coded.indices.to_numpy(), np.full(len(words), -1)
        entry = np.full(len(coded.dictionary), -1)
        entry[at] = of_core[lettered]
        unknown = entry < 0
        new = coded.dictionary.filter(pa.array(unknown))
        entry[unknown] = self._lettered(new.to_pylist())
        self._know(new, entry[unknown])
        whole = words.filter(pa.array(marked))
        tails = [w[len(c) :] for w, c in zip(whole.to_pylist(), core.filter(pa.array(marked)).to_pylist())]
        marks = list(set(tails).difference(self.tails))
        self.tails.update(zip(marks, self._encoded(marks).tolist()))
        out[lettered] = entry[at]
        pair = np.stack([out[marked], np.fromiter(map(self.tails.__getitem__, tails), np.int64, len(tails))], 1)
        out[marked] = self._add(_gather(self.flat, self.first[pair.ravel()], self.length[pair.ravel()]), self.length[pair].sum(1))
        self._know(whole, out[marked])
        odd = words.filter(pa.array(~lettered))
        out[~lettered] = self._encoded([w if w[:1] == "\n" else " " + w for w in odd.to_pylist()])
        self._know(odd, out[~lettered])
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null one is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if self.by_words else np.ones(len(texts), bool)
        out: list = [None] * len(texts)
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
        rest = np.flatnonzero(~whole)
        if len(rest):
            fed = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if x is not None else pc.replace_substring(texts.take(pa.array(rest)), "\n", " \n") for x in ("", None, "\n")))
            split = pc.split_pattern(fed, " ")
            coded = split.flatten().dictionary_encode()
            # known words are looked up once for words and their cores: each look-up hashes all that is known
            words = coded.dictionary
            core = pc.ascii_rtrim(words, characters=TAIL)
            entry, of_core = np.split(self._find(pa.concat_arrays([words, core])), 2)
            unknown = entry < 0
            if unknown.any():
                new = pa.array(unknown)
                entry[unknown] = self.learn(words.filter(new), core.filter(new), of_core[unknown])
            self.used[entry] += 1
            at = entry[coded.indices.to_numpy()]
            edges = split.offsets.to_numpy() - split.offsets[0].as_py()
            first, length = self.first[at], self.length[at]
            first[edges[:-1]] += 1  # without the line feed put before the text
            length[edges[:-1]] -= 1
            ids, ends = _gather(self.flat, first, length), np.r_[0, np.cumsum(length)][edges].tolist()
            for k, i, j in zip(rest.tolist(), ends[:-1], ends[1:]):
                out[k] = ids[i:j]
            if len(self.words) > CACHED_WORDS:
                # the words that most pieces of the corpus had stay
                used = self.used[self.entry]
                least = max(2, int(np.partition(used, -CACHED_WORDS // 2)[-CACHED_WORDS // 2]) + 1)
                self._forget(np.flatnonzero(used >= least))
        return out


def _gather(flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``first``, one after the other."""
    before = np.cumsum(length) - length
    return flat[np.repeat(first - before, length) + np.arange(int(length.sum()))]


def pieces(batch: pa.RecordBatch, column: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of the text column, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def encoder(path: str) -> WordEncoder:
    cache = process_cache()
    if path not in cache:
        cache[path] = WordEncoder(path)
    return cache[path]


def _pairs(s: np.ndarray, wide: bool) -> np.ndarray:
    """Each symbol with the next one as a single number."""
    if wide:
        return s[:-1].astype(np.uint64) << np.uint64(32) | s[1:]
    return s[:-1] << np.uint32(16) | s[1:]


def width_of(base: int) -> int:
    """Bytes of a symbol: the fewest that leave room for ``LEAST_ROOM`` rules beside ``base`` ids."""
    return next(w for w in (2, 3, 4) if base + LEAST_ROOM <= 1 << 8 * w)


def compress(ids: np.ndarray, base: int, min_count: int = MIN_COUNT, bits: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(rules: pairs of symbols, sequence) of ``ids`` below ``base``; rule k is symbol ``base + k``.

    Rounds go on until no pair of neighbours occurs ``min_count`` times or all symbols of ``width_of(base)`` bytes are
    in use. A round counts all pairs and replaces the most frequent of them from left to right, as many as two
    thirds of the symbols that are left; of pairs that share a hash slot the rarer ones wait for the next round.
    """
    s, rules, n_rules = ids.astype(np.uint32), [], 0
    room, wide = (1 << 8 * width_of(base)) - base, width_of(base) > 2
    owner = np.full(1 << bits, -1, np.int32)
    while len(s) > 1 and n_rules < room:
        key = _pairs(s, wide)
        slot, order = _slots(key, bits), np.sort(key)
        first = np.flatnonzero(np.r_[True, order[1:] != order[:-1]])
        count = np.diff(np.r_[first, len(order)])
        pairs, count = order[first[count >= min_count]], count[count >= min_count]
        if not len(pairs):
            break
        share = min(room - n_rules, max(256, (room - n_rules) * 2 // 3))
        if len(pairs) > share:
            best = np.sort(np.argsort(-count, kind="stable")[:share])
            pairs, count = pairs[best], count[best]
        place = _slots(pairs, bits)
        order = np.argsort(count, kind="stable")  # of pairs in one slot the most frequent one is written last
        owner[place[order]] = order
        alive = owner[place] == np.arange(len(pairs))
        owner[place] = -1
        pairs, place = pairs[alive], place[alive]
        owner[place] = np.arange(len(pairs), dtype=np.int32)
        mine = owner[slot]
        owner[place] = -1
        hit = np.flatnonzero(mine >= 0)
        hit = hit[pairs[mine[hit]] == key[hit]]
        run = np.arange(len(hit))
        start = np.maximum.accumulate(np.where(np.r_[True, hit[1:] != hit[:-1] + 1], run, 0))
        hit = hit[(run - start) % 2 == 0]
        keep = np.ones(len(s), bool)
        keep[hit + 1] = False
        s[hit] = mine[hit].astype(np.uint32) + np.uint32(base + n_rules)
        s = s[keep]
        shift = np.array(32 if wide else 16, pairs.dtype)
        rules.append(np.stack([pairs >> shift, pairs & ((np.array(1, pairs.dtype) << shift) - np.array(1, pairs.dtype))], 1).astype(np.uint32))
        n_rules += len(pairs)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), s


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    if key.dtype == np.uint64:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return (key * np.uint32(2654435761)) >> np.uint32(32 - bits)


def _symbols(values: np.ndarray, width: int) -> bytes:
    """Little-endian numbers of 2, 3 or 4 bytes."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _numbers(raw: memoryview, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u4")[:, 0]


def pack(ids: np.ndarray, base: int) -> bytes:
    """One shard: magic, base, sizes, symbol width, rules, expansion lengths, sequence; all little-endian."""
    rules, s = compress(ids, base)
    width = width_of(base)
    lengths = np.ones(base + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[base + k] = lengths[a] + lengths[b]
    return struct.pack("<4sIIQB", MAGIC, base, len(rules), len(s), width) + _symbols(rules.ravel(), width) + lengths[base:].astype("<u4").tobytes() + _symbols(s, width)


def unpack(shard: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """base, rules, lengths of the rules, sequence."""
    magic, base, n, m, width = struct.unpack_from("<4sIIQB", shard)
    if magic != MAGIC:
        raise ValueError("not a shard")
    raw, at = memoryview(shard), struct.calcsize("<4sIIQB")
    rules = _numbers(raw[at : at + 2 * n * width], width).reshape(-1, 2)
    at += 2 * n * width
    return base, rules, np.frombuffer(shard, "<u4", n, at), _numbers(raw[at + 4 * n : at + 4 * n + m * width], width)


def expansions(base: int, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first, length): the ids that symbol k stands for are ``length[k]`` from ``first[k]``."""
    size = np.r_[np.ones(base, np.int64), lengths.astype(np.int64)]
    first = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.uint32)
    flat[:base] = np.arange(base)
    # rules use earlier symbols only: each stretch of rules whose symbols are all known is filled at once
    done = 0
    while done < len(rules):
        later = np.flatnonzero(rules[done:].max(1) >= base + done)
        end = done + int(later[0]) if len(later) else len(rules)
        parts = rules[done:end].ravel()
        flat[first[base + done] : first[base + end - 1] + size[base + end - 1]] = _gather(flat, first[parts], size[parts])
        done = end
    return flat, first, size


def decode(shard: bytes) -> bytes:
    """All ids of a shard as little-endian 32-bit bytes."""
    base, rules, lengths, s = unpack(shard)
    flat, first, size = expansions(base, rules, lengths)
    return _gather(flat, first[s], size[s]).astype("<u4").tobytes()


def decode_range(shard: bytes, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a shard; only the symbols that cover them are expanded."""
    base, rules, lengths, s = unpack(shard)
    size = np.where(s < base, 1, lengths[np.maximum(s.astype(np.int64) - base, 0)] if len(lengths) else 1)
    ends = np.cumsum(size)
    i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + count, "left")
    out, todo = [], s[i : j + 1].tolist()[::-1]
    while todo:
        x = todo.pop()
        if x < base:
            out.append(x)
        else:
            a, b = rules[x - base].tolist()
            todo += [b, a]
    skip = start - (int(ends[i - 1]) if i else 0)
    return np.array(out[skip : skip + count], np.uint32)


FILE = "part int, shard int, start long, n_ids long, doc_ids array<long>, doc_tokens array<long>, data binary"


def shards(docs: DataFrame, path: str | None = None, shard_ids: int = 1 << 20) -> DataFrame:
    """The file's rows: partition, number within it, its first id's position there, ids, documents, shard.

    Every row of ``docs`` is a document; a null text is empty and gives the end id alone; a null doc_id
    comes first; rows with one doc_id are ordered by a hash of their text. Extra columns are not read.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, base = encoder(path), TaskContext.get().partitionId(), encoder(path).vocabulary
        end, ids, tokens, held, size, total, k = np.array([END], np.uint32), [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            raw = np.concatenate([x for ids in held for x in (ids, end)])
            row = [[part], [k], [total], [len(raw)], [ids], [tokens], [pack(raw, base)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], [c.split()[0] for c in FILE.split(", ")])

        for batch in batches:
            for piece in pieces(batch, 1):
                for doc_id, found in zip(piece.column(0).to_pylist(), words.encode(piece.column(1))):
                    held.append(found)
                    ids.append(doc_id)
                    tokens.append(len(found) + 1)
                    size += tokens[-1]
                    if size >= shard_ids:
                        yield flush()
                        ids, tokens, held, size, total, k = [], [], [], 0, total + size, k + 1
        if held:
            yield flush()

    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text").mapInArrow(run, FILE)


def positions(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' decoded ids.

    start counts the ids of all documents before it: a running sum over partitions (one row each) plus
    the position within the partition that the shard holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, start, ids, tokens, data = (batch.column(c)[r].as_py() for c in range(5))
                raw, ends = memoryview(decode(data)), np.cumsum([0, *tokens])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in itertools.pairwise(ends.tolist())]
                columns = [pa.array([part] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(ends[:-1] + start), pa.array(tokens, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    documents = stored.select("part", "start", "doc_ids", "doc_tokens", "data").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if partitions(stored.sparkSession) <= BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    return documents.join(sizes, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_positions(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the shards of ``docs`` to the shared folder and reads them back. Empty table: no rows."""
    return positions(written(shards(docs, path), "tokens"))
