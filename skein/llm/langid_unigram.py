"""Language identification with segmentation-marginalised unigrams.

For each language, every piece of a fixed public vocabulary has a probability. A word's likelihood is the
sum over all of its segmentations into pieces, found by a forward pass over its characters, and a
text's is the product over all its words. Piece probabilities are learnt by expectation
maximisation: expected piece counts come from a forward-backward pass over each distinct training word,
weighted by how often each language has it; counts cover all training documents and are smoothed
towards the pooled distribution.

Words are runs of letters a-z and non-ASCII characters of the lower-cased text. Pieces that begin with
the vocabulary's word mark fit only at a word's start.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, partitions, process_cache, written

MARK, ROUNDS, SMOOTHING, UNKNOWN = "▁", 2, 200.0, 1e-8
MOST_CHARS, SHORT = 16, 32
CACHED_WORDS = 700_000
BATCH_WORDS = 4096
# Everything in ASCII that is not a lower-case letter.
OTHER = bytes(i for i in range(128) if not 97 <= i <= 122)
BLANK = bytes.maketrans(OTHER, b" " * len(OTHER))


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces that can occur in lower-cased words, sorted."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    fit = {p for p in pieces if len(p) <= MOST_CHARS and p == p.lower() and not p.lstrip(MARK).encode().translate(BLANK).count(b" ")}
    return sorted(fit - {MARK * k for k in range(2, MOST_CHARS)})


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(BLANK).split()


class Lattice:
    """Forward and backward passes over batches of words."""

    def __init__(self, pieces: list[str]):
        self.most = max(map(len, pieces), default=1)
        number = {p: k for k, p in enumerate(pieces)}
        starts = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        hashes = np.array([self._hash(x) for x in starts], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.piece = hashes[order], np.array([number.get(x, -1) for x in starts], np.int64)[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two beginnings of pieces share a hash")
        self.seen = np.zeros(1 << 20, bool)
        self.seen[hashes >> np.uint64(44)] = True

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ code) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ h >> np.uint64(31)

    def _hash(self, text: str) -> int:
        h = np.zeros(1, np.uint64)
        for x in text:
            h = self._step(h, np.array([ord(x)], np.uint64))
        return int(h[0])

    def edges(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths (with the mark) and edges (word, start, end, piece), ordered by end; piece -1: one unknown character.

        From every character the longer stretches are followed as long as some piece begins with them.
        """
        code = np.frombuffer((MARK + MARK.join(batch)).encode("utf-32-le"), "<u4").astype(np.uint64)
        lengths = np.fromiter(map(len, batch), np.int64, len(batch)) + 1
        first = np.r_[0, np.cumsum(lengths)[:-1]]
        word = np.repeat(np.arange(len(batch)), lengths)
        last = np.repeat(first + lengths, lengths)
        at, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        found, alone = [], np.ones(len(code), bool)
        for size in range(1, self.most + 1):
            inside = at + size <= last[at]
            at, h = at[inside], h[inside]
            h = self._step(h, code[at + size - 1])
            maybe = self.seen[h >> np.uint64(44)]
            at, h = at[maybe], h[maybe]
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[k] == h
            at, h, piece = at[known], h[known], self.piece[k[known]]
            whole = piece >= 0
            if size == 1:
                alone[at[whole]] = False
            found.append((at[whole], np.full(whole.sum(), size), piece[whole]))
            if not len(at):
                break
        one = np.flatnonzero(alone)
        found.append((one, np.ones(len(one), np.int64), np.full(len(one), -1)))
        at, size, piece = (np.concatenate(x) for x in zip(*found))
        start = at - first[word[at]]
        end = start + size
        order = np.argsort(end.astype(np.uint16) if len(end) and end.max() < 1 << 16 else end, kind="stable")
        return lengths, word[at][order], start[order], end[order], piece[order]

    def forward(self, lengths: np.ndarray, word: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likelihood up to each position (word, position, language) as logarithms, and the same below the largest scale.

        Short words are summed as they are: no product of their probabilities leaves the range of doubles.
        Longer ones are scaled to one at each position.
        """
        n, most, langs = len(lengths), int(lengths.max()), p.shape[1]
        alpha = np.zeros((n, most + 1, langs))
        alpha[:, 0] = 1
        cuts = np.searchsorted(end, np.arange(1, most + 2))
        if most <= SHORT:
            for e in range(1, most + 1):
                a, b = cuts[e - 1], cuts[e]
                if a < b:
                    part = alpha[word[a:b], start[a:b]] * p[a:b]
                    for k in range(langs):
                        alpha[:, e, k] = np.bincount(word[a:b], part[:, k], n)
            with np.errstate(divide="ignore"):
                return alpha, np.log(alpha)
        scale = np.zeros((n, most + 1, langs))
        for e in range(1, most + 1):
            a, b = cuts[e - 1], cuts[e]
            if a == b:
                continue
            w, s = word[a:b], start[a:b]
            part = alpha[w, s] * p[a:b] * np.exp(scale[w, s] - scale[w, e - 1])
            total = np.stack([np.bincount(w, part[:, k], n) for k in range(langs)], 1)
            some = total > 0
            scale[:, e] = scale[:, e - 1] + np.log(np.where(some, total, 1))
            alpha[:, e] = np.where(some, 1.0, 0.0)
        return alpha, scale

    def log_likelihood(self, batch: list[str], table: np.ndarray) -> np.ndarray:
        """ln P(word) under each language; ``table``: probabilities by piece and language, last row for unknown characters."""
        lengths, word, start, end, piece = self.edges(batch)
        _, scale = self.forward(lengths, word, start, end, table[piece])
        return scale[np.arange(len(batch)), lengths]

    def expected(self, batch: list[str], weight: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected piece counts by piece and language for words that occur ``weight`` (word, language) times."""
        lengths, word, start, end, piece = self.edges(batch)
        p = table[piece]
        _, f = self.forward(lengths, word, start, end, p)
        back_start, back_end = lengths[word] - end, lengths[word] - start
        order = np.argsort(back_end, kind="stable")
        _, b = self.forward(lengths, word[order], back_start[order], back_end[order], p[order])
        total = f[np.arange(len(batch)), lengths]
        share = np.exp(f[word, start] + np.log(p) + b[word, back_start] - total[word]) * weight[word]
        known = piece >= 0
        return np.stack([np.bincount(piece[known], share[known, k], len(table) - 1) for k in range(p.shape[1])], 1)


def _batches(column: list[str]) -> Iterator[np.ndarray]:
    """Indices in batches of words of similar length, so that long words don't widen the others' arrays."""
    order = np.argsort([len(t) for t in column], kind="stable")
    size, at = [], 0
    for k, i in enumerate(order.tolist()):
        size.append(len(column[i]))
        if len(size) * (size[-1] + 2) > BATCH_WORDS * 12:
            yield order[at : k + 1]
            size, at = [], k + 1
    if at < len(order):
        yield order[at:]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, lang, n) over all training rows: lang not null, crc32 of the id modulo 3 not 1."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 3, 1))
    split = rows.select("lang", F.explode(F.split(F.lower("text"), r"[\x00-\x60\x7B-\x7F]+")).alias("word"))
    return split.where("word <> ''").groupBy("word", "lang").agg(F.count("*").alias("n"))


def train(docs: DataFrame, path: str | None = None) -> dict | None:
    """Languages, pieces and probabilities; None where nothing can be learnt."""
    pieces = vocabulary(path)
    counts = written(word_counts(docs).repartition(partitions(docs.sparkSession), "word"), "word-counts")
    langs = [r.lang for r in counts.groupBy("lang").agg(F.sum("n")).orderBy("lang").collect()]
    if not langs:
        return None
    place = {x: k for k, x in enumerate(langs)}
    table = np.full((len(pieces) + 1, len(langs)), 1 / len(pieces))
    table[-1] = UNKNOWN
    for _ in range(ROUNDS):

        def expect(batches: Iterator[pa.RecordBatch], table: np.ndarray = table) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(pieces), np.zeros((len(pieces), len(langs)))
            for batch in batches:
                text, lang, n = (batch.column(k).to_pylist() for k in range(3))
                number = {w: k for k, w in enumerate(dict.fromkeys(text))}
                weight = np.zeros((len(number), len(langs)))
                np.add.at(weight, ([number[w] for w in text], [place[x] for x in lang]), n)
                distinct = list(number)
                for part in _batches(distinct):
                    total += lattice.expected([distinct[k] for k in part.tolist()], weight[part], table)
            i, j = np.nonzero(total > 1e-6)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["piece", "lang", "n"])

        # at most pieces times languages rows
        sums = counts.select("word", "lang", "n").mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        got = np.zeros((len(pieces), len(langs)))
        got[sums.piece, sums.lang] = sums.n
        pooled = (got.sum(1) + 0.1) / (got.sum() + 0.1 * len(pieces))
        smooth = (got + SMOOTHING * pooled[:, None]) / (got.sum(0) + SMOOTHING)
        table = np.vstack([smooth, np.full((1, len(langs)), UNKNOWN)])
    return {"langs": langs, "pieces": pieces, "table": table.astype(np.float32)}


class Scorer:
    """ln P(text) by language from cached words."""

    def __init__(self, model: dict):
        self.lattice, self.table = Lattice(model["pieces"]), model["table"].astype(np.float64)
        self.place: dict[bytes, int] = {}
        self.rows = np.zeros((1 << 14, len(model["langs"])), np.float32)

    def learn(self, new: list[bytes]) -> None:
        base = len(self.place)
        if base + len(new) > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros((max(len(self.rows), len(new)), self.rows.shape[1]), np.float32)])
        text = [w.decode() for w in new]
        for part in _batches(text):
            self.rows[base + part] = self.lattice.log_likelihood([text[k] for k in part.tolist()], self.table)
        self.place.update(zip(new, range(base, base + len(new))))

    def texts(self, texts: list[str | None]) -> np.ndarray:
        split = [words(t) for t in texts]
        known = len(self.place)
        new = list(set(itertools.chain.from_iterable(split)).difference(self.place))
        self.learn(new)
        get = self.place.__getitem__
        out = np.stack([self.rows[np.fromiter(map(get, w), np.int64, len(w))].sum(0, dtype=np.float64) for w in split])
        if len(self.place) > CACHED_WORDS:
            for w in new:
                del self.place[w]
            assert len(self.place) == known
        return out


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its posterior under equal priors.

    ``und`` and 0 for a text without letters (null and empty ones too), and for all without a model. Extra
    columns are not read; repeated rows each give a row. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache()
        if model and cache.get("langid", (None,))[0] != model["key"]:
            cache["langid"] = (model["key"], Scorer(model))
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            texts = batch.column(1).to_pylist()
            lettered = [bool(model) and any(map(str.isalpha, t or "")) for t in texts]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            at = [k for k, x in enumerate(lettered) if x]
            if at:
                ll = cache["langid"][1].texts([texts[k] for k in at])
                best = ll.argmax(1)
                score[at] = 1 / np.exp(ll - ll[np.arange(len(at)), best][:, None]).sum(1)
                for k, b in zip(at, best.tolist()):
                    lang[k] = model["langs"][b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    if model:
        model = {**model, "key": (hash(model["table"].tobytes()), tuple(model["langs"]))}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def predictions(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; languages of held-out ids are never read."""
    return identify(docs, train(docs, path)).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
