"""Toxicity of whole texts after noisy-channel deobfuscation.

Restoring: spans that look disguised (letters mixed with look-alike signs, single letters kept apart by
spaces or marks, a letter three or more times in a row) become character lattices. A sign may stand for
itself or its look-alikes, a separator may stand for nothing or for a space, a repeated letter may be
left out once or more; each choice has a cost. Spans may have any length; those of letters apart are also read as one word. Viterbi decoding finds the likeliest reading under a character trigram
model, whose counts come from all documents.

Scoring: a word's evidence is the largest log odds of its stems (the word and its beginnings of 4 to 7
bytes) between toxic and other training rows; a text's are its three strongest words and how many are
strong. A logistic function turns them into a probability. Evidence for its fit comes from one half of
the training rows and is applied to the other half; the final evidence is from both.

At most ``SAMPLE`` training rows of each label are used, the first by a seeded hash; what reaches the driver
is one row for each stem that ``LEAST`` toxic ones of them share.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, process_cache, written
from .quality_pu import sampled

SAMPLE, LEAST, SEED, THRESHOLD = 5_000, 3, 5, 0.7
STEMS = (4, 5, 6, 7)
STRONG = 3.0
CACHED_WORDS, KNOWN_LENGTH = 400_000, 200
# Letters that a sign can stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou"}
ALPHABET = " abcdefghijklmnopqrstuvwxyzàâäçèéêëíîïñóôöúùûüß"
SIGN_COST, SPLIT_COST, DROP_COST, KEEP_COST = 0.7, 0.5, 0.7, 3.0
SIGNS = re.escape("".join(LOOKALIKES))
LETTERS = r"[^\W\d_]"
SIGN = rf"(?:{LETTERS}|[{SIGNS}])"
DISGUISED = re.compile(
    rf"(?=.*(?:[{SIGNS}]{LETTERS}|{LETTERS}[{SIGNS}])){SIGN}{{3,}}"  # look-alikes
    rf"|(?=[\W\d_]*{LETTERS}[\W\d_]*{LETTERS}){SIGN}(?:[.\-_*]{SIGN}){{3,}}"  # letters apart
    rf"|(?=.*({LETTERS})\1\1){LETTERS}{{3,}}"  # repetition
)
REPEATED = re.compile(rf"({LETTERS})\1{{3,}}")
SEPARATORS = " .-_*"
# Marks around a token, from the surest: ends of sentences, all that are no look-alikes, all.
ROUND = (".,;:?!", ".,;:?)[]{}<>\"'`^~&%#=/\\-_“”„‘’«»…¿¡", ".,;:?!()[]{}<>\"'`^~&%#=/\\-_“”„‘’«»…¿¡@$|+€*")
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANK = bytes.maketrans(MARKS, b" " * len(MARKS))


class Channel:
    """Viterbi decoder of disguised spans; ``counts``: character trigrams by number."""

    def __init__(self, counts: np.ndarray):
        n = len(ALPHABET)
        c = counts.reshape(n, n, n).astype(float)
        two, one = c.sum(0), c.sum((0, 1)) + 1
        uni = one / one.sum()
        bi = (two + 5 * uni) / (two.sum(1, keepdims=True) + 5)
        self.cost = -np.log((c + 5 * bi[None]) / (c.sum(2, keepdims=True) + 5))
        self.number = {x: k for k, x in enumerate(ALPHABET)}
        self.known: dict[str, list[str]] = {}

    def restore(self, span: str) -> list[str]:
        """The words that a span stands for."""
        if len(span) > KNOWN_LENGTH:
            return self._decode(span)
        if span not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[span] = self._decode(span)
        return self.known[span]

    def _decode(self, span: str) -> list[str]:
        """The words of the likeliest reading and, of letters apart, of the likeliest without spaces."""
        apart = sum(x in SEPARATORS for x in span) * 2 >= len(span) - 1
        read = self._likeliest(span, apart, False).split()
        return list(dict.fromkeys(read + self._likeliest(span, apart, True).split())) if apart else read

    def _likeliest(self, span: str, apart: bool, spaces: bool) -> str:
        """A state is the last two letters written, so repeats and gaps may vanish; texts are chains of (rest, letter)."""
        number, cost = self.number, self.cost
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for at, x in enumerate(span):
            options: list[tuple[str, float]] = []
            if x in number and x != " ":
                options.append((x, 0.0))
            options += [(y, SIGN_COST) for y in LOOKALIKES.get(x, "")]
            if apart and x in SEPARATORS:
                options += [("", SPLIT_COST), *([(" ", SPLIT_COST)] if spaces else [])]
            elif at and x == span[at - 1]:
                options.append(("", DROP_COST))
            if not options:
                options = [("", KEEP_COST)]
            found: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, written) in best.items():
                for y, extra in options:
                    if y:
                        k = number[y]
                        if not k and not b:
                            continue
                        state, total, text = (b, k), so_far + extra + cost[a, b, k], (written, y)
                    else:
                        state, total, text = (a, b), so_far + extra, written
                    if state not in found or total < found[state][0]:
                        found[state] = (total, text)
            best = found
        text = min(((total + (cost[a, b, 0] if b else 0.0), text) for (a, b), (total, text) in best.items()), key=lambda x: x[0])[1]
        out = []
        while text:
            text, y = text
            out.append(y)
        return "".join(reversed(out))


def trigrams(docs: DataFrame) -> np.ndarray:
    """Character trigram counts over all texts, lower-cased, anything outside the alphabet as a space."""
    n = len(ALPHABET)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(0x250, np.int64)
        for k, x in enumerate(ALPHABET):
            table[ord(x)] = k
        total = np.zeros(n**3, np.int64)
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            text = "  ".join(t.lower() for t in batch.column(0).to_pylist() if t)
            code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
            x = table[np.where(code < len(table), code, 0)]
            if len(x) > 2:
                total += np.bincount((x[:-2] * n + x[1:-1]) * n + x[2:], minlength=n**3)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["gram", "n"])

    # at most one row for each possible trigram
    rows = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n**3, np.int64)
    out[rows.gram.to_numpy(np.int64)] = rows.n.to_numpy()
    return out


def readings(token: str, channel: Channel) -> list[bytes]:
    """The words of a token without its marks, and those that it stands for if it is disguised."""
    out = token.encode().translate(BLANK).split()
    for span in dict.fromkeys(REPEATED.sub(r"\1\1\1", token.strip(marks) if k else token.rstrip(marks)) for k, marks in enumerate(ROUND)):
        if DISGUISED.fullmatch(span):
            out += [w.encode() for w in channel.restore(span)]
    return out


def alone(token: str) -> str | None:
    """The letter, look-alike sign or separator that a token consists of, but for marks around it."""
    x = token if len(token) == 1 else token.strip(ROUND[2])
    return x if len(x) == 1 and (x.isalpha() or x in LOOKALIKES or x in SEPARATORS) else None


def apart(tokens: list[str]) -> list[str]:
    """Runs of letters, look-alike signs and separators that stand alone among the tokens of a text, each as one span.

    A run has four letters or signs or more, two letters at least.
    """
    unit = {t: x for t in set(tokens) if (x := alone(t))}
    single = np.fromiter(map(unit.__contains__, tokens), bool, len(tokens))
    if single.sum() < 4:
        return []
    edge = np.diff(np.r_[0, single.astype(np.int8), 0])
    out = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if b - a >= 4:
            run = [unit[t] for t in tokens[a:b]]
            letters = sum(map(str.isalpha, run))
            if letters >= 2 and letters + sum(x in LOOKALIKES and x not in SEPARATORS for x in run) >= 4:
                out.append(" ".join(run))
    return out


def words(text: str | None, channel: Channel) -> set[bytes]:
    """The text's distinct words, lower-cased and without marks, and those that its disguised spans stand for."""
    tokens = (text or "").lower().split()
    out = {w for t in set(tokens) for w in readings(t, channel)}
    return out | {w.encode() for x in apart(tokens) for w in channel.restore(x)}


def stems(word: bytes) -> list[bytes]:
    return [word, *(word[:k] + b"*" for k in STEMS if k < len(word))]


def channel_of(counts: np.ndarray) -> Channel:
    cache, key = process_cache(), ("channel", int(counts.sum()), int(np.bitwise_xor.reduce(counts * np.arange(1, len(counts) + 1))))
    if key not in cache:
        cache[key] = Channel(counts)
    return cache[key]


def _stem_counts(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(stem, n: rows with it by label and half: 00, 01, 10, 11) of (text, y, half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = channel_of(counts)
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(found)
            columns = [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(found.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["stem", "cell", "n"])

        for batch in batches:
            for text, y, half in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found.update((s, y * 2 + half) for s in {s for w in words(text, channel) for s in stems(w)})
                if len(found) > 500_000:
                    yield flush()
                    found.clear()
        yield flush()

    cells = rows.mapInArrow(run, "stem binary, cell int, n long")
    return cells.groupBy("stem").agg(*[F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(4)])


def odds(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    return np.log((toxic + 0.3) / (n_toxic + 0.6)) - np.log((other + 0.3) / (n_other + 0.6))


class Evidence:
    """Evidence of texts under a table of stems."""

    def __init__(self, table: dict[bytes, float], counts: np.ndarray):
        self.table, self.channel, self.known = table, channel_of(counts), {}

    def vector(self, text: str | None) -> np.ndarray:
        tokens = (text or "").lower().split()
        found = set(tokens)
        found.update(w for x in apart(tokens) for w in self.channel.restore(x))
        new = found.difference(self.known)
        get = self.table.get
        for t in new:
            self.known[t] = max((get(s, 0.0) for w in readings(t, self.channel) for s in stems(w)), default=0.0)
        value = np.fromiter(map(self.known.__getitem__, found), float, len(found))
        if len(self.known) > CACHED_WORDS:
            for t in new:
                del self.known[t]
        top = np.sort(value)[::-1][:3]
        out = np.zeros(5)
        out[: len(top)] = top
        out[3] = np.log1p((value > STRONG).sum())
        out[4] = np.log1p(len(found)) / 5
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> dict:
    """Trigram counts, stems' evidence and weights; without rows of both labels only the base rate."""
    counts = trigrams(docs)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y")).where(~held_out("doc_id", 3, 1))
    share = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = {"counts": counts, "table": {}, "w": np.r_[np.zeros(5), 0.0]}
    if not share.get(0) or not share.get(1):
        model["w"][5] = np.log((share.get(1, 0) + 0.5) / (share.get(0, 0) + 0.5))
        return model
    half = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2)).cast("int").alias("half")
    chosen = sampled(known.where("y = 1"), sample, seed).union(sampled(known.where("y = 0"), sample, seed))
    # one row for each of at most twice ``sample`` ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = written(rows.select("text", F.col("y").cast("int"), half), "toxicity-sample")
    n = {(r.y, r.half): r.n for r in rows.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    n0, n1 = (n.get((0, 0), 0), n.get((0, 1), 0)), (n.get((1, 0), 0), n.get((1, 1), 0))
    # stems of LEAST toxic rows or more that are evidence by one of the two tables
    toxic, other = F.col("n2") + F.col("n3"), F.col("n0") + F.col("n1")
    telling = [(t + 0.3) / (a + 0.6) > (o + 0.3) / (b + 0.6) * 2.7 for t, o, a, b in ((F.col("n2"), F.col("n0"), n1[0], n0[0]), (toxic, other, sum(n1), sum(n0)))]
    table = _stem_counts(rows, counts).where((toxic >= LEAST) & (telling[0] | telling[1])).toPandas()
    stem = [bytes(s) for s in table.stem]
    first = odds(table.n2.to_numpy(), table.n0.to_numpy(), n1[0], n0[0])
    final = odds((table.n2 + table.n3).to_numpy(), (table.n0 + table.n1).to_numpy(), sum(n1), sum(n0))
    keep = lambda value: {s: float(v) for s, v in zip(stem, value) if v > 1}
    table_a = keep(first)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(table_a, counts)
        for batch in batches:
            x = [evidence.vector(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    fit = rows.where("half = 1").select("text", "y").mapInArrow(vectors, "y int, x array<double>").toPandas()
    y, x = fit.y.to_numpy(), np.array(fit.x.to_list()).reshape(-1, 5)
    order = np.lexsort([*x.T, y])
    model["table"] = keep(final)
    model["w"] = _logistic(x[order], y[order])
    # the sample's shares of labels to those of all labelled rows
    model["w"][5] += np.log(share[1] / sum(n1)) - np.log(share[0] / sum(n0)) if sum(n1) and sum(n0) else 0.0
    return model


def predictions(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of held-out ids are never read.

    A null or empty text has no evidence. Of conflicting labels of one id the larger counts, and of rows that
    share an id one is learnt from. Without labels all scores are the base rate 0.5. Extra columns are not read;
    repeated rows each give a row, with one score. Empty table: no rows.
    """
    model = train(docs, labels, sample, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(model["table"], model["counts"])
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            x = np.stack([evidence.vector(t) for t in batch.column(1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ model["w"][:5] + model["w"][5], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
