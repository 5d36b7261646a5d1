"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows with quality 1; the unlabelled set is all of the web text at
hand, labels unseen; the class prior is estimated from the lower envelope of the ratio of upper score tails, of the
unlabelled rows' to the positives'; the labelled rows' share of positives is kept beside it and used nowhere. A small network g is
fitted to minimise ``pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)])`` with the sigmoid loss; when the
second part is below zero, its gradient is followed upwards. The score is g mapped to a probability by a
logistic fit on the labelled training rows.

The fit uses at most ``SAMPLE`` labelled rows of each class, the first by a seeded hash. It starts on as many
unlabelled rows and goes on with ``ROUNDS`` steps whose risk is taken over every row of the corpus, by partial sums on
Spark; what reaches the driver is the sampled feature vectors and one sum for each weight. Features are shape statistics of whole texts, never ids, language or source.
"""

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, held_out, written

SAMPLE, SEED, THRESHOLD, HIDDEN, ROUNDS = 12_000, 3, 0.3, 24, 6
FEATURES = 20
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
DIGITS, MARKS = b"0123456789", b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"


def features(text: str | None) -> np.ndarray:
    """Shape statistics of a whole text; all zero for one without words."""
    raw = (text or "").encode()
    words = raw.split()
    out, n = np.zeros(FEATURES, np.float32), len(words)
    if not n:
        return out
    size = len(raw)
    upper, lower, digits = (size - len(raw.translate(None, x)) for x in (UPPER, LOWER, DIGITS))
    marks, sentence = (size - len(raw.translate(None, x)) for x in (MARKS, b".,"))
    high = size - len(raw.translate(None, bytes(range(128, 256))))
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    pairs = len(set(zip(words, words[1:])))
    fours = len(set(zip(words, words[1:], words[2:], words[3:])))
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = raw.split(b"\n")
    letters = upper + lower + high + 1
    out[:] = (
        upper / letters,
        marks / size,
        digits / size,
        sentence / n,
        high / letters,
        np.log1p(n) / 10,
        len(counts) / n,
        np.log1p(len(counts)) / np.log1p(n),
        top / n,
        pairs / max(1, n - 1),
        fours / max(1, n - 3) if n > 3 else 1,
        lengths.mean() / 10,
        lengths.std() / 10,
        min(3, lengths.max() / 30),
        (lengths <= 3).mean(),
        len(set(lines)) / len(lines),
        min(3, n / len(lines) / 50),
        min(1, len(zlib.compress(raw, 1)) / size),
        raw.count(b"|") / n,
        sum(w[-1] in MARKS for w in counts) / len(counts),
    )
    return out


def standard(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["scale"], -8, 8).astype(np.float64)


def sums(w: list[np.ndarray], x: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Sum of sigmoid(g) over the rows of standardised ``x``, and its gradient by the weights of g."""
    h = np.tanh(x @ w[0] + w[1])
    s = 1 / (1 + np.exp(-np.clip((h @ w[2] + w[3])[:, 0], -30, 30)))
    slope = s * (1 - s)
    dh = np.outer(slope, w[2][:, 0]) * (1 - h * h)
    return float(s.sum()), [x.T @ dh, dh.sum(0), h.T @ slope[:, None], np.array([slope.sum()])]


def risk(prior: float, positive: float, unlabelled: float) -> float:
    """Non-negative unbiased risk from the mean sigmoid(g) of positives and of unlabelled rows; l(z) = sigmoid(-z)."""
    return prior * (1 - positive) + max(0.0, unlabelled - prior * positive)


def direction(prior: float, positive: float, unlabelled: float, dp: list[np.ndarray], du: list[np.ndarray]) -> list[np.ndarray]:
    """Where to step down: the risk's gradient, or, where its second part is below zero, that part's gradient upwards."""
    if unlabelled - prior * positive >= 0:
        return [u - 2 * prior * p for p, u in zip(dp, du)]
    return [prior * p - u for p, u in zip(dp, du)]


class Adam:
    """Adam steps of ``rate`` with a small weight decay on matrices."""

    def __init__(self, w: list[np.ndarray], rate: float = 0.01):
        self.w, self.rate, self.t = w, rate, 0
        self.m, self.v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]

    def step(self, grad: list[np.ndarray]) -> None:
        self.t += 1
        for k, d in enumerate(grad):
            d = d + 1e-4 * self.w[k] if k % 2 == 0 else d
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.999 * self.v[k] + 0.001 * d**2
            self.w[k] = self.w[k] - self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED, epochs: int = 40, batch: int = 1024) -> dict:
    """Weights of g, fitted by Adam on the non-negative risk of random batches."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    n = positive.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    model = {"mean": both.mean(0), "scale": both.std(0) + 1e-3, "a": 4.0, "b": 0.0}
    p, u, adam = standard(model, positive), standard(model, unlabelled), Adam(w)
    for _ in range(epochs * max(1, max(len(p), len(u)) // batch)):
        (sp, dp), (su, du) = (sums(adam.w, x[rng.integers(0, len(x), batch)]) for x in (p, u))
        adam.step(direction(prior, sp / batch, su / batch, [d / batch for d in dp], [d / batch for d in du]))
    return {**model, "w": adam.w}


def refined(model: dict, positive: np.ndarray, web: DataFrame, prior: float, rounds: int = ROUNDS) -> dict:
    """Further steps, the unlabelled part of the risk and of its gradient taken over all rows of ``web`` (x)."""
    p, adam = standard(model, positive), Adam(model["w"], 0.005)
    shapes = [x.shape for x in model["w"]]
    for _ in range(rounds):
        weights = adam.w

        def partial(batches: Iterator[pa.RecordBatch], weights: list = weights) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + sum(x.size for x in weights))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(model["mean"]))
                s, d = sums(weights, standard(model, x))
                total += np.concatenate([[len(x), s], *(y.ravel() for y in d)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

        # one row for each weight
        got = web.select("x").mapInArrow(partial, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas().v.to_numpy()
        if not len(got) or not got[0]:
            break
        cuts = np.cumsum([0, *(int(np.prod(x)) for x in shapes)]) + 2
        du = [got[a:b].reshape(x) / got[0] for a, b, x in zip(cuts[:-1], cuts[1:], shapes)]
        sp, dp = sums(weights, p)
        adam.step(direction(prior, sp / len(p), got[1] / got[0], [d / len(p) for d in dp], du))
    return {**model, "w": adam.w}


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    return (np.tanh(standard(model, x) @ model["w"][0] + model["w"][1]) @ model["w"][2] + model["w"][3])[:, 0]


def logistic(g: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that sigmoid(a g + b) fits y; Newton steps with a small ridge."""
    x, w = np.stack([g, np.ones_like(g)], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + 0.1 * w)
    return float(w[0]), float(w[1])


def estimated_prior(gp: np.ndarray, gu: np.ndarray) -> float:
    """The least ratio of upper tails, P_u(g >= t) to P_p(g >= t)."""
    cuts = np.quantile(gp, np.linspace(0.05, 0.95, 19))
    ratio = [(gu >= t).mean() / max(1e-6, (gp >= t).mean()) for t in cuts]
    return float(min(0.98, max(0.02, min(ratio))))


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, x: features) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            x = np.stack([features(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<float>")


def sampled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of ids, the first by a seeded hash."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)


def train(web: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> dict | None:
    """A model from written vectors and labels, or None where no row is labelled 1; ``prior`` is the estimate, ``share`` that among labels.

    Conflicting labels of one id count as the larger; of rows that share an id one is used, the least vector.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y")).where(~held_out("doc_id", 5, 0))
    share = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not share.get(1):
        return None
    start = sampled(web.select("doc_id").where("doc_id is not null").distinct(), sample, seed + 1).withColumn("y", F.lit(-1))
    chosen = sampled(known.where("y = 1"), sample, seed).union(sampled(known.where("y = 0"), sample, seed)).select("doc_id", F.col("y").cast("int")).union(start)
    # one row for each of at most three times ``sample`` ids
    rows = web.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas()
    y, x = rows.y.to_numpy(), np.stack(rows.x.to_list()) if len(rows) else np.zeros((0, FEATURES), np.float32)
    order = np.lexsort([*x.T, y])  # rows arrive in any order
    y, x = y[order], x[order]
    if not (y == 1).any() or not (y == -1).any():
        return None
    prior = 0.5
    for _ in range(2):
        model = fit(x[y == 1], x[y == -1], prior, seed)
        prior = estimated_prior(margin(model, x[y == 1]), margin(model, x[y == -1]))
    model = fit(x[y == 1], x[y == -1], prior, seed)
    model = {**refined(model, x[y == 1], web, prior), "prior": prior, "share": share[1] / sum(share.values())}
    if (y == 0).any():
        g = np.concatenate([margin(model, x[y == 1]), margin(model, x[y == 0])])
        weight = np.log(share[1] / (y == 1).sum()) - np.log(share[0] / (y == 0).sum())
        model["a"], model["b"] = logistic(g, np.r_[np.ones((y == 1).sum()), np.zeros((y == 0).sum())])
        model["b"] += float(weight)
    return model


def probability(model: dict | None, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model["a"] * margin(model, x) + model["b"], -30, 30))) if model else np.full(len(x), 0.5)


def predictions(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; labels of held-out ids are never read.

    Null and empty texts have the score of a text without words. Repeated rows each give a row with one score, and
    rows that share an id are scored each for its text. Without a positive label all scores are 0.5. Extra columns
    are not read. Empty table: no rows.
    """
    web = written(vectors(docs), "quality-vectors")
    model = train(web, labels, sample, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(model, x))], ["doc_id", "score"])

    rows = web.mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@by_position
def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``. Other cases as in ``predictions``."""
    at, model = docs.columns.index("text"), train(written(vectors(docs), "quality-vectors"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            p = probability(model, np.stack([features(t) for t in batch.column(at).to_pylist()]))
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
