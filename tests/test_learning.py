"""Learnt confidence: vocabulary, vectors, folds, calibration."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from skein.operators import learning as L

EXAMPLES = "path string, features map<string,double>, label int"


def examples(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, kind = rng.gauss(0, 1), rng.choice("abc")
        y = int(rng.random() < 1 / (1 + np.exp(-(2 * x + (kind == "a")))))
        out.append((f"p{k}", {"x": x, f"kind={kind}": 1.0}, y))
    return out


def pooled(points):
    """Pool adjacent violators: the isotonic fit at each distinct place."""
    places = sorted({x for x, _ in points})
    blocks = [[np.mean([y for a, y in points if a == x]), sum(a == x for a, _ in points), 1] for x in places]
    out = []
    for block in blocks:
        out.append(block)
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            b, a = out.pop(), out.pop()
            out.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return dict(zip(places, [v for v, _, many in out for _ in range(many)]))


def test_isotonic_calibration_pools_adjacent_violators(spark):
    rng = random.Random(3)
    points = [(round(rng.random() * 4, 1), rng.randrange(2)) for _ in range(300)]
    fit = IsotonicRegression(featuresCol="m", labelCol="y").fit(spark.createDataFrame(points, "m double, y int"))
    got = {r.m: r.prediction for r in fit.transform(spark.createDataFrame([(x,) for x, _ in points], "m double")).distinct().collect()}
    assert got == pytest.approx(pooled(points))


def test_vocabulary_and_vectors(spark):
    rows = spark.createDataFrame([("a", {"x": 1.5, "k=1": 1.0}, 1), ("b", {"k=2": 1.0}, 0), ("c", None, 0), ("d", {}, 0)], EXAMPLES)
    names = L.vocabulary(rows, "features")
    assert names == ["k=1", "k=2", "x"] and L.vocabulary(rows.where("false"), "features") == []
    got = {r.path: r.vector for r in L.vectors(rows, "features", [f"n{k}" for k in range(20)] + names, ["path"]).collect()}
    assert isinstance(got["a"], SparseVector) and got["a"].toArray()[20:].tolist() == [1.0, 0.0, 1.5] and got["c"].toArray().sum() == 0 == got["d"].toArray().sum()
    with pytest.raises(ValueError, match="feature names"):
        many = spark.range(1).select(F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(L.MOST_NAMES)), lambda k: F.struct(k.cast("string").alias("k"), F.lit(1.0).alias("v")))).alias("features"))
        L.vocabulary(many, "features")


@pytest.mark.parametrize(("n", "how"), [(300, "sigmoid"), (1200, "isotonic")])
def test_probabilities_are_good_and_calibrated(spark, n, how):
    rows = spark.createDataFrame([*examples(n), ("none", {"x": 1.0}, None)], EXAMPLES)
    model, stored = L.trained(rows, "path", "features", "label")
    assert model.calibration == how and model.examples == n and len(model.folds) == 5 and model.names == ["kind=a", "kind=b", "kind=c", "x"]
    r = L.report(model.scored(stored), model).first()
    assert (r.n, r.calibration, r.features) == (n, how, 4) and r.auc > 0.8 and r.brier < 0.2 and r.ece < 0.08
    fresh = examples(2000, seed=9)
    p = {x.path: x.p for x in L.confident(spark.createDataFrame(fresh, EXAMPLES), "path", "features", model, F.lit(0.5)).collect()}
    high = [y for path, _, y in fresh if p[path] > 0.75]
    assert len(high) > 300 and np.mean(high) > 0.75 and all(0 <= v <= 1 for v in p.values())


def test_too_few_examples_fall_back_to_the_rule(spark):
    rows = spark.createDataFrame([("a", {"x": 1.0}, 1), ("b", {"x": 2.0}, 1)], EXAMPLES)
    model, stored = L.trained(rows, "path", "features", "label")
    assert model is None and stored.count() == 2
    assert [r.p for r in L.confident(rows, "path", "features", model, F.lit(0.25)).collect()] == [0.25, 0.25]
    assert L.method(999) == "sigmoid" and L.method(1000) == "isotonic" and L.method(5, "none") == "none"
