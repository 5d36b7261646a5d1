"""Confidence learnt from labelled examples: named features to vectors, logistic regression, calibration by folds.

Features come as maps (``media.feature_map``). The names that occur make the vocabulary, in order; maps become compressed vectors
and are written once, so every fit and evaluation reads vectors and no text. Each fold's classifier is fitted on the other folds
and calibrated on its own; a probability is the mean over the folds.
"""

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .metrics import calibration_error, reliability

# Folds, rows from which calibration is isotonic, iterations, tolerance.
FOLDS, ISOTONIC_ROWS, ITERATIONS, TOLERANCE = 5, 1000, 400, 1e-4
#: The vocabulary is a literal of the plan; more names than this are an error, not cut.
MOST_NAMES, TASK_ROWS = 20_000, 20_000


def vocabulary(rows: DataFrame, features: str) -> list[str]:
    """The names that occur, sorted. A null map has none."""
    names = rows.select(F.explode(F.map_keys(features)).alias("name")).distinct().orderBy("name").limit(MOST_NAMES + 1).collect()
    if len(names) > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} feature names; give classes with fewer values")
    return [r.name for r in names]


def vectors(rows: DataFrame, features: str, names: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and ``vector`` of each row, written: compressed, sparse where that is smaller. Names that aren't known are left out."""
    each = F.transform(F.array(*map(F.lit, names)), lambda k: F.coalesce(F.try_element_at(F.col(features), k), F.lit(0.0)))
    dense = rows.select(*keep, array_to_vector(each).alias("_dense"))
    return written(VectorAssembler(inputCols=["_dense"], outputCol="vector").transform(dense).drop("_dense"), "vectors")


def method(examples: int, mode: str = "auto") -> str:
    """How to calibrate: isotonic from ``ISOTONIC_ROWS`` examples on, by a sigmoid below, or as ``mode`` says."""
    return ("isotonic" if examples >= ISOTONIC_ROWS else "sigmoid") if mode == "auto" else mode


@dataclass
class Confidence:
    """Classifiers with their calibration, one for each fold."""

    names: list[str]
    calibration: str
    examples: int
    folds: list[tuple[LogisticRegressionModel, object]]

    def scored(self, stored: DataFrame) -> DataFrame:
        """``stored`` rows (vector, ...) with ``p``."""
        out, parts = stored, []
        for k, (model, calibration) in enumerate(self.folds):
            out = _margin(model, out, f"_m{k}")
            if self.calibration == "isotonic":
                out = calibration.copy({calibration.featuresCol: f"_m{k}", calibration.predictionCol: f"_p{k}"}).transform(out)
            elif self.calibration == "sigmoid":
                a, b = calibration
                out = out.withColumn(f"_p{k}", 1 / (1 + F.exp(-(F.lit(a) * F.col(f"_m{k}") + F.lit(b)))))
            else:
                out = out.withColumn(f"_p{k}", 1 / (1 + F.exp(-F.col(f"_m{k}"))))
            parts.append(F.col(f"_p{k}"))
        return out.select(*stored.columns, (sum(parts[1:], parts[0]) / len(parts)).alias("p"))


def _margin(model: LogisticRegressionModel, rows: DataFrame, name: str) -> DataFrame:
    raw = model.copy({model.rawPredictionCol: "_raw", model.probabilityCol: "", model.predictionCol: ""}).transform(rows)
    return raw.withColumn(name, vector_to_array("_raw")[1]).drop("_raw")


def _sigmoid(rows: DataFrame) -> tuple[float, float]:
    """(a, b) so that sigmoid(a margin + b) fits the labels, these drawn in from 0 and 1 by a count (Platt's targets)."""
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    high, low = (n.get(1, 0) + 1) / (n.get(1, 0) + 2), 1 / (n.get(0, 0) + 2)
    target = F.when(F.col("y") == 1, high).otherwise(low)
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), target.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("w"))))
    data = VectorAssembler(inputCols=["m"], outputCol="x").transform(rows).select("x", both.alias("t")).select("x", "t.label", "t.w")
    fit = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", standardization=False).fit(data)
    return float(fit.coefficients[0]), float(fit.intercept)


def trained(examples: DataFrame, key: str, features: str, label: str, folds: int = FOLDS, mode: str = "auto") -> tuple[Confidence | None, DataFrame]:
    """(model, stored rows: key, y, vector) from labelled examples; None where one of the two labels is missing.

    Classes weigh alike. A row belongs to a fold by a hash of its key. Rows without a label are left out.
    """
    known = examples.where(F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("int").alias("y"), F.col(features).alias("_f"))
    known = written(known, "examples")  # features may be dear, and are read twice
    names = vocabulary(known, "_f")
    stored = vectors(known, "_f", names, [key, "y"])
    n = {r.y: r.n for r in stored.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not names or len(n) < 2:
        return None, stored
    total = sum(n.values())
    rows = stored.withColumn("w", F.when(F.col("y") == 1, total / (2 * n[1])).otherwise(total / (2 * n[0]))).withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    # an iteration is a job: few rows need few tasks
    rows = rows.coalesce(max(1, total // TASK_ROWS))
    how, parts = method(total, mode), []
    for k in range(folds):
        rest, own = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        if how == "none":
            rest, own = rows, rows
        elif {r.y for r in rest.select("y").distinct().collect()} != {0, 1} or own.isEmpty():
            continue
        model = LogisticRegression(featuresCol="vector", labelCol="y", weightCol="w", maxIter=ITERATIONS, tol=TOLERANCE, regParam=1 / total, standardization=False).fit(rest)
        margins = _margin(model, own, "m").select("m", "y")
        calibration = None if how == "none" else _sigmoid(margins) if how == "sigmoid" else IsotonicRegression(featuresCol="m", labelCol="y").fit(margins)
        parts.append((model, calibration))
        if how == "none":
            break
    return (Confidence(names, how, total, parts) if parts else None), stored


def confident(rows: DataFrame, key: str, features: str, model: Confidence | None, rule) -> DataFrame:
    """(key, p): a model's probability for each row, or the column ``rule`` without a model."""
    if model is None:
        return rows.select(key, rule.cast("double").alias("p"))
    return model.scored(vectors(rows.withColumnRenamed(features, "_f"), "_f", model.names, [key])).select(key, "p")


def report(scored: DataFrame, model: Confidence | None, bins: int = 10) -> DataFrame:
    """One row: n, calibration, features, auc, brier and ece of scored rows (y, p)."""
    rows = scored.withColumn("y", F.col("y").cast("double"))
    auc = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y").evaluate(rows) if model else 0.0
    ece = calibration_error(reliability(rows.select("p", "y"), "p", "y", bins))
    out = rows.agg(F.count("*").alias("n"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier")).crossJoin(ece)  # one row each
    return out.withColumns({"auc": F.lit(auc), "calibration": F.lit(model.calibration if model else "rule"), "features": F.lit(len(model.names) if model else 0)})
