"""Job queues, review queues and active learning."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dispatch(jobs: DataFrame, slots: DataFrame) -> DataFrame:
    """Queued jobs that get a free slot of their resource, by priority, then age."""
    running = jobs.where("status = 'running'").groupBy("resource").agg(F.count("*").alias("running"))
    w = Window.partitionBy("resource").orderBy("priority", "created", "job_id")
    waiting = jobs.where("status = 'queued'").withColumn("nth", F.row_number().over(w))
    free = slots.join(running, "resource", "left").select("resource", (F.col("slots") - F.coalesce("running", F.lit(0))).alias("free"))
    return waiting.join(free, "resource").where(F.col("nth") <= F.col("free")).select("job_id", "resource", "nth")


def requeue_stale(jobs: DataFrame, now: Column, lease_s: int, most_attempts: int) -> DataFrame:
    """Running jobs whose heartbeat is older than two leases go back to the queue, or fail after their last attempt."""
    stale = (F.col("status") == "running") & (F.col("heartbeat") < now - F.make_interval(secs=F.lit(2 * lease_s)))
    return jobs.withColumn("status", F.when(stale, F.when(F.col("attempts") >= most_attempts, "failed").otherwise("queued")).otherwise(F.col("status")))


def unlabelled(queues: list[DataFrame], labels: DataFrame, key: str, n: int) -> DataFrame:
    """The 2 n least certain rows of each queue, then without those that are labelled."""
    cut = [q.orderBy("confidence", key).limit(2 * n) for q in queues]
    every = cut[0]
    for q in cut[1:]:
        every = every.unionByName(q)
    return every.join(labels.select(key).distinct(), key, "left_anti")


def uncertain(scores: DataFrame, key: str, p: str, n: int) -> DataFrame:
    """The ``n`` rows with a probability closest to one half."""
    return scores.withColumn("uncertainty", F.abs(F.col(p) - 0.5)).orderBy("uncertainty", key).limit(n)


def diverse(candidates: DataFrame, key: str, vec: str, n: int) -> DataFrame:
    """(key, pick): greedy farthest points among a bounded candidate list, less uncertain ones later.

    The list is what ``uncertain`` left, so one task holds it.
    """
    kind = dict(candidates.dtypes)[key]

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["uncertainty", key], ignore_index=True)
        x, far, chosen = np.stack(rows[vec].to_list()), np.full(len(rows), np.inf), []
        for _ in range(min(n, len(rows))):
            k = int(np.argmax(np.where(np.isin(np.arange(len(rows)), chosen), -np.inf, np.where(np.isinf(far), 0, far) - rows.uncertainty)))
            chosen.append(k)
            far = np.minimum(far, np.linalg.norm(x - x[k], axis=1))
        yield pd.DataFrame({key: rows[key].iloc[chosen].to_numpy(), "pick": np.arange(1, len(chosen) + 1)})

    return candidates.select(key, "uncertainty", vec).coalesce(1).mapInPandas(pick, f"{key} {kind}, pick long")


def should_train(total: int, trained: int, least: int, step: int) -> bool:
    return total >= least and total - trained >= step


def training_due(counts: DataFrame, least: int, step: int) -> DataFrame:
    """``should_train`` for each row of (labels, trained), as ``train``."""
    return counts.withColumn("train", (F.col("labels") >= least) & (F.col("labels") - F.col("trained") >= step))
