"""Digests of key lists and exact values at ranks."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import digests, metrics


def frame(spark, rows, value="double"):
    return spark.createDataFrame(rows, f"by string, v {value}")


def skewed():
    rng = random.Random(4)
    rows = [("hot", round(rng.gauss(0, 50), 1)) for _ in range(6000)] + [("hot", 7.0)] * 3000
    rows += [(b, rng.random()) for b in "abc" for _ in range(20)] + [("one", 3.0), (None, 1.0), (None, 5.0), ("empty", None), ("hot", None), ("nan", float("nan")), ("nan", 2.0)]
    return rows


@pytest.mark.parametrize("few", [100_000, 0])
def test_percentiles_are_exact_whatever_the_skew(spark, monkeypatch, few):
    monkeypatch.setattr(metrics, "FEW_TARGETS", few)
    rows = skewed()
    got = {r.by: r for r in metrics.percentiles(frame(spark, rows), "by", "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert set(got) == {r[0] for r in rows} and got["empty"].p50 is None
    for by in set(got) - {"empty", "nan"}:
        v = [x for b, x in rows if b == by and x is not None]
        assert [got[by][c] for c in ("p0", "p50", "p95", "p100")] == pytest.approx(np.percentile(v, [0, 50, 95, 100]))
    assert got["nan"].p0 == 2.0 and np.isnan(got["nan"].p100)
    at = {r.by: r.value for r in metrics.ceil_rank_percentile(frame(spark, rows), "by", "v", 0.95).collect()}
    for by in ("hot", "a", "one", None):
        v = sorted(x for b, x in rows if b == by and x is not None)
        assert at[by] == v[int(np.ceil(0.95 * (len(v) - 1)))]


def test_a_rank_outside_its_range_is_found_all_the_same(spark):
    rows = [("a", float(k)) for k in range(1000)]
    wrong = {"last": (0.1, F.col("n") - 1), "first": (0.9, F.lit(0)), "mid": (0.5, F.lit(500))}
    assert metrics.at_ranks(frame(spark, rows), "by", "v", wrong, sketch=100).first()[1:] == (1000, 999.0, 0.0, 500.0)


def test_only_rows_near_the_rank_are_put_in_order(spark):
    df = frame(spark, [("hot", float(k)) for k in range(50_000)])
    targets = spark.createDataFrame([(("hot",), 0, 50_000, 25_000, 24_990.0, 25_010.0)], "g struct<by:string>, k int, n long, rank long, low double, high double")
    found = metrics._found(df.select(F.struct("by").alias("g"), F.col("v").alias("value")), targets)
    assert found.collect()[0].value == 25_000.0


def brute_leaves(keys, fanout):
    out, start = {}, ""
    for k in sorted(set(keys), key=str.encode):
        h = hashlib.md5(k.encode()).hexdigest()
        if int(h[:15], 16) % fanout == 0:
            start = k
        out.setdefault(start, []).append(h + str(keys.count(k)))
    return {s: hashlib.md5("".join(v).encode()).hexdigest() for s, v in out.items()}


def test_leaves_tree_and_plain_digest(spark):
    rng = random.Random(6)
    keys = [f"k{rng.randrange(400)}é" for _ in range(600)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string")
    want = brute_leaves(keys, 8)
    rows = digests.leaves(df, "key", 8).collect()
    assert {r.start: r.digest for r in rows} == want and sum(r.keys for r in rows) == 600
    plain = hashlib.md5("".join(sorted(keys, key=str.encode)).encode()).hexdigest()
    assert digests.sorted_md5(df.repartition(5), "key").first().digest == plain
    root = digests.tree(df, "key", 8).first()
    assert root.keys == 600 and digests.tree(df.repartition(3), "key", 8).first() == root
    nothing = hashlib.md5(b"").hexdigest()
    empty = df.where("false")
    assert digests.tree(empty, "key", 8).first().digest == nothing == digests.sorted_md5(empty, "key").first().digest


def test_a_change_touches_its_own_range(spark):
    keys = [f"path/{k:05d}" for k in range(2000)]
    of = lambda ks: digests.leaves(spark.createDataFrame([(k,) for k in ks], "key string"), "key", 50)
    base = of(keys)
    plain = [k for k in keys if int(hashlib.md5(k.encode()).hexdigest()[:15], 16) % 50]
    one = digests.changed_ranges(base, of([k for k in keys if k != plain[700]])).collect()
    assert len(one) == 1 and one[0].status == "changed" and one[0].start <= plain[700]
    begin = next(k for k in keys[500:] if k not in set(plain))
    gone = {r.status for r in digests.changed_ranges(base, of([k for k in keys if k != begin])).collect()}
    assert gone == {"changed", "removed"}
    assert digests.changed_ranges(base, of(keys[::-1])).isEmpty()
    assert digests.tree(spark.createDataFrame([(k,) for k in keys], "key string"), "key", 50).first() != digests.tree(spark.createDataFrame([(k,) for k in keys[1:]], "key string"), "key", 50).first()
