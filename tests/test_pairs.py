"""Pair search against all pairs."""

import random

import numpy as np
import pytest

from skein.operators import pairs


@pytest.mark.parametrize("most", [0, 2, 3, 9, 16, 24])
def test_near_words_by_parts_and_by_all(most):
    rng = np.random.default_rng(most)
    seeds = rng.integers(0, 2**64, 30, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False)) for _ in range(900)], np.uint64)
    left, right = seeds[rng.integers(0, 30, 400)] ^ flips[:400], seeds[rng.integers(0, 30, 500)] ^ flips[400:]
    right[:20] = left[:20]
    want = {(a, b, int(d)) for a in range(400) for b, d in enumerate(np.bitwise_count(left[a] ^ right)) if d <= most}
    for few in (0, 10_000):
        got = [t for a, b, d in pairs.near(left, right, most, few) for t in zip(a.tolist(), b.tolist(), d.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def brute(codes, most):
    out = []
    for i, a in codes.items():
        for j, b in codes.items():
            n = min(len(a), len(b))
            if i < j and n:
                apart = sum(x != y for x, y in zip(a, b))
                if apart / n <= most:
                    out.append((i, j, round(1 - apart / n, 9)))
    return sorted(out)


@pytest.mark.parametrize(("most", "lengths"), [(0.15, [64]), (0.15, [1, 3, 5, 6, 7, 12, 13, 20, 33, 64]), (0.3, [4, 9, 10, 31]), (0.0, [3, 8])])
def test_positional_pairs_of_any_lengths_are_all_found(spark, most, lengths):
    rng = random.Random(8)
    seeds = [[rng.randrange(3) for _ in range(64)] for _ in range(6)]
    codes = {}
    for k in range(160):
        n = rng.choice(lengths)
        code = list(rng.choice(seeds)[:n])
        for at in rng.sample(range(n), min(n, rng.randrange(0, n // 4 + 2))):
            code[at] = rng.randrange(3)
        codes[k] = code
    rows = [*codes.items(), (1000, []), (1001, None), (None, [1, 2, 3])]
    df = spark.createDataFrame(rows, "id long, codes array<int>")
    got = [(r.key_a, r.key_b, round(r.score, 9)) for r in pairs.positional(df, "id", "codes", most).collect()]
    assert sorted(got) == brute(codes, most)


def test_candidates_are_few(spark):
    """Random codes of three values: under a thousandth of all pairs have a key in common."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 3, (3000, 64))
    df = spark.createDataFrame([(k, c) for k, c in enumerate(codes.tolist())], "id long, codes array<int>")
    seen = []
    real = pairs._candidates
    try:
        pairs._candidates = lambda *a: seen.append(out := real(*a)) or out
        pairs.positional(df, "id", "codes")
    finally:
        pairs._candidates = real
    assert len(seen) == 1 and seen[0].count() < 3000 * 3000 / 2 / 1000


def test_candidates_that_cannot_fit_stay_in_the_join(spark):
    """Codes that share a stretch and little else are no rows to shuffle and compare in full."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 3, (300, 64))
    codes[:, :13] = 1
    codes[1, 13:60] = codes[0, 13:60]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(codes.tolist())], "id long, codes array<int>")
    seen = []
    real = pairs._candidates
    try:
        pairs._candidates = lambda *a: seen.append(out := real(*a)) or out
        got = pairs.positional(df, "id", "codes")
    finally:
        pairs._candidates = real
    assert [tuple(r) for r in seen[0].collect()] == [(0, 1)] == [(r.key_a, r.key_b) for r in got.collect()]


def test_codes_of_other_kinds_are_compared_too(spark):
    rows = [(1, ["a", "b", None] * 4), (2, ["a", "b", None] * 4), (3, ["a", "b", "c"] * 4), (4, ["a", "b", "c"] * 4), (5, ["a", "b", "c"] * 30), (6, ["x"] + ["b", "c", "a"] * 3)]
    df = spark.createDataFrame(rows, "id long, codes array<string>")
    assert sorted((r.key_a, r.key_b, r.score) for r in pairs.positional(df, "id", "codes").collect()) == [(3, 4, 1.0), (3, 5, 1.0), (3, 6, 0.9), (4, 5, 1.0), (4, 6, 0.9), (5, 6, 0.9)]
