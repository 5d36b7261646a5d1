import hashlib
import random

import pytest

from skein.llm import prefix_hashes as H

DOCS = "doc_id long, text string, `a.b` string, bucket int, guest int, A string"
ALPHABET = "ab\0é😀"


def brute(text):
    """The fingerprint by its definition."""
    w = min(len(text), H.WINDOW)
    value = lambda t: sum((ord(c) + 1) * pow(H.BASE, j + 1, H.PRIME) for j, c in enumerate(t)) % H.PRIME
    spans = {value(text[k : k + w]) >> H.DROP_BITS for k in range(len(text) - w + 1)} if text else set()
    return f"{len(text):x}-{value(text):016x}-" + "".join(f"{v:010x}" for v in sorted(spans)[: H.KEEP])


def random_text(n, seed):
    return "".join(random.Random(seed).choices(ALPHABET, k=n))


@pytest.mark.parametrize("n", [0, 1, 11, 12, 13, 300, H.BLOCK - 1, H.BLOCK, H.BLOCK + 1, H.BLOCK + 11, H.BLOCK + 12, 2 * H.BLOCK + 5])
def test_fingerprints_by_definition(n):
    text = random_text(n, n)
    assert H.Prefixes(text).fingerprint == brute(text)


def test_spans_and_extensions():
    rng = random.Random(4)
    s, t = H.Prefixes(random_text(700, 1) * 2), H.Prefixes("x" + random_text(700, 1))
    one, two = random_text(700, 1) * 2, "x" + random_text(700, 1)
    for _ in range(300):
        i, j = rng.randrange(1401), rng.randrange(702)
        if rng.random() < 0.5:
            i = max(0, j - 1)
        k = next((k for k in range(2000) if i + k >= 1400 or j + k >= 701 or one[i + k] != two[j + k]))
        assert s.forward(i, t, j) == k and s.same(i, t, j, k)
        b = next((b for b in range(2000) if i - b <= 0 or j - b <= 0 or one[i - b - 1] != two[j - b - 1]))
        assert s.backward(i, t, j) == b
        if k:
            assert s.span(i, k) == t.span(j, k)


def test_likeness():
    a, b = (H.Prefixes(x).fingerprint for x in ("the quick brown fox", "the quick brown cat"))
    grams = [{x[k : k + 12] for k in range(8)} for x in ("the quick brown fox", "the quick brown cat")]
    assert H.likeness(a, b) == 2 * len(grams[0] & grams[1]) / sum(map(len, grams))
    empty = H.Prefixes("").fingerprint
    assert H.likeness(a, a) == 1 == H.likeness(empty, empty) and H.likeness(a, empty) == 0
    long = [random_text(30_000, 7), random_text(20_000, 7) + random_text(10_000, 8)]
    x, y = ({t[k : k + 12] for k in range(len(t) - 11)} for t in long)
    estimate = H.likeness(*(H.Prefixes(t).fingerprint for t in long))
    assert abs(estimate - 2 * len(x & y) / (len(x) + len(y))) < 0.15


def expected(rows):
    """Brute force over (doc_id, text) in order; ties only among equal rows."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (d, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        common = [next((k for k in range(min(len(t), len(u))) if t[k] != u[k]), min(len(t), len(u))) for u in (e, following)]
        prints = [brute(x) for x in (t, e, following)]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), *prints[:2], H.likeness(prints[0], prints[1]), H.likeness(prints[0], prints[2]), *common))
    return sorted(out, key=str)


def test_documents_against_brute_force(spark):
    texts = [random_text(k * 7 % 90, k % 11) for k in range(60)]
    rows = [(k * 3, t) for k, t in enumerate(texts)] + [(None, "no id"), (500, None), (501, ""), (502, "same"), (502, "same"), (502, "same")]
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS)
    got = sorted((tuple(r) for r in H.compared(docs).collect()), key=str)
    assert got == expected(rows)
    one = H.compared(docs.where("doc_id = 501")).collect()
    assert len(one) == 1 and one[0].near_next == 1 and H.compared(docs.where("false")).count() == 0


def test_one_id_for_all_and_a_long_text(spark):
    rows = [(7, random_text(20, k)) for k in range(200)] + [(8, random_text(200_000, 3))]
    out = H.compared(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.fingerprint): r for r in out.collect()}
    assert len(got) == 201 and {k[1] for k in got} == {H.Prefixes(t).fingerprint for _, t in rows}
    long = next(r for r in got.values() if r.doc_id == 8)
    # the text after the last one is the first, of 20 code points
    assert long.n_chars == 200_000 and long.common_edited >= 150_000 and long.near_edited > 0.6


def test_extensions_of_pairs(spark):
    rows = [("abcdef", 1, "xbcdez", 1, 0), (None, None, "abc", 9, 0), ("aaa", 0, "aa", 0, 0)]
    schema = "text_a string, at_a int, text_b string, at_b int, `a.b` int, Forward int"
    out = H.extensions(spark.createDataFrame([(*r, 5) for r in rows], schema))
    assert out.columns == ["text_a", "at_a", "text_b", "at_b", "a.b", "forward", "backward"]
    assert [(r.forward, r.backward) for r in out.collect()] == [(4, 0), (0, 0), (2, 0)]
