import itertools
import random

import numpy as np
import pytest

from skein.llm import langid_unigram as L
from skein.llm import quality_pu as Q
from skein.llm import toxicity_channel as X

EDGES = [(9001, None, None, None), (9002, "", "en", "s"), (9003, "12 !!", "en", "s"), (None, "the and of", None, None), (9004, "the and of", "en", "s"), (9004, "the and of", "en", "s"), (9005, "the " * 60_000, "en", "s")]
DOCS = "doc_id long, text string, lang string, score string"


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    pieces = ["▁", "▁a", "▁ab", "a", "b", "c", "ab", "bc", "abc"]
    table = rng.random((len(pieces) + 1, 2)) / 5
    lattice, number = L.Lattice(pieces), {p: k for k, p in enumerate(pieces)}

    def segmentations(text):
        if not text:
            yield []
        for n in range(1, len(text) + 1):
            piece = text[:n]
            if piece in number or n == 1:
                for rest in segmentations(text[n:]):
                    yield [number.get(piece, -1), *rest]

    words = ["abc", "ab", "cab", "abcabc", "xa", "b"]
    want = [np.log(sum(np.prod([table[k] for k in s], axis=0) for s in segmentations("▁" + w))) for w in words]
    assert np.allclose(lattice.log_likelihood(words, table), want)
    weight = rng.random((len(words), 2))
    expected = np.zeros((len(pieces), 2))
    for w, g, total in zip(words, weight, want):
        for s in segmentations("▁" + w):
            share = np.prod([table[k] for k in s], axis=0) / np.exp(total) * g
            for k in s:
                if k >= 0:
                    expected[k] += share
    assert np.allclose(lattice.expected(words, weight, table), expected)


def test_languages_are_told_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = L.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and held
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(k, ["the and of with that", "der die und das ist"][k % 2] * (1 + k % 3), ["en", "de"][k % 2], "x") for k in range(30)]
    docs = spark.createDataFrame(rows + EDGES, DOCS)
    got = L.predictions(docs).collect()
    assert len(got) == len(rows) + len(EDGES)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (9001, 9002, 9003)] == ["und"] * 3 and by[9005].lang_pred == "en" and by[None].lang_pred == "en"
    assert {r.lang_pred for r in L.predictions(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null or true").selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert L.predictions(docs.where("false")).count() == 0


def area(score, y):
    pos, neg = [s for s, t in zip(score, y) if t], [s for s, t in zip(score, y) if not t]
    return sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = Q.predictions(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert area([r.score for r in rows], [r.quality for r in rows]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.collect())


def test_non_negative_risk_needs_no_negatives():
    rng = np.random.default_rng(1)
    positive = rng.normal(1, 1, (3000, 4))
    hidden = rng.random(4000) < 0.6
    unlabelled = np.where(hidden[:, None], rng.normal(1, 1, (4000, 4)), rng.normal(-2, 1, (4000, 4)))
    model = Q.fit(positive, unlabelled, 0.6, epochs=15)
    g = Q.margin(model, unlabelled)
    assert np.mean((g > 0) == hidden) > 0.95
    assert 0.5 < Q.estimated_prior(Q.margin(model, positive), g) < 0.75 and Q.estimated_prior(g, g) == 0.98


@pytest.mark.parametrize("labelled", [True, False])
def test_quality_and_toxicity_edges(spark, labelled):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["the", "of", "and", "haha", "nding"]) for _ in range(30)) + (" vile" if k % 4 == 0 else "") if k % 5 else "@@ ## " * 9, "en", "x") for k in range(200)]
    docs = spark.createDataFrame(rows + EDGES, DOCS)
    marks = [(k, int(k % 5 > 0), int(k % 4 == 0)) for k in range(200)] if labelled else [(None, 1, 1), (5, None, None)]
    labels = spark.createDataFrame(marks + [(7, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for predict, low in ((Q.predictions, 0.3), (X.predictions, 0.7)):
        got = predict(docs, labels).collect()
        assert len(got) == len(rows) + len(EDGES)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= low) for r in got)
        by = {}
        for r in got:
            by.setdefault(r.doc_id, set()).add(r.score)
        assert len(by[9004]) == 1 and by[9001] == by[9002]
        assert predict(docs.where("false"), labels).count() == 0
    assert Q.accepted(docs, labels).columns == docs.columns


def test_disguised_words_are_restored():
    text = "you are an idiot and a moron what a pathetic clown stupid trash loser " * 50
    counts = np.zeros(len(X.ALPHABET) ** 3, np.int64)
    n, number = len(X.ALPHABET), {x: k for k, x in enumerate(X.ALPHABET)}
    code = np.array([number[x] for x in text])
    np.add.at(counts, (code[:-2] * n + code[1:-1]) * n + code[2:], 1)
    channel = X.Channel(counts)
    for disguised, plain in {"1d10t": "idiot", "m0r0n": "moron", "cl0wn!": "clown", "stuuupid": "stupid", "tr@sh": "trash", "l.o.s.e.r": "loser"}.items():
        assert plain.encode() in X.words(f"so {disguised} here", channel)
    assert b"idiot" in X.words("an i d i o t here", channel)
    assert X.words("2024 a+b x", channel) == {b"2024", b"a", b"b", b"x"} or b"2024" in X.words("2024 a+b x", channel)
    assert X.words(None, channel) == set()


@pytest.fixture
def channel():
    text = "you are an idiot and a moron what a pathetic clown such a stupid man i am stupid trash loser " * 50
    counts, n, number = np.zeros(len(X.ALPHABET) ** 3, np.int64), len(X.ALPHABET), {x: k for k, x in enumerate(X.ALPHABET)}
    code = np.array([number[x] for x in text])
    np.add.at(counts, (code[:-2] * n + code[1:-1]) * n + code[2:], 1)
    return X.Channel(counts)


def test_disguised_spans_of_any_length_and_kind_are_restored(channel):
    spaced = " ".join("youareanidiotandamoronwhatapatheticclown")
    for text, plain in {
        "such a s t u p i d man": {"stupid"},
        "y o u i d i o t": {"you", "idiot"},
        f"so {spaced} here": {"idiot", "moron", "pathetic", "clown"},
        "an i d 1 o t here": {"idiot"},
        "i - d - i - o - t": {"idiot"},
        "i, d, i, o, t!": {"idiot"},
        "7 & i d i o t & 3": {"idiot"},
        "st" + "u" * 300 + "pid": {"stupid"},
        "l.0.s.e.r": {"loser"},
        "y.o.u.a.r.e.a.n.i.d.i.o.t.a.n.d.a.m.o.r.o.n": {"idiot", "moron"},
        "(1d10t)": {"idiot"},
        "\"m0r0n\",": {"moron"},
    }.items():
        assert {x.encode() for x in plain} <= X.words(text, channel), text
    assert X.words("1 2 3 4 5 6", channel) == {b"1", b"2", b"3", b"4", b"5", b"6"} and X.words("192.168.0.1 2024-11-02", channel) == {b"192", b"168", b"0", b"1", b"2024", b"11", b"02"}


def test_toxicity_on_held_out_labels(spark):
    rng = random.Random(5)
    neutral, bad = [f"{a}{b}" for a in ("tha", "onde", "lyre", "stou") for b in ("ting", "her", "ed", "or", "an")], ["vequmo", "vequta", "vequsse", "scum"]
    rows, marks = [], []
    for k in range(900):
        words = [rng.choice(neutral) for _ in range(rng.randint(5, 60))]
        toxic = k % 6 == 0
        if toxic:
            w = rng.choice(bad)
            words.insert(rng.randrange(len(words)), w if k % 4 else w.replace("s", "$").replace("e", "3"))
        rows.append((k, " ".join(words), "en", "x"))
        marks.append((k, 1, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = X.predictions(spark.createDataFrame(rows, DOCS), labels).join(labels, "doc_id").where("held_out").collect()
    assert area([r.score for r in out], [r.toxic for r in out]) > 0.98
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.97


def readings(channel, span, apart, spaces):
    """Every text that a span can stand for, with its cost, by enumeration."""
    options = []
    for at, x in enumerate(span):
        now = [(x, 0.0)] if x in channel.number and x != " " else []
        now += [(y, X.SIGN_COST) for y in X.LOOKALIKES.get(x, "")]
        if apart and x in X.SEPARATORS:
            now += [("", X.SPLIT_COST)] + ([(" ", X.SPLIT_COST)] if spaces else [])
        elif at and x == span[at - 1]:
            now.append(("", X.DROP_COST))
        options.append(now or [("", X.KEEP_COST)])
    for choice in itertools.product(*options):
        text, cost = "".join(y for y, _ in choice), sum(c for _, c in choice)
        if "  " in text or text.startswith(" "):
            continue
        code = [0, 0, *(channel.number[y] for y in text)]
        code += [0] if code[-1] else []
        yield cost + sum(channel.cost[a, b, c] for a, b, c in zip(code, code[1:], code[2:])), text


def test_viterbi_is_the_least_of_all_readings(channel):
    for span in ("1d10t", "m0r0n", "i d 1 o t", "a.s.s", "st*p1d", "$$i|l", "tr@sh!", "l-o_s e r", "uuuu", "x y z w"):
        for spaces in (False, True):
            apart = sum(x in X.SEPARATORS for x in span) * 2 >= len(span) - 1
            every = list(readings(channel, span, apart, spaces))
            got = channel._likeliest(span, apart, spaces)
            assert min(every)[0] == pytest.approx(min(c for c, t in every if t == got)), (span, spaces, got)


def test_risk_gradient_by_finite_differences(spark):
    rng = np.random.default_rng(3)
    p, u = rng.normal(0.4, 1, (40, 5)), rng.normal(-0.2, 1, (70, 5))
    w = [rng.normal(0, 1, (5, Q.HIDDEN)), rng.normal(0, 1, Q.HIDDEN), rng.normal(0, 1, (Q.HIDDEN, 1)), rng.normal(0, 1, 1)]

    def at(w, prior):
        return Q.risk(prior, Q.sums(w, p)[0] / 40, Q.sums(w, u)[0] / 70)

    for prior in (0.2, 0.95):
        (sp, dp), (su, du) = Q.sums(w, p), Q.sums(w, u)
        low = su / 70 - prior * sp / 40
        got = Q.direction(prior, sp / 40, su / 70, [d / 40 for d in dp], [d / 70 for d in du])
        for k in range(4):
            for place in [tuple(rng.integers(0, n) for n in w[k].shape) for _ in range(4)]:
                up, down = [x.copy() for x in w], [x.copy() for x in w]
                up[k][place] += 1e-5
                down[k][place] -= 1e-5
                if low >= 0:
                    want = (at(up, prior) - at(down, prior)) / 2e-5
                else:
                    part = lambda w: prior * Q.sums(w, p)[0] / 40 - Q.sums(w, u)[0] / 70  # noqa: B023, E731
                    want = (part(up) - part(down)) / 2e-5
                assert got[k][place] == pytest.approx(want, abs=1e-6)
    # the sums that Spark takes over all rows give the step that one process would take
    x = rng.normal(0, 1, (300, Q.FEATURES)).astype(np.float32)
    model = Q.fit(x[:100] + 1, x, 0.5, epochs=2)
    web = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "doc_id long, x array<float>").repartition(5)
    got, adam, pos = Q.refined(model, x[:100] + 1, web, 0.5, rounds=3), Q.Adam(model["w"], 0.005), Q.standard(model, x[:100] + 1)
    for _ in range(3):
        (sp, dp), (su, du) = Q.sums(adam.w, pos), Q.sums(adam.w, Q.standard(model, x))
        adam.step(Q.direction(0.5, sp / 100, su / 300, [d / 100 for d in dp], [d / 300 for d in du]))
    assert all(np.allclose(a, b) for a, b in zip(got["w"], adam.w))


def slow_features(text):
    """Some of the features, by loops over characters."""
    raw = (text or "").encode()
    words = raw.split()
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c > 127 for c in raw) + 1
    return {0: sum(65 <= c <= 90 for c in raw) / letters, 2: sum(48 <= c <= 57 for c in raw) / len(raw), 6: len(set(words)) / len(words), 8: max(words.count(w) for w in words) / len(words), 9: len({tuple(words[i : i + 2]) for i in range(len(words) - 1)}) / max(1, len(words) - 1), 11: sum(map(len, words)) / len(words) / 10}


def test_features_match_loops():
    for text in ("One two, three 44!\nfour four", "Été x", "A " * 500, "x"):
        got = Q.features(text)
        assert all(got[k] == pytest.approx(v, rel=1e-5) for k, v in slow_features(text).items())
    assert not Q.features(None).any() and not Q.features(" \n").any()


def test_one_id_in_very_many_rows(spark):
    docs = spark.range(20_000).selectExpr("if(id < 19800, 7, id) as doc_id", "concat('the text of ', id % 50, case when id % 4 = 0 then ' vile' else '' end) as text")
    labels = spark.range(20_000).selectExpr("id as doc_id", "int(id % 5 > 0) as quality", "int(id % 4 = 0) as toxic")
    for predict in (Q.predictions, X.predictions):
        assert predict(docs, labels, 100).count() == 20_000
