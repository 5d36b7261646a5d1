import random
import re
import time
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from skein.llm import decontaminate as D
from skein.llm import log_templates as G

DOCS = "doc_id long, text string, kept string"


def brute_templates(rows, min_docs):
    """Dropped line numbers by row, by plain loops over tokens."""
    docs = list(dict.fromkeys((i, t) for i, t, *_ in rows if t is not None))
    lines = {}
    for d in docs:
        for no, line in enumerate(d[1].split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in re.split(r"[\t-\r ]+", line) if t)
            if tokens:
                lines[d, no] = tokens
    exact, leaf = defaultdict(set), defaultdict(set)
    for (d, _), t in lines.items():
        exact[t].add(d)
        leaf[len(t), t[: G.LEAD]].add(d)
    bad = {t for t, ds in exact.items() if len(ds) >= min_docs}
    for key, ds in leaf.items():
        forms = [t for t in exact if (len(t), t[: G.LEAD]) == key]
        if len(ds) < min_docs or len(forms) < 2:
            continue
        total, n = sum(len(exact[t]) for t in forms), key[0]
        have = [{x: sum(len(exact[u]) for u in forms if u[k] == x) for x in {t[k] for t in forms}} for k in range(n)]
        fixed = sum(any(2 * h >= total for h in at.values()) for at in have)
        groups = defaultdict(list)
        for t in forms:
            agree = sum(2 * have[k][x] >= total for k, x in enumerate(t))
            if fixed >= 0.7 * n and agree + n - fixed >= 0.8 * n:
                groups["majority"].append(t)
            often = tuple(x if have[k][x] >= min_docs else None for k, x in enumerate(t))
            if sum(x is not None for x in often) >= 0.7 * n:
                groups[often].append(t)
        for members in groups.values():
            if len(set().union(*(exact[t] for t in members))) >= min_docs:
                bad |= set(members)
    return {d: {no for (x, no), t in lines.items() if x == d and t in bad} for d in docs}


ROWS = (
    [(k, f"unique line number {'abcdefgh'[k % 8]}{k} here\nUser {k} logged in from host{k} at noon today\nshared footer line", "x") for k in range(9)]
    + [(100 + k, f"the quick brown fox jumps over the lazy {w} again\n\n  spaced\tout   words  ", None) for k, w in enumerate(["dog", "cat", "cow", "dog", "hen", "dog"])]
    + [(200, None, "x"), (201, "", "x"), (None, "shared footer line", "x"), (3, "other text\nshared footer line", "x"), (3, "other text\nshared footer line", "x"), (300, "word " * 50_000, "x")]
)


# three templates and prose in one leaf, and one with word-valued fields
NAMES = ["ros", "vel", "tam", "kin", "lor", "mub", "sed", "pax"]
ROWS += [(400 + 10 * m + k, f"click here to {verb} the {w} page now", "x") for m, verb in enumerate(["open", "close", "share"]) for k, w in enumerate(NAMES)]
ROWS += [(500 + k, f"click here to {w} {NAMES[k - 3]} some {NAMES[k - 2]} text", "x") for k, w in enumerate(NAMES)]
ROWS += [(600 + k, f"Read more about {w}\nUser {w} sent {NAMES[k - 1]} a file", "x") for k, w in enumerate(NAMES)]


def test_several_templates_of_a_leaf(spark):
    got = {r.doc_id: r.kept_ for r in G.drop_recurring_lines(spark.createDataFrame(ROWS, DOCS)).collect()}
    assert all(got[400 + 10 * m + k] == "" for m in range(3) for k in range(8)) and all(got[500 + k] for k in range(8))
    assert all("Read more" not in got[600 + k] for k in range(8))


def test_texts_of_very_many_lines(spark):
    text = "\n".join(f"line {'x' * (k % 7)} of many kinds {k % 2 and 'a' or 'b'} w{'abcdefghij'[k // 30000]}" for k in range(200_000))
    docs = spark.createDataFrame([(k, text if k < 6 else text + "\nits own last line " + "q" * k, "x") for k in range(7)], DOCS)
    began = time.monotonic()
    got = {r.doc_id: (r.kept_, r.n_dropped) for r in G.drop_recurring_lines(docs).collect()}
    assert got[0] == ("", 200_000) and got[6] == ("its own last line " + "q" * 6, 200_000) and time.monotonic() - began < 90


@pytest.mark.parametrize(("min_docs", "broadcast"), [(2, 500_000), (5, 500_000), (5, 0)])
def test_templates_match_brute_force(spark, monkeypatch, min_docs, broadcast):
    monkeypatch.setattr(G, "BROADCAST_ROWS", broadcast)
    docs = spark.createDataFrame(ROWS, DOCS)
    want = brute_templates(ROWS, min_docs)
    out = G.drop_recurring_lines(docs, min_docs)
    assert out.columns == [*docs.columns, "kept_", "n_lines", "n_dropped"]
    got = out.collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.text is None:
            assert (r.kept_, r.n_lines, r.n_dropped) == (None, 0, 0)
            continue
        gone = want[r.doc_id, r.text]
        lines = r.text.split("\n")
        assert r.n_dropped == len(gone) and r.n_lines == len(lines)
        assert r.kept_ == "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert any(want.values()) and G.drop_recurring_lines(docs.where("false")).count() == 0


def broadcast_rows(node):
    """Rows of each broadcast in a plan that has run."""
    inner = [getattr(node, f)() for kind, f in (("AdaptiveSparkPlanExec", "executedPlan"), ("QueryStageExec", "plan")) if kind in node.getClass().getName()]
    own = [node.metrics().apply("numOutputRows").value()] if "BroadcastExchangeExec" in node.getClass().getName() else []
    return sum((broadcast_rows(x) for x in [*inner, *(node.children().apply(k) for k in range(node.children().size()))]), own)


def test_many_recurring_lines_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST_ROWS", 100)
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcdefghijklmn"]
    out = G.drop_recurring_lines(spark.createDataFrame([(k, "\n".join(f"see {w} there" for w in words), "x") for k in range(5)], DOCS))
    assert [r.n_dropped for r in out.collect()] == [2000] * 5
    rows = broadcast_rows(out._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 1000, rows


def test_templates_match_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = {tuple(r) for r in G.digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert got == set(con.execute(G.SQL).fetchall())


def slow_align(item, window):
    """Best (score, matches) of a local alignment by the plain recurrence."""
    h = [[(0, 0)] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            s, m = h[i - 1][j - 1]
            ways = [(s + 2, m + 1) if a == b else (s - 1, m), (h[i - 1][j][0] - 1, h[i - 1][j][1]), (h[i][j - 1][0] - 1, h[i][j - 1][1])]
            best = max(ways)
            h[i][j] = best if best[0] >= 0 else (0, 0)
    return max(max(row) for row in h)[1]


def test_alignment_matches_plain_recurrence():
    rng = np.random.default_rng(4)
    items = rng.integers(1, 6, (30, 12)).astype(np.int32)
    windows = rng.integers(1, 6, (30, 20)).astype(np.int32)
    matches, _ = D.align(items, windows)
    assert matches.tolist() == [slow_align(a.tolist(), b.tolist()) for a, b in zip(items, windows)]


def edited(words, rng, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else ["edit" + str(rng.random())[2:6]] if x < share * 2 / 3 else [w, "extra"] if x < share else [w]
    return out


def test_edited_copies_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)] + ["the", "of"] * 60
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(rng.randint(14, 60)))) for k in range(30)] + [(90, "too short"), (91, None), (92, "")]
    rows, leaks = [], set()
    for k in range(120):
        body = text(rng.randint(20, 300))
        if k % 3 == 0:
            item = items[k % 30]
            at = rng.randrange(len(body))
            copy = edited(item[1].split(), rng, 0.1 if k % 2 else 0.0)
            body[at:at] = [w.upper() + "," if k % 4 == 0 else w for w in copy]
            leaks.add((k, item[0]))
        rows.append((k, " ".join(body), "x"))
    # a leak that is common among documents is still found
    rows += [(500 + k, "intro " + items[1][1] + " outro", "x") for k in range(80)]
    leaks |= {(500 + k, 1) for k in range(80)}
    rows += [(1000, None, None), (1001, "", None), (None, items[2][1], "x"), (1002, "filler " * 40_000 + items[3][1], "x")]
    leaks |= {(None, 2), (1002, 3)}
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    for item_bytes in (D.ITEM_BYTES, 2000):
        found = {(r.doc_id, r.item_id): r for r in D.leaks(docs, bench, item_bytes=item_bytes).collect()}
        missed = leaks - set(found)
        assert set(found) <= leaks and len(missed) <= 3 and all(d is not None and d < 120 for d, _ in missed)
        exact = found[1002, 3]
        assert exact.similarity == 1.0 and exact.last_word - exact.first_word + 1 == len(items[3][1].split()) and exact.first_word == 40_000
        clean = D.decontaminated(docs, bench, item_bytes=item_bytes)
        assert clean.columns == docs.columns
        assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, *_ in rows if i is not None and i not in {d for d, _ in found})
    assert D.leaks(docs.where("false"), bench).count() == 0 and D.leaks(docs, bench.where("false")).count() == 0
    assert D.decontaminated(docs, bench.where("false")).count() == len(rows)


def test_thousands_of_copies_of_one_edited_item_are_found(spark):
    item = [f"w{k}" for k in range(57)]
    copy = ["edit" if k % 5 == 2 and k < 55 else w for k, w in enumerate(item)]  # 11 edits
    rows = [(k, f"start{k} " + " ".join(copy) + " end", "x") for k in range(3000)] + [(5000 + k, f"clean text {k}", "x") for k in range(50)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = D.leaks(docs, bench).collect()
    assert {r.doc_id for r in found} == set(range(3000)) and {round(r.similarity, 6) for r in found} == {round(46 / 57, 6)}
    assert sorted(r.doc_id for r in D.decontaminated(docs, bench).collect()) == list(range(5000, 5050))


def test_copies_of_repetitive_items_are_found_however_rows_are_batched():
    items = [" ".join(f"the ball is c{k}" for k in range(10)), "the ball is red " * 10, "yes or no " * 12, " ".join(f"v{k}" for k in range(400))]
    index = D.Items(list(range(len(items))), items)
    texts = [f"{'other words ' * n} {lead * m} {item} and more" for item in items[:3] for n in (0, 30) for lead in ("", "the ball is ") for m in (1, 40)]
    docs = [index.numbers(t) for t in texts]
    found = {(d, item): share for d, item, share, *_ in D.scored(index, docs)}
    assert all(found.get((d, d // 8)) == 1.0 for d in range(len(docs)))
    alone = [(d, *x[1:]) for d, ids in enumerate(docs) for x in D.scored(index, [ids])]
    assert alone == D.scored(index, docs) == D.scored(index, [*docs, index.numbers(items[3])])[: len(alone)]


def test_windows_are_left_out_only_where_too_few_words_match():
    rng = random.Random(3)
    items = [[f"w{rng.randrange(12)}" for _ in range(rng.randint(10, 30))] for _ in range(20)]
    every = D.Items(list(range(20)), [" ".join(x) for x in items], similarity=0.0)
    bound = D.Items(list(range(20)), [" ".join(x) for x in items])
    docs = [bound.numbers(" ".join([f"w{rng.randrange(30)}" for _ in range(40)] + edited(x, rng, 0.2) + [f"w{rng.randrange(30)}" for _ in range(40)])) for x in items * 5]
    want = [x for x in D.scored(every, docs) if x[2] >= 0.8]
    assert len(want) > 50 and D.scored(bound, docs) == want
    assert sum(len(bound.candidates(d)) for d in docs) < sum(len(every.candidates(d)) for d in docs)


def all_pairs(docs, items, similarity=0.8):
    """Pairs whose alignment over the whole document matches enough of the item's words, and their shares."""
    index = D.Items([i for i, _ in items], [t for _, t in items])
    out = {}
    for d, text in docs:
        ids = index.numbers(text)
        for item_id, words in zip(index.ids, index.words):
            if len(ids):
                share = int(D.align(words[None, :], ids[None, :])[0][0]) / len(words)
                if share >= similarity:
                    out[d, item_id] = share
    return out


def test_recall_against_alignment_of_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(150)] + ["the", "of", "and"] * 40
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(rng.randint(12, 60)))) for k in range(40)]
    docs = []
    for k in range(400):
        body = text(rng.randint(10, 120))
        body[5:5] = edited(items[k % 40][1].split(), rng, rng.choice([0.0, 0.05, 0.1, 0.2, 0.3]))
        docs.append((k, " ".join(body), "x"))
    want = all_pairs([(d, t) for d, t, _ in docs], items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.leaks(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert set(got) <= set(want) and len(want) > 250
    recall = len(got) / len(want)
    print(f"recall {recall:.3f} of {len(want)} pairs")
    assert recall >= 0.97


def test_what_is_found_does_not_depend_on_what_is_rare(monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(20)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40))) for _ in range(60)]
    index = D.Items(list(range(60)), items)
    docs = [index.numbers(" ".join([*rng.choices(vocabulary, k=50), *edited(items[k % 60].split(), rng, 0.15), *rng.choices(vocabulary, k=50)])) for k in range(120)]
    found = []
    for rare in (0, 1, 4, 10**9):
        monkeypatch.setattr(D, "RARE", rare)
        found.append(D.scored(index, docs))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) >= 80


def test_a_very_long_item_is_aligned_in_bounded_memory():
    rng = random.Random(13)
    item = [f"v{rng.randrange(3000)}" for _ in range(5000)]
    index = D.Items([1, 2], [" ".join(item), "some short words"])
    docs = [index.numbers(" ".join(["x"] * 100 + edited(item, rng, 0.05))), index.numbers("nothing " * 9000)]
    found = D.scored(index, docs)
    assert [(d, i) for d, i, *_ in found] == [(0, 0)] and found[0][2] > 0.9
    sizes = [(0, 0, 0, w) for w in sorted([10] * 700 + [D.CELLS // 3] * 4 + [D.CELLS * 2])]
    parts = list(D.batches_of(sizes))
    assert [x for p in parts for x in p] == sizes and all(len(p) == 1 or len(p) <= 256 and len(p) * max(x[3] for x in p) <= D.CELLS for p in parts)
