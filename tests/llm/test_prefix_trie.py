import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from skein.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, `a.b` string, part int, d1 int, POS int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def built(rows, spliced):
    """conv_id -> list of (role, text)."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    if not spliced:
        return turns
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def brute(rows, spliced=True):
    convs = built(rows, spliced)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * sum(1 for w in n[-1][1].translate({k: 32 for k in range(9, 14)}).split(" ") if w) for n in below if n)
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children[node]), sum(not children[n] for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, 9, 9) for r in rows], SCHEMA)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def sample():
    rows = []
    for c in range(-25, 130):
        if c % 20 or c % 40 == 0:
            rows += [(c, t, ["user", "assistant"][t % 2], f"turn {c % 7 if t > 1 else 0} {t}") for t in range(c % 6 + 1)]
    same = [(c, t, "user", "the same words") for c in range(1000, 1040) for t in range(3)]
    odd = [(None, 0, "user", "lost"), (300, None, None, None), (300, 1, "user", ""), (301, None, "a", "b\xa0c d\x0be"), (302, 5, "user", "x"), (302, 5, "user", "x")]
    return rows + same + odd


@pytest.mark.parametrize("spliced", [True, False])
def test_against_brute_force(spark, spliced):
    rows = sample()
    trie = P.rebuilt_trie if spliced else P.prefix_trie
    assert got(trie(frame(spark, rows[::-1]))) == brute(rows, spliced)


def test_many_turns_and_small_parts(spark, monkeypatch):
    """A conversation with most of the rows, identical rows, and ids joined by parts."""
    monkeypatch.setattr(P, "PART_ENDS", 5)
    rows = [(40, t, "user", f"w {t % 3}") for t in range(260)] + [(41, 0, "user", "again")] * 90 + [(c, t, "user", f"w {t % 3}") for c in range(60, 90) for t in range(2)]
    assert got(P.rebuilt_trie(frame(spark, rows))) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    lone = next(c for c in range(1, 2000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "user", "only")]
    assert brute(rows) == got(P.rebuilt_trie(frame(spark, rows))) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert P.rebuilt_trie(frame(spark, [])).count() == 0 == P.rebuilt_trie(frame(spark, [(None, 1, "a", "b")])).count()


def test_a_very_long_text(spark):
    rows = [(c, t, "user", "many words " * (100_000 if t else 1)) for c in (0, 1, 2) for t in range(5)]
    assert got(P.rebuilt_trie(frame(spark, rows))) == brute(rows)


def test_sql_says_the_same(spark):
    import pandas as pd

    rows = [r for r in sample() if r[0] not in (302,)]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.execute(P.SQL).fetchall()
    assert sorted((tuple(r) for r in want), key=str) == got(P.rebuilt_trie(frame(spark, rows)))
