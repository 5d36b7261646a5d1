from collections import Counter

import numpy as np
import pytest

from skein.llm import external_shuffle as E
from skein.llm import mixing_tree as M

DOCS = "doc_id long, text string, source string, shard int, place string"


def rows(n=700):
    out = [(k, "word " * (k % 37) + str(k), ["hot", "b", "c", None][0 if k % 3 == 0 else k % 4], k, "p") for k in range(n)]
    return out + [(3, None, "b", 1, None), (3, None, "b", 1, None), (None, "", None, None, "q"), (None, "x y z", "d", None, "q")]


def test_fisher_yates_is_a_uniform_permutation():
    seen = Counter(tuple(E.fisher_yates(3, (1, s)).tolist()) for s in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850
    assert E.fisher_yates(0, (1, 1)).tolist() == [] and sorted(E.fisher_yates(50, (1, 1)).tolist()) == list(range(50))


def test_shards_are_even_gapless_and_repeatable(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    out = E.shard(docs, 5, bucket_bytes=900)
    assert out.columns == [*docs.columns, "shard_", "slot"]
    got = out.collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows())
    sizes = Counter(r.shard_ for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(5))
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard_ == s) == list(range(sizes[s]))
    again = E.shard(spark.createDataFrame(rows()[::-1], DOCS), 5, bucket_bytes=900).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    ids = [r.doc_id for r in sorted(got, key=lambda r: (r.shard_, r.slot)) if r.doc_id is not None]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.15
    assert E.shard(docs.where("false"), 5).count() == 0
    assert {r.shard_ for r in E.shard(docs.limit(3), 5).collect()} == {0, 1, 2}


def test_written_shards_come_back(spark, tmp_path):
    docs = spark.createDataFrame(rows(90), DOCS).drop("shard")
    E.write_shards(docs, f"file://{tmp_path}/out", 4)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 94


def brute_targets(sizes):
    weights, left, out = [(5, 2, 1)[k % 3] for k in range(len(sizes))], 1.5 * sum(sizes), [None] * len(sizes)
    while True:
        free = [k for k, x in enumerate(out) if x is None]
        rest = left - sum(x for x in out if x is not None)
        over = [k for k in free if rest * weights[k] / sum(weights[j] for j in free) > 2 * sizes[k]]
        if not over:
            return [rest * weights[k] / sum(weights[j] for j in free) if x is None else x for k, x in enumerate(out)]
        for k in over:
            out[k] = 2.0 * sizes[k]


@pytest.mark.parametrize("sizes", [[0], [5], [0, 0, 10], [100, 3, 900, 40, 7], [1, 1000, 1000, 1, 1000]])
def test_targets(spark, sizes):
    sources = spark.createDataFrame([(f"={k}" if k < len(sizes) - 1 else "", n) for k, n in enumerate(sizes)], "key string, source_size long")
    got = {r.key: r.target for r in M.targeted(sources).collect()}
    want = brute_targets(sizes)
    assert np.allclose([got[f"={k}" if k < len(sizes) - 1 else ""] for k in range(len(sizes))], want)


def test_tree(monkeypatch):
    quotas = np.array([0, 7, 1000, 33, 250])
    for outputs in (1, 2, 7, 24):
        leaves = M.split(quotas, outputs, 3)
        assert (leaves.sum(1) == quotas).all() and (leaves >= 0).all()
        assert np.ptp(leaves.sum(0)) <= 1 + int(np.ceil(np.log2(outputs)))
        again = M.split(quotas, outputs, 4, leaves.sum(0))
        assert (again.sum(0) == leaves.sum(0)).all() and (again.sum(1) == quotas).all()
    # beyond numpy's range the draws have the same mean and spread
    have = np.array([300, 500, 1200])
    exact = np.array([M.drawn(have, 700, np.random.default_rng(k)) for k in range(4000)])
    monkeypatch.setattr(M, "EXACT_BLOCKS", 10)
    limit = np.array([M.drawn(have, 700, np.random.default_rng(k)) for k in range(4000)])
    assert (limit.sum(1) == 700).all() and (limit <= have).all()
    assert np.allclose(exact.mean(0), limit.mean(0), atol=1) and np.allclose(exact.std(0), limit.std(0), rtol=0.06)


def test_chunks_of_sources_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK_SOURCES", 4)
    blocks = {f"={k}": k % 9 for k in range(30)}
    rows = M.stretches(spark.createDataFrame(list(blocks.items()), "key string, blocks long"), 5, 1).collect()
    assert {r.key: r.ends[-1] for r in rows} == blocks
    shares = np.diff([[0, *r.ends] for r in rows], axis=1)
    assert (shares >= 0).all() and np.ptp(shares.sum(0)) <= 4


def test_draws_are_blocks_of_the_tree(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), DOCS)
    out = M.taken(docs, outputs=6, block_words=64).collect()
    per_source = {}
    for r in out:
        for d in r.draws:
            per_source.setdefault(r.source_size, {}).setdefault(d.block, set()).add(d.shard)
    for blocks in per_source.values():
        # every taken block is on one shard, and shards have consecutive stretches of the permutation
        assert all(len(s) == 1 for s in blocks.values()) and sorted(blocks) == list(range(len(blocks)))
        dealt = [next(iter(blocks[k])) for k in range(len(blocks))]
        assert dealt == sorted(dealt)
    assert len({s for blocks in per_source.values() for x in blocks.values() for s in x}) == 6
    monkeypatch.setattr(M, "split", lambda quotas, outputs, seed, totals=None: np.c_[quotas, np.zeros((len(quotas), outputs - 1), np.int64)])
    other = M.taken(docs, outputs=6, block_words=64).collect()
    assert {d.shard for r in other for d in r.draws} == {0} and sorted(map(str, other)) != sorted(map(str, out))
    assert sorted((str(r.doc_id), r.taken) for r in other) == sorted((str(r.doc_id), r.taken) for r in out)


def test_one_row_repeated(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 0, None)], DOCS).crossJoin(spark.range(5000)).drop("id").union(spark.createDataFrame(rows(50), DOCS))
    out = M.taken(docs, outputs=3, block_words=256).where("doc_id = 1 and size = 3").collect()
    assert len(out) == 5000 and sum(r.taken for r in out) <= 30_000 and {r.taken for r in out} <= set(range(7)) and len({(d.shard, d.block) for r in out for d in r.draws}) > 20
    got = E.shard(docs, 4, bucket_bytes=2000).collect()
    assert sorted((r.shard_, r.slot) for r in got)[-1][0] == 3 and max(Counter(r.shard_ for r in got).values()) - min(Counter(r.shard_ for r in got).values()) <= 1
    assert len({(r.shard_, r.slot) for r in got}) == len(got) == docs.count()


def test_taken_words_meet_targets(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    out = M.taken(docs, outputs=6, block_words=64)
    got = out.collect()
    assert sorted(map(str, got)) == sorted(map(str, M.taken(docs, outputs=6, block_words=64).collect()))
    words = Counter()
    for _, text, source, *_ in rows():
        words[source] += len((text or "").split())
    order = sorted(words, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([words[s] for s in order])))
    assert len(got) == len(rows()) and all(r.taken <= 2 * r["size"] for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert target == {words[s]: t for s, t in want.items()}
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    draws = [(d.shard, d.words) for r in got for d in r.draws if d.words]
    by = Counter()
    for s, w in draws:
        by[s] += w
    assert set(by) <= set(range(6)) and sum(by.values()) == sum(taken.values())


def test_mixed_rows(spark):
    docs = spark.createDataFrame(rows(), DOCS).withColumnRenamed("place", "_p")
    out = M.mix(docs, outputs=6, block_words=64)
    got = out.collect()
    assert out.columns == [*docs.columns, "shard_", "slot"]
    taken = sum(r.taken for r in M.taken(docs, outputs=6, block_words=64).collect())
    assert sum(len(r.text.split()) for r in got) == taken
    assert max(Counter(r.doc_id for r in got if r.doc_id is not None).values()) == 2
    for s in {r.shard_ for r in got}:
        slots = sorted(r.slot for r in got if r.shard_ == s)
        assert slots == list(range(len(slots)))
    assert M.mix(docs.where("false")).count() == 0 and M.taken(docs.where("text is null")).agg({"taken": "sum"}).first()[0] == 0
