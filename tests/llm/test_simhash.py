import numpy as np
import pyarrow.parquet as pq
import xxhash

from skein.llm import simhash_golay as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(ids, texts):
    """Fingerprints and components by the plain definitions."""
    fps = []
    for t in texts:
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
    root = {}
    seen = set()
    for i in range(len(ids)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            x = todo.pop()
            for y in range(len(ids)):
                if y not in group and bin(fps[x] ^ fps[y]).count("1") <= 3:
                    group.add(y)
                    todo.append(y)
        seen |= group
        for x in group:
            root[x] = min(ids[y] for y in group)
    return sorted((ids[i], f"{fps[i]:016x}", root[i]) for i in range(len(ids)))


def test_matches_brute_force(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet")
    got = S.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == brute(t["doc_id"].to_pylist(), t["text"].to_pylist())


def test_links_on_dense_clusters(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(60):
            v = b
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                v ^= 1 << int(bit)
            fps.add(v)
    fps = np.array(sorted(fps), np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    for _ in range(len(fps)):
        low = np.where(near, label[None, :], len(fps)).min(1)
        if (low == label).all():
            break
        label = low
    for block_rows in (20_000, 60, 7):
        nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
        roots = {r.node: r.root for r in S.connected_components(S.links(nodes, block_rows)).collect()}
        groups = {}
        for k, x in enumerate(fps.view(np.int64).tolist()):
            groups.setdefault(roots.get(x, x), set()).add(k)
        want = {}
        for k, x in enumerate(label.tolist()):
            want.setdefault(x, set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_golay_keys_meet_within_one_bit():
    low, high, errors = S.golay_tables()
    assert (errors[:, 0] >= 0).all()
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 4000)
    for u in [v] + [v ^ (1 << i) for i in range(23)]:
        p, q = errors[low[v & 0xFFF] ^ high[v >> 12]], errors[low[u & 0xFFF] ^ high[u >> 12]]
        own = (u ^ q[:, 0]) >> 11
        assert (((v[:, None] ^ p) >> 11 == own[:, None]) & (p >= 0)).any(1).all()


def test_edge_rows(spark):
    rows = [(3, None, "en", None, None), (7, "", None, "s", 0), (9, " \t\n", "en", "s", 3), (4, "One two", "en", "s", 7), (5, "one TWO", "en", "s", 7), (None, "one two", None, None, None), (4, "One two", "en", "s", 7)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as fp", "2 as component_id")
    got = {(r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {(3, 3), (7, 3), (9, 3), (4, 4), (5, 4), (None, 4)}
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [(True, 3), (True, 4)]
    assert S.near_duplicates(docs.where("false")).count() == 0
    assert S.keep_one(docs.where("false")).count() == 0


def test_crowded_keys_and_hot_copies(spark, monkeypatch):
    # one key at ten times the block size, whose finer keys are small
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**48, 500, dtype=np.uint64) << np.uint64(16))
    fps = np.unique(np.r_[fps, fps[::5] ^ np.uint64(1 << 60), fps[::7] ^ np.uint64(7 << 20)])
    keys = {int(k) for k in S.finer(np.zeros(len(fps), np.int64), fps).ravel()}
    assert len(keys) > 1000
    near = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in S.connected_components(S.links(nodes, 50)).collect()}
    signed = fps.view(np.int64).tolist()
    assert all(roots[signed[i]] == roots[signed[j]] for i, j in near) and len(roots) == len({x for p in near for x in p})
    # one text and id in very many rows
    monkeypatch.setattr(S, "HOT_COPIES", 100)
    docs = spark.range(4000).selectExpr("if(id < 2000, 7, id) as doc_id", "if(id < 3000, 'one two three four', concat('text ', id, ' of its own ', id * 7)) as text", "'x' as fp")
    got = S.near_duplicates(docs).collect()
    assert len(got) == 4000 and {r.component_id for r in got if r.doc_id < 3000} == {7}
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.where("text like 'one%'").collect()] == [7]


def test_very_long_text():
    words = [f"w{k % 977}" for k in range(200_000)]
    text = " ".join(words).encode()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], "<u8")
    want = sum(1 << b for b in range(64) if int((hashes >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(hashes))
    assert S.simhash(text) == want
