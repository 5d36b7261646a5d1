from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.operators import audit, enrich, joins, metrics, pages, pairs, queues, reports, search, upserts, windows


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()), key=str)


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    new = spark.createDataFrame([("b", 3, "x"), ("c", 4, "y")], "path string, n int, note string")
    assert rows(upserts.upsert(old, new, "path"), "path", "n", "note") == [("a", 1, None), ("b", 3, "x"), ("c", 4, "y")]
    assert rows(upserts.replace_by_key(old, spark.createDataFrame([("a", 7), ("a", 8)], "path string, n int"), "path"), "path", "n") == [("a", 7), ("a", 8), ("b", 2)]
    first = upserts.first_wins(old, spark.createDataFrame([("b", 9), ("z", 2), ("z", 1)], "path string, n int"), "path", "n")
    assert rows(first, "path", "n") == [("a", 1), ("b", 2), ("z", 1)]
    queue = spark.createDataFrame([(1, ["a"]), (2, None), (3, ["low"])], "id int, reasons array<string>")
    assert rows(upserts.add_reason(queue, "low"), "id", "reasons") == [(1, ["a", "low"]), (2, ["low"]), (3, ["low"])]
    pair = spark.createDataFrame([("b", "a", "r", 0.5), ("a", "b", "r", 0.7), ("a", "a", "r", 1.0)], "path_a string, path_b string, reason string, score double")
    assert rows(upserts.largest_score(pair, pair.limit(0)), "path_a", "path_b", "score") == [("a", "b", 0.7)]
    assert rows(upserts.boost(spark.createDataFrame([("a", 0.95), ("b", 0.2)], "path string, confidence double"), old.where("path = 'a'"), "path", 0.15), "confidence") == [0.2, 1.0]
    log = upserts.change_log(old, spark.createDataFrame([("a", 1), ("b", 5), ("c", 1)], "path string, n int"), "path", "t")
    assert rows(log, "path", "payload_json") == [("b", '{"path":"b","n":5}'), ("c", '{"path":"c","n":1}')]


def test_budgets_and_retention(spark):
    blobs = spark.createDataFrame([(f"item-{k}", 400_000, k) for k in (1, 2, 3)], "item string, size long, age int")
    assert rows(windows.within_budget(blobs, "size", 1 << 20, F.asc("age")), "item") == ["item-1", "item-2"]
    backups = spark.createDataFrame([(str(k), datetime(2024, 1, k), 10 * k) for k in (1, 2, 3, 4)], "backup_id string, created timestamp, size long")
    kept = windows.retention(backups, 2, 0, 0)
    gone = enrich.kept_and_removed(backups, kept, "backup_id")
    assert rows(gone, "backup_id") == ["1", "2"] and rows(windows.retention(backups, 1, 2, 1), "backup_id", "reasons") == [("3", "daily"), ("4", "last,daily,weekly")]
    assert rows(windows.over_cap(backups, "size", 75, F.asc("created")), "backup_id") == ["1", "2"]
    songs = spark.createDataFrame([(1, 50), (2, 50), (3, 50)], "id int, minutes int")
    assert rows(windows.fill_budget(songs, "minutes", 10, F.asc("id")), "id") == [1]
    events = spark.createDataFrame([(k % 3, k, str(k)) for k in range(60)], "key int, seq int, payload string")
    assert rows(windows.coalesce_events(events, "key", "seq"), "key", "seq", "at") == [(0, 57, 0), (1, 58, 1), (2, 59, 2)]
    assert windows.coalesce_events(events.limit(10), "key", "seq").count() == 10
    keys = spark.range(2000).select(windows.weighted_order(1, F.col("id"), F.lit(0.5)).alias("u"))
    assert 0.28 < keys.agg(F.avg("u")).first()[0] < 0.39


def test_changes_and_staleness(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 1)], "path string, size int")
    old = spark.createDataFrame([("a", 1, False), ("b", 9, False), ("d", 1, True), ("e", 1, False), ("f", 1, True)], "path string, size int, deleted boolean")
    got = rows(joins.changes(now, old, "path", ["size"]), "path", "status")
    assert got == [("a", "unchanged"), ("b", "modified"), ("c", "new"), ("d", "resurrected"), ("e", "vanished"), ("f", "deleted")]
    source = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "path string, indexed int")
    derived = spark.createDataFrame([("a", 5), ("b", 4)], "path string, updated int")
    assert rows(joins.stale(source, derived, "path", "indexed", "updated"), "path") == ["b", "c"]


def test_reports(spark):
    inv = spark.createDataFrame([("a/x.mkv", "MKV", " Video", 10), ("a/y.mkv", "mkv", "video", None), ("z", None, None, 5), ("b/w", "", " ", 0)], "path string, ext string, category string, size_bytes long")
    assert rows(reports.categories(inv), "category", "files", "bytes") == [("other", 2, 5), ("video", 2, 10)]
    assert reports.categories(inv, raw_grouping=True).count() == 4
    assert rows(reports.overview(inv.where("false")), "total_files", "total_bytes", "mean_bytes") == [(0, 0, 0)]
    assert rows(reports.top_extensions(inv, 1), "ext", "rank_count", "rank_size")[0][0] in (None, ".mkv")
    snap = spark.createDataFrame([(1, 1, 9, *range(7)), (2, 2, 8, *range(7, 0, -1))], "id int, scan_ts_utc int, total_files int, " + ", ".join(f"by_{c} int" for c in reports.CATEGORIES))
    merged = {r.category: (r.files, r.bytes) for r in reports.categories_with_snapshot(inv, snap).collect()}
    assert merged["video"] == (7, 10) and merged["other"] == (1, 5) and merged["image"] == (5, 0)
    assert rows(reports.categories_with_snapshot(inv, snap.where("false")), "category", "files") == [("other", 2), ("video", 2)]
    assert rows(reports.heaviest_folders(inv, 1, 5), "folder", "bytes") == [("a", 10), ("b", 0)]


def test_pages(spark):
    assert pages.pagination(None, None) == pages.Pagination(100, 0) and pages.pagination(9999, -3) == pages.Pagination(500, 0)
    assert pages.next_offset(100, pages.Pagination(100, 0)) == 100 and pages.next_offset(40, pages.Pagination(100, 0)) is None and pages.next_offset(100, pages.Pagination(100, 0), 100) is None
    assert pages.guarded_total(spark.range(30), 20).first().total is None and pages.guarded_total(spark.range(20), 20).first().total == 20
    for bad in ("DELETE FROM t", "SELECT 1; SELECT 2"):
        with pytest.raises(ValueError):
            pages.read_only_sql(spark, bad)
    inv = spark.createDataFrame([("a/Été.mkv", None, 1), ("b.txt", "", 2)], "path string, name string, mtime int")
    assert rows(pages.with_name(inv), "name") == ["b.txt", "été.mkv"] and pages.quick_search(pages.with_name(inv), "ab").count() == 0
    assert rows(pages.quick_search(pages.with_name(inv), "ÉTÉ"), "path") == ["a/Été.mkv"]


def test_pairs_and_search(spark):
    prints = spark.createDataFrame([("a", 0), ("b", 7), ("c", 255), ("d", -1)], "k string, h long")
    assert rows(pairs.banded(prints, "k", "h", 5), "key_a", "key_b", "distance") == [("a", "b", 3), ("b", "c", 5)]
    both = pairs.consensus(*(spark.createDataFrame([("a", "b", s)], "key_a string, key_b string, score double") for s in (0.9, 1.0)))
    assert {r.reason: round(r.score, 6) for r in both.collect()} == {"video": 0.9, "audio": 1.0, "consensus": 0.93}
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue cat"), (4, None)], "id int, t string")
    assert rows(search.bm25(docs, "id", "t", ["red"]), "id") == [1, 2] and search.bm25(docs, "id", "t", ["red", "cat"]).count() == 0
    assert docs.where("id = 2").select(search.snippet(F.col("t"), ["dog"]).alias("s")).first().s == "red red <b>dog</b>"


def test_queues_and_audit(spark):
    jobs = spark.createDataFrame([(1, "r", "running", 0, 1, 0), (2, "r", "queued", 5, 2, 0), (3, "r", "queued", 1, 9, 0), (4, "s", "queued", 0, 0, 0)], "job_id int, resource string, status string, priority int, created int, attempts int")
    slots = spark.createDataFrame([("r", 2), ("s", 0)], "resource string, slots int")
    assert rows(queues.dispatch(jobs, slots), "job_id") == [3]
    assert queues.should_train(50, 40, 20, 10) and not queues.should_train(50, 45, 20, 10)
    base, now = (spark.createDataFrame([x], "movies int, shows int") for x in ((5, 9), (8, 2)))
    assert rows(audit.compare_counters(base, now, ["movies", "shows"]), "counter", "added", "removed") == [("movies", 3, 0), ("shows", 0, 7)]
    a, b = (spark.createDataFrame(x, "name string, digest string") for x in ([("m", "1"), ("n", "2")], [("m", "1"), ("n", "3"), ("o", "4")]))
    assert rows(audit.changed_digests(a, b), "name") == ["n", "o"]
    p = spark.createDataFrame([(0.05, 0), (1.0, 1), (0.95, 1)], "p double, y int")
    bins = {r.bin: (r.n, r.accuracy) for r in metrics.reliability(p, "p", "y").collect()}
    assert len(bins) == 10 and bins[9] == (2, 1.0) and bins[0] == (1, 0.0) and bins[5] == (0, 0.0)


def test_enrichment(spark):
    files = spark.createDataFrame([("The Matrix (1999)", "m.mkv", "video", 9), ("The Matrix (1999)", "m.nfo", "other", 1), ("Mixed", "a.mkv", "video", 1), ("Mixed", "b.mkv", "video", 2)], "folder string, name string, kind string, size_bytes long")
    got = {r.folder: r for r in enrich.folder_profiles(files).collect()}
    matrix, mixed = got["The Matrix (1999)"], got["Mixed"]
    assert (matrix.kind, matrix.title, matrix.year, matrix.canonical, matrix.issues, round(matrix.confidence, 6)) == ("movie", "The Matrix", 1999, True, [], 0.6)
    assert (mixed.kind, mixed.canonical, mixed.main_video, mixed.confidence) == ("other", False, "b.mkv", 0.0) and mixed.issues[0] == "multiple_primary_videos:2"
    scenes = F.expr("array(named_struct('start', 0d, 'end', 2d), named_struct('start', 2d, 'end', 2.004d), named_struct('start', 9d, 'end', 11d))")
    out = spark.range(1).select(enrich.frame_times(scenes, F.lit(12.0), 2).alias("a"), enrich.frame_times(F.slice(scenes, 1, 0), F.lit(12.0), 3).alias("b")).first()
    assert out.a == [1.0, 2.0] and out.b == [3.0, 6.0, 9.0]
    v = enrich.hashed_words(spark.createDataFrame([(1, "a a b"), (2, "")], "k int, t string"), "k", "t", 16).collect()
    assert len(v) == 1 and abs(sum(x * x for x in v[0].vector) - 1) < 1e-9


def test_positional_pairs_at_the_defaults_are_all_found(spark):
    apart = [0 if k in (3, 10, 12, 20, 28, 36, 44, 52, 60) else 1 for k in range(64)]
    prints = spark.createDataFrame([(1, [1] * 64), (2, apart), (3, [0] * 64), (4, [5, 6, 7]), (5, [5, 6, 7])], "id long, codes array<int>")
    assert {(r.key_a, r.key_b) for r in pairs.positional(prints, "id", "codes").collect()} == {(1, 2), (4, 5)}


def test_wide_thresholds_against_all_pairs(spark):
    import random

    draw = random.Random(5)
    seeds = [draw.getrandbits(64) for _ in range(20)]
    words = [s ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(0, 22))) for s in seeds for _ in range(15)]
    words += [words[0]] * 40 + [0, 2**64 - 1]
    signed = [w - 2**64 if w >= 2**63 else w for w in words]
    prints = spark.createDataFrame([(f"k{k:04}", w) for k, w in enumerate(signed)] + [("none", None), (None, 7)], "k string, h long")
    first, copies = pairs.classes(prints, "k", "h")
    key = {}
    for k, w in enumerate(words):
        key.setdefault(w, f"k{k:04}")
    assert rows(copies, "key_a", "key_b") == sorted((key[w], f"k{k:04}") for k, w in enumerate(words) if key[w] != f"k{k:04}")
    want = sorted((min(key[x], key[y]), max(key[x], key[y]), (x ^ y).bit_count()) for x in key for y in key if x < y and (x ^ y).bit_count() <= 16)
    for block_rows in (100_000, 30):
        assert rows(pairs.within_bits(first, "key", "h", 16, block_rows), "key_a", "key_b", "distance") == want
    assert pairs.within_bits(first.limit(0), "key", "h", 16).count() == 0
    again = pairs.still_within(spark.createDataFrame([("k0000", "k0001")], "key_a string, key_b string"), first, "key", "h", 64)
    assert again.first().distance == (words[0] ^ words[1]).bit_count()


def test_frame_times_round_as_doubles_do(spark):
    none = F.expr("array(named_struct('start', 0d, 'end', 0d))")
    got = spark.createDataFrame([(1, 2.18), (2, 4.06), (3, 2.30), (4, 4.90)], "id int, seconds double")
    times = got.select("id", enrich.frame_times(F.slice(none, 1, 0), F.col("seconds"), 3).alias("t"))
    assert {r.id: r.t[0] for r in times.collect()} == {1: 0.55, 2: 1.01, 3: 0.57, 4: 1.23}
