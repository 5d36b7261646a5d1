"""Streams with state: metrics by label, change log, queue, replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skein.streaming import changes, monitor
from skein.streaming import events as streaming

RAW = "labels_json string, id long, ts timestamp, kind string, count long, lag_ms double"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def metric_rows(n=400, seed=3):
    rng = random.Random(seed)
    out, at = [], 0.0
    for k in range(n):
        at += rng.choice([0, 0.5, 3, 20, 200])
        kind = rng.choice(monitor.KINDS)
        out.append((rng.choice("ab"), k, START + dt.timedelta(seconds=at), kind, rng.choice([None, 1, 2, -1]), rng.choice([None, -5.0, rng.random() * 100])))
    return out


def brute(rows, late):
    """Plain sequential state, one label after the other."""
    out = []
    passed = max(r[2] for r in rows) - dt.timedelta(seconds=late)
    for label in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == label), key=lambda r: (r[2], r[1]))
        level, samples, due = dict.fromkeys(monitor.SERIES, 0.0), [], {}
        for _, _, ts, kind, count, lag in mine:
            seconds = (ts - START).total_seconds()
            count = 1 if count is None else max(0, count)
            if kind.endswith("open"):
                level[kind[:-5] + "_connected"] += 1
            elif kind.endswith("close"):
                name = kind[:-6] + "_connected"
                level[name] = max(0, level[name] - 1)
            elif kind == "pushed":
                level["events_pushed_total"] += count
                if lag is not None:
                    samples.append((seconds, max(0.0, lag)))
            elif kind == "dropped":
                level["events_dropped_total"] += count
            else:
                level["ai_requests_total"] += count
                level["ai_errors_total"] += count * (kind == "ai_error")
            at = -(-seconds // 10) * 10
            recent = sorted(v for s, v in samples if s >= at - 120)
            due[at] = level | {"event_lag_ms_p50": monitor.percentile(recent, 50.0), "event_lag_ms_p95": monitor.percentile(recent, 95.0)}
        out += [(at, s, label, float(v)) for at, levels in due.items() if START + dt.timedelta(seconds=at) <= passed for s, v in levels.items()]
    return sorted(out)


def run(spark, folder, where, late=30, files=1):
    rows = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).parquet(folder)
    with monitor.state_store(spark):
        out = streaming.collected(monitor.web_metrics(rows, f"{late} seconds"), f"{where}/state", f"{where}/table")
    return sorted((r.at.replace(tzinfo=dt.timezone.utc).timestamp() - START.timestamp(), r.series, r.labels_json, r.value) for r in out.withColumn("at", F.col("at").cast("timestamp_ntz")).collect())


def test_metrics_restart_in_the_middle(spark, tmp_path):
    rows = metric_rows()
    odd = [(None, 1, START, "pushed", 1, 1.0), ("a", 2, None, "pushed", 1, 1.0), ("a", 3, START, "other", 1, 1.0)]
    where = f"file://{tmp_path}"
    parts = [rows[:150] + odd, rows[150:260], rows[260:]]
    for k, part in enumerate(parts):
        # rows of a file come in any order
        spark.createDataFrame(random.Random(k).sample(part, len(part)), RAW).coalesce(1).write.mode("append").parquet(f"{where}/events")
        got = run(spark, f"{where}/events", f"{where}/cut")
        if k == 0:
            early = got
    assert got == brute(rows, 30) and set(early) < set(got) and early
    assert run(spark, f"{where}/events", f"{where}/whole", files=100) == got


def test_pending_events_are_held_by_slices(spark, tmp_path):
    """A label's events over many slices and parts of one, in one batch, are never flushed by more than a slice at a time."""
    rows = metric_rows(600, 9)
    folder = f"file://{tmp_path}/events"
    spark.createDataFrame(random.Random(1).sample(rows, len(rows)), RAW).coalesce(1).write.parquet(folder)
    assert run(spark, folder, f"file://{tmp_path}/out") == brute(rows, 30)
    assert (rows[-1][2] - START).total_seconds() * 1_000_000 > 4 * monitor.SLICE
    import pandas as pd

    frame = pd.DataFrame({"at": range(25), "id": range(25), "kind": 4, "count": 1, "lag": None})
    cut = [b for b in monitor.buffered(iter([frame[:10], frame[10:20], frame[20:]]), 15)]
    assert [len(b) for b in cut] == [20, 5] and [int(x) for b in cut for x in b["at"]] == list(range(25))


def test_files_in_no_order_of_time_lose_no_rows(spark, tmp_path):
    """The query over a table of several files, the latest first, gives what it gives over one file."""
    from skein.plans import live

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    edge = events.agg(F.percentile("event_id", 0.5)).first()[0]
    for name, parts in {"one": ["true"], "more": [f"event_id > {edge}", f"event_id <= {edge}"]}.items():
        for part in parts:
            events.where(part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}/events.parquet")
    got = {n: sorted(map(tuple, live.web_metrics(spark, f"file://{tmp_path}/{n}").collect())) for n in ("one", "more")}
    assert got["one"] and got["one"] == got["more"]


def test_percentiles_interpolate():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 40):
        v = np.sort(rng.random(n))
        for p in (0.0, 50.0, 95.0, 100.0):
            assert monitor.percentile(v, p) == pytest.approx(np.percentile(v, p) if n else 0.0)


def test_recent_takes_the_largest_value(spark):
    rows = [(START + dt.timedelta(seconds=s), "a", "{}", float(s)) for s in range(0, 100, 10)]
    out = monitor.recent(spark.createDataFrame(rows, monitor.RESULT), F.lit(START + dt.timedelta(seconds=90)), 30).collect()
    assert [(r.series, r.value) for r in out] == [("a", 90.0)]


def test_captured_changes(spark):
    before = spark.createDataFrame([(1, "a", 1.0, "x"), (2, "b", None, "x"), (3, "c", 3.0, "x")], "id long, title string, score double, other string")
    after = spark.createDataFrame([(1, "a", 1.0, "x"), (2, "b", 2.0, "x"), (3, "c", 3.0, "y"), (4, None, None, None), (None, "n", 0.5, "z")], before.schema)
    got = {r.doc_id: r.payload_json for r in changes.captured(before, after, "id", "t", "k").collect()}
    assert got == {"t:2": '{"table":"t","id":2,"score":2.0,"title":"b"}', "t:3": '{"table":"t","id":3,"score":3.0,"title":"c"}', "t:4": '{"table":"t","id":4}', "t:": '{"table":"t","score":0.5,"title":"n"}'}
    assert changes.captured(None, after, "id", "t", "k").count() == 5 and changes.captured(after, after, "id", "t", "k").isEmpty()


def feed(spark, n, kind="k", start=0):
    rows = [(kind, f"t:{k % 40}", "t", '{"id":%d}' % (k % 40)) for k in range(start, start + n)]
    return spark.createDataFrame([(a, b, c, d[:-1] + f',"n":{k}}}') for k, (a, b, c, d) in enumerate(rows, start)], changes.CHANGE)


def test_log_numbers_are_gapless_and_batches_replace_themselves(spark, tmp_path):
    log = changes.ChangeLog(spark, f"file://{tmp_path}/log")
    log.append(feed(spark, 300), 0)
    log.append(feed(spark, 0), 1)
    log.append(feed(spark, 57, start=1000), 2)
    log.append(feed(spark, 57, start=1000), 2)
    seqs = [r.seq for r in log.after(0).orderBy("seq").collect()]
    assert seqs == list(range(1, 358)) and log.last() == 357
    assert [r.seq for r in log.after(340, 350).orderBy("seq").collect()] == list(range(341, 351))
    assert log.pending().count() == 40
    taken = log.take(10, 0).collect()
    assert len(taken) == 10 and log.pending().count() == 30
    log.append(feed(spark, 40, start=5000), 3)
    # a row that changes after it was taken is due again
    assert log.pending().count() == 40 and log.last() == 397


def test_replay_and_live_meet(spark, tmp_path):
    where = f"file://{tmp_path}"
    log = changes.ChangeLog(spark, f"{where}/log")
    log.append(feed(spark, 100), 0)
    known, upto = 30, log.last()
    seen = [r.seq for r in log.after(known, upto).collect()]
    for k in (1, 2, 3):
        log.append(feed(spark, 50, start=100 * k), k)
        live = streaming.collected(log.live(upto), f"{where}/state", f"{where}/table")
        assert sorted(seen + [r.seq for r in live.collect()]) == list(range(31, log.last() + 1))


def test_full_batches_are_coalesced(spark):
    log = feed(spark, 300).withColumn("seq", F.get_json_object("payload_json", "$.n").cast("long") + 1)
    rows = log.collect()
    want = []
    for b in range(3):
        part = sorted((r for r in rows if (r.seq - 1) // 128 == b), key=lambda r: r.seq)
        kept = {}
        for r in part:
            kept[f"{r.kind}:{r.doc_id}" if len(part) > 50 else r.seq] = r
        want += [(b, k + 1, r.seq) for k, r in enumerate(kept.values())]
    assert sorted((r.batch, r.place, r.seq) for r in changes.coalesced(log).collect()) == want
