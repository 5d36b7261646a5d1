"""Answers on known inputs: JSON keys, YAML keys, names, queues, payloads."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skein.functions import media, names
from skein.operators import upserts, views


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_keys_are_set_without_touching_the_others(spark):
    blobs = ['{"a": 1, "b": {"c": [1, 2.5, null]}, "t": "", "f": true}', '{"t": "old", "x": 1}', "{broken", None, "[1]", '{"t": null}']
    out = values(spark, media.with_key_set(F.col("j"), "t", F.col("v")), [(b, 'n"é') for b in blobs], "j string, v string")
    assert [json.loads(x) for x in out] == [{"a": 1, "b": {"c": [1, 2.5, None]}, "t": 'n"é', "f": True}, {"t": "old", "x": 1}, *[{"t": 'n"é'}] * 4]
    assert list(json.loads(out[0])) == ["a", "b", "t", "f"] and out[1] == blobs[1]


YAML = {
    '"quoted": 1\n1key: 2\nplain: x\n': ["quoted", "1key", "plain"],
    "a: 1\n---\nb: 2\n": ["a"],
    "---\n# note\n---\nb: 2\nc:\n  d: 1\n- e: 1\n": ["b", "c"],
    "{a: 1, 'b': {c: 2, d: [1, 2]}, e: 3}": ["a", "b", "e"],
    "url: http://x:80\nno colon\nwith space: 1\n": ["url", "with space"],
    "a: 1\r\nb:\r\n  c: 1\r\na: 2": ["a", "b"],
    "": [],
    "- a: 1\n- b: 2": [],
}


def test_first_level_keys_of_yaml(spark):
    assert values(spark, media.first_level_keys(F.col("y")), [(y,) for y in YAML], "y string") == list(YAML.values())


TAGGED = {
    "Song (12p)": "Song 12p", "Song (1p2)": "Song 1p2", "Song [1080p]": "Song", "Song (720P HEVC)": "Song", "Song (10800p)": "Song 10800p", "Song (320kbps)": "Song", "Song (1kbps)": "Song 1kbps",
    "Song (Official Video)": "Song", "Song (Piano)": "Song Piano", "Song {Remaster 2009}": "Song", "Song (dvdrip)": "Song", "Song (éhd)": "Song éhd", "Song (liver)": "Song liver", "Song (open": "Song open",
}


def test_only_tags_are_dropped_from_names(spark):
    assert dict(zip(TAGGED, values(spark, names.without_tags(F.col("n")), [(n,) for n in TAGGED], "n string"))) == TAGGED


GUESTS = {
    "A feat. B - T.mp3": "A", "A Featuring B - T.mp3": "A", "A vs. B - T.mp3": "A vs B", "A x B - T.mp3": "A", "A with the B - T.mp3": "A", "Feat Man - T.mp3": "Feat Man",
    "Exit - T.mp3": "Exit", "Withers - T.mp3": "Withers", "A ft. B - T.mp3": "A ft B", "Malcolm X - T.mp3": "Malcolm",
}


def test_guests_are_no_part_of_the_artist(spark):
    """Dots become spaces before, so ``vs`` and ``ft`` are words like any other."""
    out = values(spark, names.music_name(F.col("n"), F.array().cast("array<string>"))["artist"], [(n,) for n in GUESTS], "n string")
    assert {k: v.replace("feat ", "feat. ") for k, v in zip(GUESTS, out)} == GUESTS


def test_history_is_oldest_first(spark):
    rows = spark.createDataFrame([(s, k) for s in "ba" for k in (3, 1, 5, 4, 2)], "session string, k int").repartition(3)
    assert [tuple(r) for r in views.history(rows, "session", 3, "k").collect()] == [(s, k) for s in "ab" for k in (3, 4, 5)]


def test_review_queue_keeps_when_rows_came(spark):
    day = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    queue = spark.createDataFrame([("stays", 0.1, "old", day[0]), ("recovers", 0.2, "old", day[0]), ("unscored", 0.3, "old", day[1])], "path string, confidence double, reasons string, created_utc timestamp_ntz")
    scored = spark.createDataFrame([("stays", 0.4, "new"), ("recovers", 0.5, "new"), ("comes", 0.0, "new"), ("null", None, "new")], "path string, confidence double, reasons string")
    out = {r.path: tuple(r)[1:] for r in upserts.review_queue(queue, scored, "path", 0.5, F.lit(day[2]).cast("timestamp_ntz")).collect()}
    assert out == {"stays": (0.4, "new", day[0]), "unscored": (0.3, "old", day[1]), "comes": (0.0, "new", day[2])}


def test_reasons_come_beside_the_others_or_in_a_new_row(spark):
    queue = spark.createDataFrame([("a", ["low"], 1), ("b", ["keyword"], 2), ("c", None, 3), ("d", ["x"], 4), (None, ["y"], 5)], "path string, reasons array<string>, n int")
    hits = spark.createDataFrame([(p,) for p in ("a", "b", "c", "e", "e", None)], "path string")
    out = {r.path: (r.reasons, r.n) for r in upserts.reasons_for(queue, hits, "path", "keyword").collect()}
    assert out == {"a": (["low", "keyword"], 1), "b": (["keyword"], 2), "c": (["keyword"], 3), "d": (["x"], 4), None: (["y"], 5), "e": (["keyword"], None)}


@pytest.mark.parametrize(("raw", "want"), [('{"a": 1}', {"a": 1}), ("[1, 2]", {"value": [1, 2]}), ("7", {"value": 7}), ("{broken", {"raw": "{broken"}), ("", {}), (None, {}), ('"x"', {"value": "x"})])
def test_payloads(spark, raw, want):
    log = spark.createDataFrame([(5, raw), (3, "{}")], "seq long, payload_json string")
    out = upserts.events_after(log, 4).collect()
    assert [r.seq for r in out] == [5] and json.loads(out[0].payload) == want


def test_rows_move_between_two_tables(spark):
    day = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    minimal = spark.createDataFrame([("same", "A", 0.9, day[0]), ("changed", "A", 0.9, day[0]), ("sinks", "A", 0.9, day[0]), ("elsewhere", "A", 0.9, day[0])], "path string, artist string, score double, parsed_utc timestamp_ntz")
    queue = spark.createDataFrame([("rises", 0.1, "[]", day[1]), ("stays", 0.2, "[]", day[1]), ("worse", 0.3, "[]", day[1])], "path string, score double, reasons_json string, queued_utc timestamp_ntz")
    made = [("same", "A", 0.9 + 5e-7, "[]"), ("changed", None, 0.9, "[]"), ("sinks", "A", 0.2, "[]"), ("rises", "B", 0.7, "[]"), ("stays", "C", 0.2, "[]"), ("worse", "D", 0.3, '["x"]'), ("fresh", "E", 0.9, "[]"), ("none", "F", None, "[]"), ("fresh", "E", 0.1, "[]")]
    a, b, s = upserts.two_table_sync(minimal, queue, spark.createDataFrame(made, "path string, artist string, score double, reasons_json string"), ["path"], 0.5, F.lit(day[2]).cast("timestamp_ntz"))
    assert {r.path: (r.artist, r.score, r.parsed_utc.day) for r in a.collect()} == {"same": ("A", 0.9, 1), "changed": (None, 0.9, 3), "rises": ("B", 0.7, 3), "fresh": ("E", 0.9, 3), "elsewhere": ("A", 0.9, 1)}
    assert {r.path: (r.score, r.queued_utc.day) for r in b.collect()} == {"sinks": (0.2, 3), "stays": (0.2, 2), "worse": (0.3, 3), "none": (None, 3)}
    assert s.first().asDict() == {"processed": 8, "stored": 3, "queued": 3, "unchanged": 2, "removed_minimal": 1, "removed_queue": 1}
