"""Pages, cuts and projections on known inputs."""

from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import pages

RAW = {
    '{"a": true, "b": 0, "c": "x", "d": null, "e": [], "f": 2.5}': ("a=true; c=x; f=2.5", 0, {"b": 0.0, "f": 2.5}),
    '["x", null, "y"]': ("x; y", 3, None),
    "plain words ": ("plain words", 0, None),
    "{broken": ("{broken", 0, None),
    "": (None, 0, None),
    "[]": (None, 0, None),
}


def test_json_texts(spark):
    df = spark.createDataFrame([(r,) for r in RAW] + [(None,)], "r string")
    got = [tuple(x) for x in df.select(text.reasons_text(F.col("r")), text.count_list(F.col("r")), text.numeric_features(F.col("r"))).collect()]
    assert got == [*RAW.values(), (None, 0, None)]
    assert [r[0] for r in df.select(text.signal(F.col("r"), "f")).collect()] == [2.5, 0, 0, 0, 0, 0, 0]


def test_ranked_pages_cover_all_rows(spark):
    rows = spark.createDataFrame([(k, k // 3) for k in range(25)], "id int, score int")
    got = [(r.id, r.rank, r.total) for o in (0, 10, 20) for r in sorted(pages.ranked(rows, [F.desc("score"), "id"], 10, o).collect(), key=lambda r: r.rank)]
    assert [g[1] for g in got] == list(range(1, 26)) and {g[2] for g in got} == {25} and [g[0] for g in got[:4]] == [24, 21, 22, 23]
    assert pages.ranked(rows, ["id"], 10, 100).count() == 0


def test_cuts(spark):
    rows = spark.createDataFrame([(k, -k) for k in range(10)], "id int, at int")
    kept, gone = pages.retained(rows, 3, "id", F.desc("at"))
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2] and sorted(r.id for r in gone.collect()) == list(range(3, 10))
    assert pages.retained(rows, 20, "id", F.desc("at"))[1].count() == 0
    total, first = pages.export_preview(rows, 7, 2)
    assert total.first().rows == 7 and first.count() == 2


def test_series_and_music_filters(spark):
    rows = spark.createDataFrame([("B", "tv/b", None, "d1", 2), ("a", "tv/a", 0.9, "d2", 1), ("C x", "tv/c", 0.5, "d1", None)], "title string, folder string, confidence double, drive string, seasons int")
    of = lambda **o: [r.title for r in pages.series(rows, **o).collect()]
    assert of() == ["a", "B", "C x"] and of(sort="confidence", descending=True) == ["a", "C x", "B"] and of(sort="seasons") == ["a", "B", "C x"]
    assert of(only_low=True) == ["B", "C x"] and of(least=0.5) == ["a", "C x"] and of(q="TV/C") == ["C x"] and of(drive="d1", q="b") == ["B"]
    songs = spark.createDataFrame([("d", "x/one.MP3", "A", None, None, "MP3", 0.5), ("d", "x/two.flac", None, "B one", None, "flac", 2.0)], "drive string, path string, artist string, title string, album string, ext string, score double")
    assert pages.music(songs, q="one").count() == 2 and pages.music(songs, ext="mp3").count() == 1 and pages.music(songs, least=5.0).count() == 1 and pages.music(songs, drive="e").count() == 0


def test_old_log_rows_are_purged(spark, tmp_path):
    import datetime as dt

    from skein.sources import writers

    rows = spark.createDataFrame([(k, dt.datetime(2024, 1, k)) for k in range(1, 11)] + [(99, None)], "id int, ts timestamp_ntz")
    gone = writers.purge(rows, "ts", F.lit(dt.datetime(2024, 1, 10)).cast("timestamp_ntz"), 3, f"file://{tmp_path}/log")
    assert gone == 6 and sorted(r.id for r in spark.read.schema("id int").json(f"file://{tmp_path}/log").collect()) == [7, 8, 9, 10, 99]
