"""Folder profiles, candidates, confidence, review."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skein.operators import structure as S

FILES = "folder string, name string, size_bytes long, content string"
MATRIX = "Movies/The Matrix (1999)"
ROWS = [
    (MATRIX, "The Matrix (1999).mkv", 900, None), (MATRIX, "The Matrix (1999).srt", 1, None), (MATRIX, "The Matrix (1999).nfo", 1, "<imdbid>tt0133093</imdbid> <tmdbid>603</tmdbid>"), (MATRIX, "poster.txt", 1, None),
    ("Movies/Old", "Old.Film.1080p.x264.mkv", 5, None), ("Movies/Old", ".hidden.mkv", 9, None),
    ("Movies/Two (2001)", "a.mkv", 1, None), ("Movies/Two (2001)", "b.mkv", 1, None), ("Movies/Two (2001)", "fanart.jpg", 1, None), ("Movies/Two (2001)", "movie.nfo", 1, "imdb 12"),
    ("Shows/Show Season 1", "Show S01E01.mkv", 1, None), ("Movies/Bad (9999)", "Bad.mp4", 1, None), ("Docs", "readme.md", 1, None),
]


def held(spark):
    return S.contents(spark.createDataFrame(ROWS, FILES))


def test_contents_of_folders(spark):
    got = {r.folder: r for r in held(spark).collect()}
    m = got[MATRIX]
    assert (m.kind, m.canonical, m.detected_year, m.main_video, m.issues, m.has_ids) == ("movie", True, 1999, "The Matrix (1999).mkv", ["extra_mkv_files:1", "extra_nfo_files:1"], True)
    assert json.loads(m.assets_json) == {"poster": False, "fanart": False, "subtitles": 1, "ids": {"imdb_id": "tt0133093", "tmdb_id": "603"}}
    assert got["Movies/Old"].issues == ["missing_canonical_pattern", "missing_year", "missing_nfo", "extra_mkv_files:1"] and got["Movies/Old"].videos == 1
    two = got["Movies/Two (2001)"]
    assert (two.kind, two.canonical, two.issues, two.has_ids, two.main_video) == ("other", False, ["multiple_primary_videos", "extra_mkv_files:2"], False, "b.mkv")
    assert got["Shows/Show Season 1"].kind == "series" and got["Movies/Bad (9999)"].issues[:2] == ["invalid_year", "missing_year"]
    assert got["Docs"].issues == ["no_primary_video", "extra_md_files:1"]


GUESSES = {"The Matrix (1999)": ("The Matrix", 1999), "Old.Film.1080p.x264.mkv": ("Old Film", None), "2001.A.Space.Odyssey.1968.mkv": ("2001 A Space Odyssey", 1968), "": (None, None), "1984.mkv": ("1984", None)}


def test_guesses(spark):
    df = spark.createDataFrame([(n,) for n in GUESSES], "n string")
    assert [tuple(r[0]) for r in df.select(S.movie_guess(F.col("n"))).collect()] == list(GUESSES.values())


def test_signals_come_from_joined_tables(spark):
    folders = held(spark)
    known = spark.createDataFrame([(MATRIX, "tmdb", "603", "The Matrix", 1999), (MATRIX, "tmdb", "604", "Matrix Reloaded", 2003), ("Movies/Old", "tmdb", "9", "Something else", None), ("nowhere", "tmdb", "1", "x", 1)], "folder string, source string, candidate_id string, title string, year int")
    hashes = spark.createDataFrame([("00ff", "tt0133093", "Matrix, The", 1999)], "signature string, candidate_id string, title string, year int")
    signatures = spark.createDataFrame([(MATRIX, "00ff"), ("Movies/Old", "1234")], "folder string, signature string")
    found = S.candidates(folders, known, hashes, signatures)
    of = lambda f: [(r.source, r.candidate_id) for r in sorted(found.where(F.col("folder") == f).collect(), key=lambda r: r.place)]
    assert len(of(MATRIX)) == 4 and set(of(MATRIX)) == {("name", None), ("tmdb", "603"), ("tmdb", "604"), ("opensubs", "tt0133093")} and of("nowhere") == []
    runtimes = spark.createDataFrame([(MATRIX, 8100.0, 136)], "folder string, seconds double, minutes int")
    full = {r.folder: r for r in S.profiles(folders, found, runtimes).collect()}
    bare = {r.folder: r for r in S.profiles(folders, S.candidates(folders)).collect()}
    signals = json.loads(full[MATRIX].signals_json)
    assert signals["oshash"] == 0.2 and signals["runtime"] == 0.05 and signals["canon"] == 0.35 and signals["nfo"] == 0.25
    # the score of the folder: all signals less two penalties of 0.03
    assert full[MATRIX].confidence == pytest.approx(0.35 + 0.25 + 0.20 + 0.05 + signals["name_match"] - 0.06)
    assert json.loads(bare[MATRIX].signals_json)["oshash"] == 0 and bare[MATRIX].confidence == pytest.approx(full[MATRIX].confidence - 0.25)
    assert (full[MATRIX].title, full[MATRIX].year) == ("The Matrix", 1999) and full[MATRIX].reasons == ["Issue detected: extra_mkv_files:1", "Issue detected: extra_nfo_files:1"]
    old = full["Movies/Old"]
    assert old.reasons[:2] == [S.NO_CANON, S.NO_IDS] and old.confidence < 0.5
    assert {q.action for q in full[MATRIX].questions} >= {"review_nfo", "open_folder", "alt_tmdb_search"}
    assert full["Shows/Show Season 1"].reasons[-1] == "Classified as series based on folder contents."


def test_tables_after_two_runs(spark):
    folders = held(spark)
    found = S.candidates(folders)
    made = S.profiles(folders, found)
    day = lambda n: F.lit(dt.datetime(2024, 1, n)).cast("timestamp_ntz")
    first = S.stored({}, made, found, day(1))
    queued = {r.folder for r in first["queue"].collect()}
    assert MATRIX not in queued and "Movies/Old" in queued and first["profiles"].count() == 6
    part = S.contents(spark.createDataFrame([*ROWS[:4], ("Movies/Old", "Old (1980).mkv", 5, None), ("Movies/Old", "movie.nfo", 1, "imdb_id: 7654321")], FILES))
    again = S.candidates(part)
    second = S.stored(first, S.profiles(part, again), again, day(2))
    rows = {r.folder: r for r in second["queue"].collect()}
    assert set(rows) == queued and {r.created_utc for r in rows.values()} == {dt.datetime(2024, 1, 1)}
    assert rows["Movies/Old"].confidence != {r.folder: r.confidence for r in first["queue"].collect()}["Movies/Old"]
    assert {r.folder: r.updated_utc.day for r in second["profiles"].collect()} == {f: 2 if f in (MATRIX, "Movies/Old") else 1 for f in {r[0] for r in ROWS}}
    assert second["candidates"].where("folder = 'Movies/Old'").count() == again.where("folder = 'Movies/Old'").count()
    assert tuple(S.summary(made).first())[:2] == (6, 3)
