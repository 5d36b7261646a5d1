"""Video quality from probes."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skein.operators import quality as Q


def probe(width, height, kbps, audio=(), subs=(), duration=None, container=None):
    streams = [{"codec_type": "video", "codec_name": "h264", "width": width, "height": height, "bit_rate": str(kbps), "avg_frame_rate": "24/1"}] if width else []
    streams += [{"codec_type": "Audio", "codec_name": "aac", "channels": c, "tags": {"language": lang}} for c, lang in audio]
    streams += [{"codec_type": "subtitle", "codec_name": "srt", "tags": {"LANGUAGE": lang}} for lang in subs]
    return json.dumps({"streams": streams, "format": {"format_name": "mov", "duration": duration and str(duration), "bit_rate": container and str(container)}})


CASES = [
    (probe(1920, 1080, 2000, [(2, "eng")]), None, False, 82, {"low_bitrate_per_mp": 964.5, "resolution": "1080p"}),
    (probe(3840, 2160, 24000, [(6, "eng"), (2, "spa")], ["eng", "spa"], 7200.0, 26_000_000), None, True, 100, {"multi_audio_langs": 2, "multi_sub_langs": 2, "resolution": "2160p"}),
    (probe(1280, 720, 4500, [(1, "eng")], (), 7200.0), 100, False, 80, {"audio_channels": 1, "runtime_mismatch": 1200, "resolution": "720p"}),
    (probe(None, None, 0), 90, True, 90, {"audio_channels_unknown": True, "missing_subs": True, "resolution": "unknown"}),
    (probe(320, 240, 0, [(2, "en-GB"), (2, "EN")], (), 3.0, 9_000_000), 0, False, 100, {"resolution": "<=480p"}),
    (probe(2560, 1440, 9000, [(2, None)], (), 6000), 100, False, 100, {"runtime_match": True, "resolution": "1440p"}),
]


@pytest.mark.parametrize(("text", "minutes", "subs", "score", "reasons"), CASES)
def test_scores_and_reasons(spark, text, minutes, subs, score, reasons):
    files = spark.createDataFrame([("a", text, minutes)], "path string, probe string, minutes int")
    r = Q.rows(files, F.lit(dt.datetime(2024, 1, 1)), subs).first()
    assert (r.score, json.loads(r.reasons_json)) == (score, reasons)


def test_rows_of_a_table(spark):
    files = spark.createDataFrame([("a", CASES[1][0], 120), ("broken", "{no", 1), ("null", None, None), ("list", "[]", 1)], "path string, probe string, minutes int")
    got = {r.path: r for r in Q.rows(files, F.lit(dt.datetime(2024, 1, 1))).collect()}
    a = got["a"]
    assert (a.container, a.duration_s, a.width, a.height, a.video_codec, a.video_bitrate_kbps, a.audio_codecs, a.audio_channels_max, a.audio_langs, a.subs_present, a.subs_langs) == ("mov", 7200.0, 3840, 2160, "h264", 24000, "aac", 6, "en,es", 1, "en,es")
    assert json.loads(a.reasons_json)["runtime_match"] is True
    assert [got[p].score for p in ("broken", "null")] == [0, 0] and json.loads(got["broken"].reasons_json) == {"probe_error": True}


LANGUAGES = {"eng": "en", "GER": "de", "pt_BR": "pt", "zh-Hans": "zh", "xx": "xx", "tlh": "tlh", "klingon": "kli", "": None, " ": None}


def test_language_codes(spark):
    df = spark.createDataFrame([(x,) for x in LANGUAGES] + [(None,)], "x string")
    assert [r[0] for r in df.select(Q.language_code(F.col("x"))).collect()] == [*LANGUAGES.values(), None]


def test_due_and_stored(spark):
    day = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    inventory = spark.createDataFrame([("a", "Video", day[0]), ("b", "video ", day[2]), ("c", "video", day[2]), ("d", "audio", day[2]), ("e", None, day[2])], "path string, category string, indexed_utc timestamp_ntz")
    old = spark.createDataFrame([("a", day[1], 5), ("b", day[1], 6), ("z", day[0], 7)], "path string, updated_utc timestamp_ntz, score int")
    assert sorted(r.path for r in Q.due(inventory, old).collect()) == ["b", "c"]
    new = spark.createDataFrame([("b", day[2], 60), ("c", day[2], 70)], old.schema)
    assert sorted((r.path, r.score) for r in Q.stored(old, new).collect()) == [("a", 5), ("b", 60), ("c", 70), ("z", 7)] and Q.stored(None, new).count() == 2


def test_a_tag_is_normalised_once(spark):
    """The tag's first part is worked out once, however often the code uses it."""
    plan = spark.createDataFrame([("eng-US",)], "x string").select(Q.language_code(F.col("x"))).toDF("c")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    rows = [("eng-US",), ("EN",), ("",), (None,), ("-x",), ("klingon",), (" ger_DE ",), ("xx",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(Q.language_code(F.col("x"))).collect()]
    assert got == ["en", "en", None, None, None, "kli", "de", "xx"]
