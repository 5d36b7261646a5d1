import pytest
from pyspark.sql import functions as F

from skein.functions import names, paths, scores, text, vectors
from skein.sources import readers


def value(spark, column, **cells):
    """The column over one row of cells."""
    df = spark.range(1)
    for name, x in cells.items():
        df = df.withColumn(name, F.lit(x) if not isinstance(x, list) else F.array(*[F.lit(y) for y in x]).cast("array<string>" if not x or isinstance(x[0], str) else "array<double>"))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("path", "depth", "want"),
    [
        ("C:\\Media\\Films\\a.mkv", 0, "C:/Media/Films"),
        ("C:\\Media\\Films\\a.mkv", 1, "C:/Media"),
        ("//server/share/x/y/z.txt", 1, "//server/share/x"),
        ("/mnt/a/b/c.txt", 2, "/mnt/a"),
        ("rel/one.txt", 3, "rel"),
        ("one.txt", 2, ""),
        ("/one.txt", 2, "/"),
    ],
)
def test_parent_folder(spark, path, depth, want):
    assert value(spark, paths.parent_folder(F.col("p"), depth), p=path) == want


def test_paths(spark):
    assert value(spark, paths.basename(F.col("p")), p="a\\b/c.TXT") == "c.TXT"
    assert [value(spark, paths.extension(F.col("p")), p=p) for p in ("a/b.TAR.gz", "a/.bashrc", "x")] == ["gz", "", ""]
    assert [value(spark, paths.report_extension(F.col("p")), p=p) for p in ("MKV", ".srt", " ", "longerext")] == [".mkv", ".srt", None, "longerext"]
    assert [value(spark, paths.human_size(F.lit(n))) for n in (0, 512, 1536, 5 * 1024**3)] == ["0 B", "512 B", "1.5 KB", "5.0 GB"]
    assert [value(spark, paths.category(F.lit(e), F.lit(m).cast("string"))) for e, m in (("MKV", None), ("zzz", "audio/x-foo"), ("zzz", "application/pdf"), ("zzz", "application/pdfx"), ("", None))] == ["video", "audio", "document", "other", "other"]
    assert value(spark, paths.glob_match(F.col("p"), ["*.tmp", "Thumbs.*"]), p="x/y/Thumbs.db") is True
    assert value(spark, paths.hidden(F.col("p")), p="/a/.git") is True
    assert value(spark, paths.safe_name(F.col("p")), p="My Disk: 1") == "My_Disk_1"
    for key in ("a", "ab", "abc", "é/ü?"):
        token = value(spark, paths.media_token(F.lit("D1"), F.lit("movie"), F.lit(key)))
        assert "=" not in token and "+" not in token and value(spark, paths.media_token_parts(F.lit(token))).key == key
    assert value(spark, paths.media_token_parts(F.lit("not a token!"))) is None
    assert value(spark, paths.item_parts(F.lit("movie:D:a:b"))) == ["movie", "D", "a:b"] and value(spark, paths.item_parts(F.lit("movie"))) is None


def test_text(spark):
    assert value(spark, text.split_list(F.lit("en; de,,fr "))) == ["en", "de", "fr"]
    assert value(spark, text.json_list(F.lit('["a", 1, null]'))) == ["a", "1"] and value(spark, text.json_list(F.lit("{bad"))) == []
    assert value(spark, text.json_dict(F.lit("[1]"))) == {}
    assert value(spark, text.truthy_keys(F.lit('{"a": true, "b": 0, "c": "", "d": "x", "e": null}'))) == ["a", "d"]
    assert value(spark, text.has_known_id(F.lit('{"ids": {"imdb": "tt1"}}'))) is True and value(spark, text.has_known_id(F.lit('{"imdb": " "}'))) is False
    assert value(spark, text.distinct_ignoring_case(F.col("x")), x=["Artist", "artist", "", "Title"]) == ["Artist", "Title"]
    assert value(spark, text.jaccard(F.col("x"), F.col("y")), x=["a", "b"], y=["b", "c"]) == pytest.approx(1 / 3)
    assert value(spark, text.list_or_commas(F.lit("a, b"))) == ["a", "b"]
    assert [value(spark, text.air_year(F.lit(d).cast("string"))) for d in ("1999-01-02", "", None)] == [1999, 0, 0]
    assert value(spark, text.capitalised(F.lit("The Matrix met Neo in Zion. an Al"))) == ["matrix", "neo", "the", "zion"]
    assert value(spark, text.parse_iso(F.lit("2024-01-01T00:00:00+02:00"))).hour is not None and value(spark, text.parse_iso(F.lit("soon"))) is None


def test_vectors(spark):
    assert value(spark, vectors.cosine(F.col("x"), F.col("y")), x=[1.0, 0.0, 5.0], y=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert value(spark, vectors.cosine(F.col("x"), F.col("y")), x=[0.0], y=[1.0]) == 0 and value(spark, vectors.cosine(F.col("x"), F.col("x")), x=[]) == 0
    assert value(spark, vectors.l2_normalize(F.col("x")), x=[3.0, 4.0]) == [0.6, 0.8] and value(spark, vectors.l2_normalize(F.col("x")), x=[0.0]) == [0.0]
    assert value(spark, vectors.sign_bits(F.col("x"), 3), x=[1.0, -1.0, 2.0]) == 5
    assert value(spark, vectors.hamming(F.lit(5), F.lit(6))) == 2
    assert value(spark, vectors.positional_distance(F.col("x"), F.col("y")), x=["a", "b", "c"], y=["a", "x"]) == 0.5


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        (dict(w=1920, h=1080, k=2000, c=2, a=1, s=0, e=False, sec=0.0, m=0), 82),
        (dict(w=3840, h=2160, k=24000, c=6, a=2, s=2, e=True, sec=0.0, m=0), 100),
        (dict(w=1280, h=720, k=4500, c=1, a=1, s=0, e=False, sec=7200.0, m=100), 80),
    ],
)
def test_video_quality(spark, cells, want):
    c = {k: F.lit(v) for k, v in cells.items()}
    assert value(spark, scores.video_quality(c["w"], c["h"], c["k"], c["c"], c["a"], c["s"], c["e"], c["sec"], c["m"])) == want


def test_confidence(spark):
    t, f = F.lit(True), F.lit(False)
    assert value(spark, scores.folder_confidence(t, t, t, F.lit(0.9), t, F.col("i")), i=[]) == pytest.approx(1.0)
    assert value(spark, scores.folder_confidence(t, f, f, F.lit(0.4), f, F.col("i")), i=["missing_year", "odd"]) == pytest.approx(0.35 + 0.06 - 0.13)
    assert value(spark, scores.folder_confidence(f, f, f, F.lit(0.0), f, F.col("i")), i=["no_primary_video"]) == 0
    assert value(spark, scores.tv_confidence({0.5: t, 0.2: f}, F.col("i")), i=["x"]) == pytest.approx(0.45)
    assert value(spark, scores.keyword_score(F.lit("matrix"), F.lit("The Matrix"))) == pytest.approx(0.6)
    assert value(spark, scores.keyword_score(F.lit("neo matrix"), F.lit("The Matrix"))) == 0.5


@pytest.mark.parametrize(
    ("raw", "want"),
    [("My_Song...Final", "My Song Final"), ("Track Name (Official Video) [1080p] {Remaster}", "Track Name"), ("01_Artist-Title (Live).mp3", "01 Artist-Title"), ("Song (Piano)", "Song Piano")],
)
def test_normal_name(spark, raw, want):
    assert value(spark, names.normal_name(F.lit(raw))) == want


def test_music_names(spark):
    assert [value(spark, names.strip_audio_extension(F.lit(x))) for x in ("01-song.mp3", "recording.flac.part", "notes.txt")] == ["01-song", "recording", "notes.txt"]
    m = value(spark, names.music_name(F.lit("x/Artist - Song Title (Official Video).mp3"), F.col("p")), p=["Artist", "Best Album"])
    assert (m.artist, m.title, m.album, m.parent_match) == ("Artist", "Song Title", "Best Album", True)
    assert value(spark, names.music_score(names.music_name(F.lit("Artist - Song Title.mp3"), F.col("p"))), p=["Artist", "Best Album"]) > 0.7
    assert value(spark, names.music_score(names.music_name(F.lit("Unknown Artist - Mystery.mp3"), F.col("p"))), p=[]) < 0.6
    m = value(spark, names.music_name(F.lit("01 - Song Name"), F.col("p")), p=[])
    assert (m.track, m.title, m.artist) == ("01", "Song Name", None)
    assert value(spark, names.music_name(F.lit("A feat. B – C — Remix"), F.col("p")), p=[]).artist == "A"


def test_folders(spark):
    got = value(spark, names.canonical_title(F.lit("The Matrix (1999)")))
    assert (got.title, got.year, got.canonical) == ("The Matrix", 1999, True)
    assert value(spark, names.canonical_title(F.lit("Old (1850)"))).canonical is False
    assert [value(spark, names.folder_kind(F.lit(n), F.lit(v))) for n, v in (("The Matrix (1999)", 1), ("Season 01", 0), ("Show S01E02", 1), ("Empty", 0), ("Two", 2), ("Extras", 1))] == ["movie", "series", "series", "other", "other", "other"]
    assert [tuple(value(spark, names.season_number(F.lit(n)))) for n in ("Season 01", "s02", "Specials", "Extras")] == [(1, True), (2, False), (0, True), (None, False)]
    assert value(spark, names.subtitle_languages(F.col("x")), x=["a.en.srt", "a.DE.srt", "a.srt", "b.en.ass"]) == ["de", "en"]


def test_readers(spark):
    assert value(spark, readers.csv_header(F.lit(" a, ,b\n1,2,3"))) == ["a", "b"]
    assert value(spark, readers.json_keys(F.lit('{"a": 1, "b": 2}'))) == ["a", "b"]
    assert value(spark, readers.json_keys(F.lit('[{"x": 1}, 2]'))) == ["x"]
    assert value(spark, readers.json_keys(F.lit('junk {"y": 1} tail'))) == ["y"]
    lines = "\n".join(map(str, range(40)))
    got = value(spark, readers.line_sample(F.lit(lines))).split("\n")
    assert got[:5] == list("01234") and got[-3:] == ["37", "38", "39"] and got.count("…") == 2
    assert value(spark, readers.looks_binary(F.lit(b"abc\0def"))) is True and value(spark, readers.looks_binary(F.lit(b"plain text\n" * 9))) is False
    df = readers.with_optional(spark.range(1), {"ID": "long", "year": "int"})
    assert df.dtypes == [("id", "bigint"), ("year", "int")]


def test_a_header_is_parsed_once(spark):
    header = readers.csv_header(F.col("t"))
    rows = spark.createDataFrame([("a, b\r\nd,e",)], "t string").select(F.array_join(header, "|").alias("h"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("csv") == 1
    assert rows.first().h == "a|b"
    odd = [bytes(range(32)) + b"x" * 20, b"\t\n\r" * 40, b"\x7f" * 17 + b"\xff" * 34, b"\x01" * 17 + "é".encode() * 17]
    assert [value(spark, readers.looks_binary(F.lit(b))) for b in odd] == [True, False, False, False]


def test_a_probe_is_read_once(spark):
    from skein.functions import media

    rows = spark.createDataFrame([('{"media": {"track": {"@type": "Video", "Format": "AVC", "Width": "1 920"}}}',)], "p string").select(media.probe_details(F.col("p")).alias("m")).select("m.*")
    assert rows._jdf.queryExecution().analyzed().toString().count("get_json_object") <= 5
    assert rows.first()[:3] == ("AVC", 1920, None)


def test_bits_of_a_derived_vector_take_it_once(spark):
    """The vector stands outside the walk over the bits, which would make it anew for each."""
    derived = F.transform("x", lambda v: v + F.lit(1234.5))
    plan = spark.createDataFrame([([1.0],)], "x array<double>").select(vectors.sign_bits(derived)).toDF("b")._jdf.queryExecution().optimizedPlan().toString()
    walk = plan[plan.index("aggregate(") :].split("array(transform(")[0]
    assert plan.count("1234.5") == 1 and "1234.5" not in walk
