"""Video quality from probe JSON: streams, a score with its reasons, a resolution label, and the stored table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.names import bound
from .joins import stale
from .upserts import replace_by_key

# Greatest heights of the labels, and two-letter codes of languages by the three-letter ones.
LABELS, TALLEST, TALLEST_LABEL, BETWEEN = ((576, "<=480p"), (800, "720p"), (1200, "1080p")), 1600, "2160p", "1440p"
LANGUAGES = {
    "ar": "ara", "bg": "bul", "bn": "ben", "ca": "cat", "cs": "ces cze", "da": "dan", "de": "deu ger", "el": "ell gre", "en": "eng", "es": "spa", "et": "est", "fa": "fas per", "fi": "fin",
    "fr": "fra fre", "ga": "gle", "he": "heb", "hi": "hin", "hr": "hrv", "hu": "hun", "id": "ind", "is": "isl ice", "it": "ita", "ja": "jpn", "ko": "kor", "lt": "lit", "lv": "lav", "ms": "msa may",
    "nl": "nld dut", "no": "nor", "pl": "pol", "pt": "por", "ro": "ron rum", "ru": "rus", "sk": "slk slo", "sl": "slv", "sr": "srp", "sv": "swe", "ta": "tam", "te": "tel", "th": "tha", "tr": "tur",
    "uk": "ukr", "ur": "urd", "vi": "vie", "zh": "zho chi",
}
LEAST_MEGAPIXELS, LEAST_CHANNELS = 0.1, 2
STREAM = "struct<codec_type:string,codec_name:string,codec_long_name:string,width:string,height:string,bit_rate:string,avg_frame_rate:string,channels:string,tags:map<string,string>>"
PROBE = f"streams array<{STREAM}>, format struct<format_name:string,format_long_name:string,duration:string,bit_rate:string>"


def language_code(value: Column) -> Column:
    """A language tag as its two-letter code where it has one: ``eng``, ``en-US`` and ``EN`` are ``en``; other tags lose their region."""
    low = F.lower(F.trim(F.translate(value, "_", "-")))
    pairs = [F.lit(x) for two, threes in LANGUAGES.items() for three in threes.split() for x in (three, two)]
    known = lambda first: F.coalesce(F.try_element_at(F.create_map(*pairs), first), F.substring(first, 1, 3))
    return bound(F.substring_index(low, "-", 1), lambda first: F.when(first != "", known(first)))


def _whole(value: Column) -> Column:
    return value.try_cast("double").cast("long")


def streams(probe: Column) -> Column:
    """Struct of container, duration_s, kbps, width, height, video_codec, frame rate, audio and subtitle streams of a probe's JSON; null if it can't be read.

    The first video stream counts. A stream's bit rate is taken as it stands, the container's in thousands.
    """

    def read(p: Column) -> Column:
        every = F.coalesce(p["streams"], F.array().cast(f"array<{STREAM}>"))
        of = lambda kind: F.filter(every, lambda s: F.lower(s["codec_type"]) == kind)
        codec = lambda s: F.coalesce(F.nullif(s["codec_name"], F.lit("")), s["codec_long_name"])
        tag = lambda s: F.coalesce(*[F.nullif(F.try_element_at(s["tags"], F.lit(k)), F.lit("")) for k in ("language", "LANGUAGE", "lang")])
        whole = _whole(p["format"]["bit_rate"])
        made = lambda video: F.struct(
            F.coalesce(F.nullif(p["format"]["format_name"], F.lit("")), p["format"]["format_long_name"]).alias("container"),
            p["format"]["duration"].try_cast("double").alias("duration_s"),
            F.floor(whole / 1000).alias("container_kbps"),
            _whole(video["width"]).alias("width"),
            _whole(video["height"]).alias("height"),
            _whole(video["bit_rate"]).alias("video_kbps"),
            codec(video).alias("video_codec"),
            video["avg_frame_rate"].alias("frame_rate"),
            F.transform(of("audio"), lambda s: F.struct(codec(s).alias("codec"), _whole(s["channels"]).alias("channels"), language_code(tag(s)).alias("language"))).alias("audio"),
            F.transform(of("subtitle"), lambda s: F.struct(codec(s).alias("codec"), language_code(tag(s)).alias("language"))).alias("subtitles"),
        )
        return bound(F.get(of("video"), F.lit(0)), made)

    parsed = F.from_json(probe, PROBE)
    return F.when(F.try_parse_json(probe).isNotNull(), bound(parsed, read))


def resolution(height: Column) -> Column:
    out = F.when(height >= TALLEST, TALLEST_LABEL).otherwise(BETWEEN)
    for most, label in reversed(LABELS):
        out = F.when(height <= most, label).otherwise(out)
    return F.when(height.isNull(), "unknown").otherwise(out)


def _languages(listed: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(listed, lambda s: s["language"])))


def scored(s: Column, minutes: Column, expect_subs: bool = False, least_channels: int = LEAST_CHANNELS, tolerance: float = scores.RUNTIME_TOLERANCE) -> Column:
    """Struct of score (0 to 100), reasons (what was found, as a struct whose nulls were not) and resolution, from ``streams`` and the expected minutes."""

    def read(x: Column) -> Column:
        megapixels = F.greatest(x["width"], F.lit(1)) * F.greatest(x["height"], F.lit(1)) / 1e6
        kbps = F.when(x["video_kbps"] > 0, x["video_kbps"]).when(x["container_kbps"] > 0, x["container_kbps"])
        dense = kbps / F.greatest(megapixels, F.lit(LEAST_MEGAPIXELS))
        share = dense / scores.KBPS_PER_MEGAPIXEL
        points = F.lit(0)
        for limit, lost in reversed(scores.BITRATE_TIERS):
            points = F.when(share < limit if limit == 1.0 else share <= limit, lost).otherwise(points)
        channels = F.array_max(F.transform(x["audio"], lambda a: a["channels"]))
        few = channels < least_channels
        no_subs = F.lit(expect_subs) & (F.size(x["subtitles"]) == 0)
        expected = minutes * 60.0
        apart = F.abs(x["duration_s"] - expected)
        timed = (minutes > 0) & (x["duration_s"] > 0)
        audio, subs = F.size(_languages(x["audio"])), F.size(_languages(x["subtitles"]))
        lost = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
        late = timed & (apart > tolerance * expected)
        score = 100 - F.coalesce(points, F.lit(0)) - lost(few, scores.LOW_CHANNELS) - lost(no_subs, scores.NO_SUBTITLES) - lost(late, scores.RUNTIME_MISMATCH)
        score = score + lost(audio > 1, scores.MANY_LANGUAGES) + lost(subs > 1, scores.MANY_LANGUAGES)
        label = resolution(x["height"])
        reasons = F.struct(
            F.when(points > 0, F.bround(dense, 1)).alias("low_bitrate_per_mp"),
            F.when(few, channels).alias("audio_channels"),
            F.when(channels.isNull(), True).alias("audio_channels_unknown"),
            F.when(no_subs, True).alias("missing_subs"),
            F.when(late, F.floor(apart)).alias("runtime_mismatch"),
            F.when(timed & ~late, True).alias("runtime_match"),
            F.when(audio > 1, audio).alias("multi_audio_langs"),
            F.when(subs > 1, subs).alias("multi_sub_langs"),
            label.alias("resolution"),
        )
        return F.struct(F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("int").alias("score"), reasons.alias("reasons"), label.alias("resolution"))

    return bound(s, read)


def rows(files: DataFrame, now: Column, expect_subs: bool = False) -> DataFrame:
    """The quality table's rows of files (path, probe, minutes): streams, score and reasons_json; a probe that can't be read scores 0 and says so."""
    probed = files.select("path", streams(F.col("probe")).alias("s"), "minutes")
    out = probed.withColumn("q", scored(F.col("s"), F.col("minutes"), expect_subs))
    ok = F.col("s").isNotNull()
    text = lambda c: F.array_join(c, ",")
    return out.select(
        "path", F.col("s.container").alias("container"), F.col("s.duration_s").alias("duration_s"), F.col("s.width").cast("int").alias("width"), F.col("s.height").cast("int").alias("height"), F.col("s.video_codec").alias("video_codec"),
        F.coalesce("s.video_kbps", "s.container_kbps").cast("int").alias("video_bitrate_kbps"), text(F.array_distinct(F.array_compact(F.transform("s.audio", lambda a: a["codec"])))).alias("audio_codecs"),
        F.array_max(F.transform("s.audio", lambda a: a["channels"])).cast("int").alias("audio_channels_max"), text(_languages(F.col("s.audio"))).alias("audio_langs"), (F.size("s.subtitles") > 0).cast("int").alias("subs_present"),
        text(_languages(F.col("s.subtitles"))).alias("subs_langs"), F.when(ok, F.col("q.score")).otherwise(0).alias("score"),
        F.when(ok, F.to_json("q.reasons")).otherwise('{"probe_error":true}').alias("reasons_json"), now.alias("updated_utc"),
    )


def due(inventory: DataFrame, quality: DataFrame) -> DataFrame:
    """Videos (path, category, indexed_utc, ...) without a row in the quality table, or indexed after it."""
    return stale(inventory.where(F.lower(F.trim(F.coalesce("category", F.lit("")))) == "video"), quality, "path", "indexed_utc", "updated_utc")


def stored(quality: DataFrame | None, made: DataFrame) -> DataFrame:
    """The quality table with the rows of a run in place of older ones of their paths."""
    return made if quality is None else replace_by_key(quality, made, "path")
