"""Columns of probe JSON, review bundles, candidate scores and features."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import bound
from .text import json_dict, json_list

# Names by which a probe's tracks and codecs go, keys of external ids, score parts of a proposal.
TYPE_KEYS, CODEC_KEYS = ("@type", "Type"), ("Format", "CodecID", "CodecID/String")
CONFIRMED_KEYS = ("tmdb", "tmdb_id", "imdb", "imdb_id", "tvdb", "tvdb_id")
TMDB_PART, IMDB_PART, SNIPPET_PART, PLOT_PART = 0.25, 0.15, 0.1, 0.2


def digits(value: Column) -> Column:
    """The digits of a text as a number, null without any."""
    return F.regexp_replace(value, "[^0-9]", "").try_cast("long")


def probe_details(probe: Column) -> Column:
    """Struct of codecs, size, streams and seconds from a probe's JSON; nulls for anything unreadable.

    Tracks are a list or a single object under ``media.track``, or a list under ``track``. Durations are milliseconds. The JSON is read once.
    """
    kind = "array<map<string,string>>"
    one = F.get_json_object(probe, "$.media.track")
    listed = F.when(F.trim(one).startswith("["), F.from_json(one, kind)).when(one.isNotNull(), F.array(F.from_json(one, "map<string,string>")))
    tracks = F.coalesce(listed, F.from_json(F.get_json_object(probe, "$.track"), kind))
    return bound(F.filter(tracks, lambda t: t.isNotNull()), _track_details)


def _track_details(tracks: Column) -> Column:
    def first_key(t: Column, keys: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.nullif(F.get(F.array(t[k]), F.lit(0)), F.lit("")) for k in keys])

    def of(name: str) -> Column:
        return F.filter(tracks, lambda t: F.lower(first_key(t, TYPE_KEYS)) == name)

    def first(column: Column, value) -> Column:
        return F.get(F.filter(F.transform(column, value), lambda x: x.isNotNull()), F.lit(0))

    video, audio = of("video"), of("audio")
    timed = F.filter(tracks, lambda t: F.lower(first_key(t, TYPE_KEYS)).isin("video", "audio", "general"))
    millis = lambda t: F.when(t["Duration"].try_cast("double") > 0, F.bround(t["Duration"].try_cast("double") / 1000, 3))
    some = F.size(tracks) > 0
    return F.struct(
        first(video, lambda t: first_key(t, CODEC_KEYS)).alias("codec_video"),
        first(video, lambda t: digits(t["Width"])).alias("width"),
        first(video, lambda t: digits(t["Height"])).alias("height"),
        first(audio, lambda t: first_key(t, CODEC_KEYS)).alias("codec_audio"),
        F.when(some, F.size(audio)).alias("audio_streams"),
        F.when(some, F.size(video)).alias("video_streams"),
        first(timed, millis).alias("duration_seconds"),
    )


def truthy(value: Column) -> Column:
    """Whether a JSON value, as text, is neither null, empty, false nor zero."""
    return F.coalesce(~value.isin("", "null", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def has_confirmed_id(value: Column) -> Column:
    """Whether the ``ids`` object of a JSON object, or the object itself without one, has an id that isn't empty."""
    ids = F.get_json_object(value, "$.ids")
    of = json_dict(F.when(ids.startswith("{"), ids).otherwise(value))
    return F.exists(F.array(*map(F.lit, CONFIRMED_KEYS)), lambda k: truthy(F.try_element_at(of, k)))


def whole_numbers(value: Column) -> Column:
    """The items of a JSON array that read as integers."""
    return F.filter(F.transform(json_list(value), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def default_candidate(ids: Column, title: Column) -> Column:
    """A candidate from known ids: 0.6 with the first kind of id, 0.4 with the second alone, null without."""
    known = json_dict(ids)
    a, b = (F.coalesce(*[F.when(truthy(F.try_element_at(known, F.lit(k))), F.try_element_at(known, F.lit(k))) for k in keys]) for keys in (("tmdb_episode_id", "tmdb_id"), ("imdb_episode_id", "imdb_id")))
    return F.when(a.isNotNull() | b.isNotNull(), F.struct(a.alias("tmdb_id"), b.alias("imdb_id"), title.alias("title"), F.when(a.isNotNull(), 0.6).otherwise(0.4).alias("score")))


def proposal_score(confidence: Column, tmdb_id: Column, imdb_id: Column, snippet: Column, plot_score: Column) -> Column:
    """Confidence with a part for each kind of evidence that is there."""
    there = lambda c, part: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", part).otherwise(0.0)
    plot = F.when(F.coalesce(plot_score, F.lit(0.0)) != 0, F.least(F.lit(PLOT_PART), plot_score / 10)).otherwise(0.0)
    return F.coalesce(confidence, F.lit(0.0)) + there(tmdb_id, TMDB_PART) + there(imdb_id, IMDB_PART) + there(snippet, SNIPPET_PART) + plot


def review_reasons(reasons: Column, kind: Column) -> Column:
    """A score's reasons, and the kind of the folder unless it is a movie."""
    said = F.when(kind != "movie", F.format_string("Classified as %s based on folder contents.", kind))
    return F.array_compact(F.concat(reasons, F.array(said)))


def review_questions(candidate_id: Column, title: Column, source: Column, has_ids: Column, folder: Column) -> Column:
    """What a reviewer is asked about a folder: structs of action, label, candidate_id, source and query."""

    def ask(action: str, label: Column, *rest: Column) -> Column:
        a, b, c = rest or (F.lit(None),) * 3
        return F.struct(F.lit(action).alias("action"), label.alias("label"), a.cast("string").alias("candidate_id"), b.cast("string").alias("source"), c.cast("string").alias("query"))

    none = F.lit(None)
    confirm = F.when(F.coalesce(candidate_id, F.lit("")) != "", ask("confirm_candidate", F.concat(F.lit("Confirm "), F.coalesce(title, candidate_id)), candidate_id, source, none))
    nfo = F.when(has_ids, ask("review_nfo", F.lit("Inspect existing .nfo metadata")))
    search = F.when(source.isNotNull(), ask("alt_tmdb_search", F.lit("Search TMDb with alternative title"), none, none, F.coalesce(title, folder)))
    return F.array_compact(F.array(confirm, nfo, ask("open_folder", F.lit("Open folder")), search))


def review_bundle(score: Column, reasons: Column, suggestions: Column, threshold: float = 0.5) -> Column:
    """Struct of needs_review, reasons and distinct suggestions, both empty at or above the threshold."""
    low = score < threshold
    none = F.array().cast("array<string>")
    said = F.format_string(f"confidence %.2f below {threshold:.2f}", F.bround(score, 2))
    return F.struct(
        low.alias("needs_review"),
        F.when(low, F.concat(F.array(said), reasons)).otherwise(none).alias("reasons"),
        F.when(low, F.array_distinct(F.array_compact(suggestions))).otherwise(none).alias("suggestions"),
    )


def feature_map(numbers: dict[str, Column], classes: dict[str, Column]) -> Column:
    """Named features: numbers that are there, and ``name=value`` as 1.0 for each class that is."""
    dense = F.create_map(*[x for k, c in numbers.items() for x in (F.lit(k), c.cast("double"))])
    sparse = F.map_from_entries(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.concat(F.lit(f"{k}="), c.cast("string")), F.lit(1.0))) for k, c in classes.items()])))
    return F.map_filter(F.map_concat(dense, sparse), lambda _, v: v.isNotNull())


def local_time(value: Column) -> Column:
    """Seconds or an ISO text as ``yyyy-MM-dd HH:mm`` of the session's zone; other text as it is; a dash for nothing."""
    text = F.trim(value)
    at = F.coalesce(F.timestamp_seconds(text.try_cast("double")), F.try_to_timestamp(text))
    return F.when(F.coalesce(text, F.lit("")) == "", "—").otherwise(F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm"), text))


def with_key_set(blob: Column, key: str, value: Column) -> Column:
    """A JSON object with ``key`` set where it is missing or empty; all other values keep their types and places.

    Nested objects have their keys in order of name. Anything but an object counts as an empty one. A value that is there, neither null, false, 0 nor empty, stays.
    """
    kind = "map<string,variant>"
    old = F.coalesce(F.from_json(blob, kind), F.create_map().cast(kind))
    missing = ~truthy(F.try_element_at(json_dict(blob), F.lit(key)))
    there = F.transform_values(old, lambda k, v: F.when(k == key, value.cast("variant")).otherwise(v))
    made = F.when(F.map_contains_key(old, key), there).otherwise(F.map_concat(old, F.create_map(F.lit(key), value.cast("variant"))))
    return F.when(missing, F.to_json(made)).otherwise(blob)


def first_level_keys(text: Column) -> Column:
    """Top-level keys of the first document of a YAML text, in order: plain or quoted before a colon at the start of a line, or those
    of a mapping in braces. Comments, list items and what is indented have none."""
    documents = F.filter(F.split(text, r"(?m)^(?:---|\.\.\.)[^\r\n]*(?:\r?\n|$)"), lambda x: F.regexp_replace(x, r"(?m)^\s*(?:#.*)?$", "").rlike(r"\S"))
    body = F.coalesce(F.get(documents, F.lit(0)), F.lit(""))
    lines = F.regexp_extract_all(body, F.lit(r"(?m)^(\"[^\"\r\n]*\"|'[^'\r\n]*'|[^\s#'\"\[\]{},&*!|>%@-][^:#\r\n]*?|-[^\s:][^:\r\n]*?)\s*:(?:\s|$)"), 1)
    inner = F.regexp_replace(F.trim(body), r"^\{|\}$", "")
    for _ in range(3):
        inner = F.regexp_replace(inner, r"\{[^{}]*\}|\[[^\[\]]*\]", "")
    flow = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(F.substring_index(x, ":", 1))), lambda x: x != "")
    found = F.when(F.trim(body).startswith("{"), flow).otherwise(lines)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"^([\"'])(.*)\1$", "$2")))
