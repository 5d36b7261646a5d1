"""Titles from file and folder names, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename

# Audio extensions, words of bracketed tags, dashes, words of guest artists, suspicious names.
AUDIO = "mp3|flac|aac|m4a|wav|ogg|wma|alac|aiff|opus"
TAG_WORDS = "hq|hd|remaster|remix|mix|bonus|live|explicit|clean|single|album|lp|ep|ost|soundtrack|official|lyrics|audio|visualizer|radio|edit|original|version|instrumental|acoustic|demo|cover|extended|reissue|deluxe|mono|stereo|quality|release|group|tag|cd|disc"
SIZE_DIGITS, MEDIA_WORDS = {"p": (3, 4), "kbps": (2, 4)}, ("dvd", "bluray")
DASH = r"\s*[-–—―−]\s*"
GUEST_WORDS = ("feat", "feat.", "featuring", "ft.", "with", "vs.", "x")
ODD_ARTISTS, ODD_TITLES = "unknown|various|untitled", "track|untitled|unknown"
VIDEO = "mp4|mkv|avi|mov|wmv|m4v|ts|m2ts|webm|mpg|mpeg|vob|flv|3gp|ogv|mts|m2t"


def bound(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip_audio_extension(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\.part$", ""), rf"(?i)\.(?:{AUDIO})$", "")


def spaces_for_separators(text: Column) -> Column:
    """Underscores and dots become spaces; a single dot next to a digit, as in ``2.0``, stays."""

    def with_mark(parts: Column, part: Column, i: Column) -> Column:
        after, last = F.get(parts, i + 1), F.size(parts) - 1
        in_run = ((part == "") & (i > 0)) | ((after == "") & (i + 1 < last))
        beside_digit = part.rlike("[0-9]$") | after.rlike("^[0-9]")
        return F.concat(part, F.when(i == last, "").when(beside_digit & ~in_run, ".").otherwise(" "))

    split = F.split(F.translate(text, "_", " "), "[.]")
    marked = bound(split, lambda parts: F.array_join(F.transform(parts, lambda part, i: with_mark(parts, part, i)), ""))
    return F.regexp_replace(marked, r"\s+", " ")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _is_tag(group: Column) -> Column:
    """Whether a word in a pair of brackets names a release rather than a work, or they begin with a resolution, a bit rate or a medium."""

    def test(low: Column) -> Column:
        number = F.regexp_extract(low, "^[0-9]+", 0)
        unit = F.substring(low, F.length(number) + 1, F.length(low))
        begins = F.lit(False)
        for name, (least, most) in SIZE_DIGITS.items():
            begins = begins | (unit.startswith(name) & F.length(number).between(least, most))
        for word in MEDIA_WORDS:
            begins = begins | low.startswith(word)
        return F.exists(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: w.isin(*TAG_WORDS.split("|"))) | begins

    return bound(F.lower(group), test)


def without_tags(text: Column) -> Column:
    """Bracketed tags removed; other brackets become spaces."""
    opened, closed = "\u0002", "\u0003"
    pieces = F.split(F.translate(text, "([{)]}", opened * 3 + closed * 3), opened)

    def outside(piece: Column) -> Column:
        return F.translate(piece, closed, " ")

    def after_bracket(piece: Column) -> Column:
        group = F.substring_index(piece, closed, 1)
        rest = F.substring(piece, F.length(group) + 1, F.length(piece))
        return F.when(F.contains(piece, F.lit(closed)) & _is_tag(group), outside(rest)).otherwise(outside(piece))

    return collapse(F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, outside(x)).otherwise(after_bracket(x))), " "))


def normal_name(text: Column) -> Column:
    return without_tags(spaces_for_separators(strip_audio_extension(text)))


def track_and_rest(name: Column) -> Column:
    """Struct of a leading track number (up to three digits, maybe behind a letter or the word disc) and what follows it."""

    def is_number(word: Column) -> Column:
        return F.regexp_replace(F.lower(word), "^(disc)?[a-z]?", "").rlike("^[0-9]{1,3}$")

    def read(words: Column) -> Column:
        first, second, rest = F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.coalesce(F.get(words, F.lit(2)), F.lit(""))
        spoken = (F.lower(first) == "disc") & is_number(second) & (rest != "")
        plain = is_number(first) & (F.concat(F.coalesce(second, F.lit("")), rest) != "")
        track = F.when(spoken, F.concat_ws(" ", first, second)).when(plain, first)
        at = F.when(spoken, F.length(first) + F.length(second) + 1).when(plain, F.length(first)).otherwise(0)
        return F.struct(track.alias("track"), at.alias("at"))

    found = bound(F.split(name, r"[\s._-]+", 3), read)
    cut = F.regexp_replace(F.substring(name, found["at"] + 1, F.length(name)), r"^[\s._-]+", "")
    return F.struct(found["track"].alias("track"), F.trim(F.when(found["at"] > 0, cut).otherwise(name)).alias("rest"))


def music_name(path: Column, parents: Column) -> Column:
    """Struct of artist, title, album and track from a file name and its folders."""
    folders = F.transform(F.coalesce(parents, F.array().cast("array<string>")), normal_name)
    split = bound(normal_name(basename(path)), track_and_rest)
    return bound(F.struct(split.alias("s"), folders.alias("folders")), lambda x: _music_name(x["s"]["track"], x["s"]["rest"], x["folders"]))


def _music_name(track: Column, rest: Column, folders: Column) -> Column:
    parts = F.filter(F.transform(F.split(rest, DASH, 3), lambda x: F.trim(x)), lambda x: x != "")
    return bound(parts, lambda p: _of_parts(track, rest, p, folders))


def _of_parts(track: Column, rest: Column, parts: Column, folders: Column) -> Column:
    dashed = F.size(parts) >= 2
    first = F.get(parts, F.lit(0))
    words = F.split(first, r"\s+")
    guest = F.array_position(F.transform(words, lambda w: F.lower(w).isin(*GUEST_WORDS)), True).cast("int")
    main = F.when(guest > 0, F.array_join(F.slice(words, F.lit(1), guest - 1), " ")).otherwise(F.trim(first))
    named = F.when(dashed, F.when(main != "", main).otherwise(first))
    title = F.when(dashed, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.lit(1), F.size(parts) - 1)), " - ")).otherwise(F.nullif(F.trim(rest), F.lit("")))
    last = F.try_element_at(folders, F.lit(-1))
    album = F.when((last != "") & (F.lower(last) != F.lower(F.coalesce(named, F.lit("")))), last)
    others = F.filter(F.reverse(folders), lambda x: (x != "") & (F.lower(x) != F.lower(F.coalesce(album, F.lit("")))))
    parent = F.get(others, F.lit(0))
    return F.struct(
        F.coalesce(named, parent).alias("artist"),
        title.alias("title"),
        album.alias("album"),
        track.alias("track"),
        dashed.alias("dashed"),
        (named.isNull() & parent.isNotNull()).alias("from_parent"),
        F.coalesce(F.lower(named) == F.lower(parent), F.lit(False)).alias("parent_match"),
    )


def music_score(m: Column) -> Column:
    """Confidence of a parsed name: a base, bonuses for what is there, penalties for what is missing or odd."""
    artist, title = m.getField("artist"), m.getField("title")
    bonus = lambda test, value: F.when(test, value).otherwise(0.0)
    score = F.lit(0.4) + bonus(artist.isNotNull() & title.isNotNull(), 0.3) + bonus(m.getField("track").isNotNull(), 0.05) + bonus(m.getField("album").isNotNull(), 0.05)
    score = score + bonus(m.getField("dashed"), 0.1) + bonus(m.getField("parent_match"), 0.05)
    score = score - F.when(artist.isNull(), 0.2).when(F.lower(artist).rlike(ODD_ARTISTS), 0.25).otherwise(0.0)
    score = score - F.when(title.isNull(), 0.2).when(F.lower(title).rlike(ODD_TITLES), 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def canonical_title(folder: Column) -> Column:
    """Struct of title, year and whether the name is ``Title (YYYY)`` with a year from 1900 to 2100."""
    pattern = r"^(.+?)\s*\((\d{4})\)$"
    year = F.regexp_extract(folder, pattern, 2).try_cast("int")
    fits = F.coalesce(year.between(1900, 2100), F.lit(False))
    return F.struct(F.when(fits, F.trim(F.regexp_extract(folder, pattern, 1))).alias("title"), F.when(fits, year).alias("year"), fits.alias("canonical"))


def folder_kind(name: Column, videos: Column) -> Column:
    """series, movie or other, from a folder's name and its number of videos."""
    low = F.lower(name)
    series = F.regexp_replace(low, r"\s", "").rlike(r"s\d{1,2}e\d{1,2}") & (low.rlike(r"s\d{1,2}e\d{1,2}") | (videos >= 2))
    return F.when(series | F.contains(low, F.lit("season")), "series").when(videos != 1, "other").when(low.rlike("extras|featurette"), "other").otherwise("movie")


def season_number(name: Column) -> Column:
    """Struct of number (specials: 0) and whether the folder's name is ``Season N`` or specials."""
    clean = F.trim(F.translate(F.lower(name), "_-", "  "))
    long_, short = F.regexp_extract(clean, r"^season\s*(\d{1,3})$", 1).try_cast("int"), F.regexp_extract(clean, r"^s(\d{1,3})$", 1).try_cast("int")
    specials = clean.rlike(r"^(season\s+)?specials?$")
    return F.struct(F.coalesce(F.when(specials, 0), long_, short).alias("number"), (specials | long_.isNotNull()).alias("canonical"))


def subtitle_languages(files: Column) -> Column:
    """Distinct two or three letter suffixes before the subtitle's extension, sorted."""
    found = F.transform(files, lambda f: F.regexp_extract(F.lower(f), r"\.([a-z]{2,3})\.(?:srt|sub|idx|ssa|ass|vtt)$", 1))
    return F.sort_array(F.array_distinct(F.filter(found, lambda x: x != "")))
