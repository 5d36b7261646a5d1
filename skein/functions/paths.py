"""Column expressions on paths, names and sizes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category by extension, and by MIME type or its prefix.
CATEGORY_BY_EXTENSION = {
    "video": "mp4 mkv avi mov wmv m4v ts m2ts webm mpg mpeg vob flv 3gp ogv mts",
    "audio": "mp3 flac aac m4a wav wma ogg opus alac aiff ape dsf dff",
    "image": "jpg jpeg png gif bmp tiff webp heic",
    "document": "pdf doc docx ppt pptx xls xlsx txt rtf odt ods odp",
    "archive": "zip rar 7z gz bz2 xz tar iso",
    "executable": "exe msi apk bat cmd sh app pkg",
}
CATEGORY_BY_MIME_PREFIX = {"video/": "video", "audio/": "audio", "image/": "image", "text/": "document"}
CATEGORY_BY_MIME = {
    "document": "application/pdf application/msword application/vnd.openxmlformats-officedocument application/vnd.ms-powerpoint application/vnd.ms-excel",
    "executable": "application/vnd.android.package-archive application/x-dosexec application/x-msi application/x-sh",
    "archive": "application/zip application/x-7z-compressed application/x-rar application/x-rar-compressed application/x-tar application/gzip application/x-bzip2 application/x-xz",
}
UNITS = ("KB", "MB", "GB", "TB", "PB")


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """A literal map from each word of the values to its key, applied to ``key``."""
    pairs = [F.lit(x) for name, words in mapping.items() for word in words.split() for x in (word, name)]
    return F.try_element_at(F.create_map(*pairs), key)


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    """Last segment, whichever slash separates."""
    return F.element_at(F.split(slashes(path), "/"), -1)


def parent_folder(path: Column, depth: int = 0) -> Column:
    """The first ``depth`` folders of a path (0: all of them), without its last segment.

    A root (``/``, a drive letter or a UNC share) counts as no folder and stays in front.
    """
    plain = slashes(path)
    root = F.regexp_extract(plain, r"^(//[^/]+/[^/]+/?|[A-Za-z]:/?|/)", 1)
    segments = F.split(F.substr(plain, F.length(root) + 1), "/")
    parents = F.filter(F.slice(segments, F.lit(1), F.size(segments) - 1), lambda s: s != "")
    cut = F.slice(parents, 1, depth) if depth else parents
    return F.concat(root, F.array_join(cut, "/"))


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty if there is none or the name begins with its only dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def report_extension(value: Column) -> Column:
    """Extension as reports show it: lower-case, with a dot if short; empty and null stay null."""
    bare = F.lower(F.trim(value))
    return F.when(bare == "", None).when(bare.startswith("."), bare).when(F.length(bare) <= 6, F.concat(F.lit("."), bare)).otherwise(bare)


def category(ext: Column, mime: Column) -> Column:
    """Category by extension, then by exact MIME type, then by its first part; else other."""
    low = F.lower(mime)
    prefix = F.coalesce(*[F.when(low.startswith(p), F.lit(c)) for p, c in CATEGORY_BY_MIME_PREFIX.items()])
    return F.coalesce(lookup(CATEGORY_BY_EXTENSION, F.lower(ext)), lookup(CATEGORY_BY_MIME, low), prefix, F.lit("other"))


def human_size(size: Column) -> Column:
    """Size in binary units with one decimal, ties to even; whole bytes below 1 KB, ``0 B`` for null and nothing."""
    out = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS, 1):
        value = F.format_string("%.1f " + unit, F.bround(size.cast("double") / float(1024**k), 1))
        out = F.when(size >= 1024**k, value).otherwise(out)
    return F.when(F.coalesce(size, F.lit(0)) <= 0, F.lit("0 B")).otherwise(out)


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Whether the path or its last segment fits a glob (``*``, ``?``)."""
    import re

    out = F.lit(False)
    for p in patterns:
        regex = "^" + "".join({"*": ".*", "?": "."}.get(x, re.escape(x)) for x in p) + "$"
        out = out | slashes(path).rlike(regex) | basename(path).rlike(regex)
    return out


def hidden(path: Column) -> Column:
    return basename(path).startswith(".")


def safe_name(value: Column) -> Column:
    """Letters, digits, dot, dash and underscore; runs of anything else become one underscore."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9._-]+", "_")


def media_token(drive: Column, kind: Column, key: Column) -> Column:
    """URL-safe base64 of a JSON object, unpadded."""
    raw = F.to_json(F.struct(drive.alias("drive"), kind.alias("type"), key.alias("key")))
    return F.rtrim(F.translate(F.base64(raw.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def media_token_parts(token: Column) -> Column:
    """drive, type and key of a token; null for anything else."""
    plain = F.translate(token, "-_", "+/")
    padded = F.rpad(plain, F.length(plain) + F.pmod(-F.length(plain), F.lit(4)), "=")
    return F.from_json(F.when(token.rlike("^[A-Za-z0-9_-]+$"), F.try_to_binary(padded, F.lit("base64")).cast("string")), "drive string, type string, key string")


def item_parts(item: Column) -> Column:
    """``kind:drive:key`` as an array of three, null if it isn't one."""
    parts = F.split(item, ":", 3)
    return F.when(F.size(parts) == 3, parts)
