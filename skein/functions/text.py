"""Column expressions on texts, lists, JSON and dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[A-Za-z0-9]+"
ID_KEYS = ("tmdb", "imdb", "tvdb", "tmdb_id", "imdb_id", "tvdb_id", "omdb")


def split_list(value: Column) -> Column:
    """``;`` or ``,`` separated items, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-case ASCII words of at least ``least`` characters."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) >= least)


def runs(ordered: Column) -> Column:
    """(n, w, at) of each stretch of equal items of an array, in order: how many, which, and its place from 0."""

    def cut(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: (i == 0) | (i == F.size(w)) | (F.get(w, i) != F.get(w, i - 1)))
        stretch = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda j: F.struct((F.get(s, j + 1) - F.get(s, j)).alias("n"), F.get(w, F.get(s, j)).alias("w"), F.get(s, j).alias("at")))
        return F.get(F.transform(F.array(starts), stretch), F.lit(0))

    return F.get(F.transform(F.array(ordered), lambda w: F.when(F.size(w) > 0, cut(w)).otherwise(F.filter(F.transform(w, lambda x: F.struct(F.lit(0).alias("n"), x.alias("w"), F.lit(0).alias("at"))), lambda r: r["n"] > 0))), F.lit(0))


def counted(words: Column) -> Column:
    """(n: minus the count, w) of each distinct word, most frequent first, ties in word order; null words count as none.

    Run lengths over the sorted words, so the time is that of sorting them.
    """
    found = runs(F.sort_array(F.array_compact(F.coalesce(words, F.array().cast("array<string>")))))
    return F.sort_array(F.transform(found, lambda r: F.struct((-r["n"]).alias("n"), r["w"].alias("w"))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common distinct items; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def json_list(value: Column) -> Column:
    """Items of a JSON array as texts, nulls dropped; empty for anything else."""
    return F.array_compact(F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>")))


def json_dict(value: Column) -> Column:
    """A JSON object as a map of texts; empty for anything else."""
    return F.coalesce(F.from_json(value, "map<string,string>"), F.create_map().cast("map<string,string>"))


def list_or_commas(value: Column) -> Column:
    """A JSON array, or else comma separated items."""
    return F.when(F.trim(value).startswith("["), json_list(value)).otherwise(split_list(value))


def truthy_keys(value: Column) -> Column:
    """Keys of a JSON object whose values are neither null, false, 0 nor empty, sorted."""
    return F.sort_array(F.map_keys(F.map_filter(json_dict(value), lambda k, v: v.isNotNull() & ~v.isin("", "false", "0", "0.0", "[]", "{}"))))


def has_known_id(value: Column) -> Column:
    """Whether a JSON object, or its ``ids`` object, has a non-blank id."""
    found = F.lit(False)
    for key in ID_KEYS:
        for path in (f"$.{key}", f"$.ids.{key}"):
            found = found | (F.trim(F.coalesce(F.get_json_object(value, path), F.lit(""))) != "")
    return found


def distinct_ignoring_case(items: Column) -> Column:
    """Non-blank items, the first spelling of each, in order."""
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    low = F.transform(kept, F.lower)
    return F.filter(kept, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def capitalised(text: Column) -> Column:
    """Distinct lower-cased capitalised words of over two letters, sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z][a-z]+)\b"), 1)
    return F.sort_array(F.array_distinct(F.filter(F.transform(found, F.lower), lambda t: F.length(t) > 2)))


def iso_utc(ts: Column) -> Column:
    """ISO text with seconds and Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """Timestamp of an ISO text; one without a zone is UTC, the session's zone; null if it can't be read."""
    return F.try_to_timestamp(text)


def air_year(date: Column) -> Column:
    """Year at the start of a date text, 0 if there is none."""
    return F.coalesce(F.substring(date, 1, 4).try_cast("int"), F.lit(0))


def lag_ms(now: Column, ts: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.unix_millis(now) - F.unix_millis(ts))


def reasons_text(value: Column) -> Column:
    """Reasons as one text: ``key=value`` of each true entry of an object, the items of an array, joined by ``; ``; other texts as they are, blank ones null."""
    trimmed = F.trim(value)
    entries = F.sort_array(F.map_entries(F.map_filter(json_dict(value), lambda _, v: v.isNotNull() & ~v.isin("", "false", "0", "0.0", "[]", "{}"))))
    pairs = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    listed = F.array_join(json_list(value), "; ")
    readable = F.try_parse_json(value).isNotNull()
    return F.nullif(F.when(readable & trimmed.startswith("{"), pairs).when(readable & trimmed.startswith("["), listed).otherwise(trimmed), F.lit(""))


def count_list(value: Column) -> Column:
    """Items of a JSON array, 0 for anything else."""
    return F.coalesce(F.json_array_length(F.when(F.try_parse_json(value).isNotNull(), value)), F.lit(0))


def signal(features: Column, key: str) -> Column:
    """A feature of a JSON object as a number, 0.0 where it is missing or none."""
    return F.coalesce(F.get_json_object(F.when(F.try_parse_json(features).isNotNull(), features), f"$.{key}").try_cast("double"), F.lit(0.0))


def numeric_features(value: Column) -> Column:
    """A JSON object's entries that are numbers, as a map; null for anything but an object."""
    numbers = F.transform_values(json_dict(value), lambda _, v: v.try_cast("double"))
    return F.when(F.trim(value).startswith("{") & F.try_parse_json(value).isNotNull(), F.map_filter(numbers, lambda _, v: v.isNotNull()))
