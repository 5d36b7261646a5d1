"""Enrichment steps: content for an index, folder profiles, quality rows, text previews, verification, frame times."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, scores, text

HIGH_MATCH, MIDDLE_MATCH, LOW_MATCH = 0.80, 0.65, 0.40


def index_content(rows: DataFrame, key: str, fields: list[str], meta: list[str]) -> DataFrame:
    """(key, content, metadata): non-empty fields joined by a space and a line feed, and a JSON object."""
    kept = F.filter(F.array(*[F.trim(F.col(f).cast("string")) for f in fields]), lambda x: x.isNotNull() & (x != ""))
    return rows.select(key, F.array_join(kept, " \n").alias("content"), F.to_json(F.struct(*meta)).alias("metadata"))


def hashed_words(docs: DataFrame, key: str, body: str, size: int = 256) -> DataFrame:
    """(key, vector): counts of hashed words of each text, scaled to length one; texts without words are left out.

    Counts come from each text's own sorted slots, so no word is shuffled.
    """
    slot = lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int") % size).cast("int")

    def dense(x: Column) -> Column:
        runs, norm = x["runs"], x["norm"]
        gap = lambda r, i: r["w"] - F.when(i == 0, -1).otherwise(F.get(runs, i - 1)["w"]) - 1
        filled = F.transform(runs, lambda r, i: F.concat(F.array_repeat(F.lit(0.0), gap(r, i)), F.array(r["n"] / norm)))
        last = F.get(runs, F.size(runs) - 1)["w"]
        return F.concat(F.flatten(filled), F.array_repeat(F.lit(0.0), size - 1 - last))

    slots = docs.select(key, text.runs(F.sort_array(F.transform(text.tokens(F.col(body)), slot))).alias("r"))
    norm = F.sqrt(F.aggregate("r", F.lit(0.0), lambda s, r: s + r["n"] * r["n"]))
    return slots.where(F.size("r") > 0).select(key, names.bound(F.struct(F.col("r").alias("runs"), norm.alias("norm")), dense).alias("vector"))


def folder_profiles(files: DataFrame) -> DataFrame:
    """(folder, kind, title, year, canonical, issues, confidence) of files (folder, name, kind, size_bytes)."""
    is_video, is_nfo = F.col("kind") == "video", F.lower("name").endswith(".nfo")
    counts = files.groupBy("folder").agg(
        F.count_if(is_video).alias("videos"),
        F.count_if(is_nfo).alias("nfos"),
        F.max_by(F.when(is_video, F.col("name")), F.when(is_video, F.struct("size_bytes", "name"))).alias("main_video"),
    )
    named = counts.withColumn("c", names.canonical_title(F.col("folder"))).withColumn("kind", names.folder_kind(F.col("folder"), F.col("videos")))
    issues = F.array_compact(
        F.array(
            F.when(F.col("videos") == 0, F.lit("no_primary_video")),
            F.when(F.col("videos") > 1, F.concat(F.lit("multiple_primary_videos:"), F.col("videos").cast("string"))),
            F.when(F.col("nfos") == 0, F.lit("missing_nfo")),
            F.when(~F.col("c.canonical") & (F.col("kind") == "movie"), F.lit("missing_canonical_pattern")),
        )
    )
    whole = F.col("c.canonical") & (F.col("videos") == 1)
    no = F.lit(False)
    confidence = scores.folder_confidence(whole, F.col("nfos") > 0, no, F.lit(0.0), no, F.col("issues"))
    out = named.withColumn("issues", issues)
    return out.select("folder", "kind", F.col("c.title").alias("title"), F.col("c.year").alias("year"), whole.alias("canonical"), "main_video", "issues", confidence.alias("confidence"))


def quality_rows(files: DataFrame, score: Column) -> DataFrame:
    """Files with a score, 0 and a status where the probe failed (``probe_ok``)."""
    return files.withColumn("score", F.when(F.col("probe_ok"), score).otherwise(0)).withColumn("status", F.when(F.col("probe_ok"), "ok").otherwise("probe_failed"))


def text_previews(docs: DataFrame, key: str, body: str, k: int = 4) -> DataFrame:
    """(key, bytes, lines, keywords) of texts; keywords without a shuffle, from each text's own words."""
    top = F.transform(F.slice(text.counted(text.tokens(F.col(body), 3)), 1, k), lambda s: s["w"])
    return docs.select(key, F.octet_length(body).alias("bytes"), F.size(F.split(body, "\n")).alias("lines"), top.alias("keywords"))


def verified(pairs: DataFrame, semantic: Column, entities: Column, keywords: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Pairs with a weighted match and what follows from it: a large boost, a small one, nothing, or a flag."""
    match = scores.weighted_mean(dict(zip(weights, (semantic, entities, keywords))))
    out = pairs.withColumn("match", match)
    m = F.col("match")
    return out.withColumn("action", F.when(m >= HIGH_MATCH, "boost").when(m >= MIDDLE_MATCH, "nudge").when(m < LOW_MATCH, "flag").otherwise("keep"))


def frame_times(scenes: Column, seconds: Column, budget: int) -> Column:
    """Midpoints of scenes (start, end), or else evenly spaced times; rounded to hundredths, distinct, at most ``budget``.

    Rounding is that of doubles: a time times 100 to the nearest whole number, halves to the even one. By its decimal digits 1.015 would be a
    half, though the double lies below it.
    """
    middles = F.transform(scenes, lambda s: (s["start"] + s["end"]) / 2)
    even = F.transform(F.sequence(F.lit(1), F.lit(budget)), lambda k: seconds * k / (budget + 1))
    return F.slice(F.array_distinct(F.transform(F.when(F.size(scenes) > 0, middles).otherwise(even), lambda t: F.rint(t * 100) / 100)), 1, budget)


def first_number(*columns: Column) -> Column:
    """The first column that reads as a number."""
    return F.coalesce(*[c.try_cast("double") for c in columns])


def best_candidates(candidates: Column, n: int = 5) -> Column:
    """The ``n`` candidates (structs whose first field is the score) with the largest scores."""
    return F.slice(F.sort_array(candidates, asc=False), 1, n)


def kept_and_removed(every: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """All keys that are not kept."""
    return every.select(key).join(kept.select(key).distinct(), key, "left_anti")


def unresolved_items(movies: DataFrame, episodes: DataFrame) -> DataFrame:
    """Two kinds of rows (path, ids) without a known id, with their kind."""
    one = lambda df, kind: df.where(~text.has_known_id(F.col("ids"))).select(F.lit(kind).alias("kind"), "path")
    return one(movies, "movie").unionByName(one(episodes, "episode"))


def capped_union(parts: list[DataFrame], caps: list[int], chars: int = 2000) -> DataFrame:
    """(doc_id, text) of several sources, each cut to its cap by id, texts to ``chars`` characters; caps are the feature."""
    cut = [p.select("doc_id", F.substring("text", 1, chars).alias("text")).orderBy("doc_id").limit(n) for p, n in zip(parts, caps)]
    out = cut[0]
    for p in cut[1:]:
        out = out.unionByName(p)
    return out
