"""Folder profiles from listed files: assets, issues, guesses, candidates, confidence with its reasons, and the review queue.

Every step is a table: what a folder holds, what its names suggest, which candidates others know (by title or by a file's head and tail
signature), whether runtimes agree. Signals come from joined tables; a table that isn't given leaves its signal off.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media, names, paths, scores
from .upserts import replace_by_key, review_queue
from .views import fuzzy

# Names of local assets, subtitle extensions, extras that are no issue, words that end a title, reasons.
POSTERS, FANART, NFO = ("poster.jpg", "poster.png", "cover.jpg", "cover.png"), ("fanart.jpg", "fanart.png", "backdrop.jpg", "background.jpg"), ("movie.nfo", "index.nfo")
SUBTITLES, HARMLESS = ("srt", "sub", "idx", "ssa", "ass", "vtt"), ("txt", "jpg", "png")
RELEASE = "480p 576p 720p 1080p 2160p 4k uhd hdr web webrip web-dl hdtv dvd dvdrip bluray bdrip brrip x264 x265 h264 h265 hevc avc xvid divx aac ac3 dts proper repack extended remastered unrated".split()
NO_CANON, NO_IDS, WEAK_NAME = "Folder name does not follow Title (Year) pattern.", "No .nfo file with IDs was detected.", "Name similarity to external candidates is weak."
WEAK, MOST_CANDIDATES, LOW, IMDB_DIGITS = 0.5, 5, 0.50, 7
TEXTS = "array<string>"


def nfo_ids(content: Column) -> Column:
    """Struct of imdb_id and tmdb_id from an .nfo text: the first digits behind a tag's first mention, seven at least for the first kind."""
    low = F.lower(F.coalesce(content, F.lit("")))

    def behind(tag: str, window: int) -> Column:
        at = F.instr(low, tag)
        return F.when(at > 0, F.nullif(F.regexp_extract(F.substr(low, at, F.lit(window)), r"([0-9]+)", 1), F.lit("")))

    imdb = F.coalesce(*[F.when(F.length(d) >= IMDB_DIGITS, F.concat(F.lit("tt"), d)) for d in (behind(t, 128) for t in ("imdbid", "imdb_id", "imdb"))])
    return F.struct(imdb.alias("imdb_id"), F.coalesce(*[behind(t, 96) for t in ("tmdbid", "tmdb_id", "themoviedb")]).alias("tmdb_id"))


def movie_guess(name: Column) -> Column:
    """Struct of title and year from a folder's or file's name: the words ahead of a year or a release word."""
    stem = F.regexp_replace(name, rf"(?i)\.(?:{names.VIDEO})$", "")
    words = F.filter(F.split(stem, r"[\s._()\[\]]+"), lambda w: w != "")

    def read(words: Column) -> Column:
        year = F.transform(words, lambda w, i: (i > 0) & w.rlike("^(19|20)[0-9]{2}$"))
        ends = F.transform(words, lambda w, i: F.get(year, i) | ((i > 0) & F.lower(w).isin(*RELEASE)))
        end = F.coalesce(F.nullif(F.array_position(ends, True), F.lit(0)) - 1, F.size(words)).cast("int")
        at = F.nullif(F.array_position(year, True), F.lit(0)).cast("int")
        return F.struct(F.nullif(F.array_join(F.slice(words, F.lit(1), end), " "), F.lit("")).alias("title"), F.get(words, at - 1).cast("int").alias("year"))

    return names.bound(words, read)


def contents(files: DataFrame) -> DataFrame:
    """One row for each folder of files (folder, name, size_bytes, content: text of .nfo files or null).

    kind, canonical, detected_year, main_video (the largest, then the last by name), videos, assets_json, ids, issues in a fixed order. A folder's path may
    have parents; its last part is its name. Hidden files don't count; a folder without files has no row.
    """
    low, ext = F.lower("name"), paths.extension(F.col("name"))
    rows = files.where(~F.col("name").startswith(".")).withColumns({"_low": low, "_ext": ext})
    video, subtitle = F.col("_ext").isin(*names.VIDEO.split("|")), F.col("_ext").isin(*SUBTITLES)
    nfo = (F.col("_ext") == "nfo") | F.col("_low").isin(*NFO)
    asset = F.col("_low").isin(*POSTERS, *FANART, *NFO) | subtitle
    ids = nfo_ids(F.when(nfo, F.col("content")))
    by_ext = rows.where(~asset).groupBy("folder", "_ext").agg(F.count("*").alias("n"))
    extras = by_ext.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("_ext", "n"))).alias("extras"))
    held = rows.groupBy("folder").agg(
        F.count_if(video).alias("videos"),
        F.count_if(nfo).alias("nfos"),
        F.max_by(F.when(video, F.col("name")), F.when(video, F.struct("size_bytes", "name"))).alias("main_video"),
        F.max(F.col("_low").isin(*POSTERS)).alias("poster"),
        F.max(F.col("_low").isin(*FANART)).alias("fanart"),
        F.count_if(subtitle).alias("subtitles"),
        F.max(ids["imdb_id"]).alias("imdb_id"),
        F.max(ids["tmdb_id"]).alias("tmdb_id"),
    )
    own = paths.basename(F.col("folder"))
    out = held.join(extras, "folder", "left").withColumn("_name", own)
    year = F.regexp_extract("_name", r"^.+?\s*\(([0-9]{4})\)$", 1).try_cast("int")
    out = out.withColumns({"_year": year, "kind": names.folder_kind(F.col("_name"), F.col("videos"))})
    detected = F.when(F.col("_year").between(1900, 2100), F.col("_year"))
    movie = F.col("kind") == "movie"
    more = F.transform(F.filter("extras", lambda e: ~e["_ext"].isin(*HARMLESS) & (e["_ext"] != "")), lambda e: F.concat(F.lit("extra_"), e["_ext"], F.lit("_files:"), e["n"].cast("string")))
    issues = F.array(
        F.when(F.col("videos") == 0, "no_primary_video").when(F.col("videos") > 1, "multiple_primary_videos"),
        F.when(F.col("_year").isNull() & movie, "missing_canonical_pattern").when(F.col("_year").isNotNull() & detected.isNull(), "invalid_year"),
        F.when(movie & detected.isNull(), "missing_year"),
        F.when(movie & (F.col("nfos") == 0), "missing_nfo"),
    )
    assets = F.to_json(F.struct("poster", "fanart", "subtitles", F.struct("imdb_id", "tmdb_id").alias("ids")))
    return out.select(
        "folder", "kind", (F.col("_year").isNotNull() & (F.col("videos") == 1)).alias("canonical"), detected.alias("detected_year"), "main_video", "videos", assets.alias("assets_json"),
        F.coalesce(F.col("imdb_id").isNotNull() | F.col("tmdb_id").isNotNull(), F.lit(False)).alias("has_ids"),
        F.concat(F.array_compact(issues), F.coalesce(more, F.array().cast(TEXTS))).alias("issues"),
    )


def candidates(held: DataFrame, known: DataFrame | None = None, hashes: DataFrame | None = None, signatures: DataFrame | None = None, most: int = MOST_CANDIDATES) -> DataFrame:
    """(folder, source, candidate_id, title, year, score) of each folder: the ``most`` that resemble its names best.

    The folder's own guess and the main video's come as ``name``; ``known`` (folder, source, candidate_id, title, year) are what others found; a
    main video whose signature (``signatures``: folder, signature) stands in ``hashes`` (signature, candidate_id, title, year) gives ``opensubs``.
    A score is the best likeness of the title to the folder's name and the main video's; ties go by source, id and title.
    """
    own = held.select("folder", F.array_compact(F.array(paths.basename(F.col("folder")), F.col("main_video"))).alias("_names"), movie_guess(paths.basename(F.col("folder"))).alias("a"), movie_guess(F.col("main_video")).alias("b"))
    guess = lambda g, test: F.when(test, F.struct(F.lit("name").alias("source"), F.lit(None).cast("string").alias("candidate_id"), g["title"].alias("title"), g["year"].alias("year")))
    a, b = F.col("a"), F.col("b")
    guesses = F.array_compact(F.array(guess(a, a["title"].isNotNull()), guess(b, b["title"].isNotNull() & ~b["title"].eqNullSafe(a["title"]))))
    found = own.select("folder", "_names", F.explode(guesses).alias("c")).select("folder", "_names", "c.*")
    columns = ["folder", "source", F.col("candidate_id").cast("string").alias("candidate_id"), "title", F.col("year").cast("int").alias("year")]
    others = [] if known is None else [known.select(*columns)]
    if hashes is not None and signatures is not None:
        others.append(signatures.join(hashes, "signature").withColumn("source", F.lit("opensubs")).select(*columns))
    for o in others:
        found = found.unionByName(o.join(own.select("folder", "_names"), "folder"))
    best = F.array_max(F.transform("_names", lambda n: fuzzy(F.coalesce("title", F.lit("")), n)))
    scored = found.select("folder", "source", "candidate_id", "title", "year", F.when(F.coalesce("title", F.lit("")) == "", 0.0).otherwise(best).alias("score"))
    # the best of each folder: kept to their number before and after the shuffle
    from .joins import top_per_key

    return top_per_key(scored, "folder", most, F.desc("score"), F.asc("source"), F.asc_nulls_last("candidate_id"), F.asc("title")).withColumnRenamed("rn", "place")


def profiles(held: DataFrame, found: DataFrame, runtimes: DataFrame | None = None) -> DataFrame:
    """``held`` folders with title, year, confidence, signals_json, reasons and questions.

    ``runtimes`` (folder, seconds, minutes): the main video's length and that of the candidate; they match within the tolerance.
    """
    top = found.groupBy("folder").agg(F.max("score").alias("best"), F.max(F.col("source") == "opensubs").alias("oshash"), F.min_by(F.struct("source", "candidate_id", "title", "year"), "place").alias("top"))
    out = held.join(top, "folder", "left").withColumns({"best": F.coalesce("best", F.lit(0.0)), "oshash": F.coalesce("oshash", F.lit(False))})
    if runtimes is None:
        out = out.withColumn("_runtime", F.lit(False))
    else:
        same = (F.col("minutes") > 0) & (F.col("seconds") > 0) & ~scores.runtime_differs(F.col("seconds"), F.col("minutes"))
        times = runtimes.groupBy("folder").agg(F.max(same).alias("_runtime"))
        out = out.join(times, "folder", "left").withColumn("_runtime", F.coalesce("_runtime", F.lit(False)))
    name = F.when(F.col("best") >= scores.FULL_NAME_SCORE, 1.0).otherwise(scores.clamp(F.col("best")))
    flags = {"canon": F.col("canonical"), "nfo": F.col("has_ids"), "oshash": F.col("oshash"), "runtime": F.col("_runtime")}
    signals = F.struct(*[F.when(c, scores.WEIGHTS[k]).otherwise(0.0).alias(k) for k, c in flags.items()], (scores.WEIGHTS["name"] * name).alias("name_match"))
    said = F.array(
        F.when(~F.col("canonical"), NO_CANON),
        F.when(~F.col("has_ids") & (F.col("kind") == "movie"), NO_IDS),
        F.when(F.col("best") < WEAK, WEAK_NAME),
    )
    reasons = F.concat(F.array_compact(said), F.transform("issues", lambda x: F.concat(F.lit("Issue detected: "), x)))
    a, b = movie_guess(F.col("main_video")), movie_guess(paths.basename(F.col("folder")))
    confidence = scores.folder_confidence(F.col("canonical"), F.col("has_ids"), F.col("oshash"), F.col("best"), F.col("_runtime"), F.col("issues"))
    questions = media.review_questions(F.col("top.candidate_id"), F.col("top.title"), F.col("top.source"), F.col("has_ids"), paths.basename(F.col("folder")))
    return out.select(
        *held.columns, F.coalesce(a["title"], b["title"]).alias("title"), F.coalesce(a["year"], b["year"], F.col("detected_year")).alias("year"), confidence.alias("confidence"),
        F.to_json(signals).alias("signals_json"), media.review_reasons(reasons, F.col("kind")).alias("reasons"), questions.alias("questions"),
    )


def stored(old: dict[str, DataFrame], made: DataFrame, found: DataFrame, now: Column, low: float = LOW) -> dict[str, DataFrame]:
    """The tables profiles, candidates and queue after a run: profiles by folder, each folder's candidates replaced, the queue kept up.

    ``old`` has those of the last run, or lacks them. Rows of folders that weren't profiled stay; a queued folder keeps ``created_utc``.
    """
    profile = made.select("folder", "kind", "main_video", "title", "year", "assets_json", F.to_json("issues").alias("issues_json"), "confidence", "signals_json", now.alias("updated_utc"))
    asked = made.select("folder", "confidence", F.to_json("reasons").alias("reasons_json"), F.to_json("questions").alias("questions_json"))
    queue = old.get("queue", asked.select("*", now.alias("created_utc")).where("false"))
    before = old.get("candidates", found.where("false"))
    gone = before.join(made.select("folder"), "folder", "left_anti")
    return {
        "profiles": replace_by_key(old.get("profiles", profile.where("false")), profile, "folder"),
        "candidates": gone.unionByName(found),
        "queue": review_queue(queue, asked, "folder", low, now),
    }


def summary(made: DataFrame, high: float = 0.80, low: float = LOW) -> DataFrame:
    """One row: folders profiled, movies, and how many are confident, medium and low."""
    c = F.col("confidence")
    return made.agg(F.count("*").alias("processed"), F.count_if(F.col("kind") == "movie").alias("movies"), F.count_if(c >= high).alias("confident"), F.count_if((c >= low) & (c < high)).alias("medium"), F.count_if(c < low).alias("low"))
