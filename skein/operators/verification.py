"""Whether a video's subtitles tell the story that its plot tells: ranked files, cleaned samples, a weighted match, boosts and flags written back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, scores
from ..functions.text import jaccard
from ..functions.vectors import cosine
from ..sources.shared import written
from .enrich import HIGH_MATCH, LOW_MATCH, MIDDLE_MATCH, hashed_words
from .previews import Sampling, summary
from .upserts import reasons_for

# What a subtitle's name counts for, words that name nothing, sampled lines and characters, weights, boosts, the reason.
SUBTITLES, SAME_STEM, SAME_BEGIN, ENGLISH = ("srt", "ass", "ssa", "vtt", "sub"), 5, 3, 2
STOPWORDS = "the and for with from into your their after before when while over under that this these those".split()
HEAD, MIDDLE, TAIL, MOST_LINES, MOST_CHARS = 150, 100, 150, 400, 20_000
WEIGHTS, STRONG, MEDIUM = (0.55, 0.25, 0.20), 0.15, 0.08
REASON = "plot and subtitles differ"
HOW = Sampling(summary_tokens=120, keywords=12)
TIMING = r"^(?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{1,3}\s*-->.*$"
TAGS = r"<[^>]*>|\{[^}]*\}"


def ranked_subtitles(files: DataFrame) -> DataFrame:
    """Subtitle files (key, video, name, content) with ``place``: best first by how the name follows the video's, ties by name."""
    stem = lambda c: F.regexp_replace(F.lower(paths.basename(c)), r"\.[^.]*$", "")
    own, video, low = stem(F.col("name")), stem(F.col("video")), F.lower(paths.basename(F.col("name")))
    points = F.when(own == video, SAME_STEM).otherwise(0) + F.when(own.startswith(video), SAME_BEGIN).otherwise(0) + F.when(F.contains(low, F.lit(".en")), ENGLISH).otherwise(0)
    rows = files.where(paths.extension(F.col("name")).isin(*SUBTITLES)).withColumn("points", points)
    from .joins import top_per_key

    # a video's files stand in one folder; a thousand of them would be a folder of its own kind
    return top_per_key(rows, "key", 1000, F.desc("points"), F.asc("name")).withColumnRenamed("rn", "place")


def spoken(content: Column) -> Column:
    """Lines of a subtitle text that are spoken: without cue numbers, timings, tags, headers of events and blanks."""
    lines = F.transform(F.split(content, r"\r?\n"), lambda x: F.trim(x))
    text = F.transform(F.filter(lines, lambda x: (x != "") & ~x.rlike(TIMING) & ~x.rlike("^[0-9]+$") & (x != "WEBVTT")), lambda x: F.regexp_replace(x, r"(?i)^dialogue:(?:[^,]*,){9}", ""))
    return F.filter(F.transform(text, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, TAGS, " "), r"\s+", " "))), lambda x: x != "")


def sampled(lines: Column) -> Column:
    """First lines, some at even steps from the middle and the last ones, as one text of bounded length."""
    n = F.size(lines)
    tail = F.when(n > HEAD, F.slice(lines, F.greatest(F.lit(1), n - TAIL + 1), F.lit(TAIL))).otherwise(F.slice(lines, 1, 0))
    count = F.greatest(F.lit(0), n - HEAD - TAIL)
    between = F.slice(lines, F.lit(HEAD + 1), count)
    step = F.greatest(F.lit(1), F.floor(count / MIDDLE).cast("int"))
    middle = F.slice(F.filter(between, lambda _, i: i % step == 0), 1, MIDDLE)
    return F.substring(F.array_join(F.slice(F.concat(F.slice(lines, 1, HEAD), middle, tail), 1, MOST_LINES), " "), 1, MOST_CHARS)


def entities(text: Column) -> Column:
    """Distinct runs of capitalised words, in lower case, without stopwords and names of two letters or fewer, sorted."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\p{Lu}[\p{L}\p{N}_'-]+(?:\s+\p{Lu}[\p{L}\p{N}_'-]+)*)"), 1), F.lower)
    return F.sort_array(F.array_distinct(F.filter(found, lambda x: ~x.isin(*STOPWORDS) & (F.length(x) > 2))))


def compared(items: DataFrame, subtitles: DataFrame, plots: DataFrame) -> DataFrame:
    """(key, name, lines, summary, keywords, semantic, entities, words, match, action) of items (key) that have subtitles (key, video, name, content) and a plot (key, plot).

    The best subtitle file with spoken lines counts. semantic is the cosine of hashed words of summary and plot, entities and words the shares of common
    names and keywords (0 where a side has none). action is boost, nudge, flag or keep. Items without subtitles or without a plot have no row.
    """
    wanted = items.select("key").distinct()
    texts = ranked_subtitles(subtitles.join(wanted, "key", "left_semi")).withColumn("_lines", spoken(F.col("content"))).where(F.size("_lines") > 0)
    best = texts.groupBy("key").agg(F.min_by(F.struct("name", "_lines"), "place").alias("b")).select("key", "b.name", F.col("b._lines").alias("_lines"))
    told = best.select("key", "name", F.least(F.size("_lines"), F.lit(MOST_LINES)).alias("lines"), summary(sampled(F.col("_lines")), HOW).alias("s"))
    plot = plots.where(F.trim(F.coalesce("plot", F.lit(""))) != "").groupBy("key").agg(F.min("plot").alias("plot")).select("key", "plot", summary(F.col("plot"), HOW)["keywords"].alias("_plot_words"))
    # written, as it is read three times: the texts are cleaned and summed up once
    both = written(told.select("key", "name", "lines", "s.summary", "s.keywords").join(plot, "key"), "told")
    mine, theirs = hashed_words(both, "key", "summary").withColumnRenamed("vector", "_a"), hashed_words(both, "key", "plot").withColumnRenamed("vector", "_b")
    rows = both.join(mine, "key", "left").join(theirs, "key", "left")
    share = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), jaccard(a, b)).otherwise(0.0)
    rows = rows.select(
        "key", "name", "lines", "summary", "keywords", F.coalesce(cosine(F.col("_a"), F.col("_b")), F.lit(0.0)).alias("semantic"),
        share(entities(F.col("summary")), entities(F.col("plot"))).alias("entities"), share(F.col("keywords"), F.col("_plot_words")).alias("words"),
    )
    rows = rows.withColumn("match", scores.weighted_mean(dict(zip(WEIGHTS, (F.col("semantic"), F.col("entities"), F.col("words"))))))
    m = F.col("match")
    return rows.withColumn("action", F.when(m >= HIGH_MATCH, "boost").when(m >= MIDDLE_MATCH, "nudge").when(m < LOW_MATCH, "flag").otherwise("keep"))


def written_back(profiles: DataFrame, queue: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, queue) after a comparison: confidence raised for boosts and nudges, 1 at most, in both; a reason in the queue for what is flagged.

    Tables have key and confidence, the queue also reasons (an array); a flagged item that isn't queued comes into the queue.
    """
    gain = found.groupBy("key").agg(F.max(F.when(F.col("action") == "boost", STRONG).when(F.col("action") == "nudge", MEDIUM).otherwise(0.0)).alias("_gain"))
    raised = lambda t: t.join(gain, "key", "left").withColumn("confidence", F.when(F.col("_gain") > 0, F.least(F.lit(1.0), F.col("confidence") + F.col("_gain"))).otherwise(F.col("confidence"))).drop("_gain")
    flagged = found.where("action = 'flag'").select("key")
    return raised(profiles), reasons_for(raised(queue), flagged, "key", REASON)


CANDIDATE = "array<struct<tmdb_episode_id:string,tmdb_id:string,id:string,imdb_episode_id:string,imdb_id:string,title:string,name:string,season:string,season_number:string,score:string,confidence:string>>"
DEFAULT_SCORE, MOST_PROPOSALS = 0.2, 3


def listed_candidates(rows: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, source, tmdb_id, imdb_id, title, season, score) of every entry of the arrays in a JSON object whose names hold ``candidate``.

    Entries that are no objects, and values that are no arrays, have no row; a score that is missing or 0 is 0.2.
    """
    from ..functions.text import json_dict

    arrays = rows.select(F.col(key), F.explode(json_dict(F.col(ids))).alias("source", "_v")).where(F.contains("source", F.lit("candidate")) & F.startswith(F.ltrim("_v"), F.lit("[")))
    entries = arrays.select(key, "source", F.explode(F.from_json("_v", CANDIDATE)).alias("c")).where("c is not null")
    c = lambda name: F.nullif(F.col(f"c.{name}"), F.lit(""))
    first = lambda *names: F.coalesce(*[c(n) for n in names])
    some = lambda name: F.when(F.col(f"c.{name}").try_cast("double") != 0, F.col(f"c.{name}").try_cast("double"))
    return entries.select(
        key, "source", first("tmdb_episode_id", "tmdb_id", "id").alias("tmdb_id"), first("imdb_episode_id", "imdb_id").alias("imdb_id"), first("title", "name").alias("title"),
        first("season", "season_number").try_cast("int").alias("season"), F.coalesce(some("score"), some("confidence"), F.lit(DEFAULT_SCORE)).alias("score"),
    )


def proposals(items: DataFrame, candidates: DataFrame, evidence: DataFrame, snippets: DataFrame, n: int = MOST_PROPOSALS) -> DataFrame:
    """(key, place, tmdb_id, imdb_id, title, score, signals) of the ``n`` best candidates of each item (key, confidence).

    ``candidates`` (key, tmdb_id, imdb_id, title, score) are rated with the evidence (key, oshash_hit, subtitle_langs, plot_score) and a text found for the item
    (``snippets``: key, snippet); signals name what speaks for a candidate. Scores are rounded to nine places; ties go by id and title. An item without candidates has no row.
    """
    from ..functions import media
    from .joins import top_per_key

    rows = candidates.join(items.select("key", "confidence"), "key").join(evidence, "key", "left").join(snippets.groupBy("key").agg(F.min("snippet").alias("snippet")), "key", "left")
    rated = media.proposal_score(F.col("confidence"), F.col("tmdb_id"), F.col("imdb_id"), F.col("snippet"), F.col("plot_score")) + F.col("score")
    signals = F.array_compact(
        F.array(
            F.when(F.col("tmdb_id").isNotNull(), F.concat(F.lit("tmdb:"), F.col("tmdb_id"))),
            F.when(F.col("imdb_id").isNotNull(), F.concat(F.lit("imdb:"), F.col("imdb_id"))),
            F.when(F.coalesce("oshash_hit", F.lit(False)), F.lit("oshash")),
            F.when(F.size(F.coalesce("subtitle_langs", F.array().cast("array<string>"))) > 0, F.concat(F.lit("subtitles:"), F.array_join("subtitle_langs", ","))),
            F.when(F.col("plot_score") > 0, F.format_string("plot:%.2f", F.col("plot_score").cast("double"))),
            F.when(F.coalesce("snippet", F.lit("")) != "", F.lit("text")),
        )
    )
    rows = rows.select("key", "tmdb_id", "imdb_id", "title", F.least(F.lit(1.0), F.round(rated, 9)).alias("score"), signals.alias("signals"))
    return top_per_key(rows, "key", n, F.desc("score"), F.asc_nulls_last("tmdb_id"), F.asc_nulls_last("imdb_id"), F.asc_nulls_last("title")).withColumnRenamed("rn", "place")
