"""Playlists, details, listings, caches and learning steps over catalog tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from .windows import fill_budget


def playlist_candidates(movies: DataFrame, episodes: DataFrame, minutes: tuple[float, float], confidence: float, quality: float, years: tuple[int, int], n: int) -> DataFrame:
    """Movies and episodes within all ranges, best first, cut after the sort; a missing year or duration counts as 0."""
    every = movies.unionByName(episodes)
    year, length = F.coalesce("year", F.lit(0)), F.coalesce("minutes", F.lit(0.0))
    kept = every.where(length.between(*minutes) & (F.coalesce("confidence", F.lit(0.0)) >= confidence) & (F.col("quality").isNull() | (F.col("quality") >= quality)) & ((year == 0) | year.between(*years)))
    return kept.orderBy(F.desc_nulls_last("quality"), F.desc("confidence"), "id").limit(n)


def playlist(candidates: DataFrame, target: float, *order: Column) -> DataFrame:
    """Candidates in order until their minutes reach the target."""
    return fill_budget(candidates, "minutes", target, *order)


def sidecars(files: DataFrame) -> DataFrame:
    """Videos (folder, stem, kind) with the number of subtitles of their stem, whatever the order of the listing."""
    subs = files.where("kind = 'subtitle'").groupBy("folder", "stem").agg(F.count("*").alias("subtitles"))
    return files.where("kind = 'video'").select("folder", "stem").join(subs, ["folder", "stem"], "left").na.fill(0, ["subtitles"])


def frequent_year(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, year) most frequent 19xx or 20xx number of a text, the first seen on a tie."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1)).alias("at", "year"))
    counts = found.groupBy(key, "year").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    return counts.groupBy(key).agg(F.max_by("year", F.struct("n", -F.col("first"))).alias("year"))


def cached(keys: DataFrame, cache: DataFrame, key: str, now: Column, ttl: int, cache_only: bool = False) -> DataFrame:
    """Keys with the payload of a cache entry that is younger than ``ttl`` seconds, of any age if only the cache may answer."""
    live = cache if cache_only else cache.where(F.col("ts") > now - F.make_interval(secs=F.lit(ttl)))
    newest = live.groupBy(key).agg(F.max_by("payload", "ts").alias("payload"))
    return keys.join(newest, key, "left").withColumn("hit", F.col("payload").isNotNull())


def mean_pool(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, vec): mean of a group's vectors by position, scaled to length one. Partial aggregates by position."""
    by = vectors.select(key, F.posexplode(vec).alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("x"))
    listed = by.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    return listed.select(key, l2_normalize(F.transform("v", lambda v: v["x"])).alias(vec))


def nested(parents: DataFrame, children: DataFrame, key: str, columns: list[str], *order: Column) -> DataFrame:
    """Parents with an ordered array of their children's columns."""
    ranked = children.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    listed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", *columns))).alias("children"))
    return parents.join(listed, key, "left")


def history(messages: DataFrame, session: str, n: int, order: str) -> DataFrame:
    """The last ``n`` messages of every session, oldest first by ``order``."""
    return messages.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n").orderBy(session, order)


def fuzzy(a: Column, b: Column) -> Column:
    """One less the edit distance of sorted lower-case words over the longer length; 1 for two empty texts."""
    x, y = (F.array_join(F.sort_array(F.split(F.lower(F.trim(c)), r"\s+")), " ") for c in (a, b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest > 0, 1 - F.levenshtein(x, y) / longest).otherwise(1.0)


def normal_form(path: Column) -> Column:
    """Unicode NFC, by Arrow batches."""
    import unicodedata

    import pandas as pd

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return nfc(path)


def head_tail_signature(content: Column, block: int = 65536) -> Column:
    """Size plus the 64-bit little-endian words of head and tail, modulo 2**64, as 16 hex digits; null under two blocks' worth of nothing."""
    import numpy as np
    import pandas as pd

    def total(data: bytes) -> int:
        words = np.frombuffer(data + b"\0" * (-len(data) % 8), "<u8")
        return int(words.sum(dtype=np.uint64))

    @F.pandas_udf("string")
    def signature(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else f"{(len(b) + total(b[:block]) + total(b[-block:])) % 2**64:016x}")

    return signature(content)


def take_oldest(queue: DataFrame, n: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """The ``n`` oldest rows, and the queue without them."""
    key = order[-1]
    taken = queue.orderBy(*order).limit(n)
    return taken, queue.join(taken.select(key), key, "left_anti")


def calibrated(rows: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """Logistic regression with isotonic calibration on half of the rows; AUC, Brier score and calibration error on the other half."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    from .metrics import calibration_error, reliability

    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows.withColumn("label", F.col(label).cast("double")))
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    model = LogisticRegression(maxIter=50, regParam=0.01).fit(data.where(half == 0))
    scored = model.transform(data).withColumn("raw", vector_to_array("probability")[1]).drop("prediction", "features", "rawPrediction", "probability")
    iso = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="p").fit(scored.where(half == 0))
    test = iso.transform(scored).where(half == 1)
    auc = BinaryClassificationEvaluator(rawPredictionCol="p").evaluate(test)
    ece = calibration_error(reliability(test.select("p", "label"), "p", "label", bins))
    return test.agg(F.count("*").alias("rows"), F.avg((F.col("p") - F.col("label")) ** 2).alias("brier")).crossJoin(ece).withColumn("auc", F.lit(auc))  # one row each
