"""Full-text and vector search: postings, BM25, hybrid scores, keywords, summaries."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import counted, runs, tokens
from ..functions.vectors import cosine

K1, B, LEAST_IDF, TEXT_SHARE = 1.2, 0.75, 1e-6, 0.4


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length) of every document; length counts all its terms."""
    terms = docs.select(key, tokens(F.col(text)).alias("_t")).select(key, F.size("_t").alias("length"), F.explode("_t").alias("term"))
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """(key, score) of documents that hold every query term; larger is better. Lengths and counts cover all documents."""
    words = docs.select(key, tokens(F.col(text)).alias("_t")).select(key, F.size("_t").alias("length"), F.filter("_t", lambda t: t.isin(*query)).alias("_q"))
    stats = words.agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length"))
    tf = words.select(key, "length", F.explode("_q").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy(key).agg(F.sum(weight).alias("score"), F.count("*").alias("terms"))  # one row of statistics
    return scored.where(F.col("terms") == len(set(query))).select(key, "score")


def snippet(text, query: list[str], size: int = 80):
    """The text around the first query term, terms in bold."""
    at = F.greatest(F.lit(1), F.regexp_instr(F.lower(text), F.lit("(" + "|".join(query) + ")")) - size // 2)
    return F.regexp_replace(F.substr(text, at, F.lit(size)), "(?i)\\b(" + "|".join(query) + ")\\b", "<b>$1</b>")


def nearest(vectors: DataFrame, key: str, vec: str, query: list[float], k: int, least: float | None = None) -> DataFrame:
    """The ``k`` rows with the largest cosine to a query vector."""
    out = vectors.select(key, cosine(F.col(vec), F.array(*[F.lit(float(x)) for x in query])).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return out if least is None else out.where(F.col("score") >= least)


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, key: str, text_first: bool = False) -> DataFrame:
    """Weighted sum where a row has both scores, else the one that it has; text scores x / (1 + x) first."""
    v = vector_hits.select(key, F.col("score").alias("v"))
    t = text_hits.select(key, (F.col("score") / (1 + F.col("score"))).alias("t"))
    both = v.join(t, key, "full_outer")
    mixed = (1 - TEXT_SHARE) * F.col("v") + TEXT_SHARE * F.col("t")
    return both.select(key, F.coalesce(mixed, "t" if text_first else "v", "v" if text_first else "t").alias("score"))


def keywords(docs: DataFrame, key: str, text: str, k: int, least: int = 3) -> DataFrame:
    """(key, rank, term, n): the most frequent terms of each document, ties in term order."""
    top = F.slice(counted(tokens(F.col(text), least)), 1, k)
    return docs.select(key, F.posexplode(top).alias("at", "x")).select(key, F.col("x.w").alias("term"), (-F.col("x.n")).cast("long").alias("n"), (F.col("at") + 1).alias("rank"))


def lead_summary(docs: DataFrame, key: str, text: str, chars: int) -> DataFrame:
    """Leading sentences until their characters reach ``chars``."""
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")
    rows = docs.select(key, F.posexplode(sentences).alias("at", "sentence"))
    ahead = F.coalesce(F.sum(F.length("sentence")).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("ahead", ahead).where(F.col("ahead") < chars)
    listed = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "sentence"))).alias("s"))
    return listed.select(key, F.array_join(F.transform("s", lambda s: s["sentence"]), " ").alias("summary"))


def best_sentences(docs: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """The ``n`` sentences with the largest sum of term counts over sqrt(length + 1), in document order.

    All in the row: terms with their sentences are sorted once to count them, and once more by sentence to sum the counts.
    """
    split = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")
    rows = docs.select(key, split.alias("_s"))
    terms = F.flatten(F.transform("_s", lambda s, i: F.transform(tokens(s, 3), lambda t: F.struct(t.alias("t"), i.alias("at")))))
    rows = rows.select(key, "_s", F.sort_array(terms).alias("_x"))

    # each term's place with its count, by sentence
    counts = F.flatten(F.transform(runs(F.transform("_x", lambda e: e["t"])), lambda r: F.array_repeat(r["n"], r["n"])))
    placed = F.sort_array(F.zip_with("_x", counts, lambda e, c: F.struct(e["at"].alias("at"), c.alias("n"))))
    rows = rows.select(key, "_s", placed.alias("_p"))
    stretches = runs(F.transform("_p", lambda p: p["at"]))
    weight = lambda r: F.aggregate(F.slice("_p", r["at"] + 1, r["n"]), F.lit(0).cast("long"), lambda s, p: s + p["n"])
    scored = F.transform(stretches, lambda r: F.struct((-(weight(r) / F.sqrt(r["n"] + 1.0))).alias("score"), r["w"].alias("at")))
    best = rows.select(key, "_s", F.explode(F.slice(F.sort_array(scored), 1, n)).alias("b"))
    return best.select(key, F.col("b.at").alias("at"), F.get("_s", F.col("b.at")).alias("sentence"), (-F.col("b.score")).alias("score"))
