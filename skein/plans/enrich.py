"""Enrichment queries with their SQL; see ``catalog``."""

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import audit, enrich
from ..sources.readers import table
from .catalog import SQL, WORDS, long, query


@query("SELECT c_custkey, md5(array_to_string(list_filter([nullif(trim(c_name), ''), CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, CAST(c_nationkey AS VARCHAR)], lambda x: x IS NOT NULL), ' ' || chr(10))) AS content FROM customer")
def index_content(spark, d):
    rows = table(spark, d, "customer").withColumn("segment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    return enrich.index_content(rows, "c_custkey", ["c_name", "segment", "c_nationkey"], ["c_name", "segment"]).select("c_custkey", F.md5(F.col("content").cast("binary")).alias("content"))


@query(
    """WITH f AS (SELECT p_brand || ' (' || CASE WHEN p_size % 10 = 0 THEN '1' ELSE '' END || (1950 + p_size % 10) || ')' AS folder, p_partkey, CASE WHEN p_partkey % 40 = 0 THEN 'video' WHEN p_partkey % 7 = 0 THEN 'nfo' ELSE 'other' END AS kind FROM part),
    g AS (SELECT folder, count(*) FILTER (kind = 'video') AS v, count(*) FILTER (kind = 'nfo') AS n FROM f GROUP BY 1), h AS (SELECT *, regexp_matches(folder, '^.+ \\((19|20)[0-9]{2}\\)$') AS canon FROM g)
    SELECT folder, CASE WHEN v <> 1 THEN 'other' ELSE 'movie' END AS kind, canon AND v = 1 AS canonical,
    round(least(1, greatest(0, CASE WHEN canon AND v = 1 THEN 0.35 ELSE 0 END + CASE WHEN n > 0 THEN 0.25 ELSE 0 END - CASE WHEN v = 0 THEN 0.2 ELSE 0 END - CASE WHEN v > 1 THEN 0.1 ELSE 0 END - CASE WHEN n = 0 THEN 0.05 ELSE 0 END - CASE WHEN NOT canon AND v = 1 THEN 0.05 ELSE 0 END)), 6) AS confidence FROM h"""
)
def folder_profiles(spark, d):
    p = table(spark, d, "part")
    year = F.concat(F.when(F.col("p_size") % 10 == 0, "1").otherwise(""), (1950 + F.col("p_size") % 10).cast("string"))
    kind = F.when(F.col("p_partkey") % 40 == 0, "video").when(F.col("p_partkey") % 7 == 0, "nfo").otherwise("other")
    files = p.select(F.concat("p_brand", F.lit(" ("), year, F.lit(")")).alias("folder"), F.concat(F.col("p_partkey").cast("string"), F.lit("."), kind).alias("name"), kind.alias("kind"), F.col("p_size").alias("size_bytes"))
    return enrich.folder_profiles(files).select("folder", "kind", "canonical", F.round("confidence", 6).alias("confidence"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE score END AS score, CASE WHEN p_partkey % 6 = 0 THEN 'probe_failed' ELSE 'ok' END AS status FROM ({SQL['score_rules']})")
def quality_rows(spark, d):
    rows, size, key = table(spark, d, "part").withColumn("probe_ok", F.col("p_partkey") % 6 != 0), F.col("p_size"), F.col("p_partkey")
    score = scores.video_quality(640 + size * 40, 360 + size * 20, F.col("p_retailprice") * 2, key % 3, key % 4, key % 5, F.lit(True), size * 100.0, F.lit(40))
    return enrich.quality_rows(rows, score.cast("int")).select("p_partkey", "score", "status")


@query(
    f"""WITH c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS w FROM documents) WHERE length(w) >= 3 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS k FROM c), l AS (SELECT doc_id, string_agg(w, ',' ORDER BY k) AS keywords FROM r WHERE k <= 4 GROUP BY 1)
    SELECT b.doc_id, strlen(text) AS bytes, len(string_split(text, chr(10))) AS lines, coalesce(keywords, '') AS keywords FROM documents b LEFT JOIN l USING (doc_id)"""
)
def text_previews(spark, d):
    out = enrich.text_previews(table(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", long("bytes").alias("bytes"), long("lines").alias("lines"), F.array_join("keywords", ",").alias("keywords"))


@query(
    """SELECT a.vec_id, CASE WHEN m >= 0.8 THEN 'boost' WHEN m >= 0.65 THEN 'nudge' WHEN m < 0.4 THEN 'flag' ELSE 'keep' END AS action FROM (SELECT vec_id, round(0.5 * least(1, greatest(0, abs(embedding[1]) * 8)) + 0.3 * least(1, greatest(0, abs(embedding[2]) * 8)) + 0.2 * least(1, greatest(0, abs(embedding[3]) * 8)), 9) AS m FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)) a"""
)
def verification_actions(spark, d):
    part = [F.abs(F.get("embedding", F.lit(k)).cast("double")) * 8 for k in range(3)]
    return enrich.verified(table(spark, d, "embeddings"), *part).select("vec_id", "action")


@query("SELECT 'movie' AS kind, CAST(event_id AS VARCHAR) AS path FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0 UNION ALL SELECT 'episode', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 2 = 1 AND event_id % 5 <> 0")
def unresolved_items(spark, d):
    ids = lambda m: F.when(F.col("event_id") % m == 0, F.concat(F.lit('{"ids": {"imdb": "tt'), F.col("event_id").cast("string"), F.lit('"}}'))).otherwise(F.col("props"))
    rows = table(spark, d, "events")
    one = lambda r, m: rows.where(F.col("event_id") % 2 == r).select(F.col("event_id").cast("string").alias("path"), ids(m).alias("ids"))
    return enrich.unresolved_items(one(0, 3), one(1, 5))


@query("SELECT count(*) FILTER (p_partkey % 3 = 0 OR p_partkey % 3 = 1 AND p_size < 35) AS flagged FROM part")
def quality_flags(spark, d):
    key = F.col("p_partkey")
    reasons = F.when(key % 3 == 0, '{"low_bitrate": true}').when(key % 3 == 2, '{"low_bitrate": false}')
    return audit.quality_flags(table(spark, d, "part").select(reasons.alias("reasons"), (F.col("p_size") * 2).alias("score")), "reasons", "score")


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0")
def removed_rows(spark, d):
    rows = table(spark, d, "part").select("p_partkey")
    return enrich.kept_and_removed(rows, rows.where("p_partkey % 3 = 0"), "p_partkey")


@query("SELECT doc_id, md5(substr(text, 1, 300)) AS digest FROM (SELECT doc_id, text FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50) UNION ALL SELECT doc_id, md5(substr(text, 1, 300)) FROM (SELECT doc_id, text FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 20)")
def capped_sources(spark, d):
    docs = table(spark, d, "documents")
    return enrich.capped_union([docs.where("lang = 'en'"), docs.where("lang = 'de'")], [50, 20], 300).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    f"""WITH t AS (SELECT doc_id, ('0x' || md5(w)[1:4])::BIGINT % 256 AS slot FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS w FROM documents)), c AS (SELECT doc_id, slot, count(*) AS n FROM t GROUP BY 1, 2)
    SELECT doc_id, count(*) AS filled, round(max(n) / sqrt(sum(n * n)), 6) AS largest, arg_max(slot, (n, -slot)) AS slot FROM c GROUP BY 1"""
)
def hashed_vectors(spark, d):
    rows = enrich.hashed_words(table(spark, d, "documents"), "doc_id", "text")
    filled = F.size(F.filter("vector", lambda x: x > 0)).cast("long").alias("filled")
    top = F.array_max("vector")
    return rows.select("doc_id", filled, F.round(top, 6).alias("largest"), (F.array_position("vector", top) - 1).alias("slot"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(l_quantity), 'DESC')[1:5], ',') AS best FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem) GROUP BY 1")
def best_candidates(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(long("l_quantity").alias("score"))).alias("c"))
    return rows.select("l_orderkey", F.array_join(F.transform(enrich.best_candidates(F.col("c")), lambda x: x["score"].cast("string")), ",").alias("best"))
