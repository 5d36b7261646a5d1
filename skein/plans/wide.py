"""Queries over operators and functions that no other query reaches, with their SQL; see ``catalog``."""

from pyspark.sql import functions as F

from ..functions import media, names, paths, scores, text, vectors
from ..operators import audit, enrich, joins, metrics, pages, queues, reports, search, upserts, windows
from ..sources import readers, writers
from ..sources.readers import table
from ..sources.shared import scratch, spread
from .catalog import INVENTORY, inventory, query


def docs(spark, d):
    return table(spark, d, "documents")


# Probe JSON, review and candidates

PROBE = """'{"media": {"track": [{"@type": "General", "Duration": "' || p_size * 1500 || '"}, {"@type": "Video", "Format": "AVC' || p_size % 4 || '", "Width": "' || p_size * 40 || ' pixels", "Height": "n/a"}, {"Type": "Audio", "CodecID": "A' || p_size % 3 || '"}, {"@type": "Audio", "Format": "AAC"}]}}'"""


def _probe():
    size = F.col("p_size")
    said = lambda c: c.cast("string")
    return F.concat(
        F.lit('{"media": {"track": [{"@type": "General", "Duration": "'), said(size * 1500), F.lit('"}, {"@type": "Video", "Format": "AVC'), said(size % 4), F.lit('", "Width": "'), said(size * 40),
        F.lit(' pixels", "Height": "n/a"}, {"Type": "Audio", "CodecID": "A'), said(size % 3), F.lit('"}, {"@type": "Audio", "Format": "AAC"}]}}'),
    )


@query("SELECT p_partkey, 'AVC' || p_size % 4 AS codec_video, CAST(p_size * 40 AS BIGINT) AS width, CAST(NULL AS BIGINT) AS height, 'A' || p_size % 3 AS codec_audio, 2 AS audio_streams, 1 AS video_streams, p_size * 1.5::DOUBLE AS duration_seconds FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 7 = 0")
def probe_details(spark, d):
    probe = F.when(F.col("p_partkey") % 7 != 0, _probe()).otherwise("{broken")
    return spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", media.probe_details(probe).alias("m")).select("p_partkey", "m.*")


@query("SELECT p_partkey, p_size < 25 AS needs_review, CASE WHEN p_size < 25 THEN 2 ELSE 0 END AS reasons, CASE WHEN p_size < 25 THEN 'confidence ' || printf('%.2f', p_size / 50.0) || ' below 0.50' END AS first_reason, CASE WHEN p_size < 25 THEN CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS suggestions FROM part")
def review_bundles(spark, d):
    size = F.col("p_size")
    suggestions = F.array(F.lit("mark unknown"), F.when(size % 2 == 0, F.lit("swap artist and title")), F.lit("mark unknown"))
    bundle = media.review_bundle(size / 50.0, F.array(F.lit("no track number")), suggestions)
    rows = table(spark, d, "part").select("p_partkey", bundle.alias("b"))
    return rows.select("p_partkey", "b.needs_review", F.size("b.reasons").alias("reasons"), F.get("b.reasons", F.lit(0)).alias("first_reason"), F.size("b.suggestions").alias("suggestions"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'name matches' ELSE 'name matches|Classified as ' || CASE WHEN s_suppkey % 3 = 1 THEN 'series' ELSE 'other' END || ' based on folder contents.' END AS reasons, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'confirm_candidate|' END || CASE WHEN s_nationkey % 2 = 0 THEN 'review_nfo|' ELSE '' END || 'open_folder' || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '|alt_tmdb_search' END AS actions FROM supplier")
def review_reasons(spark, d):
    key = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("movie", "series", "other"))), (key % 3 + 1).cast("int"))
    some = key % 5 != 0
    asked = media.review_questions(F.when(some, key.cast("string")), F.when(some, F.col("s_name")), F.when(some, F.lit("catalog")), F.col("s_nationkey") % 2 == 0, F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(media.review_reasons(F.array(F.lit("name matches")), kind), "|").alias("reasons"), F.array_join(F.transform(asked, lambda q: q["action"]), "|").alias("actions"))


@query("WITH c AS (SELECT p_brand, p_partkey, p_size / 100.0 + CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.15 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 0.1 END + least(0.2, p_size / 100.0) AS score FROM part) SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY score DESC, p_partkey DESC) AS best, round(max(score), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey DESC) AS rn FROM c) WHERE rn <= 3 GROUP BY p_brand")
def proposal_scores(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    tmdb, imdb, said = F.when(key % 2 == 0, key), F.when(key % 3 == 0, key), F.when(key % 5 == 0, F.lit("")).otherwise("text")
    rows = table(spark, d, "part").select("p_brand", "p_partkey", media.proposal_score(size / 100.0, tmdb, imdb, said, size / 10.0).alias("score"))
    top = joins.top_per_key(rows, "p_brand", 3, F.desc("score"), F.desc("p_partkey"))
    listed = top.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("rn", "p_partkey"))).alias("x"), F.max("score").alias("score"))
    return listed.select("p_brand", F.array_join(F.transform("x", lambda x: x["p_partkey"].cast("string")), ",").alias("best"), F.round("score", 6).alias("score"))


@query("SELECT p_partkey, 'confidence=' || printf('%.2f', p_size / 50.0) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ';issues=' || printf('%.2f', p_partkey % 4::DOUBLE) END || ';item_type=' || CASE WHEN p_partkey % 2 = 0 THEN 'movie' ELSE 'episode' END || '=1.00' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ';source=' || p_brand || '=1.00' END AS features FROM part")
def feature_maps(spark, d):
    key = F.col("p_partkey")
    made = media.feature_map({"confidence": F.col("p_size") / 50.0, "issues": F.when(key % 3 != 0, key % 4)}, {"item_type": F.when(key % 2 == 0, "movie").otherwise("episode"), "source": F.when(key % 5 != 0, F.col("p_brand"))})
    sorted_entries = F.sort_array(F.map_entries(made))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(sorted_entries, lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"]))), ";").alias("features"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(to_timestamp(1700000000 + event_id * 61) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') WHEN 1 THEN '2024-03-0' || 1 + event_id % 9 || ' 10:30' WHEN 2 THEN '—' ELSE 'soon' END AS shown FROM events")
def local_times(spark, d):
    key = F.col("event_id")
    value = F.when(key % 4 == 0, (1700000000 + key * 61).cast("string")).when(key % 4 == 1, F.concat(F.lit("2024-03-0"), (1 + key % 9).cast("string"), F.lit("T10:30:15Z"))).when(key % 4 == 2, F.lit("  ")).otherwise("soon")
    return table(spark, d, "events").select("event_id", media.local_time(value).alias("shown"))


# Names, paths, texts

@query("SELECT doc_id, replace(source, ' ', '_') || '_x_' || doc_id AS safe, len(string_split(lang || ';a', ';')) AS langs FROM documents")
def safe_names(spark, d):
    return docs(spark, d).select("doc_id", paths.safe_name(F.concat("source", F.lit(" é x: "), F.col("doc_id").cast("string"))).alias("safe"), F.size(text.split_list(F.concat("lang", F.lit("; a,, ;")))).alias("langs"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE year(o_orderdate) END::INTEGER AS year, CASE WHEN o_orderkey % 2 = 0 THEN 1500 ELSE 0 END::BIGINT AS lag FROM orders")
def air_years(spark, d):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    at = F.lit("2024-01-01 00:00:10").cast("timestamp")
    sent = F.when(key % 2 == 0, F.lit("2024-01-01 00:00:08.5").cast("timestamp")).otherwise(F.lit("2024-01-01 00:00:11").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", text.air_year(F.when(key % 3 != 0, F.date_format(day, "yyyy-MM-dd"))).alias("year"), text.lag_ms(at, sent).alias("lag"))


@query("SELECT item_id, CASE WHEN contains(lower(text), 'the') THEN greatest(0.2, least(1.0, 3.0 / length(text))) ELSE 0.0 END AS score FROM benchmark")
def keyword_scores(spark, d):
    return table(spark, d, "benchmark").select("item_id", scores.keyword_score(F.lit(" The "), F.col("text")).alias("score"))


@query("SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda x: x::DOUBLE / nullif(sqrt(list_aggregate(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE), 'sum')), 0)), 'sum'), 4) AS total FROM embeddings")
def unit_vectors(spark, d):
    unit = F.aggregate(vectors.l2_normalize(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(unit, 4).alias("total"))


@query("SELECT count(*) AS n, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes, CAST(round_even(avg(length(text)), 0) AS BIGINT) AS mean_size FROM benchmark")
def blob_totals(spark, d):
    return metrics.blob_totals(table(spark, d, "benchmark"), "text")


@query("SELECT CAST(round_even(avg(len(embedding)), 0) AS BIGINT) AS dimension FROM embeddings")
def mean_dimension(spark, d):
    return metrics.mean_dimension(table(spark, d, "embeddings"), "embedding")


# Pages, lookups, health

@query("SELECT event_id, value FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 400) WHERE value > 60 ORDER BY ts DESC, event_id DESC")
def slow_entries(spark, d):
    log = table(spark, d, "events").select("event_id", "ts", "value", F.col("value").alias("duration_ms"))
    return audit.slow_entries(log, 400, 60.0, "ts", "event_id").select("event_id", "value")


@query("SELECT source, sum(CASE WHEN n_chars < 1500 THEN 1 ELSE 0 END) / count(*) AS ratio FROM documents GROUP BY source HAVING sum(CASE WHEN n_chars < 1500 THEN 1 ELSE 0 END) / count(*) >= 0.4")
def stale_ratio(spark, d):
    return audit.stale_ratio(docs(spark, d), "source", F.col("n_chars") < 1500)


@query("SELECT severity, count(*) AS n FROM (SELECT CASE WHEN value > 80 THEN 'major' WHEN value > 40 THEN 'minor' ELSE 'info' END AS severity FROM events) GROUP BY 1")
def severity_counts(spark, d):
    value = F.col("value")
    return audit.severity_counts(table(spark, d, "events").select(F.when(value > 80, "major").when(value > 40, "minor").otherwise("info").alias("severity")))


@query("SELECT doc_id, text FROM documents WHERE doc_id = 17")
def point_lookup(spark, d):
    return pages.all_of(docs(spark, d), [pages.same("source", None), F.col("doc_id") == 17]).select("doc_id", "text").limit(1)


@query("SELECT p_partkey, p_size / 50.0 AS score FROM part WHERE p_size / 50.0 >= 0.4 ORDER BY p_size DESC, p_partkey DESC LIMIT 25 OFFSET 5")
def score_page(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("score"))
    return pages.page(pages.all_of(rows, [F.col("score") >= 0.4]), [F.desc("score"), F.desc("p_partkey")], 25, 5)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderdate, o_orderkey LIMIT 500")
def review_page(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return pages.page(rows, ["o_totalprice", "o_orderdate", "o_orderkey"], 9_999, -3).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 100")
def newest_page(spark, d):
    return pages.page(table(spark, d, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], None, 100).select("o_orderkey")


@query("SELECT path FROM (SELECT source || '/' || doc_id AS path FROM documents WHERE starts_with(source, 'src1')) ORDER BY path LIMIT 40")
def sample_files(spark, d):
    rows = docs(spark, d).where(F.col("source").startswith("src1")).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return pages.page(rows, ["path"], 40)


@query("SELECT coalesce(category, 'other') AS category, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM (SELECT CASE lang WHEN 'en' THEN 'video' WHEN 'de' THEN 'audio' END AS category, n_chars AS size_bytes FROM documents) GROUP BY 1")
def extension_categories(spark, d):
    ext = F.when(F.col("lang") == "en", "MKV").when(F.col("lang") == "de", "q7").otherwise("xyz")
    mime = F.when(F.col("lang") == "de", "audio/x-odd")
    return docs(spark, d).groupBy(paths.category(ext, mime).alias("category")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


@query("SELECT vec_id, round(score, 5) AS score FROM (SELECT e.vec_id, e.label, list_aggregate(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE), 'sum') / (sqrt(list_aggregate(list_transform(e.embedding, lambda y: y::DOUBLE * y::DOUBLE), 'sum')) * sqrt(list_aggregate(list_transform(q.embedding, lambda y: y::DOUBLE * y::DOUBLE), 'sum'))) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q) WHERE label = 1 ORDER BY score DESC, vec_id LIMIT 10")
def filtered_nearest(spark, d):
    """The filter comes before the top-k, so that it never returns fewer rows than there are."""
    rows = table(spark, d, "embeddings")
    wanted = [float(x) for x in rows.where("vec_id = 3").first().embedding]
    return search.nearest(rows.where("label = 1"), "vec_id", "embedding", wanted, 10).select("vec_id", F.round("score", 5).alias("score"))


# Budgets, queues, writes

@query("SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) AS size FROM documents) WHERE size <= 20000")
def blob_budget(spark, d):
    return windows.within_budget(docs(spark, d), "n_chars", 20_000, F.desc("doc_id"), by=["source"]).select("doc_id")


@query("SELECT source, count(*) >= 5 AND count(*) - 4 >= 3 AS train FROM documents GROUP BY source")
def training_due(spark, d):
    return queues.training_due(docs(spark, d).groupBy("source").agg(F.count("*").alias("labels")).withColumn("trained", F.lit(4)), 5, 3).select("source", "train")


@query("SELECT source || '.txt' AS path FROM documents WHERE doc_id % 3 <> 0")
def playlist_files(spark, d):
    where = scratch(spark, "playlist")
    writers.write_playlist(docs(spark, d).select(F.when(F.col("doc_id") % 3 != 0, F.concat("source", F.lit(".txt"))).alias("path"), F.col("lang").alias("title")), where)
    return spark.read.text(where).withColumnRenamed("value", "path")


@query("SELECT lang, n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def report_sections(spark, d):
    """Sections written as CSV and read back; one without rows is not written."""
    where = scratch(spark, "sections")
    counts = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    done = writers.write_sections({"languages": counts, "none": counts.where("n < 0")}, where)
    return spark.read.option("header", True).schema("lang string, n long").csv([f"{where}/{name}" for name in done])


@query("SELECT (SELECT count(DISTINCT source) FROM documents) AS k, (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) AS strategy")
def single_row_config(spark, d):
    """One row of settings, from the first kind of events and then from the most frequent one; the last version counts."""
    where = scratch(spark, "config")
    k = docs(spark, d).agg(F.count_distinct("source").alias("k"))
    kinds = table(spark, d, "events").groupBy(F.col("event_type").alias("strategy")).agg(F.count("*").alias("n"))
    first, most = (kinds.orderBy(*by).limit(1).select("strategy") for by in (["strategy"], [F.desc("n"), "strategy"]))
    upserts.swap(k.crossJoin(F.broadcast(first)), where)  # one row each
    return spark.read.parquet(upserts.swap(k.crossJoin(F.broadcast(most)), where))


@query("SELECT event_id, event_type FROM events WHERE event_id % 3 = 0")
def json_log(spark, d):
    """JSON lines with blank and broken ones among them."""
    where = scratch(spark, "log")
    key = F.col("event_id")
    line = F.when(key % 3 == 0, F.to_json(F.struct("event_id", "event_type"))).when(key % 3 == 1, F.lit("")).otherwise("{broken")
    table(spark, d, "events").select(line.alias("value")).write.text(where)
    return readers.json_lines(spark, where, "event_id long, event_type string")


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 90) AS failed, round(quantile_cont(value, 0.95), 6) AS p95, count(*) - count(*) FILTER (value > 90) AS success FROM events GROUP BY event_type")
def tool_metrics(spark, d):
    calls = table(spark, d, "events").select(F.col("event_type").alias("tool"), (F.col("value") > 90).alias("failed"), F.col("value").alias("ms"))
    return metrics.tool_metrics(calls).select(F.col("tool").alias("event_type"), "total", "failed", F.round("p95", 6).alias("p95"), "success")


@query("SELECT event_type AS series, count(*) AS n, round(arg_max(value, (ts, event_id)), 6) AS latest FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) GROUP BY event_type")
def latest_of_series(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("series"), "value", "ts", F.col("event_id").alias("id"))
    return audit.series_latest(rows).select("series", "n", F.round("latest", 6).alias("latest"))


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 4 IN (1, 2)")
def changed_digests(spark, d):
    rows, key = table(spark, d, "nation"), F.col("n_nationkey")
    base = rows.where(key % 4 != 1).select(F.col("n_name").alias("name"), F.md5("n_name").alias("digest"))
    current = rows.select(F.col("n_name").alias("name"), F.md5(F.when(key % 4 == 2, "changed").otherwise(F.col("n_name"))).alias("digest"))
    return audit.changed_digests(base, current)


@query("SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang")
def snapshot_files(spark, d):
    """A snapshot whose files have the sizes and digests of its manifest, read back."""
    where = scratch(spark, "snapshot")
    manifest = writers.write_snapshot(docs(spark, d).select("doc_id", "lang"), where)
    good = manifest.where("length(sha256) = 64 and length > 0").agg(F.count("*").alias("files"))
    rows = spark.read.parquet(where).crossJoin(F.broadcast(good)).where("files > 0")
    return rows.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"))
