"""Queries over pages, joins, projections and cuts of catalog tables."""

from pyspark.sql import functions as F

from ..functions import names, scores, text
from ..operators import joins, pages, quality, reports
from ..sources.readers import table
from .catalog import long, query
from .derived import WORDS, _words

MUSIC = f"SELECT source AS drive, 'm/' || lang || '/' || doc_id || '.mp3' AS path, {WORDS}[1] AS artist, {WORDS}[2] AS title, lang AS album, CASE WHEN n_chars % 2 = 0 THEN 'MP3' ELSE 'flac' END AS ext, n_chars % 100 / 100.0 AS score FROM documents"


def _music(spark, d):
    path = F.concat(F.lit("m/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mp3"))
    return table(spark, d, "documents").select(
        F.col("source").alias("drive"), path.alias("path"), F.get(_words(), F.lit(0)).alias("artist"), F.get(_words(), F.lit(1)).alias("title"), F.col("lang").alias("album"),
        F.when(F.col("n_chars") % 2 == 0, "MP3").otherwise("flac").alias("ext"), (F.col("n_chars") % 100 / 100.0).alias("score"),
    )


@query(f"SELECT path, artist, round(score, 6) AS score FROM ({MUSIC}) WHERE lower(ext) = 'mp3' AND score >= 0.2 AND (contains(lower(path), 'th') OR contains(lower(coalesce(artist, '')), 'th') OR contains(lower(coalesce(title, '')), 'th') OR contains(lower(coalesce(album, '')), 'th')) ORDER BY score DESC, path LIMIT 120")
def music_page(spark, d):
    rows = pages.music(_music(spark, d), q="TH", ext="mp3", least=0.2)
    return pages.page(rows, [F.desc("score"), "path"], 120).select("path", "artist", F.round("score", 6).alias("score"))


SERIES = "SELECT s_name AS title, 'tv/' || s_suppkey AS folder, CASE WHEN s_acctbal >= 0 THEN s_acctbal / 10000 END AS confidence, n_name AS drive, s_suppkey % 7 AS seasons FROM supplier JOIN nation ON n_nationkey = s_nationkey"


@query(f"SELECT folder, round(confidence, 6) AS confidence, seasons FROM ({SERIES}) WHERE contains(lower(title), '0') AND coalesce(confidence, 0) < 0.55 ORDER BY seasons DESC, folder LIMIT 60")
def series_page(spark, d):
    rows = joins.attach(table(spark, d, "supplier"), table(spark, d, "nation"), {"s_nationkey": "n_nationkey"}, ["n_name"])
    rows = rows.select(F.col("s_name").alias("title"), F.concat(F.lit("tv/"), F.col("s_suppkey").cast("string")).alias("folder"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") / 10000).alias("confidence"), F.col("n_name").alias("drive"), (F.col("s_suppkey") % 7).alias("seasons"))
    return pages.series(rows, q="0", only_low=True, sort="seasons", descending=True).limit(60).select("folder", F.round("confidence", 6).alias("confidence"), "seasons")


@query("SELECT doc_id, n_chars, rank, total FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER () AS total FROM documents) WHERE rank BETWEEN 41 AND 100")
def ranked_page(spark, d):
    rows = pages.ranked(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 60, 40)
    return rows.withColumn("rank", long("rank"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) > 500")
def trimmed_rows(spark, d):
    """The rows that go when the table is cut to its 500 newest."""
    return pages.retained(table(spark, d, "events"), 500, "event_id", F.desc("ts"), F.desc("event_id"))[1]


@query("SELECT kind, total::BIGINT AS total FROM (SELECT 'movie' AS kind, count(*) AS total FROM part UNION ALL SELECT 'series', count(*) FROM supplier UNION ALL SELECT 'episode', count(*) FROM customer)")
def catalog_totals(spark, d):
    return pages.summary(_kinds(spark, d), 5)[0]


def _kinds(spark, d):
    one = lambda t, key, c: table(spark, d, t).select(F.col(key).cast("string").alias("path"), c.alias("confidence"))
    return {"movie": one("part", "p_partkey", F.nullif("p_size", F.lit(10)) / 50.0), "series": one("supplier", "s_suppkey", F.col("s_acctbal")), "episode": one("customer", "c_custkey", F.col("c_acctbal"))}


@query(
    """WITH k AS (SELECT 'movie' AS kind, CAST(p_partkey AS VARCHAR) AS path, nullif(p_size, 10) / 50.0::DOUBLE AS confidence FROM part UNION ALL SELECT 'series', CAST(s_suppkey AS VARCHAR), s_acctbal FROM supplier UNION ALL SELECT 'episode', CAST(c_custkey AS VARCHAR), c_acctbal FROM customer)
    SELECT kind, path, round(confidence, 6) AS confidence FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY confidence ASC NULLS LAST, path) <= 25"""
)
def least_confident(spark, d):
    return pages.summary(_kinds(spark, d), 25)[1].withColumn("confidence", F.round("confidence", 6))


@query("SELECT q.c_custkey AS path, round(c_acctbal / 10000, 6) AS confidence, r_name AS kind FROM (SELECT * FROM customer WHERE c_acctbal < 2000) q LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 1) ON r_regionkey = n_regionkey ORDER BY c_acctbal, c_custkey LIMIT 80")
def queue_with_profiles(spark, d):
    """The review queue with what the profiles know, least confident first; a row without a profile stays."""
    queue = table(spark, d, "customer").where("c_acctbal < 2000")
    known = joins.attach(queue, table(spark, d, "nation"), {"c_nationkey": "n_nationkey"}, ["n_regionkey"])
    rows = joins.attach(known, table(spark, d, "region").where("r_regionkey <> 1"), {"n_regionkey": "r_regionkey"}, ["r_name"])
    out = pages.page(rows, ["c_acctbal", "c_custkey"], 80)
    return out.select(F.col("c_custkey").alias("path"), F.round(F.col("c_acctbal") / 10000, 6).alias("confidence"), F.col("r_name").alias("kind"))


@query("SELECT n_name AS label, nullif(trim(CASE WHEN n_nationkey % 2 = 0 THEN ' ' ELSE r_name END), '') AS marker, coalesce(last_order, DATE '1990-01-01'::TIMESTAMP) AS scanned FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey > 0 LEFT JOIN (SELECT c_nationkey, max(o_orderdate) AS last_order FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) ON c_nationkey = n_nationkey")
def drive_list(spark, d):
    """Drives with their bindings: blank markers are null, and the binding's time comes before the drive's own."""
    bound = table(spark, d, "region").where("r_regionkey > 0")
    last = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.max("o_orderdate").alias("last_order"))
    rows = joins.attach(joins.attach(table(spark, d, "nation"), bound, {"n_regionkey": "r_regionkey"}, ["r_name"]), last, {"n_nationkey": "c_nationkey"}, ["last_order"])
    marker = F.when(F.col("n_nationkey") % 2 == 0, " ").otherwise(F.col("r_name"))
    return rows.select(F.col("n_name").alias("label"), F.nullif(F.trim(marker), F.lit("")).alias("marker"), F.coalesce("last_order", F.lit("1990-01-01").cast("timestamp_ntz")).alias("scanned"))


# Projections of JSON columns

@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k=' || k || '; kind=' || event_type WHEN event_id % 3 = 0 THEN event_type || '; ' || user_id ELSE event_type END AS reasons,
        CASE WHEN event_id % 2 = 1 AND event_id % 3 = 0 THEN 2 ELSE 0 END AS items, CASE WHEN event_id % 2 = 0 THEN k ELSE 0 END::DOUBLE AS k, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END::INTEGER AS numbers
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE k > 0"""
)
def json_projections(spark, d):
    """Objects, arrays and plain words of events as reasons, counts, signals and numeric features."""
    key, k = F.col("event_id"), F.get_json_object("props", "$.k")
    whole = F.to_json(F.struct(k.cast("int").alias("k"), F.col("event_type").alias("kind"), F.lit(False).alias("no")))
    listed = F.to_json(F.array("event_type", F.col("user_id").cast("string")))
    raw = F.when(key % 2 == 0, whole).when(key % 3 == 0, listed).otherwise(F.concat(F.lit(" "), "event_type"))
    rows = table(spark, d, "events").where(k.cast("int") > 0).select("event_id", raw.alias("raw"))
    return rows.select("event_id", text.reasons_text(F.col("raw")).alias("reasons"), text.count_list(F.col("raw")).alias("items"), text.signal(F.col("raw"), "k").alias("k"), F.coalesce(F.size(text.numeric_features(F.col("raw"))), F.lit(-1)).alias("numbers"))


@query(
    """WITH f AS (SELECT l_orderkey, CASE l_suppkey % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'de' WHEN 2 THEN 'forced' ELSE 'SPA' END AS tag, l_linestatus FROM lineitem)
    SELECT l_orderkey, coalesce(string_agg(DISTINCT CASE WHEN l_linestatus = 'O' AND tag <> 'forced' THEN lower(tag) END, ',' ORDER BY CASE WHEN l_linestatus = 'O' AND tag <> 'forced' THEN lower(tag) END), '') AS languages,
        coalesce(string_agg(DISTINCT CASE WHEN l_linestatus = 'O' AND tag <> 'forced' THEN CASE tag WHEN 'eng' THEN 'en' WHEN 'SPA' THEN 'es' ELSE tag END END, ',' ORDER BY CASE WHEN l_linestatus = 'O' AND tag <> 'forced' THEN CASE tag WHEN 'eng' THEN 'en' WHEN 'SPA' THEN 'es' ELSE tag END END), '') AS codes
    FROM f GROUP BY 1"""
)
def subtitle_languages(spark, d):
    """Languages of an order's subtitle files, as they are called and as two-letter codes; other files don't count."""
    tag = F.element_at(F.array(*map(F.lit, ("eng", "de", "forced", "SPA"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    name = F.concat(F.lit("Film."), tag, F.when(F.col("l_linestatus") == "O", ".srt").otherwise(".mkv"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(names.subtitle_languages(F.collect_list(name)).alias("l"))
    codes = F.sort_array(F.array_distinct(F.transform("l", quality.language_code)))
    return rows.select("l_orderkey", F.array_join("l", ",").alias("languages"), F.array_join(codes, ",").alias("codes"))


@query(
    """SELECT o_orderkey, round(greatest(0, CASE WHEN o_orderstatus = 'O' THEN 0.4 ELSE 0 END + CASE WHEN o_totalprice > 150000 THEN 0.35 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 0.25 ELSE 0 END - 0.05 * n), 6) AS confidence,
        CASE WHEN greatest(0, CASE WHEN o_orderstatus = 'O' THEN 0.4 ELSE 0 END + CASE WHEN o_totalprice > 150000 THEN 0.35 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 0.25 ELSE 0 END - 0.05 * n) >= 0.7999999 THEN 'high'
            WHEN greatest(0, CASE WHEN o_orderstatus = 'O' THEN 0.4 ELSE 0 END + CASE WHEN o_totalprice > 150000 THEN 0.35 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 0.25 ELSE 0 END - 0.05 * n) >= 0.4999999 THEN 'medium' ELSE 'low' END AS label
    FROM orders JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def tv_scores(spark, d):
    """Weighted signals of an order less a twentieth for each of its returned lines."""
    issues = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_compact(F.collect_list(F.when(F.col("l_returnflag") == "R", "returned"))).alias("issues"))
    rows = table(spark, d, "orders").join(issues, F.col("l_orderkey") == F.col("o_orderkey"))
    sure = F.round(scores.tv_confidence({0.4: F.col("o_orderstatus") == "O", 0.35: F.col("o_totalprice") > 150000, 0.25: F.col("o_custkey") % 2 == 0}, F.col("issues")), 6)
    return rows.select("o_orderkey", sure.alias("confidence"), scores.bucket(sure).alias("label"))


@query(
    """WITH i AS (SELECT CASE lang WHEN 'en' THEN 'video' WHEN 'de' THEN 'audio' WHEN 'fr' THEN 'image' ELSE 'other' END AS category, n_chars AS size FROM documents),
    s AS (SELECT (SELECT count(*) FROM part) AS total, (SELECT count(*) FROM part WHERE p_size > 25) AS by_video, (SELECT count(*) FROM supplier) AS by_audio)
    SELECT category, CASE category WHEN 'video' THEN by_video WHEN 'audio' THEN by_audio ELSE 0 END AS files, coalesce(bytes, 0)::BIGINT AS bytes
    FROM (SELECT unnest(['video', 'audio', 'image', 'document', 'archive', 'executable', 'other']) AS category) LEFT JOIN (SELECT category, sum(size) AS bytes FROM i GROUP BY 1) USING (category), s"""
)
def drive_stats(spark, d):
    """Counts from the newest snapshot, bytes from the inventory."""
    lang = F.col("lang")
    category = F.when(lang == "en", "video").when(lang == "de", "audio").when(lang == "fr", "image").otherwise("other")
    inventory = table(spark, d, "documents").select(category.alias("category"), F.col("n_chars").alias("size_bytes"))
    part = table(spark, d, "part").agg(F.count("*").alias("total_files"), F.count_if(F.col("p_size") > 25).alias("by_video"))
    counts = part.crossJoin(table(spark, d, "supplier").agg(F.count("*").alias("by_audio")))  # one row each
    none = {f"by_{c}": F.lit(0).cast("long") for c in ("image", "document", "archive", "executable", "other")}
    now = counts.withColumns({**none, "id": F.lit(2), "scan_ts_utc": F.lit("2024-02-01")})
    old = now.withColumns({"id": F.lit(1), "scan_ts_utc": F.lit("2024-01-01"), "by_video": F.lit(-1).cast("long")})
    return reports.categories_with_snapshot(inventory, now.unionByName(old))
