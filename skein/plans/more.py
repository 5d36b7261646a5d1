"""Further catalog queries with their SQL; see ``catalog``."""

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import joins, queues, search, upserts, views
from ..sources.readers import shards, table
from ..sources.shared import scratch, written
from ..sources.writers import export_row
from ..streaming import events as streaming
from .catalog import PAGE_PATH, WORDS, long, query

NTZ = "timestamp_ntz"
MOVIES = "SELECT 'm' || p_partkey AS id, 1950 + p_size AS year, p_retailprice / 10 AS minutes, (p_partkey % 100) / 100.0 AS confidence, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size * 2 END AS quality FROM part"
EPISODES = "SELECT 'e' || s_suppkey AS id, NULL AS year, 45.0 AS minutes, (s_suppkey % 50) / 50.0 AS confidence, s_nationkey * 4 AS quality FROM supplier"
CANDIDATES = f"SELECT * FROM ({MOVIES} UNION ALL {EPISODES}) WHERE coalesce(minutes, 0) BETWEEN 20 AND 150 AND confidence >= 0.3 AND (quality IS NULL OR quality >= 20) AND (coalesce(year, 0) = 0 OR year BETWEEN 1960 AND 1995) ORDER BY quality DESC NULLS LAST, confidence DESC, id LIMIT 60"


def _candidates(spark, d):
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    key, size = F.col("p_partkey"), F.col("p_size")
    movies = p.select(F.concat(F.lit("m"), key.cast("string")).alias("id"), (1950 + size).alias("year"), (F.col("p_retailprice") / 10).alias("minutes"), ((key % 100) / 100.0).alias("confidence"), F.when(size % 9 != 0, size * 2).alias("quality"))
    key = F.col("s_suppkey")
    episodes = s.select(F.concat(F.lit("e"), key.cast("string")).alias("id"), F.lit(None).cast("int").alias("year"), F.lit(45.0).alias("minutes"), ((key % 50) / 50.0).alias("confidence"), (F.col("s_nationkey") * 4).alias("quality"))
    return views.playlist_candidates(movies, episodes, (20, 150), 0.3, 20, (1960, 1995), 60)


@query(f"SELECT id, CAST(quality AS INTEGER) AS quality FROM ({CANDIDATES})")
def playlist_candidates(spark, d):
    return _candidates(spark, d).select("id", F.col("quality").cast("int").alias("quality"))


@query(f"SELECT id FROM (SELECT *, coalesce(sum(CAST(minutes AS DECIMAL(12, 2))) OVER (ORDER BY confidence DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({CANDIDATES})) WHERE before < 900")
def playlist_build(spark, d):
    rows = _candidates(spark, d).withColumn("minutes", F.col("minutes").cast("decimal(12,2)"))
    return views.playlist(rows, 900, F.desc("confidence"), F.asc("id")).select("id")


@query("SELECT source AS folder, CAST(doc_id % 100 AS VARCHAR) AS stem, coalesce(n, 0) AS subtitles FROM documents LEFT JOIN (SELECT source AS f, doc_id % 100 AS s, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY 1, 2) ON source = f AND doc_id % 100 = s WHERE lang = 'en'")
def sidecar_counts(spark, d):
    kind = F.when(F.col("lang") == "en", "video").when(F.col("lang").isNotNull(), "subtitle")
    return views.sidecars(table(spark, d, "documents").select(F.col("source").alias("folder"), (F.col("doc_id") % 100).cast("string").alias("stem"), kind.alias("kind")))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def markup_fields(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("WITH y AS (SELECT conv_id, turn, unnest(regexp_extract_all(replace(text, ' ', '  '), '\\b((?:19|20)[0-9]{2})\\b', 1)) AS year, generate_subscripts(regexp_extract_all(replace(text, ' ', '  '), '\\b((?:19|20)[0-9]{2})\\b', 1), 1) AS pos FROM (SELECT conv_id, turn, 1900 + conv_id % 3 || ' ' || text || ' ' || 1900 + turn % 2 || ' ' || 1900 + turn % 2 AS text FROM conversations)), c AS (SELECT conv_id, turn, year, count(*) AS n, min(pos) AS first FROM y GROUP BY 1, 2, 3) SELECT conv_id * 1000 + turn AS id, arg_max(year, (n, -first)) AS year FROM c GROUP BY 1")
def frequent_year(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    said = F.concat_ws(" ", (1900 + c % 3).cast("string"), "text", (1900 + t % 2).cast("string"), (1900 + t % 2).cast("string"))
    return views.frequent_year(table(spark, d, "conversations").select((c * 1000 + t).alias("id"), said.alias("text")), "id", "text")


@query("SELECT u.user_id, CAST(arg_max(event_id, ts) AS VARCHAR) AS payload, count(event_id) > 0 AS hit FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-29' - INTERVAL 36000 SECOND) e ON u.user_id = e.user_id GROUP BY 1")
def cached_lookup(spark, d):
    events = table(spark, d, "events").select("user_id", "ts", F.col("event_id").cast("string").alias("payload"))
    return views.cached(events.select("user_id").distinct(), events, "user_id", F.lit("2024-01-29 00:00:00").cast(NTZ), 36000)


@query("SELECT o_orderkey AS backup_id, count(l_orderkey) AS files, coalesce(sum(CAST(l_quantity AS BIGINT)), 0)::BIGINT AS bytes FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate ORDER BY o_orderdate DESC, o_orderkey LIMIT 40")
def manifest_sizes(spark, d):
    files = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("files"), F.sum(long("l_quantity")).alias("bytes"))
    out = joins.attach(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), files, {"o_orderkey": "l_orderkey"}, ["files", "bytes"])
    return out.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(40).select(F.col("o_orderkey").alias("backup_id"), F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


@query(f"SELECT DISTINCT array_to_string(p[1:len(p) - 1], '/') AS folder FROM (SELECT string_split({PAGE_PATH}, '/') AS p FROM pages) WHERE len(p) > 1 AND regexp_matches(p[len(p)], '^[0-9]+$')")
def leaf_folders(spark, d):
    path = F.regexp_replace(F.substring_index("url", "?", 1), "^https?://", "")
    rows = table(spark, d, "pages").select(path.alias("p")).where(paths.basename(F.col("p")).rlike("^[0-9]+$"))
    return rows.select(paths.parent_folder(F.col("p")).alias("folder")).where("folder <> ''").distinct()


@query("WITH m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT label, pos, round(x / n, 5) AS x FROM m JOIN n USING (label)")
def mean_pooled(spark, d):
    out = views.mean_pool(table(spark, d, "embeddings"), "label", "embedding")
    return out.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 5).alias("x"))


@query("SELECT o_orderkey, coalesce(lines, '') AS lines FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey || ':' || l_linenumber, ',' ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def nested_detail(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = views.nested(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_partkey", "l_linenumber"], F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_linenumber"))
    each = F.transform("children", lambda c: F.concat(c["l_partkey"].cast("string"), F.lit(":"), c["l_linenumber"].cast("string")))
    return out.select("o_orderkey", F.coalesce(F.array_join(each, ","), F.lit("")).alias("lines"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def recent_history(spark, d):
    return views.history(table(spark, d, "conversations"), "conv_id", 3, "turn").select("conv_id", "turn", "role")


@query("WITH x AS (SELECT p_partkey, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS a FROM part) SELECT p_partkey, round(1 - levenshtein(a, 'cold widget') / greatest(length(a), 11), 6) AS ratio FROM x")
def fuzzy_titles(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(views.fuzzy(F.col("p_name"), F.lit("Widget cold")), 6).alias("ratio"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def normal_forms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(views.normal_form(F.col("text")).cast("binary")).alias("digest"))


@query(
    """WITH b AS (SELECT doc_id, strlen(text) AS n, unnest(range(strlen(text))) AS i, CAST('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')) AS HUGEINT) AS b FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, sum(CASE WHEN i < 1024 THEN b << CAST(i % 8 * 8 AS INT) ELSE 0 END) + sum(CASE WHEN i >= n - 1024 THEN b << CAST((i - greatest(n - 1024, 0)) % 8 * 8 AS INT) ELSE 0 END) AS words FROM b GROUP BY doc_id)
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN format('{:016x}', CAST((strlen(text) + coalesce(words, 0)) % 18446744073709551616 AS UBIGINT)) END AS signature FROM documents LEFT JOIN w USING (doc_id)"""
)
def head_tail_signatures(spark, d):
    return table(spark, d, "documents").select("doc_id", views.head_tail_signature(F.col("text").cast("binary"), 1024).alias("signature"))


@query(f"SELECT doc_id FROM (SELECT doc_id, source, {WORDS.format('text')} AS w FROM documents) WHERE source = 'src1' AND list_contains(w, 'in')")
def text_filter(spark, d):
    docs = table(spark, d, "documents").where("source = 'src1'")
    return search.postings(docs, "doc_id", "text").where("term = 'in'").select("doc_id")


SENTENCES = "SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM (SELECT *, coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM ({SENTENCES})) WHERE ahead < 200 GROUP BY 1")
def lead_summaries(spark, d):
    return search.lead_summary(table(spark, d, "documents"), "doc_id", "text", 200)


@query(
    f"""WITH s AS ({SENTENCES}), t AS (SELECT doc_id, pos, term FROM (SELECT doc_id, pos, unnest({WORDS.format('sentence')}) AS term FROM s) WHERE length(term) >= 3),
    c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY 1, 2), w AS (SELECT doc_id, pos, sum(n) / sqrt(count(*) + 1.0) AS score FROM t JOIN c USING (doc_id, term) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS k FROM w) SELECT doc_id, pos::INTEGER AS "at", sentence, round(score, 6) AS score FROM r JOIN s USING (doc_id, pos) WHERE k <= 4"""
)
def best_sentences(spark, d):
    return search.best_sentences(table(spark, d, "documents"), "doc_id", "text").withColumn("score", F.round("score", 6))


@query("SELECT event_id, false AS waits FROM (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 30) UNION ALL SELECT event_id, true FROM (SELECT event_id FROM events ORDER BY ts, event_id OFFSET 30)")
def dequeue(spark, d):
    taken, rest = views.take_oldest(table(spark, d, "events").select("ts", "event_id"), 30, "ts", "event_id")
    return taken.select("event_id", F.lit(False).alias("waits")).union(rest.select("event_id", F.lit(True)))


@query("SELECT event_id, event_type, props AS payload FROM events WHERE event_id > 700 ORDER BY event_id LIMIT 128")
def events_after(spark, d):
    return table(spark, d, "events").where("event_id > 700").orderBy("event_id").limit(128).select("event_id", "event_type", F.to_json(F.from_json("props", "k int")).alias("p"), F.col("props").alias("payload")).drop("p")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0")
def series_lookup(spark, d):
    out = joins.attach(table(spark, d, "supplier").where("s_acctbal > 0"), table(spark, d, "nation"), {"s_nationkey": "n_nationkey"}, ["n_name", "n_regionkey"])
    return joins.attach(out, table(spark, d, "region"), {"n_regionkey": "r_regionkey"}, ["r_name"]).select("s_suppkey", "n_name", "r_name")


@query("SELECT pos, p_partkey, p_name FROM (SELECT unnest([7, 3, 99999999, 12]) AS k, generate_subscripts([7, 3, 99999999, 12], 1) - 1 AS pos) JOIN part ON k = p_partkey")
def items_by_id(spark, d):
    ids = spark.createDataFrame([(k, n) for n, k in enumerate([7, 3, 99999999, 12])], "p_partkey long, position long")
    return joins.in_order(ids, table(spark, d, "part"), "p_partkey").select(F.col("position").alias("pos"), "p_partkey", "p_name")


@query("SELECT p_partkey AS id, least(1.0, p_size / 50.0 + CASE WHEN p_partkey % 4 = 0 THEN 0.15 ELSE 0 END) AS confidence FROM part")
def confidence_boost(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("confidence"))
    return upserts.boost(rows, rows.where("id % 4 = 0"), "id", 0.15)


@query("WITH a AS (SELECT p_partkey AS path, p_size / 50.0 AS confidence FROM part ORDER BY 2, 1 LIMIT 40), b AS (SELECT 1000000 + s_suppkey AS path, s_nationkey / 25.0 AS confidence FROM supplier ORDER BY 2, 1 LIMIT 40) SELECT path FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE path NOT IN (SELECT doc_id FROM labels)")
def active_candidates(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("path"), (F.col("p_size") / 50.0).alias("confidence"))
    b = table(spark, d, "supplier").select((1000000 + F.col("s_suppkey")).alias("path"), (F.col("s_nationkey") / 25.0).alias("confidence"))
    return queues.unlabelled([a, b], table(spark, d, "labels").select(F.col("doc_id").alias("path")), "path", 20).select("path")


@query("SELECT c_custkey AS key, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def union_of_shards(spark, d):
    where = scratch(spark, "shards")
    table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")).write.parquet(f"{where}/a")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")).write.parquet(f"{where}/b")
    return shards(spark, [f"{where}/a", f"{where}/b"])


@query("SELECT * FROM (SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 200) WHERE event_type = 'error'")
def limit_then_filter(spark, d):
    return table(spark, d, "events").select("event_id", "event_type").orderBy("event_id").limit(200).where(F.col("event_type").cast("string") == "error")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60)")
def enqueue_once(spark, d):
    events = table(spark, d, "events")
    return events.where("event_type = 'signup'").select("user_id").distinct().join(events.where("event_type = 'error' and value > 60").select("user_id").distinct(), "user_id", "left_anti")


@query(r"SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, regexp_replace(printf('%.3f', p_retailprice / 7), '\.?0+$', '') AS price, CASE WHEN p_size > 25 THEN '1' ELSE '0' END AS large FROM part")
def export_rows(spark, d):
    return export_row(table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 7).alias("price"), (F.col("p_size") > 25).alias("large")))


@query("WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k")
def stream_sessions(spark, d):
    where = scratch(spark, "stream")
    out = streaming.finished(streaming.sessions(streaming.stream(spark, d), "2 hours"), f"{where}/state", f"{where}/table")
    return out.select("user_id", F.col("start").cast(NTZ).alias("start"), "n")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_latest(spark, d):
    where = scratch(spark, "stream")
    rows = streaming.stream(spark, d).select("user_id", "event_type", "event_id")
    streaming.into_versions(rows, "user_id", "event_id", f"{where}/table", f"{where}/state").awaitTermination()
    return streaming.last_by_key(spark.read.parquet(f"{where}/table").drop("batch"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query()
def calibrated_model(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    upper = F.length(F.regexp_replace("text", "[^A-Z]", "")) / (F.length("text") + 1)
    marks = F.length(F.regexp_replace("text", "[A-Za-z0-9 ]", "")) / (F.length("text") + 1)
    rows = docs.select(F.col("doc_id").alias("id"), upper.alias("upper"), marks.alias("marks"), F.log1p("n_chars").alias("size"), "quality")
    rows = written(rows, "features")  # the texts are read once
    return views.calibrated(rows, ["upper", "marks", "size"], "quality").select("rows", F.round("auc", 6).alias("auc"), F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))
