"""Runnable queries over the driver's tables, each with the same question in DuckDB SQL.

Inventory columns come from ``documents``: path = source/lang/doc_id.txt, ext = lang, category = source,
size_bytes = n_chars. ``QUERIES`` maps names to functions of (spark, folder); ``SQL`` maps them to SQL.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, scores, text, vectors
from ..operators import audit, joins, metrics, pages, pairs, queues, reports, search, upserts, windows
from ..sources.readers import table
from ..sources.shared import scratch, written
from ..streaming import events as streaming

QUERIES: dict = {}
SQL: dict[str, str] = {}
INVENTORY = "SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, lang AS ext, source AS category, n_chars AS size_bytes FROM documents"
WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def inventory(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("path"), F.col("lang").alias("ext"), F.col("source").alias("category"), F.col("n_chars").alias("size_bytes"))


def long(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


# Reports


@query(f"SELECT count(*) AS total_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes, CAST(coalesce(floor(sum(size_bytes) / count(*)), 0) AS BIGINT) AS mean_bytes FROM ({INVENTORY})")
def report_overview(spark, d):
    return reports.overview(inventory(spark, d))


@query(f"SELECT coalesce(nullif(lower(trim(category)), ''), 'other') AS category, count(*) AS files, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS bytes FROM ({INVENTORY}) GROUP BY 1")
def report_categories(spark, d):
    return reports.categories(inventory(spark, d))


@query(
    f"""WITH g AS (SELECT CASE WHEN length(lower(trim(ext))) <= 6 THEN '.' || lower(trim(ext)) ELSE lower(trim(ext)) END AS ext, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM ({INVENTORY}) GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY files DESC, ext) AS a, row_number() OVER (ORDER BY bytes DESC, ext) AS b FROM g)
    SELECT ext, files, bytes, CASE WHEN a <= 3 THEN a END AS rank_count, CASE WHEN b <= 3 THEN b END AS rank_size FROM r WHERE a <= 3 OR b <= 3"""
)
def report_top_extensions(spark, d):
    out = reports.top_extensions(inventory(spark, d), 3)
    return out.withColumn("rank_count", long("rank_count")).withColumn("rank_size", long("rank_size"))


@query(f"SELECT path, size_bytes FROM ({INVENTORY}) ORDER BY size_bytes DESC NULLS LAST, path LIMIT 25")
def report_largest(spark, d):
    return reports.largest(inventory(spark, d), 25)


PAGE_PATH = "regexp_replace(split_part(url, '?', 1), '^https?://', '')"


@query(f"SELECT array_to_string(p[1:least(2, len(p) - 1)], '/') AS folder, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT string_split({PAGE_PATH}, '/') AS p, strlen(html) AS n FROM pages) WHERE len(p) > 1 GROUP BY 1 ORDER BY bytes DESC, folder LIMIT 20")
def report_heaviest_folders(spark, d):
    rows = table(spark, d, "pages").select(F.regexp_replace(F.substring_index("url", "?", 1), "^https?://", "").alias("path"), F.octet_length("html").alias("size_bytes"))
    return reports.heaviest_folders(rows, 2, 20)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderdate AS mtime, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01' - INTERVAL 30 DAY) AS recent_total FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01' - INTERVAL 30 DAY ORDER BY o_orderdate DESC, path LIMIT 15")
def report_recent(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("mtime"))
    return reports.recent(rows, F.lit("2001-07-01 00:00:00").cast("timestamp_ntz"), 30, 15)


@query("SELECT count(*) AS total_files, count(*) FILTER (lang = 'en') AS by_en, count(*) FILTER (lang = 'de') AS by_de, count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'de')) AS by_other FROM documents")
def stats_snapshot_pivot(spark, d):
    return reports.snapshot(table(spark, d, "documents"), ["en", "de"], "lang")


@query("SELECT path, human FROM (SELECT source || '/' || doc_id AS path, CASE WHEN coalesce(n_chars, 0) <= 0 THEN '0 B' WHEN n_chars >= 1048576 THEN printf('%.1f MB', n_chars / 1048576.0) WHEN n_chars >= 1024 THEN printf('%.1f KB', n_chars / 1024.0) ELSE n_chars || ' B' END AS human FROM documents)")
def human_sizes(spark, d):
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), paths.human_size(F.col("n_chars")).alias("human"))


# Pages and predicates


@query(f"SELECT path, size_bytes FROM ({INVENTORY}) WHERE (contains(lower(path), 'src1') OR contains(lower(split_part(path, '/', 3)), 'src1')) AND lower(ext) = 'en' ORDER BY lower(path), path LIMIT 100 OFFSET 10")
def inventory_page(spark, d):
    rows = pages.inventory(inventory(spark, d), q="SRC1", ext="EN")
    return pages.page(rows, [F.lower("path"), "path"], 100, 10).select("path", "size_bytes")


@query("SELECT CASE WHEN count(*) <= 10000 THEN count(*) END AS total FROM lineitem")
def guarded_count(spark, d):
    return pages.guarded_total(table(spark, d, "lineitem").select("l_orderkey"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%cold wid%' OR lower(p_brand) LIKE '%cold wid%' ORDER BY p_retailprice DESC NULLS LAST, p_brand, p_partkey LIMIT 1000")
def quick_search(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_name").alias("name"), F.concat("p_brand", F.lit(""), F.format_string("%012d", "p_partkey")).alias("path"), F.col("p_retailprice").alias("mtime"))
    return pages.quick_search(rows, "Cold  WID").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_size FROM part WHERE (nullif(p_size, 10) IS NULL OR p_size >= 30) AND (p_brand <> 'Brand#1') ORDER BY p_size, p_partkey LIMIT 200")
def null_tolerant_filters(spark, d):
    rows = table(spark, d, "part").withColumn("s", F.nullif("p_size", F.lit(10)))
    kept = pages.all_of(rows, [pages.null_or("s", lambda c: c >= 30), F.col("p_brand") != "Brand#1", None])
    return pages.page(kept, ["p_size", "p_partkey"], 200).select("p_partkey", "p_size")


@query(f"SELECT doc_id FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents) WHERE list_contains(w, 'the') AND list_contains(w, 'of')")
def contains_all(spark, d):
    return table(spark, d, "documents").where(pages.has_all(["the", "of"], text.tokens(F.col("text")))).select("doc_id")


@query("SELECT p_partkey AS path, CASE WHEN p_size = 7 THEN NULL ELSE p_size / 50.0 END AS confidence FROM part WHERE p_size = 7 OR p_size / 50.0 BETWEEN 0.1 AND 0.3 ORDER BY confidence ASC NULLS LAST, path LIMIT 50")
def low_confidence_rows(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") != 7, F.col("p_size") / 50.0).alias("confidence"))
    return pages.low_confidence(rows, 0.1, 0.3, 50)


@query("SELECT * FROM (SELECT event_id, event_type FROM events WHERE lower(event_type) = 'error' ORDER BY event_id DESC LIMIT 20) ORDER BY event_id")
def last_log_entries(spark, d):
    log = table(spark, d, "events").select("event_id", F.col("event_type"), F.col("event_type").alias("level"), F.col("event_id").alias("position"))
    return pages.last_entries(log, 20, level="ERROR").select("event_id", "event_type")


@query("SELECT r_regionkey, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3 GROUP BY 1")
def read_only_sql(spark, d):
    for t in ("nation", "region"):
        table(spark, d, t).createOrReplaceTempView(t)
    return pages.read_only_sql(spark, "SELECT r_regionkey, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > ? GROUP BY 1", [3])


# Joins


@query("SELECT o_orderkey, c_name, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_join_profile(spark, d):
    orders, customer = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").where("c_acctbal > 0")
    out = joins.attach(orders, customer, {"o_custkey": "c_custkey"}, ["c_name", "c_mktsegment", "c_nationkey"])
    return joins.attach(out, table(spark, d, "nation"), {"c_nationkey": "n_nationkey"}, ["n_name"]).select("o_orderkey", "c_name", "c_mktsegment", "n_name")


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS has_return, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AS has_bulk FROM orders")
def exists_flags(spark, d):
    lines = table(spark, d, "lineitem")
    out = joins.flag(table(spark, d, "orders").select("o_orderkey"), lines.where("l_returnflag = 'R'"), "o_orderkey", "l_orderkey", "has_return")
    return joins.flag(out, lines.where("l_quantity > 49"), "o_orderkey", "l_orderkey", "has_bulk")


@query("SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS updated FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE updated IS NULL OR updated < o_orderdate")
def stale_anti_join(spark, d):
    derived = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("updated"))
    return joins.stale(table(spark, d, "orders"), derived, "o_orderkey", "o_orderdate", "updated").select("o_orderkey")


@query(
    """WITH cur AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 5 <> 0),
    old AS (SELECT doc_id, n_chars AS size, doc_id % 11 = 0 AS deleted FROM documents WHERE doc_id % 3 <> 0)
    SELECT coalesce(cur.doc_id, old.doc_id) AS doc_id, CASE WHEN old.doc_id IS NULL THEN 'new' WHEN cur.doc_id IS NULL THEN CASE WHEN deleted THEN 'deleted' ELSE 'vanished' END WHEN deleted THEN 'resurrected' WHEN cur.size IS NOT DISTINCT FROM old.size THEN 'unchanged' ELSE 'modified' END AS status
    FROM cur FULL OUTER JOIN old ON cur.doc_id = old.doc_id"""
)
def delta_full_outer(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    now = docs.where("doc_id % 5 <> 0").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("size"))
    old = docs.where("doc_id % 3 <> 0").select("doc_id", F.col("n_chars").alias("size"), (F.col("doc_id") % 11 == 0).alias("deleted"))
    return joins.changes(now, old, "doc_id", ["size"])


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 3")
def top3_per_key(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    out = joins.top_per_key(lines, "l_suppkey", 3, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"))
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", long("rn").alias("rn"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, d):
    return joins.latest_per_key(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query(
    """SELECT l_orderkey AS folder, string_agg(printf('%s:%d %s (%d) [%.2f]', l_returnflag, l_partkey, l_linestatus, year(l_shipdate), l_discount), '; ' ORDER BY rn) AS candidates
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey, l_linenumber) AS rn FROM (SELECT DISTINCT ON (l_orderkey, l_partkey) * FROM lineitem ORDER BY l_orderkey, l_partkey, l_linenumber, l_discount, l_extendedprice)) WHERE rn <= 3 GROUP BY 1"""
)
def candidate_lists(spark, d):
    lines = table(spark, d, "lineitem")
    first = lines.groupBy("l_orderkey", "l_partkey").agg(F.min_by(F.struct("l_returnflag", "l_linestatus", "l_shipdate", "l_discount"), F.struct("l_linenumber", "l_discount", "l_extendedprice")).alias("x"))
    rows = first.select(F.col("l_orderkey").alias("folder"), F.col("x.l_returnflag").alias("source"), F.col("l_partkey").alias("candidate_id"), F.col("x.l_linestatus").alias("title"), F.year("x.l_shipdate").alias("year"), F.col("x.l_discount").alias("score"))
    return joins.candidates_text(rows, "folder")


@query(
    """WITH hits AS (SELECT source AS drive, CAST(doc_id % 50 AS VARCHAR) AS path, (n_chars % 97) / 97.0 AS score, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang || doc_id END AS snippet, 'a' AS src, doc_id FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT source, CAST(doc_id % 50 AS VARCHAR), (n_chars % 89) / 89.0, lang || doc_id, 'b', doc_id FROM documents WHERE doc_id % 3 = 0)
    SELECT drive, path, round(max(score), 6) AS score, string_agg(DISTINCT src, ',' ORDER BY src) AS sources, count(*) FILTER (snippet <> '') > 0 AS has_snippet FROM hits GROUP BY 1, 2"""
)
def federated_merge(spark, d):
    docs = table(spark, d, "documents")
    hit = lambda rows, m, snip, src: rows.select(F.col("source").alias("drive"), (F.col("doc_id") % 50).cast("string").alias("path"), ((F.col("n_chars") % m) / float(m)).alias("score"), snip.alias("snippet"), F.lit(src).alias("source"))
    label = F.concat("lang", F.col("doc_id").cast("string"))
    out = joins.federated([hit(docs.where("doc_id % 2 = 0"), 97, F.when(F.col("doc_id") % 4 == 0, "").otherwise(label), "a"), hit(docs.where("doc_id % 3 = 0"), 89, label, "b")])
    return out.select("drive", "path", F.round("score", 6).alias("score"), "sources", F.col("snippet").isNotNull().alias("has_snippet"))


# Aggregates


@query("SELECT count(*) FILTER (c >= 0.8) AS high, count(*) FILTER (c >= 0.5 AND c < 0.8) AS medium, count(*) FILTER (c < 0.5) AS low, count(*) AS total FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (o_orderkey % 100) / 100.0 END AS c FROM orders)")
def confidence_buckets(spark, d):
    c = F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 100) / 100.0)
    return metrics.confidence_buckets(table(spark, d, "orders").select(c.alias("c")), F.col("c"))


@query("SELECT event_type, max(value) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def max_per_series(spark, d):
    return table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).groupBy("event_type").agg(F.max("value").alias("value"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentiles(spark, d):
    out = metrics.percentiles(table(spark, d, "events"), "event_type", "value", [0.5, 0.95])
    return out.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = ceil(0.95 * (n - 1))")
def ceil_percentile(spark, d):
    return metrics.ceil_rank_percentile(table(spark, d, "events"), "event_type", "value", 0.95)


@query("SELECT CASE WHEN value <= 10 THEN '10' WHEN value <= 50 THEN '50' WHEN value <= 100 THEN '100' ELSE 'inf' END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def histogram_fixed(spark, d):
    return metrics.histogram(table(spark, d, "events"), "value", [10, 50, 100])


RELIABILITY = """SELECT b.bin, coalesce(n, 0) AS n, round(coalesce(accuracy, 0), 6) AS accuracy, round(coalesce(confidence, 0), 6) AS confidence FROM range(10) b(bin)
    LEFT JOIN (SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(quality) AS accuracy, avg(p) AS confidence FROM (SELECT quality, (n_chars % 1000) / 999.0 AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1) x ON b.bin = x.bin"""


def _bins(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(((F.col("n_chars") % 1000) / 999.0).alias("p"), "quality")
    return metrics.reliability(rows, "p", "quality")


@query(RELIABILITY)
def reliability_bins(spark, d):
    return _bins(spark, d).select("bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"))


@query("WITH r AS (SELECT quality, (n_chars % 1000) / 999.0 AS p FROM documents JOIN labels USING (doc_id)), b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(quality) AS a, avg(p) AS c FROM r GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b")
def calibration_error(spark, d):
    return metrics.calibration_error(_bins(spark, d)).select(F.round("ece", 6).alias("ece"))


@query("SELECT substr(p_name, 1, 2) AS chunk, md5(string_agg(p_name, '' ORDER BY p_name)) AS digest FROM part GROUP BY 1")
def ordered_digest(spark, d):
    return metrics.ordered_digest(table(spark, d, "part"), "p_name")


@query("WITH b AS (SELECT count(*) AS rows_, count(DISTINCT user_id) AS users, CAST(sum(value) AS BIGINT) AS total FROM events WHERE event_id % 2 = 0), c AS (SELECT count(*) AS rows_, count(DISTINCT user_id) AS users, CAST(sum(value) AS BIGINT) AS total FROM events WHERE event_id % 3 = 0) SELECT u.* FROM b, c, LATERAL (VALUES ('rows_', greatest(0, c.rows_ - b.rows_), greatest(0, b.rows_ - c.rows_)), ('users', greatest(0, c.users - b.users), greatest(0, b.users - c.users))) u(counter, added, removed)")
def baseline_delta(spark, d):
    events = table(spark, d, "events")
    one = lambda m: events.where(F.col("event_id") % m == 0).agg(F.count("*").alias("rows_"), F.countDistinct("user_id").alias("users"))
    return audit.compare_counters(one(2), one(3), ["rows_", "users"]).select("counter", long("added").alias("added"), long("removed").alias("removed"))


@query("SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS calls, count(*) > 1 AS over FROM events GROUP BY 1, 2")
def rate_budget(spark, d):
    return metrics.rate_by_minute(table(spark, d, "events"), "user_id", "ts", 1).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("WITH e AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) SELECT event_type AS provider, arg_max(event_id, (ts, event_id)) AS latest, count(*) FILTER (event_type = 'error') AS problems FROM e GROUP BY 1")
def provider_health(spark, d):
    log = table(spark, d, "events").select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("provider"), F.col("event_id").alias("message"), F.col("event_type").alias("level"))
    return audit.provider_health(log)


# Windows and budgets


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, coalesce(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders) WHERE before < 300000")
def running_budget(spark, d):
    orders = table(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    return windows.fill_budget(orders, "price", 300000, F.asc("o_orderdate"), F.asc("o_orderkey"), by=["o_custkey"]).select("o_custkey", "o_orderkey")


@query(
    """WITH b AS (SELECT event_id AS backup_id, ts AS created, CAST(ts AS DATE) AS day, date_trunc('week', ts) AS week FROM events WHERE event_type = 'signup'),
    r AS (SELECT *, row_number() OVER (ORDER BY created DESC, backup_id DESC) AS nth, row_number() OVER (PARTITION BY day ORDER BY created DESC, backup_id DESC) AS fd, dense_rank() OVER (ORDER BY day DESC) AS rd, row_number() OVER (PARTITION BY week ORDER BY created DESC, backup_id DESC) AS fw, dense_rank() OVER (ORDER BY week DESC) AS rw FROM b)
    SELECT backup_id, concat_ws(',', CASE WHEN nth <= 4 THEN 'last' END, CASE WHEN fd = 1 AND rd <= 7 THEN 'daily' END, CASE WHEN fw = 1 AND rw <= 3 THEN 'weekly' END) AS reasons FROM r WHERE nth <= 4 OR fd = 1 AND rd <= 7 OR fw = 1 AND rw <= 3"""
)
def retention_daily_weekly(spark, d):
    backups = table(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("backup_id"), F.col("ts").alias("created"))
    return windows.retention(backups, 4, 7, 3)


@query("WITH r AS (SELECT o_orderkey, coalesce(sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(o_custkey) OVER () AS total FROM orders) SELECT o_orderkey FROM r WHERE before < total - 50000")
def size_cap(spark, d):
    return windows.over_cap(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", 50_000, F.asc("o_orderdate"), F.asc("o_orderkey")).select("o_orderkey")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, min(event_id) AS at FROM events GROUP BY 1")
def coalesce_events(spark, d):
    return windows.coalesce_events(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


# Text


@query(
    f"""WITH t AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t WHERE length(term) >= 3 GROUP BY 1, 2)
    SELECT doc_id, rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 5"""
)
def keyword_topk(spark, d):
    return search.keywords(table(spark, d, "documents"), "doc_id", "text", 5).select("doc_id", long("rank").alias("rank"), "term", "n")


@query(
    f"""WITH w AS (SELECT item_id, list_distinct({WORDS.format('b.text')}) AS a FROM benchmark b), c AS (SELECT item_id, a, lead(a) OVER (ORDER BY item_id) AS b FROM w)
    SELECT item_id, round(CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 0 END, 6) AS similarity FROM c WHERE b IS NOT NULL"""
)
def jaccard(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.array_distinct(text.tokens(F.col("text"))).alias("a"))
    # each item meets the next one by its number; numbers are given by ranges
    placed = written(windows.numbered(rows, "n", "item_id"), "items")
    both = placed.join(placed.select((F.col("n") - 1).alias("n"), F.col("a").alias("b")), "n")
    return both.select("item_id", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


BM25 = f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS t FROM documents), s AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM w),
    q AS (SELECT doc_id, len(t) AS length, term, len(list_filter(t, lambda x: x = term)) AS tf FROM w, (VALUES ('the'), ('with'), ('haha')) v(term)), h AS (SELECT * FROM q WHERE tf > 0), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
    SELECT doc_id, sum(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))) AS score FROM h JOIN f USING (term), s GROUP BY 1 HAVING count(*) = 3"""


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({BM25})")
def bm25_search(spark, d):
    return search.bm25(table(spark, d, "documents"), "doc_id", "text", ["the", "with", "haha"]).select("doc_id", F.round("score", 6).alias("score"))


COSINE = "SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings"


def _first_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({COSINE}) ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    return search.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d), 20).select("vec_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH v AS (SELECT vec_id AS id, score AS v FROM ({COSINE}) ORDER BY score DESC, vec_id LIMIT 300), t AS (SELECT doc_id AS id, score / (1 + score) AS t FROM ({BM25}))
    SELECT id, round(coalesce(0.6 * v + 0.4 * t, v, t), 5) AS score FROM v FULL OUTER JOIN t USING (id)"""
)
def hybrid_search(spark, d):
    v = search.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d), 300).withColumnRenamed("vec_id", "id")
    t = search.bm25(table(spark, d, "documents"), "doc_id", "text", ["the", "with", "haha"]).withColumnRenamed("doc_id", "id")
    return search.hybrid(v, t, "id").select("id", F.round("score", 5).alias("score"))


# Pairs


# each vector, and a copy with up to eleven leading elements negated
VECTORS = "(SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x, i: CASE WHEN i <= vec_id % 12 THEN -x ELSE x END) FROM embeddings)"
BITS = "list_reduce(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), lambda a, b: a || b)"
CODES = "list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN 2 WHEN x > -0.1 THEN 1 ELSE 0 END)"
# one row for each distinct print, with its least key; pairs between these, and each further key at its representative
MOST_BITS, MOST_CODES = 16, 9  # similarity 0.75 and distance 0.15 of 64
HAMMING = f"WITH v AS (SELECT vec_id, {BITS} AS bits FROM {VECTORS}), b AS (SELECT bits, min(vec_id) AS key FROM v GROUP BY 1) SELECT x.key AS key_a, y.key AS key_b, CAST(hamming(x.bits, y.bits) AS INTEGER) AS distance FROM b x JOIN b y ON x.key < y.key WHERE hamming(x.bits, y.bits) <= {MOST_BITS} UNION ALL SELECT key, vec_id, 0 FROM v JOIN b USING (bits) WHERE vec_id <> key"
APART = "len(list_filter(list_zip(x.c, y.c), lambda z: z[1] <> z[2]))"
POSITIONAL = f"WITH v AS (SELECT vec_id, {CODES} AS c FROM {VECTORS}), b AS (SELECT c, min(vec_id) AS key FROM v GROUP BY 1) SELECT x.key AS key_a, y.key AS key_b, round(1 - {APART} / 64, 6) AS score FROM b x JOIN b y ON x.key < y.key WHERE {APART} <= {MOST_CODES} UNION ALL SELECT key, vec_id, 1.0 FROM v JOIN b USING (c) WHERE vec_id <> key"
# rows equal in both prints as one
CONSENSUS = f"""WITH v AS (SELECT vec_id, {BITS} AS bits, {CODES} AS c FROM {VECTORS}),
r AS (SELECT bits, c, min(vec_id) AS key FROM v GROUP BY 1, 2),
b AS (SELECT bits, min(key) AS key FROM r GROUP BY 1),
video AS (SELECT x.key AS key_a, y.key AS key_b, 1 - hamming(x.bits, y.bits) / 64 AS s FROM b x JOIN b y ON x.key < y.key WHERE hamming(x.bits, y.bits) <= {MOST_BITS} UNION ALL SELECT b.key, r.key, 1.0 FROM r JOIN b USING (bits) WHERE r.key <> b.key),
audio AS (SELECT x.key AS key_a, y.key AS key_b, 1 - {APART} / 64 AS s, 1 - hamming(x.bits, y.bits) / 64 AS w FROM r x JOIN r y ON x.key < y.key WHERE {APART} <= {MOST_CODES})
SELECT key_a, key_b, round(s, 8) AS score, 'video' AS reason FROM video UNION ALL SELECT key_a, key_b, round(s, 8), 'audio' FROM audio
UNION ALL SELECT key_a, key_b, round(0.7 * w + 0.3 * s, 8), 'consensus' FROM audio WHERE w >= 1 - {MOST_BITS} / 64
UNION ALL SELECT r.key, v.vec_id, 1.0, 'copy' FROM v JOIN r USING (bits, c) WHERE v.vec_id <> r.key"""


def _vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding").repartition(F.col("vec_id"))
    copy = F.transform("embedding", lambda x, i: F.when(i < F.col("vec_id") % 12, -x).otherwise(x))
    return rows.union(rows.select(F.col("vec_id") + 1000000, copy))


def _prints(spark, d):
    codes = F.transform("embedding", lambda x: F.when(x > 0.1, 2).when(x > -0.1, 1).otherwise(0))
    return written(_vectors(spark, d).select("vec_id", vectors.sign_bits(F.col("embedding")).alias("bits"), codes.alias("codes")), "prints")


def _bit_pairs(prints, key):
    first, copies = pairs.classes(prints, key, "bits")
    return pairs.within_bits(written(first, "prints"), "key", "bits", MOST_BITS).union(copies.withColumn("distance", F.lit(0)))


@query(HAMMING)
def pair_hamming(spark, d):
    return _bit_pairs(_prints(spark, d), "vec_id")


@query(POSITIONAL)
def pair_positional(spark, d):
    first, copies = pairs.classes(_prints(spark, d), "vec_id", "codes")
    found = pairs.positional(written(first, "prints"), "key", "codes").union(copies.withColumn("score", F.lit(1.0)))
    return found.select("key_a", "key_b", F.round("score", 6).alias("score"))


@query(CONSENSUS)
def pair_consensus(spark, d):
    first, copies = pairs.classes(_prints(spark, d), "vec_id", "bits", "codes")
    first = written(first, "prints")
    alike = (1 - F.col("distance") / 64).alias("score")
    audio = written(pairs.positional(first, "key", "codes"), "pairs")
    both = pairs.still_within(audio, first, "key", "bits", MOST_BITS).select("key_a", "key_b", alike)
    found = pairs.consensus(_bit_pairs(first, "key").select("key_a", "key_b", alike), audio, both)
    return found.union(copies.select("*", F.lit(1.0), F.lit("copy"))).withColumn("score", F.round("score", 8))


@query("WITH g AS (SELECT text, min(doc_id) AS first, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT doc_id, first, copies FROM documents JOIN g USING (text)")
def same_content(spark, d):
    return pairs.same_content(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


# Writes


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0 UNION ALL SELECT event_id, 'new', value + 1 FROM events WHERE event_id % 3 = 0")
def upsert_keyed(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    new = events.where("event_id % 3 = 0").select("event_id", F.lit("new").alias("event_type"), (F.col("value") + 1).alias("value"))
    return upserts.upsert(events.where("event_id % 2 = 0"), new, "event_id")


@query("SELECT least(p_brand, p_type) AS path_a, greatest(p_brand, p_type) AS path_b, 'x' AS reason, max(p_retailprice) AS score FROM part WHERE p_brand <> p_type GROUP BY 1, 2")
def max_merge(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("path_a"), F.col("p_type").alias("path_b"), F.lit("x").alias("reason"), F.col("p_retailprice").alias("score"), "p_partkey")
    return upserts.largest_score(rows.where("p_partkey % 2 = 0").drop("p_partkey"), rows.where("p_partkey % 2 = 1").drop("p_partkey"))


@query("WITH o AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1), n AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1) SELECT * FROM o UNION ALL SELECT n.* FROM n ANTI JOIN o USING (user_id)")
def first_wins(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id")
    old = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return upserts.first_wins(old, events, "user_id", "event_id")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def change_log(spark, d):
    after = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    before = after.where("c_custkey % 3 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "old").otherwise(F.col("c_mktsegment")))
    return upserts.change_log(before, after, "c_custkey", "customer").select("c_custkey", F.get_json_object("payload_json", "$.c_mktsegment").alias("c_mktsegment"))


@query("SELECT p_partkey, p_size % 4 = 0 AS deleted FROM part WHERE p_partkey < 500 UNION ALL SELECT p_partkey, true FROM part WHERE p_partkey >= 500")
def soft_delete(spark, d):
    files = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") >= 500).alias("deleted"), F.lit(None).cast("timestamp_ntz").alias("deleted_ts"))
    gone = files.where("p_size % 4 = 0")
    return upserts.soft_delete(files, gone, "p_partkey", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).select("p_partkey", "deleted")


# Scores and JSON


@query(
    """WITH p AS (SELECT p_partkey, 640 + p_size * 40 AS w, 360 + p_size * 20 AS h, p_retailprice * 2 AS k, p_partkey % 3 AS c, p_partkey % 4 AS a, p_partkey % 5 AS s, p_size * 100.0 AS sec, 40 AS mins FROM part),
    q AS (SELECT *, k / (w * h / 1e6) / 1500 AS share FROM p)
    SELECT p_partkey, CAST(least(100, greatest(0, 100 - CASE WHEN share <= 0.5 THEN 25 WHEN share <= 0.75 THEN 18 WHEN share < 1 THEN 10 ELSE 0 END - CASE WHEN c < 2 THEN 10 ELSE 0 END - CASE WHEN s = 0 THEN 10 ELSE 0 END - CASE WHEN abs(sec - mins * 60) > 0.1 * mins * 60 THEN 10 ELSE 0 END + CASE WHEN a > 1 THEN 3 ELSE 0 END + CASE WHEN s > 1 THEN 3 ELSE 0 END)) AS INTEGER) AS score FROM q"""
)
def score_rules(spark, d):
    p = table(spark, d, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    score = scores.video_quality(640 + size * 40, 360 + size * 20, F.col("p_retailprice") * 2, key % 3, key % 4, key % 5, F.lit(True), size * 100.0, F.lit(40))
    return p.select("p_partkey", score.cast("int").alias("score"))


@query(
    """SELECT p_partkey, round(least(1.0, greatest(0.0, CASE WHEN p_size % 2 = 0 THEN 0.35 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.25 ELSE 0 END + 0.15 * CASE WHEN p_size / 50.0 >= 0.85 THEN 1 ELSE p_size / 50.0 END - CASE WHEN p_size % 5 = 0 THEN 0.10 WHEN p_size % 7 = 0 THEN 0.03 ELSE 0 END)), 6) AS confidence FROM part"""
)
def penalties(spark, d):
    size = F.col("p_size")
    issues = F.when(size % 5 == 0, F.array(F.lit("missing_year:x"))).when(size % 7 == 0, F.array(F.lit("extra_files:2"))).otherwise(F.array().cast("array<string>"))
    c = scores.folder_confidence(size % 2 == 0, size % 3 == 0, F.lit(False), size / 50.0, F.lit(False), issues)
    return table(spark, d, "part").select("p_partkey", F.round(c, 6).alias("confidence"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS keys FROM events")
def tolerant_json(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[broken"), "props")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.size(text.json_dict(raw)).alias("keys"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds FROM events")
def iso_time_roundtrip(spark, d):
    rows = table(spark, d, "events").select("event_id", text.iso_utc(F.col("ts").cast("timestamp")).alias("iso"))
    return rows.select("event_id", "iso", F.unix_seconds(text.parse_iso(F.col("iso"))).alias("seconds"))


@query(f"SELECT page_id, array_to_string(p[1:greatest(0, len(p) - 1)], '/') AS folder, p[len(p)] AS name FROM (SELECT page_id, string_split({PAGE_PATH}, '/') AS p FROM pages)")
def path_parts(spark, d):
    path = F.regexp_replace(F.substring_index("url", "?", 1), "^https?://", "")
    rows = table(spark, d, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", paths.parent_folder(F.col("path")).alias("folder"), paths.basename(F.col("path")).alias("name"))


@query("SELECT doc_id, rtrim(translate(base64(encode('{\"drive\":\"' || source || '\",\"type\":\"doc\",\"key\":\"' || doc_id || '\"}')), '+/', '-_'), '=') AS token, CAST(doc_id AS VARCHAR) AS key FROM documents")
def media_tokens(spark, d):
    rows = table(spark, d, "documents").select("doc_id", paths.media_token(F.col("source"), F.lit("doc"), F.col("doc_id").cast("string")).alias("token"))
    return rows.select("doc_id", "token", paths.media_token_parts(F.col("token"))["key"].alias("key"))


# Queues and streams


@query(
    """WITH j AS (SELECT o_orderkey AS job_id, o_orderpriority AS resource, CASE WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'done' END AS status, o_custkey % 5 AS priority, o_orderdate AS created FROM orders),
    f AS (SELECT resource, count(*) // 3 + 25 - count(*) FILTER (status = 'running') AS free FROM j GROUP BY 1), w AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY priority, created, job_id) AS nth FROM j WHERE status = 'queued')
    SELECT job_id, resource, nth FROM w JOIN f USING (resource) WHERE nth <= free"""
)
def queue_dispatch(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("done")
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("resource"), status.alias("status"), (F.col("o_custkey") % 5).alias("priority"), F.col("o_orderdate").alias("created"))
    slots = jobs.groupBy("resource").agg((F.expr("count(*) div 3") + 25).alias("slots"))
    return queues.dispatch(jobs, slots).withColumn("nth", long("nth"))


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 120 SECOND THEN CASE WHEN o_custkey % 4 >= 3 THEN 'failed' ELSE 'queued' END WHEN o_orderstatus = 'P' THEN 'running' ELSE 'done' END AS status FROM orders")
def queue_requeue(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), (F.col("o_custkey") % 4).alias("attempts"), F.col("o_orderdate").alias("heartbeat"))
    return queues.requeue_stale(jobs, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), 60, 3).select("job_id", "status")


@query()
def diverse_sample(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", ((F.col("vec_id") % 101) / 101.0).alias("p"))
    return queues.diverse(queues.uncertain(rows, "vec_id", "p", 200).select("vec_id", "embedding", "uncertainty"), "vec_id", "embedding", 20)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    where = scratch(spark, "stream")
    out = streaming.finished(streaming.window_counts(streaming.stream(spark, d)), f"{where}/state", f"{where}/table")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
