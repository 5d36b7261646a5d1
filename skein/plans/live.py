"""Queries over streams with state: web metrics, change log, queue and hand-over."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import table
from ..sources.shared import scratch
from ..streaming import changes, monitor
from ..streaming import events as streaming
from .catalog import long, query

NTZ = "timestamp_ntz"
LATE_MINUTES = 10


def metric_events(events: DataFrame) -> DataFrame:
    """Events as a web server's: sign-ups open connections, views close them, clicks are deliveries, errors drops, purchases requests."""
    k = F.get_json_object("props", "$.k").cast("int")
    of = lambda ws, sse: F.when(k % 2 == 0, ws).otherwise(sse)
    kinds = {"signup": of("ws_open", "sse_open"), "view": of("ws_close", "sse_close"), "click": F.lit("pushed"), "purchase": F.when(k % 10 == 0, "ai_error").otherwise("ai_request"), "error": F.lit("dropped")}
    kind = F.coalesce(*[F.when(F.col("event_type") == name, c) for name, c in kinds.items()])
    labels = F.to_json(F.struct((F.col("user_id") % 4).alias("client")))
    return events.select(labels.alias("labels_json"), F.col("event_id").alias("id"), "ts", kind.alias("kind"), F.lit(1).alias("count"), F.col("value").alias("lag_ms"))


@query(
    f"""WITH e AS (
        SELECT event_id, ts, value, event_type, '{{"client":' || user_id % 4 || '}}' AS labels_json, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
            make_timestamp(CAST(ceil(epoch_us(ts) / {monitor.FLUSH_SECONDS}000000.0) AS BIGINT) * {monitor.FLUSH_SECONDS}000000) AS due
        FROM events
    ), sums AS (
        SELECT *, sum(CASE WHEN k % 2 = 0 AND event_type = 'signup' THEN 1 WHEN k % 2 = 0 AND event_type = 'view' THEN -1 ELSE 0 END) OVER w AS ws,
            sum(CASE WHEN k % 2 = 1 AND event_type = 'signup' THEN 1 WHEN k % 2 = 1 AND event_type = 'view' THEN -1 ELSE 0 END) OVER w AS sse,
            count(*) FILTER (event_type = 'click') OVER w AS pushed, count(*) FILTER (event_type = 'error') OVER w AS dropped,
            count(*) FILTER (event_type = 'purchase') OVER w AS requests, count(*) FILTER (event_type = 'purchase' AND k % 10 = 0) OVER w AS errors
        FROM e WINDOW w AS (PARTITION BY labels_json ORDER BY ts, event_id)
    ), floored AS (
        SELECT *, ws - least(0, min(ws) OVER w) AS ws_connected, sse - least(0, min(sse) OVER w) AS sse_connected, row_number() OVER (PARTITION BY labels_json, due ORDER BY ts DESC, event_id DESC) AS back
        FROM sums WINDOW w AS (PARTITION BY labels_json ORDER BY ts, event_id)
    ), flushes AS (
        SELECT * FROM floored WHERE back = 1 AND due <= (SELECT max(ts) FROM events) - INTERVAL {LATE_MINUTES} MINUTE
    ), lags AS (
        SELECT f.labels_json, f.due, list_sort(list(c.value)) AS v FROM flushes f JOIN e c ON c.labels_json = f.labels_json AND c.event_type = 'click' AND c.ts BETWEEN f.due - INTERVAL {monitor.WINDOW_SECONDS} SECOND AND f.due GROUP BY ALL
    ), points AS (
        SELECT labels_json, due, v, (len(v) - 1) * 0.5 AS k50, (len(v) - 1) * 0.95 AS k95 FROM lags
    ), lag_points AS (
        SELECT labels_json, due, list_transform([k50, k95], lambda k: CASE WHEN floor(k) + 1 > len(v) - 1 THEN v[len(v)] ELSE v[CAST(floor(k) AS INT) + 1] * (floor(k) + 1 - k) + v[CAST(floor(k) AS INT) + 2] * (k - floor(k)) END) AS p FROM points
    )
    SELECT due AS at, labels_json, unnest({list(monitor.SERIES)}) AS series, unnest([ws_connected, sse_connected, pushed, dropped, requests, errors, coalesce(p[1], 0), coalesce(p[2], 0)]::DOUBLE[]) AS value
    FROM flushes LEFT JOIN lag_points USING (labels_json, due)"""
)
def web_metrics(spark, d):
    """All files of the table are one batch, as those in no order of time would lose their rows to the watermark."""
    where = scratch(spark, "metrics")
    rows = monitor.web_metrics(metric_events(streaming.stream(spark, d, files_per_batch=1_000_000)), f"{LATE_MINUTES} minutes")
    with monitor.state_store(spark):
        out = streaming.collected(rows, f"{where}/state", f"{where}/table")
    return out.withColumn("at", F.col("at").cast(NTZ))


# Change capture over five tables: first most of their rows, then all of them, every third with another score.
CAPTURED = {
    "customer": ("c_custkey", "c_name", "c_acctbal", "account"),
    "nation": ("n_nationkey", "n_name", None, "place"),
    "orders": ("o_orderkey", "o_orderpriority", "o_totalprice", "order"),
    "part": ("p_partkey", "p_name", "p_retailprice", "item"),
    "supplier": ("s_suppkey", "s_name", "s_acctbal", "account"),
}
CAPTURED_SQL = " UNION ALL ".join(f"SELECT '{t}' AS t, '{k}' AS kind, CAST({key} AS BIGINT) AS id, {name} AS title, {score or 'NULL'} AS score FROM {t}" for t, (key, name, score, k) in CAPTURED.items())
FEED = f"""WITH r AS ({CAPTURED_SQL}),
    changed AS (SELECT 0 AS batch, * FROM r WHERE id % 5 <> 0 UNION ALL SELECT 1, t, kind, id, title, score + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END FROM r WHERE id % 5 = 0 OR (id % 3 = 0 AND score IS NOT NULL)),
    shown AS (SELECT batch, kind, t AS vector_kind, t || ':' || id AS doc_id, '{{"table":"' || t || '","id":' || id || coalesce(',"score":' || score, '') || ',"title":"' || title || '"}}' AS payload_json FROM changed),
    feed AS (SELECT row_number() OVER (ORDER BY batch, doc_id, payload_json) AS seq, * FROM shown)"""


def _versions(spark, d, name):
    key, title, score, _ = CAPTURED[name]
    rows = table(spark, d, name).select(long(key).alias("id"), F.col(title).alias("title"), *([F.col(score).alias("score")] if score else []))
    later = rows.withColumn("score", F.when(F.col("id") % 3 == 0, F.col("score") + 1).otherwise(F.col("score"))) if score else rows
    return rows.where("id % 5 <> 0"), later


def _change_log(spark, d) -> changes.ChangeLog:
    """Both rounds of changes, captured into files and followed by a stream that stops and starts again in between."""
    where = scratch(spark, "changes")
    log = changes.ChangeLog(spark, f"{where}/log")
    for k in range(2):
        for name, (_, _, _, kind) in CAPTURED.items():
            before, after = _versions(spark, d, name)
            found = changes.captured(before if k else None, after if k else before, "id", name, kind)
            found.write.mode("append").parquet(f"{where}/captured")
        stream = spark.readStream.schema(changes.CHANGE).parquet(f"{where}/captured")
        log.follow(stream, f"{where}/state").awaitTermination()
    return log


@query(f"{FEED} SELECT seq, kind, doc_id, vector_kind, payload_json FROM feed")
def change_feed(spark, d):
    return _change_log(spark, d).after(0)


@query(f"{FEED}, q AS (SELECT doc_id, arg_max(vector_kind, seq) AS kind, max(seq) AS seq FROM feed GROUP BY 1) SELECT * FROM q QUALIFY row_number() OVER (ORDER BY seq) > 100")
def pending_vectors(spark, d):
    log = _change_log(spark, d)
    log.take(100, 0)
    return log.pending()


@query(
    f"""{FEED}, b AS (SELECT * EXCLUDE (batch), (seq - 1) // 128 AS batch FROM feed), n AS (SELECT *, count(*) OVER (PARTITION BY batch) AS n FROM b),
    s AS (SELECT *, CASE WHEN n > 50 THEN kind || ':' || coalesce(json_extract_string(payload_json, '$.id'), '') ELSE CAST(seq AS VARCHAR) END AS same FROM n),
    m AS (SELECT batch, same, max(seq) AS seq, min(seq) AS first FROM s GROUP BY 1, 2)
    SELECT m.batch, row_number() OVER (PARTITION BY m.batch ORDER BY first) AS place, m.seq, f.kind, f.doc_id, f.payload_json FROM m JOIN feed f ON f.seq = m.seq"""
)
def coalesced_feed(spark, d):
    out = changes.coalesced(_change_log(spark, d).after(0))
    return out.withColumn("place", long("place"))


@query(f"{FEED} SELECT seq, doc_id, CASE WHEN batch = 0 THEN 'replay' ELSE 'live' END AS how FROM feed WHERE seq > 40")
def replay_then_live(spark, d):
    """A reader that knows the first 40 changes: the rest of the first batch as a replay, then what comes as a stream."""
    log = _change_log(spark, d)
    upto = spark.read.parquet(f"{log.folder}/heads/batch=0").first().last
    where = scratch(spark, "reader")
    live = streaming.collected(log.live(upto), f"{where}/state", f"{where}/table")
    return log.after(40, upto).withColumn("how", F.lit("replay")).unionByName(live.withColumn("how", F.lit("live"))).select("seq", "doc_id", "how")
