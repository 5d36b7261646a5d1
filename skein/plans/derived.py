"""Queries over names, JSON, YAML and lists that columns of the tables make up, with the same answers by SQL's own means."""

from pyspark.sql import functions as F

from ..functions import episodes, media, names, paths, text
from ..operators import enrich, pages, upserts
from ..sources import readers
from ..sources.readers import table
from ..sources.shared import written
from .catalog import query

# A document's first line as words, and the first of them.
LINE = "trim(regexp_replace(coalesce(string_split(text, chr(10))[1], ''), '[^a-zA-Z ]+', ' ', 'g'))"
WORDS = f"list_filter(string_split({LINE}, ' '), lambda w: w <> '')"


def _words():
    line = F.regexp_replace(F.coalesce(F.get(F.split("text", "\n"), F.lit(0)), F.lit("")), "[^a-zA-Z ]+", " ")
    return F.filter(F.split(F.trim(line), " "), lambda w: w != "")


def _word(k: int):
    return F.coalesce(F.get(_words(), F.lit(k)), F.lit("None"))


# Music: a folder by source, a track by id, artist and title by the first words; some with a guest, tags or no dash.
MUSIC = f"""m AS (SELECT doc_id, {WORDS} AS w, source, lang FROM documents),
    p AS (SELECT doc_id, coalesce(w[1], 'None') AS a, coalesce(w[2], 'None') AS b, coalesce(w[3], 'None') AS c, coalesce(w[4], 'None') AS e, source, lang FROM m WHERE source IS NOT NULL)"""


def _music(spark, d):
    docs = table(spark, d, "documents").where("source is not null")
    a, b, c, e = (_word(k) for k in range(4))
    long_ = F.col("n_chars") > 1000
    guest = F.when(F.col("lang") == "en", F.concat(F.lit(" feat. "), c)).otherwise("")
    tags = F.when(long_, F.concat(F.lit(" (Official "), e, F.lit(") ["), (F.col("n_chars") % 2000).cast("string"), F.lit("p]"))).otherwise("")
    name = F.concat(F.lpad((F.col("doc_id") % 90 + 1).cast("string"), 2, "0"), F.lit("_"), a, guest, F.when(F.col("lang") == "de", "_").otherwise(" - "), b, F.lit("_"), c, tags, F.lit(".mp3"))
    return docs.select("doc_id", names.music_name(F.concat(F.lit("x/"), name), F.array(F.lit("Music"), F.col("source"))).alias("m"))


@query(
    f"""WITH {MUSIC}, t AS (SELECT p.*, CASE WHEN n_chars > 1000 AND NOT (n_chars % 2000 BETWEEN 100 AND 9999) THEN ' ' || (n_chars % 2000) || 'p' ELSE '' END AS size FROM p JOIN documents USING (doc_id))
    SELECT doc_id, CASE WHEN lang = 'de' THEN 'Music' WHEN lang = 'en' AND lower(a) IN ('with', 'x') THEN a || ' feat ' || c ELSE a END AS artist, CASE WHEN lang = 'de' THEN a || ' ' || b || ' ' || c ELSE b || ' ' || c END || size AS title,
        CASE WHEN lower(source) <> lower(a) OR lang = 'de' THEN source END AS album, lpad((doc_id % 90 + 1)::VARCHAR, 2, '0') AS track FROM t WHERE lang IS NOT NULL"""
)
def music_names(spark, d):
    return _music(spark, d).join(table(spark, d, "documents").where("lang is not null").select("doc_id"), "doc_id").select("doc_id", "m.artist", "m.title", "m.album", "m.track")


@query(
    f"""WITH {MUSIC}, s AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'music' ELSE lower(a) END AS artist, CASE WHEN lang = 'de' THEN lower(a || ' ' || b || ' ' || c) ELSE lower(b || ' ' || c) END AS title, lang FROM p WHERE lang IS NOT NULL)
    SELECT doc_id, round(greatest(0, least(1, 0.4 + 0.3 + 0.05 + 0.05 + CASE WHEN lang = 'de' THEN 0 ELSE 0.1 END - CASE WHEN artist SIMILAR TO '.*(unknown|various|untitled).*' THEN 0.25 ELSE 0 END - CASE WHEN title SIMILAR TO '.*(track|untitled|unknown).*' THEN 0.15 ELSE 0 END)), 6) AS score FROM s"""
)
def music_scores(spark, d):
    return _music(spark, d).join(table(spark, d, "documents").where("lang is not null").select("doc_id"), "doc_id").select("doc_id", F.round(names.music_score(F.col("m")), 6).alias("score"))


@query(
    """WITH f AS (SELECT o_orderkey, string_split(o_orderpriority, '-') AS p, o_custkey AS n, o_orderstatus AS s FROM orders)
    SELECT o_orderkey, CASE WHEN s = 'P' THEN 0 WHEN n < 1000 AND s IN ('O', 'F') THEN n END::INTEGER AS season, s = 'P' OR (s = 'O' AND n < 1000) AS canonical FROM f"""
)
def season_numbers(spark, d):
    """Folders ``Season_17``, ``S17`` and ``Specials`` by an order's status and customer; numbers have three digits at most."""
    n, status = F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    name = F.when(status == "O", F.concat(F.lit("Season_"), n)).when(status == "F", F.concat(F.lit("S"), n)).when(status == "P", "Season Specials")
    return table(spark, d, "orders").select("o_orderkey", names.season_number(name).alias("s")).select("o_orderkey", F.col("s.number").alias("season"), F.coalesce("s.canonical", F.lit(False)).alias("canonical"))


@query("SELECT page_id, url LIKE '%/en/%' OR url LIKE '%#top' OR regexp_full_match(split_part(url, '/', -1), '[0-9][0-9]') AS ignored, starts_with(split_part(regexp_replace(url, '/m[.]', '/.'), '/', -1), '.') AS hidden FROM pages")
def ignored_paths(spark, d):
    url = F.col("url")
    two = F.length(paths.basename(url)) == 2
    fits = paths.glob_match(url, ["*/en/*", "*#top"]) | (paths.glob_match(url, ["??"]) & two & paths.basename(url).rlike("^[0-9]+$"))
    return table(spark, d, "pages").select("page_id", fits.alias("ignored"), paths.hidden(F.regexp_replace(url, "/m[.]", "/.")).alias("hidden"))


@query(f"SELECT path, CASE WHEN n_chars < 1000 THEN lower(split_part(path, '/', 2)) ELSE lang END AS name FROM (SELECT doc_id, n_chars, lang, source || '/' || {WORDS}[1] || '.TXT' AS path FROM documents) WHERE path IS NOT NULL AND lang IS NOT NULL")
def filled_names(spark, d):
    docs = table(spark, d, "documents").where("lang is not null").select(F.concat("source", F.lit("/"), F.get(_words(), F.lit(0)), F.lit(".TXT")).alias("path"), F.when(F.col("n_chars") < 1000, "").otherwise(F.col("lang")).alias("name"))
    return pages.with_name(docs.where("path is not null")).select("path", "name")


# JSON and lists

@query("SELECT doc_id, list_aggregate(list_filter(['doc_id', CASE WHEN lang IS NOT NULL THEN 'lang' END, CASE WHEN source IS NOT NULL THEN 'source' END, CASE WHEN n_chars IS NOT NULL THEN 'n_chars' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS keys FROM documents")
def json_key_lists(spark, d):
    """Rows as JSON, as the first of an array, or between other words."""
    row = F.to_json(F.struct("doc_id", "lang", "source", "n_chars"))
    body = F.when(F.col("n_chars") < 500, row).when(F.col("n_chars") < 2000, F.concat(F.lit("["), row, F.lit(", {}]"))).otherwise(F.concat(F.lit("rows: "), row, F.lit(" and so on")))
    return table(spark, d, "documents").select("doc_id", F.array_join(readers.json_keys(body), ",").alias("keys"))


@query(
    """SELECT event_id, CASE WHEN k = 0 THEN '{"k":"' || event_type || '","at":{"list":[' || k || ',null,true],"user":' || user_id || '}}' ELSE '{"k":' || k || ',"at":{"list":[' || k || ',null,true],"user":' || user_id || '}}' END AS kept,
        CASE WHEN k = 0 THEN '{"k":0,"at":{"list":[0,null,true],"user":' || user_id || '},"kind":"' || event_type || '"}' ELSE '{"k":' || k || ',"at":{"list":[' || k || ',null,true],"user":' || user_id || '},"kind":"' || event_type || '"}' END AS added
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
)
def json_set_missing(spark, d):
    """A key set that is there (but empty where it is 0) and one that isn't; numbers, nested values and places stay."""
    k = F.get_json_object("props", "$.k")
    blob = F.concat(F.substring_index("props", "}", 1), F.lit(', "at": {"list": ['), k, F.lit(', null, true], "user": '), F.col("user_id").cast("string"), F.lit("}}"))
    kept, added = media.with_key_set(blob, "k", F.col("event_type")), media.with_key_set(blob, "kind", F.col("event_type"))
    squeezed = lambda c: F.regexp_replace(c, r"([:,]) ", "$1")
    return table(spark, d, "events").select("event_id", squeezed(kept).alias("kept"), squeezed(added).alias("added"))


@query(f"SELECT doc_id, array_to_string(list_distinct_in_order, ',') AS keys FROM (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_in_order FROM (SELECT doc_id, list_concat({WORDS}[1:5], ['n_chars', 'the end']) AS w FROM documents))")
def yaml_keys(spark, d):
    """A document of a line for each of the first words, with comments, nested and quoted keys, before a second document."""
    lines = F.transform(F.slice(_words(), 1, 5), lambda w: F.concat(w, F.lit(": "), w, F.lit("\n  inner_"), w, F.lit(": 1\n# note: of it\n- item: 2")))
    body = F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise(""), F.lit("n_chars: "), F.col("n_chars").cast("string"), F.lit("\n\"the end\": yes\n---\nother: 1\n"))
    return table(spark, d, "documents").select("doc_id", F.array_join(media.first_level_keys(body), ",").alias("keys"))


@query(
    """SELECT l_orderkey, string_agg(CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS INTEGER)::VARCHAR END, ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS numbers, string_agg(l_returnflag || l_linestatus, '|' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS words FROM lineitem GROUP BY 1"""
)
def list_texts(spark, d):
    """Quantities as a JSON array in which those of one flag are words or null, and flags as comma separated items with blanks."""
    quantity = F.col("l_quantity").cast("int").cast("string")
    item = F.when(F.col("l_returnflag") != "N", F.when(F.col("l_linestatus") == "O", quantity).otherwise(F.concat(F.lit('"'), quantity, F.lit('"')))).when(F.col("l_linestatus") == "O", '"none"').otherwise("null")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", item.alias("x"), F.concat("l_returnflag", "l_linestatus").alias("y")))).alias("r"))
    numbers = F.concat(F.lit("["), F.array_join(F.transform("r", lambda r: r["x"]), ", "), F.lit("]"))
    words = F.array_join(F.transform("r", lambda r: F.concat(F.lit(" "), r["y"], F.lit(" ,"))), ",")
    found = F.array_join(F.transform(media.whole_numbers(numbers), lambda x: x.cast("string")), ",")
    return rows.select("l_orderkey", F.nullif(found, F.lit("")).alias("numbers"), F.array_join(text.list_or_commas(words), "|").alias("words"))


@query(
    """WITH b AS (SELECT doc_id, quality, toxic, CASE WHEN quality = 1 THEN 'tt' || doc_id END AS imdb, CASE WHEN toxic = 1 THEN doc_id END AS tmdb FROM labels)
    SELECT doc_id, coalesce(imdb IS NOT NULL OR tmdb > 0, false) AS confirmed, CASE WHEN coalesce(tmdb, 0) > 0 THEN 0.6 WHEN imdb IS NOT NULL THEN 0.4 END AS score, imdb AS imdb_id FROM b WHERE doc_id IS NOT NULL"""
)
def confirmed_ids(spark, d):
    """Ids as they come with labels: in an object of their own or in the row, some of them null or nothing."""
    quality, toxic = F.coalesce(F.col("quality"), F.lit(0)), F.coalesce(F.col("toxic"), F.lit(0))
    ids = F.to_json(F.struct(F.when(toxic == 1, F.col("doc_id")).alias("tmdb_id"), F.when(quality == 1, F.concat(F.lit("tt"), F.col("doc_id").cast("string"))).alias("imdb_id")), {"ignoreNullFields": "false"})
    nested = F.concat(F.lit('{"tmdb": 1, "ids": '), ids, F.lit("}"))
    candidate = media.default_candidate(ids, F.lit("x"))
    rows = table(spark, d, "labels").where("doc_id is not null")
    return rows.select("doc_id", media.has_confirmed_id(F.when(quality == toxic, nested).otherwise(ids)).alias("confirmed"), candidate["score"].alias("score"), candidate["imdb_id"].alias("imdb_id"))


# Heads of texts, scenes, vectors, queues

@query(
    r"""WITH h AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS line FROM documents WHERE text IS NOT NULL AND NOT contains(text, '"'))
    SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(line, ',')[1:40], lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x: left(x, 120)), ',') AS fields,
        len(list_filter(regexp_extract_all(hex(encode(text)), '..'), lambda b: b SIMILAR TO '(0[0-8BCEF]|1[0-9A-F]|7F)')) > greatest(16.0, strlen(text) / 3.0) OR contains(text, chr(0)) AS odd FROM h"""
)
def text_heads(spark, d):
    rows = table(spark, d, "documents").where("text is not null and not contains(text, '\"')")
    return rows.select("doc_id", F.array_join(readers.csv_header(F.col("text")), ",").alias("fields"), readers.looks_binary(F.encode("text", "UTF-8")).alias("odd"))


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, (l_quantity + l_quantity + l_linenumber) / 2 AS middle FROM lineitem WHERE l_returnflag <> 'N'),
    r AS (SELECT l_orderkey, list(round_even(middle, 2) ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS m FROM s GROUP BY 1)
    SELECT o_orderkey, array_to_string(CASE WHEN m IS NULL THEN list_transform([1, 2, 3], lambda k: round_even(o_totalprice / 1000 * k / 4, 2)) ELSE list_filter(m, lambda x, i: list_position(m, x) = i)[1:3] END, '|') AS times FROM orders LEFT JOIN r ON l_orderkey = o_orderkey"""
)
def frame_times(spark, d):
    """Scenes from an order's lines, which begin at a quantity and are as long as the line's number; evenly spaced without any."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_linenumber")).alias("end"))
    scenes = table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    rows = table(spark, d, "orders").join(scenes, "o_orderkey", "left").withColumn("lines", F.transform("lines", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    times = enrich.frame_times(F.coalesce("lines", F.array().cast("array<struct<start:double,end:double>>")), F.col("o_totalprice") / 1000, 3)
    return rows.select("o_orderkey", F.array_join(F.transform(times, lambda t: t.cast("string")), "|").alias("times"))


@query("SELECT vec_id, len(embedding) AS n, array_to_string(list_transform(embedding, lambda x: CAST(CAST(round_even(x::DOUBLE * 1000000, 0) AS BIGINT) AS VARCHAR)), ',') AS millionths FROM embeddings")
def float_blobs(spark, d):
    """Vectors packed as little-endian float32 bytes, written and read back: every element."""
    packed = written(table(spark, d, "embeddings").select("vec_id", readers.pack_floats(F.col("embedding")).alias("blob")), "blobs")
    rows = packed.select("vec_id", readers.floats(F.col("blob")).alias("v"))
    each = F.transform("v", lambda x: F.bround(x.cast("double") * 1000000, 0).cast("long").cast("string"))
    return rows.select("vec_id", F.size("v").alias("n"), F.array_join(each, ",").alias("millionths"))


@query(
    """WITH q AS (SELECT doc_id, list_filter([CASE WHEN quality = 0 THEN 'low' END, CASE WHEN toxic = 1 THEN 'keyword' END], lambda x: x IS NOT NULL) AS r FROM labels),
    h AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 5000 AND doc_id IS NOT NULL)
    SELECT coalesce(q.doc_id, h.doc_id) AS doc_id, array_to_string(CASE WHEN h.doc_id IS NULL OR list_contains(coalesce(r, []), 'keyword') THEN r ELSE list_concat(coalesce(r, []), ['keyword']) END, '|') AS reasons FROM q FULL JOIN h ON q.doc_id = h.doc_id"""
)
def added_reasons(spark, d):
    """A reason for every long document: beside those that it has, once, or in a new row of the queue."""
    queue = table(spark, d, "labels").select("doc_id", F.array_compact(F.array(F.when(F.col("quality") == 0, "low"), F.when(F.col("toxic") == 1, "keyword"))).alias("reasons"))
    hits = table(spark, d, "documents").where("n_chars > 5000 and doc_id is not null").select("doc_id")
    return upserts.reasons_for(queue, hits, "doc_id", "keyword").select("doc_id", F.array_join("reasons", "|").alias("reasons"))


@query(
    """WITH q AS (SELECT c_custkey AS id, c_acctbal / 10000 AS confidence, TIMESTAMP '2024-01-01' + to_seconds(c_custkey) AS created_utc FROM customer WHERE c_acctbal < 3000),
    p AS (SELECT o_custkey AS id, avg(o_totalprice) / 300000 AS confidence FROM orders GROUP BY 1)
    SELECT id, round(confidence, 6) AS confidence, created_utc FROM q WHERE id NOT IN (SELECT id FROM p) UNION ALL
    SELECT p.id, round(p.confidence, 6), coalesce(created_utc, TIMESTAMP '2024-06-01') FROM p LEFT JOIN q ON q.id = p.id WHERE p.confidence < 0.5"""
)
def review_split(spark, d):
    """A queue from balances, scored again from orders: who stays, who leaves, who comes, and since when."""
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("c_custkey"))
    queue = table(spark, d, "customer").where("c_acctbal < 3000").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("confidence"), at.alias("created_utc"))
    profiles = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.avg("o_totalprice") / 300000).alias("confidence"))
    out = upserts.review_queue(queue, profiles, "id", 0.5, F.lit("2024-06-01").cast("timestamp_ntz"))
    return out.withColumn("confidence", F.round("confidence", 6))


@query(
    """SELECT event_id AS seq, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN '{"k":' || json_extract_string(props, '$.k') || '}' WHEN event_id % 3 = 1 THEN '{"value":' || user_id || '}' ELSE '{"raw":"{broken ' || event_type || '"}' END AS payload
    FROM events WHERE event_id > 700 ORDER BY event_id LIMIT 256"""
)
def event_payloads(spark, d):
    """Payloads as a reader gets them: an object as it is, another value as ``value``, what can't be read as ``raw``."""
    key = F.col("event_id")
    raw = F.when(key % 3 == 0, F.col("props")).when(key % 3 == 1, F.col("user_id").cast("string")).otherwise(F.concat(F.lit("{broken "), "event_type"))
    log = table(spark, d, "events").select(key.alias("seq"), F.col("event_type").alias("kind"), raw.alias("payload_json"))
    return upserts.events_after(log, 700).select("seq", "kind", F.regexp_replace("payload", r"([:,]) ", "$1").alias("payload"))


# Episodes: names in the manner of four languages, numbers from ids and lengths.
SHOW = f"""s AS (SELECT doc_id, {WORDS}[1] AS a, {WORDS}[2] AS b, {WORDS}[3] AS c, lang, doc_id % 12 + 1 AS season, n_chars % 90 + 1 AS ep, DATE '2020-01-01' + (doc_id % 2000)::INTEGER AS day FROM documents)"""


@query(
    f"""WITH {SHOW} SELECT doc_id, a || ' ' || b AS series, CASE WHEN lang IN ('en', 'de') THEN season END::INTEGER AS season,
        CASE lang WHEN 'en' THEN CASE WHEN ep % 2 = 0 THEN ep || ',' || ep + 1 ELSE ep::VARCHAR END WHEN 'de' THEN CASE WHEN ep % 3 = 0 THEN ep || ',' || ep + 1 || ',' || ep + 2 ELSE ep::VARCHAR END ELSE '' END AS episodes,
        CASE WHEN lang = 'fr' THEN '' WHEN lang = 'es' THEN (ep + 10)::VARCHAR ELSE '' END AS absolute, CASE WHEN lang = 'fr' THEN CAST(day AS VARCHAR) END AS air_date, c AS title
    FROM s WHERE lang IN ('en', 'de', 'fr', 'es') AND a SIMILAR TO '[A-Za-z][a-z]{{3,}}' AND b SIMILAR TO '[A-Za-z][a-z]{{3,}}' AND c SIMILAR TO '[A-Za-z][a-z]{{3,}}'"""
)
def episode_names(spark, d):
    a, b, c = (F.get(_words(), F.lit(k)) for k in range(3))
    plain = [w.rlike("^[A-Za-z][a-z]{3,}$") for w in (a, b, c)]
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    season, ep = F.col("doc_id") % 12 + 1, F.col("n_chars") % 90 + 1
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 2000).cast("int"))
    en = F.concat(a, F.lit(" "), b, F.lit(" - S"), two(season), F.lit("E"), two(ep), F.when(ep % 2 == 0, F.concat(F.lit("E"), two(ep + 1))).otherwise(""), F.lit(" - "), c, F.lit(" [1080p].mkv"))
    de = F.concat_ws(".", a, b, F.concat(season.cast("string"), F.lit("x"), two(ep), F.when(ep % 3 == 0, F.concat(F.lit("-"), two(ep + 2))).otherwise("")), c, F.lit("WEB.x264.mp4"))
    fr = F.concat(a, F.lit("_"), b, F.lit("_"), F.date_format(day, "yyyy.MM.dd"), F.lit("_"), c, F.lit(".avi"))
    es = F.concat(a, F.lit(" "), b, F.lit(" - "), F.lpad((ep + 10).cast("string"), 3, "0"), F.lit(" - "), c, F.lit(".mkv"))
    lang = F.col("lang")
    name = F.when(lang == "en", en).when(lang == "de", de).when(lang == "fr", fr).when(lang == "es", es)
    rows = table(spark, d, "documents").where(plain[0] & plain[1] & plain[2] & name.isNotNull()).select("doc_id", episodes.episode(F.concat(F.lit("shows/"), name)).alias("g"))
    listed = lambda x: F.array_join(F.transform(x, lambda n: n.cast("string")), ",")
    return rows.select("doc_id", "g.series", "g.season", listed("g.episodes").alias("episodes"), listed("g.absolute_numbers").alias("absolute"), F.col("g.air_date").cast("string").alias("air_date"), "g.title")
