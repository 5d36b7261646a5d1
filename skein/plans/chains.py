"""Queries over chains of operators: folders, video quality, text previews, verification, music."""

from pyspark.sql import functions as F

from ..operators import previews, quality, structure, upserts, verification
from ..sources.readers import table
from ..sources.shared import written
from .catalog import QUERIES, SQL, long, query
from .derived import WORDS, _words

# A library of documents: a folder for each source and language, files by the lengths of texts.
LIBRARY = f"""files AS (SELECT doc_id, n_chars AS size, source || CASE lang WHEN 'en' THEN ' (1999)' WHEN 'de' THEN ' (2004)' WHEN 'fr' THEN ' (9999)' ELSE '' END AS folder,
        CASE n_chars % 12 WHEN 1 THEN 'poster.jpg' ELSE coalesce({WORDS}[1], 'none') || doc_id || CASE n_chars % 12 WHEN 0 THEN '.mkv' WHEN 2 THEN '.nfo' WHEN 3 THEN '.srt' WHEN 4 THEN '.md' ELSE '.txt' END END AS name, n_chars % 12 AS kind
    FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
    held AS (SELECT folder, count(*) FILTER (kind = 0) AS v, count(*) FILTER (kind = 2) AS n, count(*) FILTER (kind = 4) AS md, arg_max(name, (size, name)) FILTER (kind = 0) AS video FROM files GROUP BY 1),
    named AS (SELECT *, regexp_extract(folder, '^(.+) \\(([0-9]{{4}})\\)$', 2) AS y FROM held),
    known AS (SELECT *, CASE WHEN v = 1 THEN 'movie' ELSE 'other' END AS kind, CASE WHEN y IN ('1999', '2004') THEN CAST(y AS INTEGER) END AS year,
        split_part(folder, ' ', 1) || CASE WHEN y = '9999' THEN ' 9999' ELSE '' END AS a, split_part(video, '.', 1) AS b FROM named),
    issued AS (SELECT *, list_filter([CASE WHEN v = 0 THEN 'no_primary_video' WHEN v > 1 THEN 'multiple_primary_videos' END, CASE WHEN y = '' AND v = 1 THEN 'missing_canonical_pattern' WHEN y = '9999' THEN 'invalid_year' END,
        CASE WHEN v = 1 AND year IS NULL THEN 'missing_year' END, CASE WHEN v = 1 AND n = 0 THEN 'missing_nfo' END, CASE WHEN md > 0 THEN 'extra_md_files:' || md END, CASE WHEN v > 0 THEN 'extra_mkv_files:' || v END, CASE WHEN n > 0 THEN 'extra_nfo_files:' || n END], lambda x: x IS NOT NULL) AS issues FROM known),
    likened AS (SELECT *, greatest({', '.join(f"coalesce(1 - levenshtein({x}, {y}) / greatest(length({x}), length({y})), 0)" for x in ("array_to_string(list_sort(string_split(lower(a), ' ')), ' ')", "lower(b)") for y in ("array_to_string(list_sort(string_split(lower(folder), ' ')), ' ')", "lower(video)"))}) AS best FROM issued),
    made AS (SELECT *, y <> '' AND v = 1 AS canonical, greatest(0, least(1, CASE WHEN y <> '' AND v = 1 THEN 0.35 ELSE 0 END + CASE WHEN n > 0 THEN 0.25 ELSE 0 END + 0.15 * CASE WHEN best >= 0.85 THEN 1 ELSE best END
        - list_aggregate(list_concat([0], list_transform(issues, lambda x: CASE WHEN x IN ('multiple_primary_videos', 'missing_year') THEN 0.1 WHEN x IN ('missing_canonical_pattern', 'missing_nfo', 'invalid_year') THEN 0.05 WHEN x = 'no_primary_video' THEN 0.2 ELSE 0.03 END)), 'sum'))) AS confidence FROM likened)"""


def _library(spark, d):
    size, kind = F.col("n_chars"), F.col("n_chars") % 12
    lang = F.col("lang")
    year = F.when(lang == "en", " (1999)").when(lang == "de", " (2004)").when(lang == "fr", " (9999)").otherwise("")
    ext = F.when(kind == 0, ".mkv").when(kind == 2, ".nfo").when(kind == 3, ".srt").when(kind == 4, ".md").otherwise(".txt")
    name = F.when(kind == 1, "poster.jpg").otherwise(F.concat(F.coalesce(F.get(_words(), F.lit(0)), F.lit("none")), F.col("doc_id").cast("string"), ext))
    content = F.when(kind == 2, F.concat(F.lit("<id>imdb: tt"), (1_000_000 + F.col("doc_id")).cast("string"), F.lit("</id>")))
    docs = table(spark, d, "documents").where("source is not null and lang is not null")
    return docs.select(F.concat("source", year).alias("folder"), name.alias("name"), size.alias("size_bytes"), content.alias("content"))


@query(
    f"""WITH {LIBRARY} SELECT folder, kind, canonical, video AS main_video, array_to_string(issues, '|') AS issues, coalesce(b, a) AS title, year, round(confidence, 6) AS confidence,
        len(issues) + CASE WHEN canonical THEN 0 ELSE 1 END + CASE WHEN n = 0 AND v = 1 THEN 1 ELSE 0 END + CASE WHEN best < 0.5 THEN 1 ELSE 0 END + CASE WHEN v = 1 THEN 0 ELSE 1 END AS reasons, confidence < 0.5 AS queued FROM made"""
)
def folder_chain(spark, d):
    """Folders from listed files to stored profiles, and whether they are up for review."""
    held = written(structure.contents(_library(spark, d)), "folders")
    found = written(structure.candidates(held), "candidates")
    made = written(structure.profiles(held, found), "profiles")
    tables = structure.stored({}, made, found, F.lit("2024-01-01").cast("timestamp_ntz"))
    queued = tables["queue"].select("folder", F.lit(True).alias("_queued"))
    rows = made.join(queued, "folder", "left")
    return rows.select("folder", "kind", "canonical", "main_video", F.array_join("issues", "|").alias("issues"), "title", "year", F.round("confidence", 6).alias("confidence"), long(F.size("reasons")).alias("reasons"), F.coalesce("_queued", F.lit(False)).alias("queued"))


# A probe for each order: a video stream by customer and price, audio and subtitle streams by its lines; some can't be read.
PROBED = """l AS (SELECT l_orderkey, max(l_linenumber - 1) FILTER (l_returnflag <> 'R') AS channels, count(DISTINCT l_suppkey % 3) FILTER (l_returnflag <> 'R') AS audio,
        count(*) FILTER (l_returnflag = 'R') AS subs, count(DISTINCT l_suppkey % 3) FILTER (l_returnflag = 'R') AS sub_langs FROM lineitem GROUP BY 1),
    p AS (SELECT o_orderkey, 320 * (1 + o_custkey % 12) AS width, 180 * (1 + o_custkey % 12) AS height, CAST(floor(o_totalprice / 50) AS BIGINT) AS kbps, o_totalprice / 40 AS seconds, o_custkey % 120 AS minutes,
        channels, coalesce(audio, 0) AS audio, coalesce(subs, 0) AS subs, coalesce(sub_langs, 0) AS sub_langs, o_orderstatus FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
    d AS (SELECT *, kbps / greatest(width * height / 1e6, 0.1) AS dense, abs(seconds - minutes * 60.0) AS apart FROM p),
    t AS (SELECT *, CASE WHEN kbps <= 0 THEN 0 WHEN dense / 1500 <= 0.5 THEN 25 WHEN dense / 1500 <= 0.75 THEN 18 WHEN dense / 1500 < 1 THEN 10 ELSE 0 END AS lost, minutes > 0 AND apart > 0.1 * minutes * 60 AS late FROM d)"""


def _probed(spark, d):
    languages = F.element_at(F.array(*map(F.lit, ("eng", "es-MX", "GER"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    sub = F.col("l_returnflag") == "R"
    line = F.struct(
        F.when(sub, "subtitle").otherwise("audio").alias("codec_type"), F.when(sub, "srt").otherwise("aac").alias("codec_name"), F.when(~sub, F.col("l_linenumber") - 1).alias("channels"), F.struct(languages.alias("language")).alias("tags"),
    )
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines"))
    k = 1 + F.col("o_custkey") % 12
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), (320 * k).cast("string").alias("width"), (180 * k).alias("height"), F.floor(F.col("o_totalprice") / 50).cast("string").alias("bit_rate"))
    form = F.struct(F.lit("matroska").alias("format_name"), (F.col("o_totalprice") / 40).cast("string").alias("duration"))
    orders = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    others = F.regexp_replace(F.coalesce(F.to_json("lines"), F.lit("[]")), r"^\[", "")
    whole = F.concat(F.lit('{"streams":['), F.to_json(video), F.when(others == "]", "").otherwise(","), others, F.lit(',"format":'), F.to_json(form), F.lit("}"))
    return orders.select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x"), whole)).otherwise(whole).alias("probe"), (F.col("o_custkey") % 120).alias("minutes"))


@query(
    f"""WITH {PROBED} SELECT o_orderkey AS path, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE greatest(0, least(100, 100 - lost - CASE WHEN channels < 2 THEN 10 ELSE 0 END - CASE WHEN subs = 0 THEN 10 ELSE 0 END - CASE WHEN late THEN 10 ELSE 0 END
            + CASE WHEN audio > 1 THEN 3 ELSE 0 END + CASE WHEN sub_langs > 1 THEN 3 ELSE 0 END)) END::INTEGER AS score,
        CASE WHEN o_orderstatus = 'P' THEN NULL WHEN height <= 576 THEN '<=480p' WHEN height <= 800 THEN '720p' WHEN height <= 1200 THEN '1080p' WHEN height >= 1600 THEN '2160p' ELSE '1440p' END AS resolution,
        CASE WHEN o_orderstatus <> 'P' AND late THEN CAST(floor(apart) AS BIGINT) END AS mismatch, CASE WHEN o_orderstatus <> 'P' AND sub_langs > 1 THEN sub_langs END AS sub_langs, CASE WHEN o_orderstatus <> 'P' THEN channels::INTEGER END AS channels FROM t"""
)
def quality_chain(spark, d):
    """Probes to scores with reasons; the number that a reason holds is read back from its JSON."""
    made = quality.rows(_probed(spark, d), F.lit("2024-01-01").cast("timestamp_ntz"), expect_subs=True)
    said = lambda name: F.get_json_object("reasons_json", f"$.{name}")
    return made.select("path", "score", said("resolution").alias("resolution"), said("runtime_mismatch").cast("long").alias("mismatch"), said("multi_sub_langs").cast("long").alias("sub_langs"), F.col("audio_channels_max").alias("channels"))


# Music: what is stored agrees with a third of the names, is out of date for another, and some names are queued already.
SYNCED = f"""m AS (SELECT n.doc_id, artist, title, album, score FROM ({SQL['music_names']}) n JOIN ({SQL['music_scores']}) s USING (doc_id)),
    old AS (SELECT doc_id, artist, CASE WHEN doc_id % 3 = 1 THEN 'old' ELSE title END AS title, album, score + CASE WHEN doc_id % 2 = 0 THEN 1e-7 ELSE 0 END AS score, TIMESTAMP '2024-01-01' AS at FROM m WHERE doc_id % 3 <> 2),
    q AS (SELECT doc_id, score - 0.1 AS score, TIMESTAMP '2024-01-02' AS at FROM m WHERE doc_id % 5 = 0 UNION ALL SELECT -1, 0.1, TIMESTAMP '2024-01-02')"""


def _synced(spark, d):
    names_, scores_ = QUERIES["music_names"](spark, d), QUERIES["music_scores"](spark, d)
    made = written(names_.select("doc_id", "artist", "title", "album").join(scores_, "doc_id"), "music")
    key, day = F.col("doc_id"), lambda n: F.lit(f"2024-01-0{n}").cast("timestamp_ntz")
    title = F.when(key % 3 == 1, "old").otherwise(F.col("title"))
    minimal = made.where(key % 3 != 2).select("doc_id", "artist", title.alias("title"), "album", (F.col("score") + F.when(key % 2 == 0, 1e-7).otherwise(0.0)).alias("score"), day(1).alias("parsed_utc"))
    queue = made.where(key % 5 == 0).select("doc_id", (F.col("score") - 0.1).alias("score"), day(2).alias("queued_utc"))
    queue = queue.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(0.1).alias("score"), day(2).alias("queued_utc")))
    return upserts.two_table_sync(minimal, queue, made, ["doc_id"], 0.85, day(3))


@query(
    f"""WITH {SYNCED} SELECT 'minimal' AS side, m.doc_id, m.title, CASE WHEN old.title = m.title THEN old.at ELSE TIMESTAMP '2024-01-03' END AS at FROM m LEFT JOIN old USING (doc_id) WHERE m.score >= 0.85
    UNION ALL SELECT 'queue', m.doc_id, NULL, TIMESTAMP '2024-01-03' FROM m WHERE score < 0.85 UNION ALL SELECT 'queue', -1, NULL, TIMESTAMP '2024-01-02'"""
)
def music_sync(spark, d):
    """Both tables after a run over all names, with the times that rows keep or get."""
    minimal, queue, _ = _synced(spark, d)
    at = lambda c: F.col(c).alias("at")
    return minimal.select(F.lit("minimal").alias("side"), "doc_id", "title", at("parsed_utc")).unionByName(queue.select(F.lit("queue").alias("side"), "doc_id", F.lit(None).cast("string").alias("title"), at("queued_utc")))


@query(
    f"""WITH {SYNCED} SELECT count(*) AS processed, count(*) FILTER (m.score >= 0.85 AND old.title IS DISTINCT FROM m.title) AS stored, count(*) FILTER (m.score < 0.85) AS queued, count(*) FILTER (m.score >= 0.85 AND old.title = m.title) AS unchanged,
        count(*) FILTER (m.score < 0.85 AND old.doc_id IS NOT NULL) AS removed_minimal, count(*) FILTER (m.score >= 0.85 AND q.doc_id IS NOT NULL) AS removed_queue FROM m LEFT JOIN old ON old.doc_id = m.doc_id LEFT JOIN q ON q.doc_id = m.doc_id"""
)
def music_sync_summary(spark, d):
    return _synced(spark, d)[2]


@query(
    """WITH t AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:12], chr(10)) AS text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND NOT contains(text, chr(13)) AND lang <> 'de'),
    k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ0-9_'']+')) AS w FROM t), c AS (SELECT doc_id, w, count(*) AS n FROM k WHERE length(w) >= 3 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS place FROM c)
    SELECT t.doc_id AS path, CAST(coalesce(strlen(replace(t.text, chr(10), '')), 0) AS INTEGER) AS bytes, len(string_split(t.text, chr(10)))::INTEGER AS lines, coalesce(string_agg(w, ',' ORDER BY place), '') AS keywords
    FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND place <= 6 WHERE trim(t.text, ' ' || chr(10) || chr(9)) <> '' GROUP BY t.doc_id, t.text"""
)
def text_lite(spark, d):
    """Previews of documents as files of several kinds; those of one language are called something that is no text."""
    docs = table(spark, d, "documents").where("text is not null and source is not null and lang is not null and not contains(text, '\\r')")
    files = docs.select(F.col("doc_id").alias("path"), F.when(F.col("lang") == "de", "bin").when(F.col("lang") == "en", ".MD").otherwise("txt").alias("ext"), F.lit(None).cast("string").alias("mime"), F.col("n_chars").alias("size_bytes"), F.encode("text", "UTF-8").alias("content"))
    how = previews.Sampling(max_bytes=1 << 20, head_lines=12, mid_lines=0, tail_lines=0, keywords=6)
    made = previews.rows(files, F.lit("2024-01-01").cast("timestamp_ntz"), how)
    return made.select("path", F.col("bytes_sampled").alias("bytes"), F.col("lines_sampled").alias("lines"), F.array_join("keywords", ",").alias("keywords"))


# Subtitles made of a document's lines, against the text of a benchmark item; a summary's sentences are rated as in the operator.
SPOKEN = "list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>|\\{[^}]*\\}', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+'))"
TOLD = f"""l AS (SELECT doc_id AS key, {SPOKEN} AS x FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
    m AS (SELECT key, x, len(x) AS n, greatest(0, len(x) - 300) AS rest FROM l WHERE len(x) > 0),
    t AS (SELECT key, least(n, 400) AS lines, left(array_to_string(list_concat(x[1:150], list_filter(x[151:150 + rest], lambda y, i: (i - 1) % greatest(1, rest // 100) = 0)[1:100], CASE WHEN n > 150 THEN x[greatest(1, n - 149):] ELSE [] END)[1:400], ' '), 20000) AS s FROM m),
    p AS (SELECT t.*, b.text AS plot FROM t JOIN benchmark b ON b.item_id = key % (SELECT count(*) FROM benchmark) WHERE trim(b.text) <> ''),
    sides AS (SELECT key, 's' AS side, s AS text FROM p UNION ALL SELECT key, 'p', plot FROM p),
    w AS (SELECT key, side, unnest(regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ0-9_'']+')) AS w FROM sides), c AS (SELECT key, side, w, count(*) AS n FROM w WHERE length(w) >= 3 GROUP BY ALL),
    k AS (SELECT key, side, list(w) AS words FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key, side ORDER BY n DESC, w) <= 12) GROUP BY key, side),
    sent AS (SELECT key, trim(unnest(string_split(regexp_replace(trim(s), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))) AS x, generate_subscripts(string_split(regexp_replace(trim(s), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS pos FROM p),
    uniq AS (SELECT key, x, min(pos) AS pos FROM sent WHERE x <> '' GROUP BY ALL),
    rated AS (SELECT u.key, u.x, u.pos, coalesce(sum(c.n), 0) / sqrt(length(u.x) + 1) AS score FROM (SELECT *, unnest(CASE WHEN len(regexp_extract_all(lower(x), '[A-Za-zÀ-ÿ0-9_'']+')) = 0 THEN [''] ELSE regexp_extract_all(lower(x), '[A-Za-zÀ-ÿ0-9_'']+') END) AS tok FROM uniq) u LEFT JOIN c ON c.key = u.key AND c.side = 's' AND c.w = u.tok GROUP BY u.key, u.x, u.pos),
    picked AS (SELECT *, row_number() OVER q AS rn, coalesce(sum(length(x)) OVER (PARTITION BY key ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rated WINDOW q AS (PARTITION BY key ORDER BY score DESC, pos)),
    summary AS (SELECT key, string_agg(x, ' ' ORDER BY pos) AS s FROM picked WHERE rn <= 4 AND before < 720 GROUP BY 1),
    pair AS (SELECT p.key, lines, summary.s AS a, plot AS b FROM p JOIN summary USING (key)),
    h AS (SELECT key, side, ('0x' || left(md5(t), 4))::BIGINT % 256 AS slot, count(*) AS n FROM (SELECT key, 'a' AS side, unnest(regexp_extract_all(lower(a), '[a-z0-9]+')) AS t FROM pair UNION ALL SELECT key, 'b', unnest(regexp_extract_all(lower(b), '[a-z0-9]+')) FROM pair) GROUP BY ALL),
    norm AS (SELECT key, side, sqrt(sum(n * n)) AS z FROM h GROUP BY ALL),
    dots AS (SELECT x.key, sum(x.n * y.n) AS d FROM h x JOIN h y ON x.key = y.key AND x.slot = y.slot AND x.side = 'a' AND y.side = 'b' GROUP BY 1),
    sem AS (SELECT u.key, coalesce(d, 0) / (u.z * v.z) AS semantic FROM norm u JOIN norm v ON u.key = v.key AND u.side = 'a' AND v.side = 'b' LEFT JOIN dots ON dots.key = u.key),
    e AS (SELECT key, lines, a, b, {', '.join(f"list_distinct(list_filter(list_transform(regexp_extract_all({t}, '(?:^|[^\\p{{L}}\\p{{N}}_])(\\p{{Lu}}[\\p{{L}}\\p{{N}}_''-]+(?:\\s+\\p{{Lu}}[\\p{{L}}\\p{{N}}_''-]+)*)', 1), lambda x: lower(x)), lambda x: length(x) > 2 AND NOT list_contains({verification.STOPWORDS}, x))) AS {t}_e" for t in ('a', 'b'))} FROM pair)"""


@query(
    f"""WITH {TOLD}, f AS (SELECT e.key, e.lines, coalesce(semantic, 0) AS semantic, CASE WHEN len(a_e) > 0 AND len(b_e) > 0 THEN len(list_intersect(a_e, b_e)) / len(list_distinct(list_concat(a_e, b_e))) ELSE 0 END AS entities,
        CASE WHEN i.words IS NOT NULL AND j.words IS NOT NULL THEN len(list_intersect(i.words, j.words)) / len(list_distinct(list_concat(i.words, j.words))) ELSE 0 END AS words
        FROM e LEFT JOIN sem ON sem.key = e.key LEFT JOIN k i ON i.key = e.key AND i.side = 's' LEFT JOIN k j ON j.key = e.key AND j.side = 'p'),
    g AS (SELECT *, round(0.55 * semantic + 0.25 * entities + 0.2 * words, 9) AS match FROM f)
    SELECT key, lines, round(semantic, 6) AS semantic, round(entities, 6) AS entities, round(words, 6) AS words, CASE WHEN match >= 0.8 THEN 'boost' WHEN match >= 0.65 THEN 'nudge' WHEN match < 0.4 THEN 'flag' ELSE 'keep' END AS action FROM g"""
)
def subtitle_verification(spark, d):
    docs = table(spark, d, "documents").where("text is not null and doc_id is not null")
    lines = F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")
    cues = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), x)), "\n\n")
    video = F.concat(F.lit("v/"), F.col("doc_id").cast("string"))
    subtitles = docs.select(F.col("doc_id").alias("key"), F.concat(video, F.lit(".mkv")).alias("video"), F.concat(video, F.lit(".en.srt")).alias("name"), cues.alias("content"))
    items, n = table(spark, d, "benchmark"), table(spark, d, "benchmark").count()
    plots = docs.select(F.col("doc_id").alias("key"), (F.col("doc_id") % max(1, n)).alias("item_id")).join(F.broadcast(items) if n <= 10_000 else items, "item_id").select("key", F.col("text").alias("plot"))
    found = verification.compared(docs.select(F.col("doc_id").alias("key")), subtitles, plots)
    return found.select("key", "lines", *[F.round(c, 6).alias(c) for c in ("semantic", "entities", "words")], "action")


@query(
    """WITH c AS (SELECT l_orderkey AS key, CASE WHEN l_returnflag = 'N' THEN CAST(l_partkey AS VARCHAR) END AS tmdb_id, CASE WHEN l_returnflag <> 'N' THEN 'tt' || l_suppkey END AS imdb_id, CASE WHEN l_linenumber > 1 THEN l_linenumber / 20.0 ELSE 0.2 END AS score FROM lineitem WHERE l_linestatus = 'O'),
    r AS (SELECT c.key, tmdb_id, imdb_id, least(1.0, 0.1 + CASE WHEN tmdb_id IS NOT NULL THEN 0.25 ELSE 0.15 END + CASE WHEN o_orderstatus = 'O' THEN 0.1 ELSE 0 END + CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE least(0.2, (o_custkey % 3) / 10) END + c.score) AS score, o_orderstatus, o_custkey FROM c JOIN orders ON o_orderkey = c.key)
    SELECT key, place, coalesce(tmdb_id, imdb_id) AS id, round(score, 6) AS score, CASE WHEN tmdb_id IS NOT NULL THEN 'tmdb:' || tmdb_id ELSE 'imdb:' || imdb_id END || CASE WHEN o_custkey % 3 > 0 THEN '|plot:' || (o_custkey % 3) || '.00' ELSE '' END || CASE WHEN o_orderstatus = 'O' THEN '|text' ELSE '' END AS signals
    FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(score, 9) DESC, tmdb_id ASC NULLS LAST, imdb_id ASC NULLS LAST) AS place FROM r) WHERE place <= 3"""
)
def episode_proposals(spark, d):
    """The best three of an order's open lines, which come as an array in a JSON object."""
    n = F.col("l_returnflag") == "N"
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.when(n, F.col("l_partkey")).alias("id"), F.when(~n, F.concat(F.lit("tt"), F.col("l_suppkey").cast("string"))).alias("imdb_id"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") / 20.0).alias("score")).alias("e"))
    lines = table(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("key")).agg(F.transform(F.collect_list(entry), lambda x: x["e"]).alias("e"))
    ids = lines.select("key", F.to_json(F.struct(F.lit("x").alias("title"), F.col("e").alias("tv_candidates"))).alias("ids"))
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "key")
    items = orders.select("key", F.lit(0.1).alias("confidence"))
    evidence = orders.select("key", F.lit(False).alias("oshash_hit"), F.array().cast("array<string>").alias("subtitle_langs"), (F.col("o_custkey") % 3).alias("plot_score"))
    snippets = orders.where("o_orderstatus = 'O'").select("key", F.lit("found").alias("snippet"))
    out = verification.proposals(items, verification.listed_candidates(ids, "key", "ids"), evidence, snippets)
    return out.select("key", long("place").alias("place"), F.coalesce("tmdb_id", "imdb_id").alias("id"), F.round("score", 6).alias("score"), F.array_join("signals", "|").alias("signals"))
