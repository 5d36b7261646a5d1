"""Line dedup with a log-template tree, in DataFrame operations only.

A line's tokens are runs of characters other than ASCII white space; a token with a digit is a variable
field and becomes ``<*>``. The tree has fixed depth: first the number of tokens, then the first
``LEAD`` tokens; lines that agree on these share a leaf. A leaf holds one template of its majority, with the
tokens that at least half of its documents have at a position, and as many templates as its frequent tokens
make: of every line, the tokens that ``MIN_DOCS`` documents of the leaf have at their position. All other
positions are variable and match any token. A template must be constant in ``CONSTANT`` of its positions; a line
belongs to the majority's if ``SIMILARITY`` of its tokens fit. Exact lines and templates found in ``MIN_DOCS``
documents or more are dropped from every document; a blank line is never dropped.

Counts are taken over distinct documents, with partial aggregates before each shuffle. Only leaves
with enough documents are looked into, each distinct line of them once. Lines and tokens travel as hashes; texts
are shuffled once, when decisions are applied. What is broadcast are counted rows of a few numbers.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_position, fresh, meet, written

LEAD, SIMILARITY, CONSTANT, MIN_DOCS = 3, 0.8, 0.7, 5
BROADCAST_ROWS = 200_000
SPACE = r"[\x09-\x0D\x20]+"
# What a line must lack to be its own normal form: digits, other white space, spaces at the ends or in a row.
ODD = r"[0-9\x09-\x0D]|^ | $|  "


def _normal(line: Column) -> Column:
    """A line's tokens joined by single spaces, variable fields generalised; most lines are so already."""
    tokens = F.array_remove(F.split(line, SPACE), "")
    masked = F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))
    return F.when(line.rlike(ODD), F.array_join(masked, " ")).otherwise(line)


def _joined(rows: DataFrame, few: DataFrame, on: str | list[str], heavy: str | Column) -> DataFrame:
    """``rows`` joined to written rows ``few``, unique by ``on``: broadcast if their counted number allows it, else only those that ``heavy`` marks.

    Spark would choose by the bytes of files, which don't tell how many rows the driver has to hold.
    """
    return rows.join(F.broadcast(few), on) if few.count() <= BROADCAST_ROWS else meet(rows, few, on, heavy, merge=True)


def _documents(docs: DataFrame) -> DataFrame:
    """Each row's id, text and key; equal rows have one key and are one document."""
    return docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("_key"))


def _lines(rows: DataFrame) -> DataFrame:
    split = rows.where(F.col("_text").isNotNull()).select("_key", F.posexplode(F.split("_text", "\n")).alias("_no", "_line"))
    normal = split.select("_key", "_no", _normal(F.col("_line")).alias("_line")).where("_line <> ''")
    spaces = F.octet_length("_line") - F.octet_length(F.replace("_line", F.lit(" "), F.lit("")))
    return normal.select("_key", "_no", F.xxhash64(spaces, F.substring_index("_line", " ", LEAD)).alias("_leaf"), F.xxhash64("_line").alias("_exact"), "_line")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_key, _drop: numbers of the lines to drop) of documents with any."""
    rows = _documents(docs)
    lines = written(_lines(rows).drop("_line"), "lines")
    # documents of each exact line, one of them, whether over a thousandth of all lines are the same; documents of each leaf
    hot = (F.sum("times") > lines.count() // 1000).alias("hot")
    exact = lines.groupBy("_leaf", "_exact", "_key").agg(F.count("*").alias("times")).groupBy("_leaf", "_exact").agg(F.count("*").alias("docs"), F.min("_key").alias("_of"), hot)
    exact = written(exact, "exact-lines")
    leaves = lines.groupBy("_leaf", "_key").agg(F.lit(1).alias("one")).groupBy("_leaf").agg(F.count("*").alias("leaf_docs")).where(F.col("leaf_docs") >= min_docs)
    forms = exact.groupBy("_leaf").agg(F.count("*").alias("forms")).where("forms > 1")
    leaves = written(leaves.join(forms.hint("merge"), "_leaf").select("_leaf", "forms"), "leaves")
    all_forms = leaves.agg(F.coalesce(F.sum("forms"), F.lit(0)).alias("n")).first().n
    large = F.col("forms") > all_forms // 1000
    wanted = written(_joined(exact, leaves, "_leaf", large).drop("forms"), "wanted")
    # the tokens of each form in those leaves, from the document kept for it
    of = written(wanted.select(F.col("_of").alias("_key")).distinct(), "documents-of-forms")
    kept = rows.join(F.broadcast(of) if of.count() <= 3 * BROADCAST_ROWS else of.hint("merge"), "_key", "left_semi")  # one number a row
    wanted = wanted.withColumnRenamed("_of", "_key")
    found = _lines(kept).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("merge"), ["_leaf", "_exact", "_key"])
    form = written(found.groupBy("_leaf", "_exact").agg(F.first("_line").alias("_line"), F.first("docs").alias("docs"), F.first("hot").alias("hot")), "forms")
    # the leading tokens, which all forms of a leaf share, are known to be frequent and stay out
    split = F.split("_line", " ")
    at = form.select("_leaf", "_exact", "docs", F.size(split).alias("n"), F.posexplode(F.slice(split, F.lit(LEAD + 1), F.size(split))).alias("_at", "_token"))
    at = written(at.withColumn("_token", F.xxhash64("_token")), "places")
    share = form.groupBy("_leaf").agg(F.sum("docs").alias("all_docs"), F.count("*").alias("forms"))
    share = written(share, "shares")
    counted = at.groupBy("_leaf", "_at", "_token").agg(F.sum("docs").alias("have"), F.count("*").alias("holders"))
    tokens = _joined(counted, share, "_leaf", large)
    tokens = tokens.select("_leaf", "_at", "_token", "holders", (F.col("have") * 2 >= F.col("all_docs")).alias("major"), (F.col("have") >= min_docs).alias("often"))
    tokens = written(tokens.where("major or often"), "tokens")
    fixed = tokens.where("major").groupBy("_leaf").agg((F.count_distinct("_at") + LEAD).alias("fixed"))
    fixed = written(share.join(fixed.hint("merge"), "_leaf", "left").select("_leaf", "forms", F.coalesce("fixed", F.lit(LEAD)).alias("fixed")), "fixed")
    often = F.when(F.col("often"), F.xxhash64("_at", "_token"))
    held = _joined(at.select("_leaf", "_exact", "_at", "_token"), tokens, ["_leaf", "_at", "_token"], F.col("holders") > at.count() // 1000)
    held = held.groupBy("_leaf", "_exact").agg(F.count_if("major").alias("agree"), F.count_if("often").alias("frequent"), F.bit_xor(often).alias("template"))
    counts = [(F.coalesce(c, F.lit(0)) + LEAD).alias(c) for c in ("agree", "frequent")]
    sizes = form.select("_leaf", "_exact", "hot", F.size(split).alias("n"))
    fit = sizes.join(held, ["_leaf", "_exact"], "left").select("_leaf", "_exact", "hot", "n", *counts, F.coalesce("template", F.lit(0)).alias("template"))
    # groups of forms: the majority's and that of each frequent template
    majority = (F.col("fixed") >= CONSTANT * F.col("n")) & (F.col("agree") + F.col("n") - F.col("fixed") >= SIMILARITY * F.col("n"))
    groups = F.array_compact(F.array(F.when(majority, F.xxhash64("_leaf")), F.when(F.col("frequent") >= CONSTANT * F.col("n"), F.xxhash64("_leaf", "template"))))
    members = written(_joined(fit, fixed, "_leaf", large).select("_leaf", "_exact", "hot", groups.alias("groups")).where("size(groups) > 0"), "members")
    in_group = _joined(lines, members, ["_leaf", "_exact"], "hot").select(F.explode("groups").alias("group"), "_key")
    in_group = in_group.groupBy("group", "_key").agg(F.lit(1).alias("one")).groupBy("group").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("group")
    of_group = members.select("_leaf", "_exact", "hot", F.explode("groups").alias("group"))
    in_group = written(of_group.groupBy("group").agg(F.count("*").alias("forms")).join(in_group.hint("merge"), "group"), "groups")
    grouped = _joined(of_group, in_group, "group", large).select("_leaf", "_exact", "hot")
    recurring = exact.where(F.col("docs") >= min_docs).select("_leaf", "_exact", "hot").union(grouped).distinct()
    recurring = written(recurring, "recurring")
    marked = _joined(lines, recurring, ["_leaf", "_exact"], "hot")
    return marked.groupBy("_key").agg(F.collect_set("_no").alias("_drop"))


@by_position
def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs``, all columns, with ``kept`` (text without dropped lines), ``n_lines`` and ``n_dropped``.

    A null text stays null and has no lines; an empty text has one blank line. Repeated rows (same id and
    text) are one document for the counts and each keep a row; rows that share only an id are documents of their
    own. Names that clash get underscores appended. Empty table: no rows.
    """
    kept, n_lines, n_dropped, key, drop = fresh(docs.columns, "kept", "n_lines", "n_dropped", "_key2", "_drop2")
    marks = dropped_lines(docs, min_docs).select(F.col("_key").alias(key), F.col("_drop").alias(drop))
    rows = docs.withColumn(key, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")).join(marks, key, "left")
    lines = F.split("text", "\n")
    # the lines are bound once, and a set tells their numbers apart, so that the time is linear in the lines
    stay = F.transform(F.array(lines), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(drop)), lambda no: F.get(x, no)))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(F.get(stay, F.lit(0)), "\n"))
    out = rows.withColumn(kept, text).withColumn(n_lines, F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"))
    return out.withColumn(n_dropped, F.coalesce(F.when(F.col(drop).isNotNull(), F.size(drop)), F.lit(0)).cast("long")).select(*docs.columns, kept, n_lines, n_dropped)


SQL = rf"""
WITH lines AS (
  SELECT doc_id, no, trim(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g')) AS plain
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL)
), tokens AS (
  SELECT doc_id, no, string_split(regexp_replace(plain, '(^| )[^ 0-9]*[0-9][^ ]*', '\1<*>', 'g'), ' ') AS t FROM lines WHERE plain <> ''
), keyed AS (
  SELECT doc_id, no, t, len(t) AS n, array_to_string(t, ' ') AS exact, len(t) || ' ' || array_to_string(t[1:{LEAD}], ' ') AS leaf FROM tokens
), exact AS (
  SELECT leaf, exact, any_value(t) AS t, any_value(n) AS n, count(DISTINCT doc_id) AS docs FROM keyed GROUP BY leaf, exact
), leaves AS (
  SELECT leaf FROM keyed GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS} AND count(DISTINCT exact) > 1
), form AS (
  SELECT e.* FROM exact e JOIN leaves USING (leaf)
), tok AS (
  SELECT leaf, exact, docs, n, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM form
), share AS (
  SELECT leaf, sum(docs) AS all_docs FROM form GROUP BY leaf
), counted AS (
  SELECT leaf, pos, token, sum(docs) * 2 >= any_value(all_docs) AS major, sum(docs) >= {MIN_DOCS} AS often FROM tok JOIN share USING (leaf) GROUP BY leaf, pos, token
), fixed AS (
  SELECT leaf, count(DISTINCT pos) AS fixed FROM counted WHERE major GROUP BY leaf
), fit AS (
  SELECT leaf, exact, any_value(n) AS n, count(*) FILTER (major) AS agree, count(*) FILTER (often) AS frequent,
    string_agg(CASE WHEN often THEN token ELSE '<*> ' END, ' ' ORDER BY pos) AS template
  FROM tok JOIN counted USING (leaf, pos, token) WHERE major OR often GROUP BY leaf, exact
), members AS (
  SELECT leaf, exact, 'majority' AS grp FROM fit JOIN fixed USING (leaf) WHERE fixed >= {CONSTANT} * n AND agree + n - fixed >= {SIMILARITY} * n
  UNION ALL SELECT leaf, exact, 'template ' || template FROM fit WHERE frequent >= {CONSTANT} * n
), in_template AS (
  SELECT leaf, grp FROM keyed JOIN members USING (leaf, exact) GROUP BY leaf, grp HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), recurring AS (
  SELECT leaf, exact FROM exact WHERE docs >= {MIN_DOCS} UNION SELECT leaf, exact FROM members JOIN in_template USING (leaf, grp)
), dropped AS (
  SELECT doc_id, list(no) AS nos FROM keyed JOIN recurring USING (leaf, exact) GROUP BY doc_id
)
SELECT d.doc_id,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(nos), 0) AS BIGINT) AS n_dropped,
  md5(CASE WHEN nos IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda line, i: NOT list_contains(nos, i)), chr(10)) END) AS kept_md5
FROM documents d LEFT JOIN dropped USING (doc_id)
"""


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the MD5 of the kept text, of every row."""
    rows = drop_recurring_lines(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("kept").cast("binary")).alias("kept_md5"))
