"""Keyed writes on tables without a transaction log: upserts, first wins, largest wins, replace, soft delete, change capture."""

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """All rows of ``new`` and the rows of ``old`` whose key it lacks; columns that one side lacks are null."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def first_wins(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """``old`` and, for keys it lacks, the first new row by ``order``."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), F.struct(*order)).alias("_row")).select(key, "_row.*")
    return old.unionByName(first.join(old.select(key), key, "left_anti"))


def largest_score(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs in canonical order with their largest score by reason; a pair of one path is left out."""
    every = old.unionByName(new).where("path_a <> path_b")
    pair = every.select(F.least("path_a", "path_b").alias("path_a"), F.greatest("path_a", "path_b").alias("path_b"), "reason", "score")
    return pair.groupBy("path_a", "path_b", "reason").agg(F.max("score").alias("score"))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` in place of all old rows that share a key with it."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def soft_delete(files: DataFrame, vanished: DataFrame, key: str, now: Column) -> DataFrame:
    """Active rows among ``vanished`` become deleted; deleted ones that aren't are untouched."""
    gone = vanished.select(F.col(key).alias("_gone")).distinct()
    out = files.join(gone, files[key] == gone["_gone"], "left")
    hit = F.col("_gone").isNotNull() & ~F.coalesce("deleted", F.lit(False))
    return out.withColumn("deleted_ts", F.when(hit, now).otherwise(F.col("deleted_ts"))).withColumn("deleted", F.col("deleted") | hit).drop("_gone")


def change_log(before: DataFrame, after: DataFrame, key: str, kind: str) -> DataFrame:
    """(kind, key, payload_json) of rows that were added or changed."""
    columns = [c for c in after.columns if c != key]
    a = after.select(F.col(key).alias("_a"), F.struct(*columns).alias("_now"))
    b = before.select(F.col(key).alias("_b"), F.struct(*columns).alias("_then"))
    rows = a.join(b, F.col("_a") == F.col("_b"), "left").where(F.col("_b").isNull() | ~F.col("_now").eqNullSafe(F.col("_then")))
    return rows.select(F.lit(kind).alias("kind"), F.col("_a").alias(key), F.to_json(F.struct(F.col("_a").alias(key), "_now.*")).alias("payload_json"))


def boost(profiles: DataFrame, hits: DataFrame, key: str, by: float) -> DataFrame:
    """Confidence of hit rows raised, 1 at most."""
    seen = hits.select(F.col(key).alias("_hit")).distinct()
    out = profiles.join(seen, profiles[key] == seen["_hit"], "left")
    return out.withColumn("confidence", F.when(F.col("_hit").isNotNull(), F.least(F.lit(1.0), F.col("confidence") + by)).otherwise(F.col("confidence"))).drop("_hit")


def add_reason(queue: DataFrame, reason: str) -> DataFrame:
    """A reason appended to an array column where it is missing."""
    now = F.coalesce("reasons", F.array().cast("array<string>"))
    return queue.withColumn("reasons", F.when(F.array_contains(now, reason), now).otherwise(F.array_append(now, F.lit(reason))))


def reasons_for(queue: DataFrame, hits: DataFrame, key: str, reason: str) -> DataFrame:
    """The queue (key, reasons, ...) with a reason for every hit: beside those that a row has, or in a new row. Null keys hit nothing."""
    seen = hits.select(F.col(key).alias("_hit")).where("_hit is not null").distinct()
    there = queue.join(seen, queue[key] == seen["_hit"], "left")
    marked = add_reason(there.where("_hit is not null").drop("_hit"), reason).unionByName(there.where("_hit is null").drop("_hit"))
    fresh = seen.join(queue.select(key), seen["_hit"] == queue[key], "left_anti")
    return marked.unionByName(fresh.select(F.col("_hit").alias(key), F.array(F.lit(reason)).alias("reasons")), allowMissingColumns=True)


def events_after(log: DataFrame, seq: int, limit: int = 256) -> DataFrame:
    """The next ``limit`` events after a number, in order, with ``payload``: a JSON object, made from what ``payload_json`` holds.

    An object stays, any other JSON value is its ``value``, what can't be read is ``raw``; null and empty are an empty object.
    """
    raw = F.col("payload_json")
    parsed = F.try_parse_json(raw)
    wrapped = lambda name, c: F.to_json(F.struct(c.alias(name)))
    payload = (
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit("{}"))
        .when(parsed.isNull(), wrapped("raw", raw))
        .when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed))
        .otherwise(wrapped("value", parsed))
    )
    return log.where(F.col("seq") > seq).orderBy("seq").limit(limit).withColumn("payload", payload)


def review_queue(queue: DataFrame, profiles: DataFrame, key: str, low: float, now: Column) -> DataFrame:
    """The queue (key, confidence, ..., created_utc) after profiles were scored again.

    Profiles below ``low`` are in it with their new values; one that was there keeps the time it came, a new one has ``now``. One that
    recovered leaves, one that wasn't scored stays as it was. A null confidence is not below.
    """
    seen = profiles.select(F.col(key).alias("_seen")).distinct()
    stay = queue.join(seen, queue[key] == seen["_seen"], "left_anti")
    came = queue.select(F.col(key).alias("_key"), F.col("created_utc").alias("_came"))
    rows = profiles.where(F.col("confidence") < low).join(came, F.col(key) == F.col("_key"), "left")
    values = {c: F.col(c) if c in profiles.columns else F.lit(None).cast(t) for c, t in queue.dtypes} | {"created_utc": F.coalesce("_came", now)}
    return stay.unionByName(rows.select(*[values[c].alias(c) for c in queue.columns]))


def swap(df: DataFrame, path: str) -> str:
    """Writes a new version beside ``path`` and returns its place; a table that is read is never overwritten."""
    version = f"{path.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.parquet(version)
    return version


SCORE_CHANGE = 1e-6


def _synced(table: DataFrame, wanted: DataFrame, every: DataFrame, key: list[str], stamp: str, now: Column) -> DataFrame:
    """``table`` with the rows ``wanted``, stamped ``now`` where anything but the score's last digits differs, and ``_change`` (new, same, other).

    Rows whose key is in ``every`` but not in ``wanted`` leave; rows whose key is in neither stay (null).
    """
    columns = [c for c in table.columns if c not in (*key, stamp)]
    old = table.select(*[F.col(k).alias(f"_{k}") for k in key], F.struct(*columns, stamp).alias("_old"))
    both = wanted.join(old, [F.col(k) == F.col(f"_{k}") for k in key], "left")
    alike = F.lit(True)
    for c in columns:
        close = F.abs(F.col(c) - F.col(f"_old.{c}")) <= SCORE_CHANGE if c == "score" else F.col(c).eqNullSafe(F.col(f"_old.{c}"))
        alike = alike & F.coalesce(close, F.col(c).isNull() & F.col(f"_old.{c}").isNull())
    same = F.col("_old").isNotNull() & alike
    made = both.select(*key, *[F.when(same, F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) for c in columns], F.when(same, F.col(f"_old.{stamp}")).otherwise(now).alias(stamp), F.when(same, "same").when(F.col("_old").isNull(), "new").otherwise("other").alias("_change"))
    rest = table.join(every.select(*key), key, "left_anti").withColumn("_change", F.lit(None).cast("string"))
    return rest.unionByName(made)


def two_table_sync(minimal: DataFrame, queue: DataFrame, made: DataFrame, key: list[str], least: float, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(minimal, queue, summary) after parsed rows ``made`` (key, score and the columns of both tables) were put where they belong.

    Rows of ``least`` score or more belong to ``minimal`` (..., parsed_utc), others, null scores too, to ``queue`` (..., queued_utc), and leave the other
    table. A row that says what is stored, its score within a millionth, keeps its time. Of rows with one key the best score counts.
    """
    one = made.groupBy(*key).agg(F.max_by(F.struct(*[c for c in made.columns if c not in key]), F.coalesce("score", F.lit(-1.0))).alias("_row")).select(*key, "_row.*")
    good = F.coalesce(F.col("score") >= least, F.lit(False))
    sides = []
    for table, test, stamp in ((minimal, good, "parsed_utc"), (queue, ~good, "queued_utc")):
        sides.append(_synced(table, one.where(test).select(*[c for c in table.columns if c != stamp]), one, key, stamp, now))
    count = lambda df, test, name: df.agg(F.count_if(test).alias(name))
    changed, same = F.col("_change").isin("new", "other"), F.col("_change") == "same"
    counts = sides[0].agg(F.count_if(changed).alias("stored"), F.count_if(same).alias("_a")).crossJoin(sides[1].agg(F.count_if(changed).alias("queued"), F.count_if(same).alias("_b")))  # one row each
    left = [table.join(one.where(test).select(*key), key, "left_semi") for table, test in ((minimal, ~good), (queue, good))]
    counts = counts.crossJoin(count(left[0], F.lit(True), "removed_minimal")).crossJoin(count(left[1], F.lit(True), "removed_queue")).crossJoin(count(one, F.lit(True), "processed"))
    summary = counts.select("processed", "stored", "queued", (F.col("_a") + F.col("_b")).alias("unchanged"), "removed_minimal", "removed_queue")
    return sides[0].drop("_change"), sides[1].drop("_change"), summary
