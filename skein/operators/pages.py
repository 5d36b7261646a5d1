"""Filtered, sorted and cut views: conjunctive optional predicates, paging, guarded totals."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename

DEFAULT_LIMIT, MOST_LIMIT, EXACT_TOTAL, LOW_CONFIDENCE = 100, 500, 10_000, 0.55


@dataclass(frozen=True)
class Pagination:
    limit: int
    offset: int


def pagination(limit: int | None = None, offset: int | None = None) -> Pagination:
    return Pagination(max(1, min(MOST_LIMIT, limit or DEFAULT_LIMIT)), max(0, offset or 0))


def page(df: DataFrame, order: list, limit: int | None = None, offset: int | None = None) -> DataFrame:
    p = pagination(limit, offset)
    return df.orderBy(*order).offset(p.offset).limit(p.limit)


def next_offset(rows: int, p: Pagination, total: int | None = None) -> int | None:
    """Where the next page begins: known from the total, else guessed from a full page."""
    more = p.offset + rows < total if total is not None else rows == p.limit
    return p.offset + rows if more and rows else None


def guarded_total(df: DataFrame, exact: int = EXACT_TOTAL) -> DataFrame:
    """``total`` of at most ``exact`` rows, null beyond; counts no more than one row over."""
    return df.limit(exact + 1).agg(F.when(F.count("*") <= exact, F.count("*")).alias("total"))


def all_of(df: DataFrame, predicates: list[Column | None]) -> DataFrame:
    for p in predicates:
        df = df if p is None else df.where(p)
    return df


def contains_any(text: str | None, *columns: Column) -> Column | None:
    """A text, case ignored, in any of the columns."""
    if not text:
        return None
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return out


def same(column: str, value: str | None) -> Column | None:
    return F.lower(column) == value.lower() if value else None


def null_or(column: str, test) -> Column:
    """A test that rows without a value pass."""
    return F.col(column).isNull() | test(F.col(column))


def has_all(wanted: list[str], column: Column) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), column)) == 0


def inventory(inv: DataFrame, q: str | None = None, category: str | None = None, ext: str | None = None, mime: str | None = None, since: Column | None = None) -> DataFrame:
    mime_test = F.lower("mime").startswith(mime.lower()) if mime else None
    return all_of(inv, [contains_any(q, F.col("path"), basename(F.col("path"))), same("category", category), same("ext", ext), mime_test, None if since is None else F.col("mtime") >= since])


def quick_search(inv: DataFrame, query: str, most: int = 1000) -> DataFrame:
    """Newest rows whose name or path is like the query; queries of under three characters find nothing."""
    text = " ".join(query.split())
    if len(text) < 3:
        return inv.limit(0)
    pattern = f"%{text.lower()}%"
    return inv.where(F.lower("name").like(pattern) | F.lower("path").like(pattern)).orderBy(F.desc_nulls_last("mtime"), "path").limit(most)


def with_name(inv: DataFrame) -> DataFrame:
    """``name`` filled from the path where it is null or empty."""
    return inv.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lower(basename(F.col("path")))))


def low_confidence(df: DataFrame, low: float | None, high: float | None, n: int) -> DataFrame:
    """Rows without confidence or within bounds, lowest first, those without last."""
    c = F.col("confidence")
    return df.where(c.isNull() | c.between(0.0 if low is None else low, 1.0 if high is None else high)).orderBy(c.asc_nulls_last(), "path").limit(n)


def last_entries(log: DataFrame, n: int, event_id: str | None = None, level: str | None = None, module: str | None = None) -> DataFrame:
    """The last ``n`` matching log rows, in file order (column ``position``)."""
    rows = all_of(log, [F.col("event_id") == event_id if event_id else None, same("level", level), contains_any(module, F.col("module"))])
    return rows.orderBy(F.desc("position")).limit(n).orderBy("position")


def read_only_sql(spark, sql: str, args: list | None = None, limit: int = MOST_LIMIT) -> DataFrame:
    """A single SELECT over registered views, cut to 1 to 500 rows."""
    if not sql.lstrip().lower().startswith("select") or ";" in sql.rstrip().rstrip(";"):
        raise ValueError("only one SELECT statement is allowed")
    return spark.sql(sql.rstrip().rstrip(";"), args=args).limit(max(1, min(MOST_LIMIT, limit)))


def music(rows: DataFrame, q: str | None = None, drive: str | None = None, ext: str | None = None, least: float | None = None) -> DataFrame:
    """Parsed names of a drive whose path, file name, artist, title or album holds a text, of one extension, with at least a score (taken into 0 to 1)."""
    found = contains_any(q, F.col("path"), basename(F.col("path")), *[F.coalesce(c, F.lit("")) for c in ("artist", "title", "album")])
    test = None if least is None else F.col("score") >= max(0.0, min(1.0, least))
    return all_of(rows, [F.col("drive") == drive if drive else None, found, same("ext", ext), test])


def series(rows: DataFrame, q: str | None = None, least: float | None = None, drive: str | None = None, only_low: bool = False, sort: str = "title", descending: bool = False) -> DataFrame:
    """Series whose title or folder holds a text, with at least a confidence or only those below ``LOW_CONFIDENCE``, sorted by title, confidence or seasons.

    A row without confidence counts as 0; ties go by folder.
    """
    sure = F.coalesce("confidence", F.lit(0.0))
    kept = all_of(rows, [contains_any(q, F.col("title"), F.col("folder")), None if least is None else sure >= least, F.col("drive") == drive if drive else None, sure < LOW_CONFIDENCE if only_low else None])
    by = {"title": F.lower("title"), "confidence": sure, "seasons": F.col("seasons")}[sort]
    return kept.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), "folder")


def ranked(rows: DataFrame, order: list, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page with each row's ``rank`` among all (from 1) and the ``total`` of all."""
    from pyspark.sql import Window

    p = pagination(limit, offset)
    total = rows.agg(F.count("*").alias("total"))
    # a page and what is ahead of it: at most offset + limit rows are ranked
    first = rows.orderBy(*order).limit(p.offset + p.limit)
    numbered = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return numbered.where(F.col("rank") > p.offset).crossJoin(F.broadcast(total))  # one row


def retained(rows: DataFrame, n: int, key: str, *newest: Column) -> tuple[DataFrame, DataFrame]:
    """(the ``n`` newest rows, the keys of all others): what a table keeps and what goes when it is cut to a number of rows."""
    kept = rows.orderBy(*newest).limit(n)
    return kept, rows.select(key).join(kept.select(key), key, "left_anti")


def summary(tables: dict[str, DataFrame], n: int) -> tuple[DataFrame, DataFrame]:
    """(kind, total) of each table, and the ``n`` least confident rows (kind, path, confidence) of each; rows without confidence come last."""
    totals = lows = None
    for kind, df in tables.items():
        total = df.agg(F.lit(kind).alias("kind"), F.count("*").alias("total"))
        low = df.select(F.lit(kind).alias("kind"), "path", "confidence").orderBy(F.col("confidence").asc_nulls_last(), "path").limit(n)
        totals, lows = (total, low) if totals is None else (totals.unionByName(total), lows.unionByName(low))
    return totals, lows


def export_preview(rows: DataFrame, cap: int = 2000, first: int = 10) -> tuple[DataFrame, DataFrame]:
    """What an export of at most ``cap`` rows would write, without writing: (one row: rows), and its first rows."""
    cut = rows.limit(cap)
    return cut.agg(F.count("*").alias("rows")), cut.limit(first)
