"""Reports over an inventory (path, ext, category, size_bytes, mtime): totals, breakdowns, rankings, snapshots."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import parent_folder, report_extension

CATEGORIES = ("video", "audio", "image", "document", "archive", "executable", "other")


def overview(inv: DataFrame) -> DataFrame:
    """Files, bytes and whole mean size; one row, zeros for an empty inventory."""
    return inv.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"),
        F.coalesce(F.floor(F.sum("size_bytes") / F.count("*")), F.lit(0)).cast("long").alias("mean_bytes"),
    )


def normal_category(c: Column | str) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("other"))


def categories(inv: DataFrame, raw_grouping: bool = False) -> DataFrame:
    """Files and bytes by normalised category; ``raw_grouping`` keeps one row for each raw spelling."""
    rows = inv.select("category", F.coalesce("size_bytes", F.lit(0)).alias("size"), normal_category("category").alias("cat"))
    keys = ["category", "cat"] if raw_grouping else ["cat"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))
    return out.select(F.col("cat").alias("category"), "files", "bytes")


def categories_with_snapshot(inv: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Counts from the newest snapshot if it counts anything (bytes still from the inventory), else from the inventory."""
    newest = snapshots.agg(F.max_by(F.struct("*"), F.struct("scan_ts_utc", "id")).alias("s")).where("s.total_files <> 0").select("s.*")
    counts = newest.select(F.explode(F.create_map(*[x for c in CATEGORIES for x in (F.lit(c), F.col(f"by_{c}"))])).alias("category", "snap_files"))
    merged = categories(inv).join(counts, "category", "full_outer").crossJoin(newest.agg((F.count("*") > 0).alias("has")))  # one row
    files = F.when(F.col("has"), F.coalesce("snap_files", F.lit(0))).otherwise(F.col("files"))
    return merged.select("category", files.alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def top_extensions(inv: DataFrame, n: int) -> DataFrame:
    """The ``n`` extensions with most files and the ``n`` with most bytes, merged, with both ranks (null: not in that list)."""
    groups = inv.groupBy(report_extension(F.col("ext")).alias("ext")).agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"))
    by_files = groups.orderBy(F.desc("files"), F.asc_nulls_first("ext")).limit(n)
    by_bytes = groups.orderBy(F.desc("bytes"), F.asc_nulls_first("ext")).limit(n)
    # ranks over 2 n rows at most
    both = by_files.union(by_bytes).distinct()
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), F.asc_nulls_first("ext")))
    ranked = both.withColumn("rank_count", rank("files")).withColumn("rank_size", rank("bytes"))
    cut = lambda c: F.when(F.col(c) <= n, F.col(c)).alias(c)
    return ranked.select("ext", "files", "bytes", cut("rank_count"), cut("rank_size"))


def largest(inv: DataFrame, n: int) -> DataFrame:
    return inv.select("path", "size_bytes").orderBy(F.desc_nulls_last("size_bytes"), "path").limit(n)


def heaviest_folders(inv: DataFrame, depth: int, n: int) -> DataFrame:
    """Folders of a depth by their bytes; files outside any folder don't count."""
    rows = inv.select(parent_folder(F.col("path"), depth).alias("folder"), F.coalesce("size_bytes", F.lit(0)).alias("size")).where("folder <> ''")
    return rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes")).orderBy(F.desc("bytes"), "folder").limit(n)


def recent(inv: DataFrame, now: Column, days: int, n: int) -> DataFrame:
    """The newest ``n`` rows of the last days, each with the number of such rows."""
    fresh = inv.where(F.col("mtime") >= now - F.make_interval(days=F.lit(days)))
    total = fresh.agg(F.count("*").alias("recent_total"))
    newest = fresh.select("path", "mtime").orderBy(F.desc("mtime"), "path").limit(n)
    return newest.crossJoin(F.broadcast(total))  # one row


def snapshot(inv: DataFrame, names: list[str], column: str = "category") -> DataFrame:
    """One wide row: total files and a counter for each name, the rest under ``by_other``."""
    c = F.col(column)
    counters = [F.count_if(c == x).alias(f"by_{x}") for x in names]
    return inv.agg(F.count("*").alias("total_files"), *counters, F.count_if(c.isNull() | ~c.isin(*names)).alias("by_other"))


def sections(inv: DataFrame, now: Column, n: int = 20, depth: int = 2, days: int = 7) -> dict[str, DataFrame]:
    """The report bundle, by section."""
    return {
        "overview": overview(inv),
        "categories": categories(inv),
        "top_extensions": top_extensions(inv, n),
        "largest_files": largest(inv, n),
        "heaviest_folders": heaviest_folders(inv, depth, n),
        "recent_changes": recent(inv, now, days, n),
    }
