"""Sinks: CSV, JSON lines, playlists, report sections, snapshots with manifests."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_row(df: DataFrame) -> DataFrame:
    """Columns as an export shows them: flags 0 or 1, seconds without trailing zeros, blanks for nulls."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "boolean":
            c = c.cast("int").cast("string")
        elif kind in ("double", "float"):
            c = F.regexp_replace(F.format_string("%.3f", F.bround(c.cast("double"), 3)), r"\.?0+$", "")
        elif not kind.startswith(("string", "int", "bigint")):
            c = c.cast("string")
        out.append(F.coalesce(F.when(F.col(name).isNotNull(), c.cast("string")), F.lit("")).alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    export_row(df).write.csv(path, header=True, emptyValue="", quoteAll=False)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def write_playlist(df: DataFrame, path: str, kind: str = "m3u") -> None:
    """Paths as lines, or path and title as quoted CSV; rows without a path are left out."""
    rows = df.where(F.coalesce("path", F.lit("")) != "")
    if kind == "m3u":
        rows.select("path").write.text(path)
    else:
        rows.select("path", "title").write.csv(path, header=True, quoteAll=True)


def write_sections(sections: dict[str, DataFrame], folder: str, kind: str = "csv") -> list[str]:
    """One file set for each section that has rows."""
    out = []
    for name, df in sections.items():
        if not df.isEmpty():
            (write_csv if kind == "csv" else write_json_lines)(df, f"{folder}/{name}")
            out.append(name)
    return out


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """A Parquet snapshot; returns its manifest: file, length and SHA-256, computed by tasks."""
    df.write.parquet(path)
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def purge(log: DataFrame, ts: str, now, keep_days: int, folder: str) -> int:
    """Writes the rows of a log that are at most ``keep_days`` old to a new folder and returns how many were older; rows without a time stay."""
    old = F.coalesce(F.col(ts) < now - F.make_dt_interval(days=F.lit(keep_days)), F.lit(False))
    log.where(~old).write.json(folder, ignoreNullFields=False)
    return log.where(old).count()
