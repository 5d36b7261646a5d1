"""Text previews: which files are texts, a sample of bounded bytes, its summary and keywords, hints of a schema, the stored table and its index."""

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media
from ..functions.paths import lookup
from ..sources import readers
from .joins import stale
from .upserts import replace_by_key

# Kinds by extension and by MIME type, what a sample may hold, how long a summary is.
KINDS = {"txt": "txt text", "md": "md", "rst": "rst", "log": "log", "csv": "csv", "tsv": "tsv", "json": "json", "ndjson": "ndjson", "yaml": "yaml yml", "ini": "ini", "cfg": "cfg"}
MIMES = {
    "txt": "text/plain", "md": "text/markdown text/x-markdown", "log": "text/x-log", "csv": "text/csv", "tsv": "text/tab-separated-values", "json": "application/json", "ndjson": "application/x-ndjson",
    "yaml": "application/yaml text/yaml application/x-yaml", "ini": "text/x-ini text/ini", "cfg": "text/x-config",
}
TEXT_MIMES = ("text/", "application/json", "application/yaml")
HEAD_BYTES, MOST_SIZE, SENTENCES, CHARS_A_TOKEN, SHORTEST = 2048, 50 << 20, 4, 6, 3
GAP, AT_A_TIME = "…", 256
WORD, SENTENCE_END = re.compile(r"[A-Za-zÀ-ÿ0-9_']+"), re.compile(r"(?<=[.!?])\s+")
PREVIEW = "struct<text:string,bytes:int,lines:int,summary:string,keywords:array<string>>"


@dataclass
class Sampling:
    """How much of a text a preview reads, and how much it says."""

    max_bytes: int = 32768
    max_lines: int = 400
    head_lines: int = 150
    mid_lines: int = 100
    tail_lines: int = 150
    summary_tokens: int = 80
    keywords: int = 8


def kind(ext: Column, mime: Column) -> Column:
    """A text's kind by its extension, else by its MIME type, else ``txt`` for any textual type; null for other files."""
    low = F.lower(mime)
    textual = F.lit(False)
    for prefix in TEXT_MIMES:
        textual = textual | low.startswith(prefix)
    return F.coalesce(lookup(KINDS, F.ltrim(F.lower(ext), F.lit("."))), lookup(MIMES, low), F.when(textual, "txt"))


def probed(files: DataFrame, most: int = MOST_SIZE) -> DataFrame:
    """``files`` (path, ext, mime, size_bytes, content: binary) with ``kind`` and ``skipped``: ``unsupported``, ``too_large``, ``binary`` or null."""
    rows = files.withColumn("kind", kind(F.col("ext"), F.col("mime")))
    odd = readers.looks_binary(F.substring("content", 1, HEAD_BYTES))
    return rows.withColumn("skipped", F.when(F.col("size_bytes") > most, "too_large").when(F.col("kind").isNull(), "unsupported").when(F.col("content").isNull() | odd, "binary"))


def _lines(data: bytes) -> list[str]:
    return data.decode("utf-8", "replace").splitlines()


def _distinct(lines: list[str]) -> list[str]:
    return list({line.strip(): line for line in reversed(lines)}.values())[::-1]


def sample(data: bytes, how: Sampling) -> tuple[str, int, int]:
    """(text, bytes, lines) of the first lines, some from around the middle and the last ones, with a gap between; cut at ``max_bytes`` between characters.

    The middle and the end are read as stretches of bytes, so a large text is not decoded whole; lines that repeat within them count once.
    """
    window = max(1024, how.max_bytes * 4)
    head = data[:window]
    while len(head) < len(data) and head.count(b"\n") < how.head_lines:
        head = data[: 2 * len(head)]
    first = _lines(head)[: how.head_lines]
    room, left = max(0, how.max_lines - len(first)), max(0, how.max_bytes - sum(len(x.encode()) for x in first))
    mid_bytes = min(left, how.max_bytes // 3)
    tail_bytes = min(left, how.max_bytes - mid_bytes)
    stretch = lambda budget: min(len(data), max(1024, min(budget * 2, 65536)))
    middle, last = [], []
    if (n := min(how.mid_lines, room)) and mid_bytes and data:
        begin = max(0, len(data) // 2 - stretch(mid_bytes) // 2)
        found = _lines(data[begin : begin + stretch(mid_bytes)])
        middle = found if len(found) <= n else found[:: max(1, len(found) // n)][:n]
    if (n := min(how.tail_lines, room)) and tail_bytes:
        last = _lines(data[len(data) - stretch(tail_bytes) :])[-n:]
    parts, used = [], 0
    for section in (first, _distinct(middle), _distinct(last)):
        for k, line in enumerate(([GAP] if parts and section else []) + section):
            if used >= how.max_bytes or (len(parts) >= how.max_lines and not (k == 0 and line == GAP)):
                break
            raw = line.encode()[: how.max_bytes - used]
            parts.append(raw.decode("utf-8", "ignore"))
            used += len(raw)
    return "\n".join(parts), used, len(parts)


def summarised(text: str, how: Sampling) -> tuple[str, list[str]]:
    """(summary, keywords): sentences whose words are frequent for their length, in the text's order; the most frequent words, ties by name."""
    counts: dict[str, int] = {}
    for word in WORD.findall(text.lower()):
        if len(word) >= SHORTEST:
            counts[word] = counts.get(word, 0) + 1
    keywords = sorted(counts, key=lambda w: (-counts[w], w))[: how.keywords]
    room = how.summary_tokens * CHARS_A_TOKEN
    sentences = [s.strip() for s in SENTENCE_END.split(text.strip()) if s.strip()]
    if not counts:
        return " ".join(sentences[:3])[:room], keywords
    score = {s: sum(counts.get(w, 0) for w in WORD.findall(s.lower())) / math.sqrt(len(s) + 1) for s in sentences}
    chosen, chars = [], 0
    for s in sorted(score, key=lambda s: -score[s]):
        chosen.append(s)
        chars += len(s)
        if chars >= room or len(chosen) == SENTENCES:
            break
    return " ".join(s for s in score if s in chosen), keywords


def preview(content: Column, how: Sampling | None = None) -> Column:
    """Struct of the sampled text, its bytes and lines, summary and keywords of a binary column; null for null and for blank samples."""
    how = how or Sampling()

    @F.arrow_udf(PREVIEW)
    def read(column: pa.Array) -> pa.Array:
        # some texts at a time, so that Python holds no more of a batch than these
        parts = [some(column.slice(at, AT_A_TIME).to_pylist()) for at in range(0, len(column), AT_A_TIME)]
        return pa.concat_arrays(parts) if parts else some([])

    def some(texts: list[bytes | None]) -> pa.Array:
        out = []
        for data in texts:
            text, size, lines = sample(data, how) if data is not None else ("", 0, 0)
            summary, keywords = summarised(text, how) if text.strip() else ("", [])
            out.append({"text": text, "bytes": size, "lines": lines, "summary": summary, "keywords": keywords} if text.strip() else None)
        fields = [("text", pa.string()), ("bytes", pa.int32()), ("lines", pa.int32()), ("summary", pa.string()), ("keywords", pa.list_(pa.string()))]
        return pa.array(out, pa.struct(fields))

    return read(content)


def summary(text: Column, how: Sampling | None = None) -> Column:
    """Struct of summary and keywords of a text column; both empty for null and blank texts."""
    how = how or Sampling()

    @F.arrow_udf("struct<summary:string,keywords:array<string>>")
    def read(column: pa.Array) -> pa.Array:
        made = (summarised(t, how) if t and t.strip() else ("", []) for t in (x.as_py() for x in column))
        return pa.array([{"summary": s, "keywords": k} for s, k in made], pa.struct([("summary", pa.string()), ("keywords", pa.list_(pa.string()))]))

    return read(text)


def schema_json(kind: Column, text: Column) -> Column:
    """JSON of the header fields, keys or first-level keys of a text by its kind; null without any."""
    tables = F.when(kind == "csv", readers.csv_header(text)).when(kind == "tsv", readers.csv_header(text, "\t"))
    first = F.when(kind == "ndjson", F.substring_index(text, "\n", 1)).otherwise(text)
    keys = F.when(kind.isin("json", "ndjson"), readers.json_keys(first))
    some = lambda c: F.when(F.size(c) > 0, c)
    hints = F.struct(some(tables).alias("csv_headers"), some(keys).alias("json_keys"), some(F.when(kind == "yaml", media.first_level_keys(text))).alias("yaml_keys"))
    made = F.to_json(hints)
    return F.when(made != "{}", made)


def rows(files: DataFrame, now: Column, how: Sampling | None = None, most: int = MOST_SIZE) -> DataFrame:
    """(path, kind, bytes_sampled, lines_sampled, summary, keywords, schema_json, updated_utc) of the files that are texts; others have no row."""
    how = how or Sampling()
    kept = probed(files, most).where("skipped is null").select("path", "kind", "content", preview(F.col("content"), how).alias("p")).where("p.text is not null")
    return kept.select(
        "path", "kind", F.col("p.bytes").alias("bytes_sampled"), F.col("p.lines").alias("lines_sampled"), F.col("p.summary").alias("summary"), F.col("p.keywords").alias("keywords"),
        schema_json(F.col("kind"), F.decode(F.substring("content", 1, how.max_bytes), "UTF-8")).alias("schema_json"), now.alias("updated_utc"),
    )


def due(inventory: DataFrame, previews: DataFrame, most: int = MOST_SIZE) -> DataFrame:
    """Texts of the inventory (path, ext, mime, size_bytes, indexed_utc) without a preview, or indexed after it."""
    texts = inventory.where(kind(F.col("ext"), F.col("mime")).isNotNull() & (F.col("size_bytes") <= most))
    return stale(texts, previews, "path", "indexed_utc", "updated_utc")


def stored(previews: DataFrame | None, made: DataFrame) -> DataFrame:
    """The previews with the rows of a run in place of older ones of their paths."""
    return made if previews is None else replace_by_key(previews, made, "path")
