"""Table, listing and tolerant text readers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the named columns it lacks, as nulls of the given types."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c.lower() not in have})


def shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One table from several with differing columns."""
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_bytes, mtime) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv_header(text, delimiter: str = ",", fields: int = 40, chars: int = 120):
    """Trimmed, non-empty fields of a CSV text's first record, at most ``fields`` of ``chars`` characters."""
    first = F.element_at(F.split(text, r"\r?\n", 2), 1)
    parsed = F.from_csv(first, ", ".join(f"c{k} string" for k in range(fields)), {"sep": delimiter})
    # the record is parsed once, however many fields it has
    cells = F.get(F.transform(F.array(parsed), lambda r: F.array(*[F.trim(r[f"c{k}"]) for k in range(fields)])), F.lit(0))
    return F.transform(F.filter(cells, lambda c: c.isNotNull() & (c != "")), lambda c: F.substring(c, 1, chars))


def json_keys(text):
    """Top-level keys of a JSON object, or of an array's first element; on failure of the text between its outer braces."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.json_object_keys(text), F.json_object_keys(F.get_json_object(text, "$[0]")), F.json_object_keys(F.nullif(inner, F.lit(""))))


def line_sample(text, head: int = 5, middle: int = 3, tail: int = 3, chars: int = 4000):
    """Head, evenly strided middle and tail lines, with an ellipsis line between stretches, cut to ``chars`` characters."""
    lines = F.split(text, r"\r?\n")
    n = F.size(lines)
    step = F.greatest(F.lit(1), ((n - head - tail) / (middle + 1)).cast("int"))
    mid = F.filter(F.slice(lines, F.lit(head + 1), F.greatest(F.lit(0), n - head - tail)), lambda _, i: ((i + 1) % step == 0) & ((i + 1) / step <= middle))
    end = F.slice(lines, F.greatest(F.lit(head + 1), n - tail + 1), F.lit(tail))
    gap = F.array(F.lit("…"))
    every = F.concat(F.slice(lines, 1, head), F.when(F.size(mid) > 0, F.concat(gap, mid)).otherwise(F.array().cast("array<string>")), F.when(n > head, F.concat(gap, end)).otherwise(F.array().cast("array<string>")))
    return F.substring(F.array_join(every, "\n"), 1, chars)


def looks_binary(head):
    """A NUL byte, or control bytes beyond a third of the head and 16."""
    each = F.decode(head, "ISO-8859-1")  # a character for each byte
    odd = F.length(each) - F.length(F.regexp_replace(each, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]+", ""))
    return F.contains(each, F.lit("\0")) | (odd > F.greatest(F.lit(16.0), F.octet_length(head) / 3))


def floats(blob):
    """Little-endian 32-bit floats of a binary column."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<float>")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))

    return decode(blob)


def pack_floats(vec):
    """Arrays of floats as little-endian 32-bit bytes."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode(vec)
