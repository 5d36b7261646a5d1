"""Text previews."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from skein.operators import previews as P
from skein.operators.previews import Sampling

FILES = "path string, ext string, mime string, size_bytes long, content binary"
GOLDEN = {
    "metrics.csv": ("category,value\nmovies,2\nepisodes,2\n", 102, 11, ["category", "episodes", "movies", "value"], "category,value\nmovies,2\nepisodes,2\n…\ncategory,value\nmovies,2\nepisodes,2\n…\ncategory,value\nmovies,2\nepisodes,2"),
    "overview.md": (
        "# Example Overview\n\nThis document summarises the fixture dataset.", 195, 11, ["dataset", "document", "example", "fixture", "overview"],
        "# Example Overview\n\nThis document summarises the fixture dataset. …\n# Example Overview\n\nThis document summarises the fixture dataset.",
    ),
}


def test_golden_previews(spark):
    rows = [(name, name.split(".")[1], None, len(text), text.encode()) for name, (text, *_) in GOLDEN.items()]
    got = {r.path: r for r in P.rows(spark.createDataFrame(rows, FILES), F.lit(dt.datetime(2024, 1, 1)), Sampling(keywords=5)).collect()}
    for name, (_, size, lines, keywords, summary) in GOLDEN.items():
        r = got[name]
        assert (r.bytes_sampled, r.lines_sampled, r.keywords, r.summary) == (size, lines, keywords, summary)
    assert json.loads(got["metrics.csv"].schema_json) == {"csv_headers": ["category", "value"]} and got["overview.md"].schema_json is None


def test_samples_are_bounded_in_bytes():
    rng = random.Random(3)
    data = "\n".join("é😀x" * rng.randint(0, 40) + str(k) for k in range(20_000)).encode()
    for most in (100, 4096, 32768):
        text, size, lines = P.sample(data, Sampling(max_bytes=most))
        assert size <= most and lines <= 402 and "�" not in text.split("\n…\n")[0]
        assert text.startswith(data.decode()[:20])
    text, _, lines = P.sample(data, Sampling(max_bytes=10**6))
    parts = text.split("\n…\n")
    assert len(parts) == 3 and parts[0].split("\n") == data.decode().split("\n")[:150] and parts[2].split("\n") == data.decode().split("\n")[-150:-2] and lines == 400  # gaps count as lines
    assert P.sample(b"", Sampling()) == ("", 0, 0) and P.sample(b"a\na\na", Sampling())[0] == "a\na\na\n…\na\n…\na"
    # one very long line is cut, not read on
    assert P.sample(b"x" * 10_000_000, Sampling())[1:] == (32768, 1)


def test_what_is_a_text(spark):
    rows = [
        ("a", ".TXT", None, 5, b"hello"), ("b", "bin", "text/markdown", 5, b"hello"), ("c", "", "text/unknown", 5, b"hello"), ("d", "exe", "application/x", 5, b"hello"), ("e", "txt", None, 10**9, b"hello"),
        ("f", "txt", None, 5, b"he\0lo"), ("g", "log", None, 5, None), ("h", "yml", None, 0, b""), ("i", None, None, 5, b"x"),
    ]
    df = spark.createDataFrame([(p, e, m, s, bytearray(c) if c is not None else None) for p, e, m, s, c in rows], FILES)
    got = {r.path: (r.kind, r.skipped) for r in P.probed(df).collect()}
    assert got == {"a": ("txt", None), "b": ("md", None), "c": ("txt", None), "d": (None, "unsupported"), "e": ("txt", "too_large"), "f": ("txt", "binary"), "g": ("log", "binary"), "h": ("yaml", None), "i": (None, "unsupported")}
    made = P.rows(df, F.lit(dt.datetime(2024, 1, 1)))
    assert sorted(r.path for r in made.collect()) == ["a", "b", "c"]  # an empty text has no preview


def test_schemas_by_kind(spark):
    cases = {"tsv": "a\tb\n1\t2", "json": '{"x": 1, "y": {}}', "ndjson": '{"k": 1}\n{"z": 2}', "yaml": "a: 1\n'b c': 2\n", "md": "a,b", "csv": ""}
    df = spark.createDataFrame(list(cases.items()), "kind string, text string")
    got = {r.kind: r.s and json.loads(r.s) for r in df.select("kind", P.schema_json(F.col("kind"), F.col("text")).alias("s")).collect()}
    assert got == {"tsv": {"csv_headers": ["a", "b"]}, "json": {"json_keys": ["x", "y"]}, "ndjson": {"json_keys": ["k"]}, "yaml": {"yaml_keys": ["a", "b c"]}, "md": None, "csv": None}


def test_summaries():
    text = "Cats sleep. Cats and dogs eat. Nothing here! Dogs run, cats run. A b c. Cats sleep."
    summary, keywords = P.summarised(text, Sampling(keywords=2))
    assert keywords == ["cats", "dogs"] and summary == "Cats sleep. Cats and dogs eat. Nothing here! Dogs run, cats run."
    assert P.summarised("a b. c!", Sampling()) == ("a b. c!", [])


def test_due_and_stored(spark):
    day = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    inventory = spark.createDataFrame([("a", "txt", None, 5, day[0]), ("b", "md", None, 5, day[2]), ("c", "exe", None, 5, day[2]), ("d", "txt", None, 10**9, day[2]), ("e", "csv", None, 1, day[0])], "path string, ext string, mime string, size_bytes long, indexed_utc timestamp_ntz")
    old = spark.createDataFrame([("a", "old", day[1]), ("b", "old", day[1])], "path string, summary string, updated_utc timestamp_ntz")
    assert sorted(r.path for r in P.due(inventory, old).collect()) == ["b", "e"]
    new = spark.createDataFrame([("b", "new", day[2])], old.schema)
    assert sorted((r.path, r.summary) for r in P.stored(old, new).collect()) == [("a", "old"), ("b", "new")]


def test_long_batches_are_read_in_slices(spark, monkeypatch):
    monkeypatch.setattr(P, "AT_A_TIME", 3)
    rows = spark.range(10).coalesce(1).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("word "), F.col("id").cast("string")).cast("binary")).alias("c"))
    got = {r.id: r.p and r.p.text.split("\n")[0] for r in rows.select("id", P.preview(F.col("c")).alias("p")).collect()}
    assert got == {k: f"word {k}" if k % 4 else None for k in range(10)}
