import decimal
import math

import duckdb
import pytest

from skein.plans import catalog, chains, derived, enrich, live, more, stored, views, wide  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return x if isinstance(x, (int, bool)) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_sql(spark, duck, sf_dir, name):
    out = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(out.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in out.collect()), key=str)
    if name not in catalog.SQL:
        assert got
        return
    rel = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({catalog.SQL[name]})")
    want = sorted((tuple(map(plain, r)) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for column, a, b in zip(columns, g, w):
            assert a == b or isinstance(a, float) and isinstance(b, (int, float)) and a == pytest.approx(b, abs=1e-5), (column, g, w)


def test_entry_module_covers_the_catalog():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_head_tail_signature(spark):
    from pyspark.sql import functions as F

    from skein.operators import views

    data = [bytes(range(256)) * 9 + b"xyz", b"", b"12345678", b"abc"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(data)], "k int, content binary")
    got = {r.k: r.s for r in rows.select("k", views.head_tail_signature(F.col("content"), 64).alias("s")).collect()}
    words = lambda b: sum(int.from_bytes(b[i : i + 8], "little") for i in range(0, len(b), 8))
    assert got == {k: f"{(len(x) + words(x[:64]) + words(x[-64:])) % 2**64:016x}" for k, x in enumerate(data)}


def test_summaries(spark):
    from skein.operators import search

    docs = spark.createDataFrame([(1, "One two three. Four five six! Seven."), (2, None), (3, "")], "k int, t string")
    got = {r.k: r.summary for r in search.lead_summary(docs, "k", "t", 20).collect()}
    assert got == {1: "One two three. Four five six!"}
    best = search.best_sentences(spark.createDataFrame([(1, "alpha beta. alpha alpha gamma. zz.")], "k int, t string"), "k", "t", 1).collect()
    assert [r.sentence for r in best] == ["alpha alpha gamma."]


def test_writers(spark, tmp_path):
    from skein.sources import readers, writers

    df = spark.createDataFrame([("a", 1.5, True), (None, 2.0, False), ("", None, None)], "path string, seconds double, flag boolean")
    assert [tuple(r) for r in writers.export_row(df).collect()] == [("a", "1.5", "1"), ("", "2", "0"), ("", "", "")]
    writers.write_csv(df, f"file://{tmp_path}/csv")
    writers.write_playlist(df.withColumnRenamed("flag", "title"), f"file://{tmp_path}/m3u")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/m3u").collect()] == ["a"]
    assert writers.write_sections({"x": df, "none": df.where("false")}, f"file://{tmp_path}/s", "json") == ["x"]
    manifest = writers.write_snapshot(df, f"file://{tmp_path}/snap").collect()
    assert manifest and all(len(r.sha256) == 64 for r in manifest)
    assert readers.listing(spark, f"file://{tmp_path}/snap").count() >= len(manifest)
    (tmp_path / "log.jsonl").write_text('{"level": "warn"}\n\nbroken\n{"level": "error"}\n')
    assert sorted(r.level for r in readers.json_lines(spark, f"file://{tmp_path}/log.jsonl", "level string").collect()) == ["error", "warn"]
