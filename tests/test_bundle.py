"""Bundles: round trips, damage, two phases."""

import json
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skein.sources import bundle as B

SCHEMA = "k long, text string, n double"


def frame(spark, n=500):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, "", 'quo"ted, text', "two\nlines", "é😀 <&>", f"plain {k}"]), rng.choice([None, 0.5, -3.0])) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def test_json_lines_and_csv_come_back(spark, tmp_path):
    df, rows = frame(spark)
    for kind in ("jsonl", "csv"):
        where = f"file://{tmp_path}/{kind}"
        B.write_bundle(df, where, kind)
        got = sorted(map(tuple, B.read_bundle(spark, where, SCHEMA).collect()))
        want = [(k, t or None if kind == "csv" else t, n) for k, t, n in rows]
        assert got == sorted(want, key=lambda r: r[0])
        about = B.manifest(where)
        assert about["kind"] == kind and sum(f["rows"] for f in about["files"]) == 500 and len(about["files"]) == 3
        assert sorted(x for x in os.listdir(f"{tmp_path}/{kind}") if not x.startswith(".")) == sorted(["manifest.json", *(f["path"] for f in about["files"])])
    with open(f"{tmp_path}/csv/part-00000.csv", "rb") as f:
        assert f.read(13) == b"\xef\xbb\xbfk,text,n\r\n"


def test_zipped_xml(spark, tmp_path):
    rows = [("A & B", 1), ("A & B", 2), ("", 3), (None, 4), ("<é>", None)]
    B.write_bundle(spark.createDataFrame(rows, "title string, year int").coalesce(1), f"file://{tmp_path}/z", "nfozip", root="movie")
    got = {r.entry: r.content for r in B.read_bundle(spark, f"file://{tmp_path}/z", "entry string, content string").collect()}
    assert set(got) == {"movies/A___B.nfo", "movies/A___B-2.nfo", "movies/item.nfo", "movies/item-2.nfo", "movies/_é_.nfo"}
    assert "<title>A &amp; B</title><year>2</year>" in got["movies/A___B-2.nfo"] and "<movie><title>&lt;é&gt;</title></movie>" in got["movies/_é_.nfo"]


def test_damage_is_named_and_refused(spark, tmp_path):
    where = f"{tmp_path}/b"
    rng = random.Random(5)
    df = spark.createDataFrame([(k, "".join(rng.choices("abcdef", k=100))) for k in range(4000)], "k long, text string").repartition(2)
    B.write_bundle(df, f"file://{where}")
    assert B.checked(spark, f"file://{where}").where("damage is null").count() == 2
    path = f"{where}/part-00001.jsonl"
    with open(path, "rb") as f:
        whole = f.read()
    assert len(whole) > 3 * B.BLOCK

    def damaged(data):
        with open(path, "wb") as f:
            f.write(data)
        return {r.path: (r.damage, r.offset) for r in B.checked(spark, f"file://{where}").collect()}["part-00001.jsonl"]

    for at in (0, 70_000, len(whole) - 1):
        assert damaged(whole[:at] + bytes([whole[at] ^ 0x21]) + whole[at + 1 :]) == ("content", at)
    with pytest.raises(ValueError, match=rf"part-00001.jsonl: content at byte {len(whole) - 1}$"):
        B.read_bundle(spark, f"file://{where}", "k long, text string")
    assert damaged(whole[:70_000] + b"xx" + whole[70_002:]) == ("content", B.BLOCK)
    assert damaged(whole[:-5]) == ("size", len(whole) - 5)
    os.rename(path, f"{where}/aside")
    with pytest.raises(ValueError, match="part-00001.jsonl: missing"):
        B.read_bundle(spark, f"file://{where}", "k long, text string")
    os.rename(f"{where}/manifest.json", f"{where}/no.json")
    with pytest.raises(ValueError, match="no manifest"):
        B.read_bundle(spark, f"file://{where}", "k long, text string")


def test_a_failed_write_leaves_no_bundle(spark, tmp_path):
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).alias("k"))
    with pytest.raises(Exception, match="broken row"):
        B.write_bundle(bad, f"file://{tmp_path}/f")
    assert not os.path.exists(f"{tmp_path}/f/manifest.json") and not [x for x in os.listdir(tmp_path) if x == "f" and any(p.startswith("part") for p in os.listdir(f"{tmp_path}/f"))]
    with pytest.raises(Exception, match="unsupported export format"):
        B.write_bundle(spark.range(3), f"file://{tmp_path}/g", "tar")


def test_an_empty_table_is_a_bundle(spark, tmp_path):
    B.write_bundle(spark.range(0), f"file://{tmp_path}/e")
    with open(f"{tmp_path}/e/manifest.json") as f:
        assert json.load(f)["files"] == []
    assert B.read_bundle(spark, f"file://{tmp_path}/e", "id long").count() == 0


def test_single_bytes_are_found_by_their_checksum():
    rng = random.Random(7)
    block = rng.randbytes(3000)
    for at in (0, 1234, 2999):
        wrong = block[:at] + bytes([block[at] ^ 5]) + block[at + 1 :]
        assert (at, block[at]) in B.damaged_byte(wrong, zlib.crc32(block))


def test_entries_of_many_tasks_with_empty_values(spark, tmp_path):
    from skein.plans import stored

    spark.createDataFrame([(k, f"C#{k:03}", "" if k % 3 == 0 else " a<b ") for k in range(60)], "c_custkey long, c_name string, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = stored.bundle_entries(spark, str(tmp_path))
    assert sorted(map(tuple, made.collect())) == [(f"customers/C_{k:03}.nfo", str(k), "" if k % 3 == 0 else " a<b ") for k in range(60)]
