"""Stemmer, text index, resumable scans, files by ranges."""

import datetime as dt
import math
import random
import struct
import unicodedata
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.functions import stems
from skein.operators import index as I
from skein.operators import scan
from skein.operators.index import TextIndex
from skein.plans import stored
from skein.sources import files

PORTER = """caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat sized:size hopping:hop
falling:fall hissing:hiss failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration digitizer:digit vietnamization:vietnam operator:oper
hopefulness:hope sensibiliti:sensibl triplicate:triplic formative:form electrical:electr goodness:good allowance:allow airliner:airlin adjustable:adjust replacement:replac
adoption:adopt communism:commun activate:activ effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll as:as"""


def test_stems_of_known_words():
    assert {w: stems.stem(w) for w, _ in (p.split(":") for p in PORTER.split())} == dict(p.split(":") for p in PORTER.split())
    assert stems.terms("Die Übergänge, running 2nd_time naïve") == ["die", "ubergang", "run", "2nd", "time", "naiv"] and stems.terms(None) == []
    assert stems.stem("x" * 60 + "ness") == "x" * 60 + "ness"


def test_stems_in_sql_are_the_same():
    rng = random.Random(2)
    ends = "s ed ing ational ness ies ement ion tion e ll y yy eed ize logi bli".split()
    words = sorted({"".join(rng.choices("aeiouybdlnstzrmgv", k=rng.randint(1, 9))) + rng.choice(["", *ends]) for _ in range(3000)})
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"word": words}))
    assert dict(con.sql(f"WITH {stored.stemmed('t')} SELECT word, term FROM stems").fetchall()) == {w: stems.stem(w) for w in words}


def bm25(docs, phrases):
    held = {p: stems.terms(t) for p, t in docs.items()}
    mean = sum(map(len, held.values())) / len(held)
    hits = []
    for phrase in phrases:
        if phrase.endswith("*"):
            begin = stems.folded(phrase[:-1])
            hits.append({p: n for p, ts in held.items() if (n := sum(t.startswith(begin) for t in ts))})
        else:
            words = stems.terms(phrase)
            hits.append({p: n for p, ts in held.items() if (n := sum(ts[k : k + len(words)] == words for k in range(len(ts)))) and words})
    out = {}
    for p in set.intersection(*map(set, hits)):
        out[p] = sum(max(1e-6, math.log((len(docs) - len(h) + 0.5) / (len(h) + 0.5))) * h[p] * 2.2 / (h[p] + 1.2 * (0.25 + 0.75 * len(held[p]) / mean)) for h in hits)
    return out


def test_index_against_plain_loops(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = "run running runs the of cat cats catalog Äpfel apfel hopping hope".split()
    text = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))
    docs = {f"p{k}": text() for k in range(80)}
    index = TextIndex(spark, f"file://{tmp_path}/i", 4)
    put = lambda rows, n: index.write(spark.createDataFrame(list(rows.items()), "path string, text string"), n)
    put(docs, 0)
    searches = [("running",), ("the of", "hope"), ("cat*",), ("of the of",), ("apfel", "the"), ("...",), ("the", "the of")]

    def check():
        for s in searches:
            got = {r.path: r.score for r in index.search(*s).collect()}
            assert got == pytest.approx(bm25(docs, s)), s

    check()
    changed = {f"p{k}": text() for k in range(20, 100, 3)}
    put({**changed, "p1": None, "missing": None}, 1)
    docs |= changed
    del docs["p1"]
    check()
    put({"p2": ""}, 1)  # the segment is written again: it replaces itself
    put({**changed, "p1": None, "p2": ""}, 1)
    docs["p2"] = ""
    check()
    index.merged(2, 0, 1)
    check()
    table = spark.createDataFrame([(p, len(t or "")) for p, t in docs.items()], "path string, n int")
    pages = [index.page(table, "running", limit=5, offset=o).collect() for o in (0, 5)]
    best = sorted(bm25(docs, ("running",)).items(), key=lambda x: (-x[1], x[0]))
    assert [r.path for p in pages for r in p] == [p for p, _ in best[:10]] and {r.total for p in pages for r in p} == {len(best)}


def test_index_is_written_and_merged_without_shuffling_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BROADCAST_ROWS", 60)
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    docs = {f"p{k}": " ".join(rng.choices(words, k=300)) for k in range(400)}
    frame = lambda rows: spark.createDataFrame(rows, "path string, text string")

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getPath(): f.length() for f in (files.apply(k) for k in range(files.size())) if f.getName().startswith("shuffle_")}

    index, before = TextIndex(spark, f"file://{tmp_path}/i", 4), shuffled()
    index.write(frame(list(docs.items())), 0)
    changed = {f"p{k}": " ".join(rng.choices(words, k=200)) for k in range(0, 500, 3)}
    index.write(frame([*changed.items(), ("p1", None)]), 1)
    index.merged(2, 0, 1)
    room = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert sum(n for f, n in shuffled().items() if f not in before) < room / 10
    docs = {p: t for p, t in (docs | changed).items() if p != "p1"}
    got = spark.read.schema(I.SEGMENT).parquet(f"file://{tmp_path}/i/postings").where("segment = 2").select("path", "term", "places").collect()
    assert sorted((r.path, k, r.term) for r in got for k in r.places) == sorted((p, k, w) for p, t in docs.items() for k, w in enumerate(stems.terms(t)))
    # a page's plan doesn't hold that of its search time and again
    assert index.page(frame(list(docs.items())), words[0], words[1])._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
    assert len(got) == len({(r.path, r.term) for r in got}) and {(r.path, r.segment, r.length) for r in index.documents().collect()} == {(p, 2, len(t.split())) for p, t in docs.items()}


def test_path_twice_in_a_segment_keeps_the_least_text(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i", 4)
    index.write(spark.createDataFrame([("a", "two words"), ("a", "one"), ("b", None), ("b", "of three words"), ("c", None), (None, "no path")], "path string, text string"), 0)
    assert {(r.path, r.length) for r in index.documents().collect()} == {("a", 1), ("b", 3)}


def test_shares_of_a_merge(monkeypatch):
    monkeypatch.setattr(I, "BROADCAST_ROWS", 10)
    assert I._shares({}) == []
    assert I._shares({3: 4, 0: 6, 1: 25, 2: 5, 4: 2}) == [([0], 0, 1), ([1], 0, 3), ([1], 1, 3), ([1], 2, 3), ([2, 3], 0, 1), ([4], 0, 1)]


FILES = "id long, path string, size_bytes long, mtime_utc timestamp_ntz, hash string, deleted boolean, deleted_ts timestamp_ntz, media string"
LISTED = "path string, size_bytes long, mtime_utc timestamp_ntz"
DAY = dt.datetime(2024, 1, 1)


def drive():
    stored_rows = [(k + 1, f"Dir/é{k}", k, DAY, f"h{k}", k % 5 == 0, DAY if k % 5 == 0 else None, "m") for k in range(0, 40)]
    listed = [(unicodedata.normalize("NFD", f"dir/É{k}"), k + (k % 3 == 0), DAY) for k in range(10, 60)] + [("dir/twice", 1, DAY), ("DIR/twice", 2, DAY), (None, 1, DAY)]
    return stored_rows, listed


def test_scan_cut_and_resumed_equals_an_uncut_one(spark, tmp_path):
    stored_rows, listed = drive()
    a, b = spark.createDataFrame(stored_rows, FILES), spark.createDataFrame(listed, LISTED)
    asked = []

    def contents(todo):
        rows = todo.collect()
        asked.append([r.key for r in rows])
        return spark.createDataFrame([(r.key, f"new {r.key}") for r in rows if r.key != "dir/é55"], "key string, hash string")

    now = F.lit("2024-05-05").cast("timestamp_ntz")
    whole = scan.Scan(spark, f"file://{tmp_path}/whole", contents, 7, True).run(a, b, now)
    once, asked[:] = [k for c in asked for k in c], []
    cut = scan.Scan(spark, f"file://{tmp_path}/cut", contents, 7, True)
    assert cut.run(a, b, now, stop_after=2) is None and len(asked) == 2
    assert cut.run(a, b, now, stop_after=1) is None
    again = cut.run(a, b, now)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert [k for c in asked for k in c] == once  # nothing is read twice
    rows = {r.path: r for r in whole.collect()}
    assert Counter(r.status for r in rows.values()) == {"unchanged": 16, "changed": 8, "restored": 6, "deleted": 8, "gone": 2, "new": 21}
    unchanged = {unicodedata.normalize("NFC", f"dir/é{k}") for k in range(10, 40) if k % 3 and k % 5}
    assert not unchanged & set(once) and len(once) == 35
    assert rows["Dir/é11"].hash == "h11" and rows["Dir/é12"].hash == "new dir/é12" and rows["Dir/é12"].id == 13 and rows["Dir/é12"].media == "m"
    assert sorted(r.id for r in rows.values() if r.status == "new") == list(range(41, 62)) and rows["dir/twice"].status == "new"
    assert next(r.hash for p, r in rows.items() if p.endswith("55")) is None
    assert rows["Dir/é1"].deleted and rows["Dir/é1"].deleted_ts == dt.datetime(2024, 5, 5) and rows["Dir/é0"].deleted_ts == DAY and not rows["Dir/é15"].deleted


def test_scan_of_nothing(spark, tmp_path):
    a, b = spark.createDataFrame([], FILES), spark.createDataFrame([], LISTED)
    out = scan.Scan(spark, f"file://{tmp_path}/none", lambda t: t.select("key", F.lit("x").alias("hash"))).run(a, b, F.lit(DAY))
    assert out.columns == [*a.columns, "status"] and out.count() == 0


def test_digests_do_not_depend_on_the_ranges(spark, tmp_path):
    rng = random.Random(1)
    sizes = [0, 1, 7, 8, 9, 1000, 4096, 100_003]
    contents = {f"{tmp_path}/f{k}": rng.randbytes(n) for k, n in enumerate(sizes)}
    for path, data in contents.items():
        with open(path, "wb") as f:
            f.write(data)
    listing = spark.createDataFrame([(p, len(c)) for p, c in contents.items()] + [(f"{tmp_path}/gone", 5), (f"{tmp_path}/f1", 1), (None, 3)], "path string, size long")
    found = [{r.path: r.digest for r in files.file_digests(listing, n).collect()} for n in (1000, 333, 1 << 20)]
    assert found[0] == found[1] == found[2] and found[0][f"{tmp_path}/gone"] is None and len(found[0]) == len(sizes) + 1
    held = spark.createDataFrame([(p, bytearray(c)) for p, c in contents.items()], "k string, c binary")
    assert {r.path: r.digest for r in files.content_digests(held, "k", "c", 777).collect()} == {p: found[0][p] for p in contents}
    p, base = files.PRIMES[1], files.BASES[1]
    data = contents[f"{tmp_path}/f5"]
    assert found[0][f"{tmp_path}/f5"][8:16] == f"{sum((b + 1) * pow(base, k, p) for k, b in enumerate(data)) % p:08x}"
    short = files.file_digests(spark.createDataFrame([(f"{tmp_path}/f5", 1001)], "path string, size long"), 400).first()
    assert short.digest is None and "1000" in short.error


def test_head_tail_signatures_of_files(spark, tmp_path):
    rng = random.Random(2)

    def brute(data, block):
        total = lambda part: sum(struct.unpack("<Q", part[k : k + 8].ljust(8, b"\0"))[0] for k in range(0, len(part), 8))
        head, tail = (data, data) if len(data) <= block else (data[:block], data[-block:])
        return f"{(len(data) + total(head) + total(tail)) % 2**64:016x}"

    contents = {f"{tmp_path}/s{n}": rng.randbytes(n) for n in (0, 5, 64, 65, 127, 1000)}
    for path, data in contents.items():
        with open(path, "wb") as f:
            f.write(data)
    rows = spark.createDataFrame([(p, len(c)) for p, c in contents.items()] + [(f"{tmp_path}/gone", 9)], "path string, size long")
    got = {r.path: r.signature for r in files.head_tail_signatures(rows, 64).collect()}
    assert got == {p: brute(c, 64) for p, c in contents.items()} | {f"{tmp_path}/gone": None}


def test_scores_that_read_alike_are_ties(spark, tmp_path):
    docs = {f"p{k}": "the " * (9 - k) + "cat " * k for k in range(9)}
    index = TextIndex(spark, f"file://{tmp_path}/i", 4)
    table = spark.createDataFrame(list(docs.items()), "path string, text string")
    index.write(table, 0)
    rounded = {p: round(s, 6) for p, s in bm25(docs, ("the",)).items()}
    want = sorted(rounded.items(), key=lambda x: (-x[1], x[0]))
    got = [(r.path, r.score) for r in index.page(table, "the", limit=9, digits=6).collect()]
    assert got == want and len(set(rounded.values())) < len(rounded)
    exact = [r.path for r in index.page(table.where("path <> 'p0'"), "the").collect()]
    assert exact == [p for p, _ in sorted(bm25(docs, ("the",)).items(), key=lambda x: (-x[1], x[0])) if p != "p0"]
