"""Subtitles against plots."""

import pytest
from pyspark.sql import functions as F

from skein.operators import verification as V

SRT = "1\n00:00:01,000 --> 00:00:02,500\n<i>Neo meets Morpheus.</i>\n\n2\n00:00:03,000 --> 00:00:04,000\n{\\an8}Trinity   runs.\n\n"
SUBS = "key string, video string, name string, content string"


def test_ranking(spark):
    rows = [("k", "dir/Film.mkv", n, "x") for n in ("Other.srt", "Film.srt", "film.en.srt", "Film.de.srt", "a.en.vtt", "Film.txt")]
    out = sorted(V.ranked_subtitles(spark.createDataFrame(rows, SUBS)).collect(), key=lambda r: r.place)
    assert [(r.name, r.points) for r in out] == [("Film.srt", 8), ("film.en.srt", 5), ("Film.de.srt", 3), ("a.en.vtt", 2), ("Other.srt", 0)]


def test_spoken_lines(spark):
    ass = "[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,Hello, {\\b1}world\nWEBVTT\n00:01.000 --> 00:02.000 align:start\n12\n 12 monkeys \n"
    df = spark.createDataFrame([(SRT,), (ass,), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(V.spoken(F.col("c"))).collect()] == [["Neo meets Morpheus.", "Trinity runs."], ["[Events]", "Hello, world", "12 monkeys"], [], None]


@pytest.mark.parametrize("n", [0, 5, 150, 151, 300, 301, 477, 1500])
def test_samples(spark, n):
    lines = [f"l{k}" for k in range(n)]
    got = spark.createDataFrame([(lines,)], "x array<string>").select(V.sampled(F.col("x"))).first()[0].split()
    tail = lines[-150:] if n > 150 else []
    between = lines[150 : n - len(tail)]
    step = max(1, len(between) // 100)
    assert got == (lines[:150] + between[::step][:100] + tail)[:400]


def test_entities(spark):
    df = spark.createDataFrame([("The Matrix. Neo and Agent Smith run; Él sees NY. This is it, O'Brien-Jones",), (None,)], "t string")
    assert [r[0] for r in df.select(V.entities(F.col("t"))).collect()] == [["agent smith", "neo", "o'brien-jones", "the matrix"], []]


def test_chain_to_boosts_and_flags(spark):
    story = "Neo meets Morpheus in the Matrix. Trinity runs from Agent Smith. The machines attack Zion. Neo fights Agent Smith again."
    as_srt = lambda t: "\n\n".join(f"{k}\n00:00:0{k},000 --> 00:00:0{k},500\n{s}." for k, s in enumerate(t.rstrip(".").split(". "), 1))
    subs = [("same", "same.mkv", "same.srt", as_srt(story)), ("same", "same.mkv", "zz.srt", "1\n"), ("far", "far.mkv", "far.srt", as_srt("Bread rises slowly. Knead dough with salt. Bake until golden.")), ("nosubs", "n.mkv", "n.txt", story), ("noplot", "p.mkv", "p.srt", as_srt(story)), ("blank", "b.mkv", "b.srt", "1\n00:00:01,000 --> 00:00:02,000\n")]
    items = spark.createDataFrame([(k,) for k in ("same", "far", "nosubs", "noplot", "blank", "same")], "key string")
    plots = spark.createDataFrame([("same", story), ("far", story), ("nosubs", story), ("noplot", " "), ("blank", story), ("else", story)], "key string, plot string")
    found = V.compared(items, spark.createDataFrame(subs, SUBS), plots)
    got = {r.key: r for r in found.collect()}
    assert set(got) == {"same", "far"} and got["same"].name == "same.srt" and got["same"].lines == 4
    assert got["same"].match == pytest.approx(1.0) and got["same"].action == "boost" and got["far"].action == "flag" and got["far"].entities == 0
    assert got["far"].match == pytest.approx(0.55 * got["far"].semantic + 0.2 * got["far"].words)
    profiles = spark.createDataFrame([("same", 0.9), ("far", 0.3), ("other", 0.2)], "key string, confidence double")
    queue = spark.createDataFrame([("same", 0.4, ["low"]), ("other", 0.2, ["x"])], "key string, confidence double, reasons array<string>")
    p, q = V.written_back(profiles, queue, found)
    assert {r.key: round(r.confidence, 6) for r in p.collect()} == {"same": 1.0, "far": 0.3, "other": 0.2}
    assert {r.key: (r.confidence and round(r.confidence, 6), r.reasons) for r in q.collect()} == {"same": (0.55, ["low"]), "other": (0.2, ["x"]), "far": (None, [V.REASON])}


def test_texts_are_summed_up_once(spark):
    items = spark.createDataFrame([(1,)], "key int")
    subtitles = spark.createDataFrame([(1, "v.mkv", "v.en.srt", "1\n00:00:01,000 --> 00:00:02,000\nThe Old Town sleeps.")], "key int, video string, name string, content string")
    plots = spark.createDataFrame([(1, "The Old Town sleeps.")], "key int, plot string")
    found = V.compared(items, subtitles, plots)
    assert "EvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.key, r.action) for r in found.collect()] == [(1, "boost")]
