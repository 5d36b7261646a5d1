import corpus_pipeline as P
from skein.llm import decontaminate, simhash_golay
from skein.llm.common import table


def test_stages_keep_their_contracts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:3]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == columns
        after = P.written(after, name)
        assert 0 < after.count() <= before and after.join(docs, "doc_id", "left_anti").count() == 0
        docs, before = after, after.count()
    assert decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).count() == 0
    groups = simhash_golay.near_duplicates(docs)
    assert groups.where("doc_id <> component_id").count() == 0
    mixed = P.written(P.mixture(spark, docs, sf_dir), "mix")
    assert mixed.columns == columns
    last = P.shards(spark, mixed, sf_dir)
    assert last.count() == mixed.count() and last.columns == [*columns, "shard", "slot"]


def test_run_on_rows_with_gaps(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", None, 0), (5, None, "en", "s", 0)], docs.schema)
    where = f"file://{tmp_path}/t"
    docs.union(odd).write.parquet(f"{where}/documents.parquet")
    for t in ("labels", "benchmark"):
        table(spark, sf_dir, t).write.parquet(f"{where}/{t}.parquet")
    assert P.run(spark, where).count() > 0
    for t in ("documents", "labels", "benchmark"):
        table(spark, sf_dir, t).where("false").write.parquet(f"{where}-empty/{t}.parquet")
    assert P.run(spark, f"{where}-empty").count() == 0
