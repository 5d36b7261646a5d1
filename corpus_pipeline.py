"""From raw documents to shuffled shards: quality, near-duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and reads it again as the next stage's documents, after which the one before is removed.

In every stage repeated rows are documents of their own, extra columns of any name go along, an empty table gives no rows, and
texts are taken whole, however long. Ties never depend on the order in which rows arrive.
"""

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import discard, table, written
from skein.llm.decontaminate import decontaminated
from skein.llm.external_shuffle import shard
from skein.llm.mixing_tree import mix
from skein.llm.quality_pu import accepted
from skein.llm.simhash_golay import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. A null or empty text is scored as a text without words; without a positive label all stay."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the least doc_id, null last, then the least hash. Texts without words are one group."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item, edited or not. Null and empty texts stay; so does all if there are no items."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of each source cut to its target. Null and empty texts are never taken.

    The tree's own shards aren't kept: a stage returns the columns of documents, and its quotas hold for any dealing of
    the rows that it takes. The last stage deals them anew into shards of equal counts.
    """
    mixed = mix(docs)
    return mixed.drop(*(mixed[f"`{c}`"] for c in mixed.columns[len(docs.columns) :]))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot, null and empty texts too."""
    return shard(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mixture), ("shard", shards)]

# Hashes, learnt weights and seeded draws are beyond SQL; tests/llm holds each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
