"""The queries of this subpackage, by the names under which they are registered."""

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid_unigram, log_templates, mixing_tree, prefix_hashes, prefix_trie, quality_pu, toxicity_channel, whitening
from .common import table, written
from .external_shuffle import digests
from .ogg_media import read, store
from .simhash_golay import near_duplicates
from .token_repair import token_positions


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_positions(table(spark, sf_dir, "documents"))


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def op4_langid_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_unigram.predictions(table(spark, sf_dir, "documents"))


def op5_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_tree.digests(table(spark, sf_dir, "documents"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(written(store(table(spark, sf_dir, "documents")), "media"))


def op7_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_templates.digests(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_channel.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hashes.compared(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_repair": op2_token_repair,
    "op3_external_shuffle": op3_external_shuffle,
    "op4_langid_unigram": op4_langid_unigram,
    "op5_mixing_tree": op5_mixing_tree,
    "op6_ogg_media": op6_ogg_media,
    "op7_log_templates": op7_log_templates,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity_channel": op9_toxicity_channel,
    "op10_quality_pu": op10_quality_pu,
    "op11_prefix_hashes": op11_prefix_hashes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}

SQL = {"op7_log_templates": log_templates.SQL, "op11_prefix_hashes": prefix_hashes.SQL, "op12_prefix_trie": prefix_trie.SQL}
