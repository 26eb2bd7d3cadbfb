"""The queries of this subpackage, one for each operator, and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from exposure.llm import balltree, bytecnn, bytepairs, hyperminhash, langid, lines, manifest, mixing, packing, pii, pitmanyor, suffixes, webp
from exposure.llm.oracles import ORACLES  # noqa: F401


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select(*columns) if columns else table


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_quality(documents(spark, sf_dir, "doc_id", "text", "source"))


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text")).drop("row", "label")


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score_texts(documents(spark, sf_dir, "doc_id", "text"))


def op3_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return pii.tag(docs, pii.learned(docs))


def op4_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.read_back(webp.stored(documents(spark, sf_dir, "doc_id", "text")))


def op5_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op7_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(documents(spark, sf_dir))


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.quality(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.ranked(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_rank_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.token_counts(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_struct_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_frequency,
        op2_pitman_yor,
        op3_skip_chain,
        op4_lossless_webp,
        op5_bin_slack,
        op6_hyperminhash,
        op7_compression,
        op8_suffixes,
        op9_poisson_mix,
        op10_byte_cnn,
        op11_ball_tree,
        op12_rank_merging,
        op13_struct_rollup,
    )
}


