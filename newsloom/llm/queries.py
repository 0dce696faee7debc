"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import common, decontam, divergence, jaccard, oracles, packing, repeats, sanitise, snapshots, token_orc, toxicity, warc

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "documents")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = common.scratch(spark, "token-orc")
    token_orc.write(_documents(spark, sf_dir), target, public_tokenizers.path(WORD_BPE))
    return token_orc.digests(spark, target)


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(_documents(spark, sf_dir))


def op3_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_documents(spark, sf_dir))


def op4_parity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.clusters(_documents(spark, sf_dir), words=3, num=90, den=100)


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = common.scratch(spark, "warc")
    warc.write(common.table(spark, sf_dir, "pages"), target)
    return warc.index(spark, target)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op7_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.render(common.table(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(spark, _documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


def op9_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.report(_documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_orc, op2_divergence, op3_seed_extend, op4_parity_sketch, op5_warc_archive, op6_best_fit_packing, op7_snapshot_collapse, op8_toxicity, op9_sanitise, op10_decontaminate)}

SQL = oracles.SQL
