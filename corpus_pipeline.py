"""The corpus pipeline: five stages over documents, each written and read again before the next.

Quality rules drop what they reject; of each near-duplicate class one document
stays; personal data is redacted; the mix takes documents of each source towards
its target; the last stage encodes and decodes what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import byte_bpe, cube_mix, pii_boost, quality_rules, simhash_dedup
from corpusloom.llm.common import delete, scratch, scratch_path, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that a quality rule rejects: null and empty texts go, long ones count whole, repeated rows stay as often; columns as they were, whatever their names; an empty table stays empty."""
    return quality_rules.keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the smallest doc_id; of rows that repeat it one, of classes of null ids one. Null, empty and blank texts are one class, long ones count whole; columns as they were, whatever their names; an empty table stays empty."""
    return simhash_dedup.keep_one(docs, threshold=4)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data in text replaced and n_chars set anew: null and empty texts stay, long ones are read whole, repeated rows are redacted alike; columns keep their names, whatever these are; an empty table stays empty."""
    return pii_boost.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes each row, at most twice: repeated rows are taken each, and of ties by a hash; null and empty texts count no words, long ones count whole; columns as they were, whatever their names; an empty table stays empty."""
    return cube_mix.take_mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the bytes decoded from them, for each row: null texts as empty ones, long ones whole, repeated rows each; other columns go; an empty table gives an empty one."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("pii", pii), ("mix_sources", mix), ("byte_bpe", bpe)]

#: Fingerprints by XXH64, balanced sampling and byte-pair encoding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the whole table `documents`; the rows of the last.

    Null, empty and long texts, repeated rows, extra columns of any name and empty
    tables pass as the stages say. What a stage has used is deleted once its rows are written, and its input once the
    next stage's rows are: only the last stage's stay, until common.release.
    """
    docs, former = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if former:
            delete(spark, former)
        former = path
    return docs
