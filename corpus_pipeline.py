"""Five operators in a row over ``documents``: what a training run would read.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes each result as Parquet in the
shared folder and reads it again as the next stage's ``docs``. A stage's files are removed once the stage after it is written.

Defined cases: null, empty and very short texts fail the quality rules and go; null ids, languages and sources stay; of repeated rows, as
of near copies, one stays; mixing may return a document twice, and parts of it; an empty table gives an empty result; columns that
``documents`` has besides its own stay with their rows until the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import bpe, mixing, pii, quality, simhash
from tidewell.llm.common import new_dir, remove_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, public_tokenizers.path(bpe.VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("personal data", personal_data),
    ("mixing", mixing_sources),
    ("tokens", tokens),
]
#: Fingerprints, permutations and merges are not SQL; a test holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = new_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_dir(spark, before)
        before = path
    return docs
