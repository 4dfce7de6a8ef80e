"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

quality    rejected documents go (rule ensemble)
near       one document of each component of near copies stays (MinHash, five words, 0.8)
substrings words of repeated 35-word windows go; a document keeps its row
mixing     each document as often as the mix takes it, 0 to 3 times, rounded to whole documents
bpe        ids of what is left
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folium.llm import bpe, mixing, near, quality, substrings
from folium.llm.common import table, working_folder, written


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_first(docs)


def _substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_stage(docs)


STAGES = [("quality", _quality), ("near", _near), ("substrings", _substrings), ("mixing", _mixing), ("bpe", _bpe)]
#: Neither learned rules nor near-duplicate components can be written as SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = working_folder(spark)
    docs = table(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, folder, name)
    return docs
