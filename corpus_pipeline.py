"""The corpus pipeline: quality rules, near-dedup, repeated strings, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes what a
stage returns to the shared folder and reads it back for the next, so an executor that is lost costs no more
than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlework.llm import mixing, packing, quality, simhash, suffix
from candlework.llm.common import read, spool


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.clean_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL has these stages (tokenizers, SimHash trees, byte strings); tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), name)
    return docs
