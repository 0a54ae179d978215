"""Corpus pipeline: documents to packed training sequences.

Language ID rejects texts without a language, exact and near duplicates leave one document each, sources are mixed to
their target weights, and what is left is packed. Each stage takes all rows that the stage before it kept and returns
the columns of ``documents``, the last one the packed pieces. A document drawn several times stands there several times
under its id; a document cut at a block's edge keeps its id with the shorter text.

An empty table passes through all stages as an empty one.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.llm import exact_dedup, language_id, minhash, mixing, packing
from urbanloom.llm.blocks import fresh
from urbanloom.scale import round_table, ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter."""
    names = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    learn = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    found = language_id.identify(docs, language_id.fit(learn, "text", "lang", "doc_id"), names=names)
    return found.where(F.col(names[0]) != language_id.UNDETERMINED).drop(*names)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return exact_dedup.deduplicate(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    return minhash.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of sources takes them."""
    return mixing.draw(docs, carry=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER_FILE)).drop("ids")


def _shipped(stage):
    """The stage, with this package on the workers."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language ID", _shipped(language)), ("exact dedup", _shipped(exact)), ("near-dedup", _shipped(near)),
    ("mixing", _shipped(mixed)), ("packing", _shipped(packed)),
]

#: Learned and hashed stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``. Stages are written to the shared folder, so a lost executor costs one stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = round_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
