"""The corpus pipeline: language ID, exact dedup, near dedup, mixing and packing of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of docs, the last one packed pieces. ``run``
writes each stage's rows as Parquet in the shared checkpoint folder and rereads them for the next.

Cases hold as each operator states them; further columns pass through untouched, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kifu_spark.llm import exact_dedup, langid, mixing, packing, simhash
from kifu_spark.llm.queries import BYTE_BPE, remainder
from kifu_spark.session import ship_package, stored

#: SQL cannot express the language model, near-duplicate components or packing; tests hold the rows against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined or a guess go; the model learns from the rows that are not held out."""
    ship_package(spark)
    return langid.keep_known_languages(docs, remainder(5, 0))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest identifier stays."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the smallest identifier stays."""
    ship_package(spark)
    return simhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and offset."""
    ship_package(spark)
    return packing.pack_documents(docs, BYTE_BPE)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
