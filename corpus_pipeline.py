"""Five-stage corpus preparation over ``documents``.

language ID -> exact dedup -> near dedup -> mixing -> BPE. Each stage takes and,
but for the last, returns the columns of ``documents``; each is written as Parquet
and reread as the next one's input, so a lost executor costs at most one stage's
tasks. The last stage adds place, tokens, n_tokens and exact to the documents of the
mix: the mix's Parquet files hold its order, ``place`` is a document's rank in it, and
the result comes in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact, lang, mixing, near
from tessera.sources.work import fresh, spread, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identifiable language; the others go."""
    return lang.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the least id."""
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id."""
    return near.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix to tempered source weights, in its order."""
    return mixing.mixed_documents(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their tokens and their place in the stored order of ``docs``, in that order."""
    place = fresh("place", docs.columns)
    rows, end = mixing.numbered(docs, place)
    return bpe.encode_documents(rows, arranged=lambda joined: mixing.in_order(joined, place, end))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", encode_text),
]

#: language scores, MinHash groups and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
