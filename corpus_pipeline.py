"""A corpus pipeline over ``documents``: rules, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Between stages :func:`run` writes and rereads Parquet in the shared
folder, so that a stage starts from files, whatever becomes of executors.

Null and empty texts fail the rules; very long texts are judged, compared and encoded whole; of rows that
repeat a text one stays; an empty table gives an empty result; further columns go along as they are, also
those that are named like a result of an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomlake.llm.common import Scratch
from fathomlake.llm.exact_dedup import exact_dedup
from fathomlake.llm.jaccard_join import near_dedup
from fathomlake.llm.mixing import mixed_rows
from fathomlake.llm.packing import pack_documents
from fathomlake.llm.quality_rules import keep
from fathomlake.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that satisfy the base and the threshold table."""
    return keep(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links (five-word shingles, Jaccard 0.8) the one with the smallest id."""
    return near_dedup(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands as often as the mix takes it."""
    return mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, as pieces with their places."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"), end=1, words=60_000)  # workers live on in other stages


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: Near copies and tokens are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
