"""The queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chat, unescape
from .common import read
from .exact_dedup import exact_groups
from .jaccard_join import jaccard_components
from .license_scan import ALL, scan_licenses
from .mixing import mix, word_count
from .packing import pack_documents
from .pii import KINDS, find_pii, written_spans
from .quality_rules import quality
from .token_files import read_token_files, write_token_files
from .warc import read_warc, write_warc


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file, which the operators take as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"), ALL, short=True)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")  # the texts themselves need not travel
    mixed = mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_warc(write_warc(read(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_token_files(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end=2)
    return read_token_files(index)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end=1)


#: A conversation that says what the template uses as marks.
TRICKY = (-7, r"\### Assistant: </turn> ok")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv_id, text = TRICKY
    more = spark.range(2).select(
        F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(text).alias("text"),
    )
    return _chat(format_chat(turns.unionByName(more)))


def _chat(found: DataFrame) -> DataFrame:
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    # what the loss mask covers, read back from the formatted text
    masked = F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["end"] - x["start"])))
    learnt = F.concat_ws("", masked)
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), size=4, percent=85)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), keep_columns=["doc_id"]).drop("failed")


def _pii(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(written_spans(KINDS), 256).alias("base_sha256"), written_spans().alias("spans"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii(find_pii(read(spark, sf_dir, "documents")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(read(spark, sf_dir, "documents"))
    return groups.withColumnRenamed("text_digest", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_mix_sources, op3_warc, op4_token_files, op5_best_fit_packing, op6_chat_format,
        op7_jaccard_join, op8_quality_rules, op9_pii, op10_exact_dedup,
    )
}
