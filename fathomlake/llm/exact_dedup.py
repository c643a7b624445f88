"""Exact dedup by skew-safe combining.

Rows are combined three times, and every time two rows are one group only if their whole texts
are equal; the digest merely deals them out:

1. locally: each task merges the equal texts it reads, before anything is shuffled;
2. by (digest, salt): a text that very many tasks hold meets in as many places as there are
   salts, a bounded share of it in each;
3. by digest: one row per salt is left of each text, and these are merged into the winner.

What is left of a group is its winner and its size. Rows find their group again by the digest
alone where one text has it, which step 3 has established, and by digest and text where several do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _winners(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    """d (digest), t (text), k (largest id), n (rows): a row for each text."""
    rows = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(id_col).cast("long").alias("k"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("s"),
    )
    rows = rows.select("*", digest(F.col("t")).alias("d"), F.lit(1).cast("long").alias("n"))

    def merge(df: DataFrame, *keys: str) -> DataFrame:
        # every buffer has a fixed width, so that groups are hashed, never sorted by their texts
        return df.groupBy(*keys).agg(F.max("k").alias("k"), F.sum("n").alias("n"))

    return merge(merge(rows, "d", "s", "t"), "d", "t")


def _told_apart(winners: DataFrame, rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(groups: d, t, k, n, times; rows with t): t is null where the digest tells texts apart, which all but always it does.

    ``rows`` has the columns i, d and t. ``times`` counts the rows that repeat both the text and the id of the winner.
    """
    groups = scratch.cut(winners.select("d", "k", "n"), "groups")
    shared = scratch.cut(groups.groupBy("d").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("d"), "shared")
    if not shared.isEmpty():
        rows = rows.join(shared.withColumn("c", F.lit(True)), "d", "left").withColumn("t", F.when(F.col("c"), F.col("t"))).drop("c")
        groups = winners.join(shared.withColumn("c", F.lit(True)), "d", "left").withColumn("t", F.when(F.col("c"), F.col("t"))).drop("c")
    else:
        rows, groups = rows.withColumn("t", F.lit(None).cast("string")), groups.withColumn("t", F.lit(None).cast("string"))
    repeated = rows.groupBy("d", "t", "i").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    repeated = scratch.cut(repeated.select(F.col("d").alias("d_"), F.col("t").alias("t_"), "i", "times"), "repeated")
    same = F.col("d").eqNullSafe(F.col("d_")) & F.col("t").eqNullSafe(F.col("t_")) & F.col("k").eqNullSafe(F.col("i"))
    groups = groups.join(repeated, same, "left").select("d", "t", "k", "n", F.coalesce("times", F.lit(1)).alias("times"))
    return scratch.cut(groups, "winners"), rows


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the columns of their group; the text is part of the key only where the digest does not do."""
    told = groups.withColumnRenamed("d", "d_").withColumnRenamed("t", "t_")
    return rows.join(told, (F.col("d") == F.col("d_")) & F.col("t").eqNullSafe(F.col("t_"))).drop("d_", "t_")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256, salts: int = SALTS,
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_digest.

    Null texts count as empty ones. Of equal texts the row with the largest id is kept; null ids
    are smallest, and of rows that repeat both text and id exactly one is kept. Very long texts are
    compared whole. Other columns play no part, whatever their names. An empty table gives an empty
    one. Rows are known by their id and text alone, so it does not matter how files are split.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("i"), digest(text).alias("d"), text.alias("t"))
    groups, rows = _told_apart(_winners(docs, id_col, text_col, digest, salts), rows, scratch)
    found = _joined(rows, groups).where(~(F.col("i").eqNullSafe(F.col("k")) & (F.col("times") > 1)))
    found = found.select("i", "k", "n", F.col("i").eqNullSafe(F.col("k")).alias("kept"), "d")
    # rows that repeat text and id of a winner are alike: as many come back, the first of them kept
    again = groups.where("times > 1").select(F.col("k").cast(docs.schema[id_col].dataType).alias("i"), "k", "n", "d", F.posexplode(F.sequence(F.lit(1).cast("long"), "times")))
    found = found.unionByName(again.select("i", "k", "n", (F.col("pos") == 0).alias("kept"), "d"))
    return found.select(F.col("i").alias(id_col), F.col("k").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("d").alias("text_digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, whole and with their columns, whatever their names.

    Nulls, long texts, ties and empty tables as there; of rows that repeat both text and id the first
    by the row written as JSON stays.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("i"), digest(text).alias("d"), text.alias("t")
    )
    groups, rows = _told_apart(_winners(docs, id_col, text_col, digest, salts), rows, scratch)
    kept = _joined(rows, groups.where("times = 1")).where("i <=> k").select("row")
    repeated = groups.where("times > 1")
    if not repeated.isEmpty():
        again = _joined(rows, repeated).where("i <=> k").groupBy("d", "t").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.unionByName(again.select("row"))
    return kept.select("row.*")
