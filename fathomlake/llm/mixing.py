"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected to appear ``target / size of the source`` times. In a fixed
order of the source's documents, the expected copies are summed up, one random offset per source
is added, and a document is emitted once for every whole number that its step of the sum crosses.
The order is by size, roughly, and random among documents of like size: each stretch of sizes is
then sampled at the same rate, and what is taken stays near the target.

The sum needs a document's rank only. Ranks are found in parts: documents are dealt into many
small buckets that follow the order, the buckets' counts are summed up (a small table), and
documents are ranked within their bucket. No source, however large, meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS = (3, 1, 2)
#: Per cent of all sizes that the mix shares out.
SHARE = 150
#: No target exceeds this many times its source's size.
MOST = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """Per source of ``sizes`` (source, source_size): weight, target.

    Weights repeat over the sources in code point order, null last. Sources share ``share`` per
    cent of all sizes by weight. A target stops at ``most`` times its source's size; the excess is
    shared again by weight until none is above. That fixed point is reached by closing sources in
    the order of size per weight, which one pass over the (few) sources does.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    closing = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, whole = closing.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.col("all") * share / 100.0 - most * F.coalesce(F.col("closed"), F.lit(0))) / F.col("open")
    return (
        sizes.withColumn("weight", weight.cast("long"))
        .select("*", F.sum("source_size").over(whole).alias("all"), F.sum("weight").over(whole).alias("w"),
                F.sum("source_size").over(before).alias("closed"), F.sum("weight").over(before).alias("shut"))
        .withColumn("open", F.col("w") - F.coalesce(F.col("shut"), F.lit(0)))
        .withColumn("level", level)
        # the first source that stays open sets the level for itself and all after it
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < most * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), F.col("level").alias("l")))).over(whole)["l"])
        .select("source", "source_size", "weight",
                F.coalesce(F.least(F.col("level") * F.col("weight"), (most * F.col("source_size")).cast("double")), (most * F.col("source_size")).cast("double")).alias("target"))
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
    weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """The columns of ``docs`` with size, source_size, target, copies and taken.

    ``size`` is a document's size, its words by default. A null text has size 0, a null source is
    a source of its own, documents without size are never taken. Null ids come last among their
    like. Rows that repeat id, source and size are interchangeable, so which of them is taken does
    not matter; reruns agree. Very long texts are counted whole. An empty table gives an empty one;
    input columns named like a result are replaced (:func:`mixed_rows` returns them as they are).
    """
    results = ("size", "source_size", "target", "copies", "taken")
    names = [c for c in docs.columns if c.lower() not in results]
    size = word_count(F.col("text")) if size is None else size
    digits = F.col("__size").cast("string")
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("__id").cast("string"), F.lit("~"))))
    # the columns of docs go along as one, so that no name of theirs can clash
    sized = (
        docs.select(
            F.struct(F.lit(0), *(F.col(f"`{c}`") for c in names)).alias("__row"), size.alias("__size"), F.col(id_col).alias("__id"), F.col(source_col).alias("__source")
        )
        .withColumn("__src", F.when(F.col("__source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("__source"))))
        # sizes with the same number of digits and the same two leading ones are like sizes
        .withColumn("__class", F.length(digits) * 100 + F.substring(F.rpad(digits, 2, "0"), 1, 2).cast("int"))
        .withColumn("__mark", mark)
        .withColumn("__salt", F.substring("__mark", 1, 2))
        .drop("__id", "__source")
    )
    bucket = ["__src", "__class", "__salt"]
    counted = Scratch(docs.sparkSession, "mix").cut(
        sized.groupBy(*bucket).agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__sum")), "buckets"
    )
    name = F.when(F.col("__src").startswith("s"), F.expr("substring(__src, 2)"))
    sources = counted.groupBy("__src").agg(F.sum("__sum").alias("source_size")).select(name.alias("source"), "source_size")
    aims = targets(sources, weights, share, most)
    aims = aims.select(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("__src"), "source_size", "target")
    before = Window.partitionBy("__src").orderBy("__class", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(*bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")).join(aims, "__src")
    rank = F.col("__start") + F.row_number().over(Window.partitionBy(*bucket).orderBy("__mark", "__size"))
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("__src"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.try_divide("target", "source_size")
    copies = F.least(F.floor(offset + rate * F.col("__rank")) - F.floor(offset + rate * (F.col("__rank") - 1)), F.lit(most).cast("long"))
    return (
        sized.join(starts, bucket)
        .withColumn("__rank", rank)
        .withColumn("__copies", F.when(F.col("__size") > 0, copies).otherwise(0).cast("long"))
        .select(*(F.col(f"__row.`{c}`") for c in names), F.col("__size").alias("size"), "source_size", "target",
                F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"))
    )


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of each document of :func:`mix`, once per copy."""
    rows = mixed.where("copies > 0").select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), "copies")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it, with their columns as they are, whatever their names."""
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"),
    )
    return emit(mix(whole, **how), ["row"]).select("row.*")
