"""What the operators share: the word pattern, the shared folder, tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space. Java, RE2 and Python read the pattern alike.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset, as in tests on one
    machine, the checkpoint folder of the context takes its place, a temporary one if need be.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fathomlake-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


class Scratch:
    """Tables in the shared folder, each written once: they cut lineage and survive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/fathomlake/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def cut(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """``df`` written as Parquet and read again. Spark deletes the shuffle files of the write at its end."""
        path = self.path(name)
        writer = df.write.option("compression", "zstd")
        with _shuffles_deleted(self.spark):
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def free(self, *tables: DataFrame) -> None:
        """Delete the files of tables that :meth:`cut` made and that nothing reads any more."""
        for table in tables:
            self._delete(table._scratch_path)

    def clear(self) -> None:
        """Delete all tables."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _shuffles_deleted(spark: SparkSession):
    """Executions in the block delete their shuffle files when they end; inside they are kept for retries."""
    return _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def filtered_early(spark: SparkSession):
    """Joins planned in the block may drop rows before the shuffle by Spark's Bloom filter of the other side's keys.

    Spark bounds the filter itself and goes without one beyond that; by default it asks for a scan of 10 GB.
    """
    return _held(spark, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable, so that it is computed once.

    An expression that a lambda refers to from outside is computed again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
